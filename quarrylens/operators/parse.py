"""Files to symbols: one Arrow-batched pass over (path, lang, content).

Only this pass runs Python; it reads each file once and returns the relations that are asked for as
nested arrays, which Catalyst explodes. Files are independent and never shuffled. A line of over 64 KiB
makes the file's ``error``, unless ``strict``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fold
from ..languages import PROFILES, Profile

#: Relations a pass can return: name -> (fields, Arrow type, Spark type).
RELATIONS = {
    "functions": [("name", pa.string(), "string"), ("start", pa.int64(), "bigint"), ("end", pa.int64(), "bigint"), ("class_name", pa.string(), "string"), ("decorators", pa.list_(pa.string()), "array<string>")],
    "classes": [("name", pa.string(), "string"), ("start", pa.int64(), "bigint"), ("end", pa.int64(), "bigint")],
    "types": [("name", pa.string(), "string"), ("kind", pa.string(), "string"), ("start", pa.int64(), "bigint"), ("end", pa.int64(), "bigint")],
    "fields": [("type_name", pa.string(), "string"), ("name", pa.string(), "string"), ("type", pa.string(), "string"), ("line", pa.int64(), "bigint")],
    "calls": [("line", pa.int64(), "bigint"), ("receiver", pa.string(), "string"), ("name", pa.string(), "string")],
    "edges": [("caller", pa.string(), "string"), ("receiver", pa.string(), "string"), ("callee", pa.string(), "string"), ("line", pa.int64(), "bigint"), ("own", pa.bool_(), "boolean")],
    "symbols": [("kind", pa.string(), "string"), ("name", pa.string(), "string"), ("start", pa.int64(), "bigint"), ("end", pa.int64(), "bigint")],
    "call_names": [("name", pa.string(), "string"), ("count", pa.int64(), "bigint")],
    "clean_lines": [("line_no", pa.int64(), "bigint"), ("raw", pa.string(), "string"), ("clean", pa.string(), "string"), ("state", pa.string(), "string")],
    "scopes": [("name", pa.string(), "string"), ("kind", pa.string(), "string"), ("start", pa.int64(), "bigint"), ("end", pa.int64(), "bigint"), ("indent", pa.int64(), "bigint"), ("parent", pa.string(), "string")],
    "complexity": [("name", pa.string(), "string"), ("start", pa.int64(), "bigint"), ("end", pa.int64(), "bigint"), ("lines_of_code", pa.int64(), "bigint"), ("depth", pa.int64(), "bigint")],
    "signatures": [("name", pa.string(), "string"), ("start", pa.int64(), "bigint"), ("signature", pa.string(), "string")],
}


def _arrow(rel: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, t) for n, t, _ in RELATIONS[rel]]))


def _spark(rel: str) -> str:
    return f"{rel} array<struct<{','.join(f'`{n}`:{t}' for n, _, t in RELATIONS[rel])}>>"


def _nested(rel: str, offsets: list[int], rows: list[tuple]) -> pa.Array:
    """Rows as one list for each file, column by column."""
    flat = [pa.array([row[k] for row in rows], t) for k, (_, t, _) in enumerate(RELATIONS[rel])]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, names=[n for n, *_ in RELATIONS[rel]]))


_SANITIZERS: dict[tuple, tuple[Profile, fold.Sanitizer]] = {}


def sanitizer(p: Profile, use_raw: bool, strict: bool) -> fold.Sanitizer:
    """One for each profile; it holds no state of a file."""
    key = (id(p), use_raw, strict)
    if key not in _SANITIZERS or _SANITIZERS[key][0] is not p:
        _SANITIZERS[key] = p, fold.Sanitizer(p, use_raw, strict)
    return _SANITIZERS[key][1]


def parse_file(lang: str, content: str, want: tuple[str, ...], names: frozenset[str] | None = None, use_raw: bool = False, strict: bool = False, first: int = 1, profile: Profile | None = None) -> dict[str, list[tuple]]:
    """The wanted relations of one file, as tuples in the order of ``RELATIONS``. ``first`` is the first line's number."""
    p = profile or PROFILES[lang]
    raw = content.split("\n") if p.indent_based else fold.split_lines(content)
    out: dict[str, list[tuple]] = {}
    asked, brace = set(want), not p.indent_based
    clean, states = sanitizer(p, use_raw, strict).whole(raw, "clean_lines" in asked) if brace or {"calls", "clean_lines", "edges", "call_names"} & asked else ([], None)
    deltas = fold.depths(clean) if brace else []
    classes, found, own_types, sites = [], [], [], []
    if {"functions", "classes", "symbols"} & asked:
        classes = fold.classes(p, clean, strict, first, deltas) if brace else fold.python_types(raw, names) if {"classes", "symbols"} & asked else []
    if {"functions", "complexity", "signatures", "edges", "symbols"} & asked:
        found = fold.python_functions(p, raw, names) if p.indent_based else fold.functions(p, clean, classes, names, strict, first, deltas)
    if {"types", "fields", "symbols"} & asked:
        own_types = fold.types(p, raw, clean, names, first, deltas)
    if {"calls", "edges"} & asked:
        sites = fold.call_sites(clean, first)
    body = lambda f: raw[f.start - first : f.end - first + 1]
    for rel in want:
        if rel == "functions":
            out[rel] = [(f.name, f.start, f.end, f.class_name, f.decorators) for f in found]
        elif rel == "classes":
            out[rel] = [(c.name, c.start, c.end) for c in classes]
        elif rel == "types":
            out[rel] = [(t.name, t.kind, t.start, t.end) for t in own_types]
        elif rel == "fields":
            out[rel] = [(t.name, *f) for t in own_types for f in fold.fields(p, raw, t, first)]
        elif rel == "symbols":
            at = {(c.name, c.start) for c in classes}
            out[rel] = [("function", f.name, f.start, f.end) for f in found] + [("class", c.name, c.start, c.end) for c in classes]
            out[rel] += [(t.kind, t.name, t.start, t.end) for t in own_types if (t.name, t.start) not in at]
        elif rel == "calls":
            out[rel] = sites
        elif rel == "edges":
            out[rel] = fold.file_edges(found, sites)
        elif rel == "call_names":
            out[rel] = fold.call_names(p, clean)
        elif rel == "clean_lines":
            out[rel] = [(i, r, c, s) for i, (r, c, s) in enumerate(zip(raw, clean, states or repeat(fold.NORMAL), strict=states is not None), first)]
        elif rel == "scopes":
            out[rel] = fold.python_scopes(fold.split_lines(content))
        elif rel == "complexity":
            nest, flat = fold.nesting_patterns(lang)
            out[rel] = [(f.name, f.start, f.end, sum(map(fold.is_code, body(f))), fold.nesting(body(f), nest, flat)[0]) for f in found]
        elif rel == "signatures":
            out[rel] = [(f.name, f.start, fold.signature(body(f))) for f in found]
    return out


def parse(files: DataFrame, want: tuple[str, ...] = ("functions",), names: list[str] | None = None, use_raw: bool = False, strict: bool = False, lines: tuple[int, int] | None = None, profiles: dict[str, Profile] | None = None) -> DataFrame:
    """(path, lang, error, one array column per wanted relation). ``names`` restricts functions and types while
    reading, which decides what opens an interval, so it is not the same as a later filter. Null content is an
    empty file; files of unknown languages are left out.

    ``lines`` (first, last; -1: the end) reads those lines of each file only, as if they were the file, and counts from the
    first. ``profiles`` are further languages, or others in place of the known ones. ``errors`` tells what was not read.
    """
    rels = tuple(want)
    known = PROFILES | (profiles or {})
    first, upto = lines or (1, -1)
    chosen = frozenset(names) if names else None
    src = files.where(F.col("lang").isin(*known)).select("path", "lang", F.coalesce("content", F.lit("")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list] = {r: [] for r in rels}  # all files' rows
            upto_row: dict[str, list[int]] = {r: [0] for r in rels}
            errors = []
            for lang, content in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                text = content.as_py()
                if lines:
                    text = "\n".join(text.split("\n")[first - 1 : None if upto < 0 else upto])
                bad = 0 if strict or known[lang].indent_based or len(text) <= fold.LONGEST_LINE // 4 else fold.too_long(fold.split_lines(text))
                errors.append(f"line {bad} is too long" if bad else None)
                got = parse_file(lang, "" if bad else text, rels, chosen, use_raw, strict, first, known[lang])
                for r in rels:
                    found[r] += got[r]
                    upto_row[r].append(len(found[r]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(errors, pa.string()), *(_nested(r, upto_row[r], found[r]) for r in rels)], names=["path", "lang", "error", *rels])

    return src.mapInArrow(run, ", ".join(["path string, lang string, error string", *map(_spark, rels)]))


def errors(parsed: DataFrame) -> DataFrame:
    """(path, lang, error) of the files that were not read; their relations are empty."""
    return parsed.where("error is not null").select("path", "lang", "error")


def relation(parsed: DataFrame, rel: str) -> DataFrame:
    """One of the parsed relations as rows: path, lang and the relation's columns."""
    return parsed.select("path", "lang", F.explode(rel).alias("x")).select("path", "lang", "x.*")
