"""Reading source trees: files with their language, ignore rules, module files and manifests."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, extension
from ..languages import PROFILES, by_extension

MANIFEST = "version string, root_dir string, split_by string, shards array<struct<path:string,files:bigint,total_functions:bigint,total_classes:bigint,checksum:string,depends_on:array<string>>>, total_files bigint, total_functions bigint, total_classes bigint"


def language_of(path: Column) -> Column:
    """The language of a path by its extension, null if unknown; .h is C."""
    table = {e: by_extension(e) for p in PROFILES.values() for e in p.extensions}
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[extension(path)]


def ignore_patterns(text: str, strict: bool = False) -> list[tuple[str, bool, bool]]:
    """(regular expression, folders only, negated) of an ignore file's lines.

    Not ``strict``: text from ``#`` on is cut anywhere in a line, ``!`` lines are dropped and ``*`` is left as a
    repeat of what stands before it. ``strict``: comments start a line, ``!`` takes back, ``*``, ``**`` and ``?`` are globs.
    """
    out = []
    for line in text.split("\n"):
        line = line.strip() if not strict else line.rstrip()
        line = line.split("#", 1)[0].strip() if not strict else ("" if line.startswith("#") else line)
        if not line or line.startswith("!") and not strict:
            continue
        negated = line.startswith("!")
        line = line.removeprefix("!")
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = line.startswith("/") or strict and "/" in line
        line = line.lstrip("/")
        if strict:
            glob = "".join(".*" if t == "**" else "[^/]*" if t == "*" else "[^/]" if t == "?" else re.escape(t) for t in re.split(r"(\*\*|\*|\?)", line))
            body = glob.replace(".*/", "(?:.*/)?")
        else:
            # only some characters are quoted; a star stays a star
            body = "".join("." if c == "?" else c if c == "*" else re.escape(c) for c in line)
        expr = f"^{body}($|/)" if anchored and strict else f"^{body}$" if anchored else f"(^|/){body}($|/)"
        try:
            re.compile(expr)
        except re.error:
            continue  # such a pattern is skipped
        if "**" in body and not strict:
            continue
        out.append((expr, folder, negated))
    return out


def is_ignored(path: Column, patterns: list[tuple[str, bool, bool]], is_dir: Column | None = None) -> Column:
    """Whether a path or one of its folders matches; a rule for folders does not match a file of that name."""
    isdir = F.lit(False) if is_dir is None else is_dir
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    hit = F.lit(False)
    for expr, only_folders, negated in patterns:
        m = folder.rlike(expr) | (isdir & path.rlike(expr)) if only_folders else path.rlike(expr)
        hit = hit & ~m if negated else hit | m
    return hit


def select_files(files: DataFrame, lang: str | None = None, recursive: bool = True, ignore: str = "", strict: bool = False, known_only: bool = True) -> DataFrame:
    """The files of a scan: no hidden parts of the path, no ignored ones, known languages or one language.

    ``lang`` keeps that language's extensions only; ``known_only`` False keeps every file.
    """
    path = F.col("path")
    out = files.where(~path.rlike(r"(^|/)\.(?!gitignore$)[^/]"))
    if not recursive:
        out = out.where(~path.contains("/"))
    rules = ignore_patterns(ignore, strict)
    if rules:
        out = out.where(~is_ignored(path, rules))
    out = out.withColumns({"ext": extension(path), "lang": F.lit(lang) if lang else language_of(path)})
    if lang:
        return out.where(F.col("ext").isin(*PROFILES[lang].extensions))
    return out.where("lang is not null") if known_only else out


def _ignored(path: str, patterns: list[tuple[str, bool, bool]]) -> bool:
    """``is_ignored`` for one folder."""
    hit = False
    for expr, _, negated in patterns:
        if re.search(expr, path):
            hit = not negated
    return hit


def list_files(root: str, recursive: bool = True, rules: list[tuple[str, bool, bool]] | None = None) -> list[tuple[str, int]]:
    """(path below root, size) of a tree; hidden and ignored folders are not entered. A folder is listed at a time."""
    fs, base = FileSystem.from_uri(root) if re.match(r"[a-z0-9]+:", root) else (LocalFileSystem(), root)
    base = base.rstrip("/")
    # with a rule that takes back, a file below an ignored folder may count after all
    prune = rules if rules and not any(negated for *_, negated in rules) else []
    found, todo = [], [base]
    while todo:
        for info in fs.get_file_info(FileSelector(todo.pop())):
            path = info.path[len(base) + 1 :]
            if info.type == FileType.Directory:
                if recursive and not info.base_name.startswith(".") and not _ignored(path, prune):
                    todo.append(info.path)
            elif info.type == FileType.File:
                found.append((path, info.size))
    return sorted(found)


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root) if re.match(r"[a-z0-9]+:", root) else (LocalFileSystem(), root)
        for b in batches:
            for i, path in enumerate(b.column(0).to_pylist()):
                with fs.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                    raw = f.read()
                try:
                    text, error = raw.decode("utf-8"), None
                except UnicodeDecodeError as e:
                    text, error = raw.decode("utf-8", "replace"), f"byte {e.start} is not UTF-8"
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([text], pa.string()), pa.array([error], pa.string())], names=[*row.schema.names, "content", "error"])

    return run


def scan(spark: SparkSession, root: str, lang: str | None = None, recursive: bool = True, use_ignore: bool = True, strict: bool = False, known_only: bool = True, part_bytes: int = 32 << 20) -> DataFrame:
    """(path, content, ext, lang, error) of a source tree; paths are relative to ``root``, a path or URI that all executors can read.

    The driver lists names and sizes without entering hidden or ignored folders; files are chosen by their names, dealt out by
    size, and only chosen files are opened, on executors. Bytes that are not UTF-8 are replaced and named in ``error``. ``known_only`` False
    keeps files of every kind.
    """
    rules = ""
    if use_ignore:
        top = [p for p, _ in list_files(root, recursive=False) if p == ".gitignore"]
        if top:
            rules = read_text(f"{root.rstrip('/')}/.gitignore")
    listed = list_files(root, recursive, ignore_patterns(rules, strict))
    total = sum(n for _, n in listed)
    parts = max(1, min(len(listed), max(spark.sparkContext.defaultParallelism, -(-total // part_bytes))))
    names = spark.createDataFrame([p for p, _ in listed], "string").toDF("path")
    chosen = select_files(names, lang, recursive, rules, strict, known_only).select("path", "ext", "lang")
    read = chosen.repartition(parts).mapInArrow(_reader(root), "path string, ext string, lang string, content string, error string")
    return read.select("path", "content", "ext", "lang", "error")


def read_text(path: str) -> str:
    fs, at = FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (LocalFileSystem(), path)
    with fs.open_input_stream(at) as f:
        return f.read().decode("utf-8", "replace")


def module_prefix(files: DataFrame) -> str:
    """The module of the root's go.mod; empty if there is none."""
    row = files.where(F.col("path") == "go.mod").select(F.regexp_extract("content", r"(?m)^\s*module\s+(\S+)", 1).alias("m")).first()
    return row.m if row else ""


def ts_aliases(files: DataFrame) -> dict[str, str]:
    """Path aliases of tsconfig.json at the root, tsconfig.base.json, or one folder below: prefix -> folder."""
    rows = files.where(base_name(F.col("path")).isin("tsconfig.json", "tsconfig.base.json") & (F.size(F.split("path", "/")) <= 2)).select("path", "content").collect()
    ranked = sorted(rows, key=lambda r: (r.path.count("/"), not r.path.endswith("tsconfig.json"), r.path))
    return next((a for r in ranked if (a := parse_ts_paths(r.content or ""))), {})


def parse_ts_paths(text: str) -> dict[str, str]:
    """The ``paths`` of a tsconfig: the first target of each, stars and ``./`` cut, ending in a slash."""
    block = re.search(r'"paths"\s*:\s*\{(.*?)\}', text, re.DOTALL)
    found = re.findall(r'"([^"]+)"\s*:\s*\[\s*"([^"]+)"', block[1]) if block else []
    slash = lambda x: x if x.endswith("/") else x + "/"
    return {slash(k.rstrip("*")): slash(v.rstrip("*").removeprefix("./")) for k, v in found}


def tsconfig_above(spark: SparkSession, root: str, most: int = 8) -> str | None:
    """The nearest folder above ``root`` (not itself) with a tsconfig, looking up at most ``most`` times."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = fs.makeQualified(at).getParent()
    for _ in range(most):
        if at is None:
            return None
        if any(fs.exists(jvm.org.apache.hadoop.fs.Path(at, n)) for n in ("tsconfig.json", "tsconfig.base.json")):
            return at.toUri().getPath()
        at = at.getParent()
    return None


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's shards; a missing file is an error."""
    whole = spark.read.schema(MANIFEST).json(path, multiLine=True)
    return whole.select("version", "split_by", F.explode("shards").alias("s")).select("version", "split_by", F.col("s.path").alias("shard"), "s.files", "s.total_functions", "s.total_classes", "s.checksum", "s.depends_on")


def write_manifest(rows: DataFrame, path: str, root: str, split_by: str = "dir") -> None:
    """One JSON document; a row per shard, in shard order."""
    deps = F.col("depends_on") if "depends_on" in rows.columns else F.array().cast("array<string>")
    shard = F.struct(F.col("shard").alias("path"), "files", "total_functions", "total_classes", "checksum", deps.alias("depends_on"))
    total = [F.sum(c).alias(t) for c, t in (("files", "total_files"), ("total_functions", "total_functions"), ("total_classes", "total_classes"))]
    whole = rows.agg(F.array_sort(F.collect_list(shard)).alias("shards"), *total).select(F.lit("1.0").alias("version"), F.lit(root).alias("root_dir"), F.lit(split_by).alias("split_by"), "shards", "total_files", "total_functions", "total_classes")
    whole.coalesce(1).write.mode("overwrite").json(path)


def write_shards(maps: DataFrame, path: str) -> None:
    """One folder of JSON per shard: rows (shard, path, functions, classes)."""
    maps.repartition("shard").write.mode("overwrite").partitionBy("shard").json(path)


