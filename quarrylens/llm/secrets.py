"""Secrets by assignment-aware lexing.

Beside the plain patterns, a text that names a sensitive target at all is read as source or
configuration: a small lexer yields names, literals, operators and line ends; assignments become pairs
of a name and an expression of literals and names joined by ``+``, ``.`` or ``..``; names bound to
constants are propagated to later uses; and the literals that reach a target are scored by the target's
name and their own shape. Lines of configuration bind values without quotes too. Literals at or over the threshold are spans of kind ``literal``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_NEEDS = ("passw", "secret", "token", "key")
RANKS = {"assign": 0, "access": 1, "hex": 2, "literal": 3}
#: Parts of a target's name and how strongly each speaks for a secret.
SENSITIVE = {"password": 0.6, "passwd": 0.6, "passphrase": 0.6, "pwd": 0.5, "secret": 0.6, "token": 0.5, "apikey": 0.6, "api_key": 0.6, "credential": 0.5, "private_key": 0.6, "privatekey": 0.6, "auth": 0.3, "signing_key": 0.5, "client_secret": 0.6, "access_key": 0.6, "connection_string": 0.5}
#: Whole literals that stand for a secret without being one.
PLACEHOLDERS = {"changeme", "password", "secret", "token", "none", "null", "true", "false", "example", "todo", "xxx", "your-token", "undefined", "test"}
QUOTED = {'"': r'"(?:[^"\\\n]|\\.)*+"', "'": r"'(?:[^'\\\n]|\\.)*+'", "`": r"`[^`\n]*+`"}
LEXEME = (
    r"(?P<skip>(?://|\#)[^\n]*|[ \t\r]+)|(?P<line>[\n;,{}])|(?P<text>TEXT)"
    r"|(?P<name>[A-Za-z_$][\w$]*+(?:[.-][A-Za-z_$][\w$]*+)*+)|(?P<bind>:=|=>|={1,3}|!=|[:])|(?P<join>\+|\.\.)|(?P<other>.)"
)
#: A line of configuration whose value has no quotes.
BARE = re.compile(r"""^[ \t]*(?:(?:export|set|-)[ \t]+)?([A-Za-z_][\w.-]*+)[ \t]*(?::=|[:=])[ \t]*([^\s"'`,;{}()\[\]<>$\#]{6,})[ \t]*(?:\#.*)?\r?$""", re.ASCII | re.MULTILINE)
#: Least score of a literal that is reported.
THRESHOLD = 0.7
Span = tuple[int, int, int, str]


class Literal(NamedTuple):
    value: str
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """(start, rank, end, kind) of the base kinds; a match that fails its length is dropped, not tried again."""
    out = []
    if any(w in text.lower() for w in ASSIGN_NEEDS):
        out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return out


@cache
def lexer(without: str) -> re.Pattern:
    """The lexemes, where the quotes ``without`` open nothing."""
    return re.compile(LEXEME.replace("TEXT", "|".join(p for q, p in QUOTED.items() if q not in without) or r"(?!)"), re.ASCII)


def lexemes(text: str) -> Iterator[re.Match]:
    """The lexemes of a text, in linear time: a quote that is not closed on its line leaves later ones there unclosed too."""
    at, open_quotes = 0, ""
    while at < len(text):
        for m in lexer(open_quotes).finditer(text, at):
            at = m.end()
            yield m
            if m.lastgroup == "other" and m[0] in QUOTED and m[0] not in open_quotes:
                open_quotes = "".join(sorted(open_quotes + m[0]))
                break
            if open_quotes and m[0] == "\n":
                open_quotes = ""
                break


def assignments(text: str) -> Iterator[tuple[str, list[str | Literal]]]:
    """(target, expression) of each assignment or key-value pair; an expression is literals and names in order."""
    target, expr, state, last, by = None, [], "start", None, ""
    for m in lexemes(text):
        kind = m.lastgroup
        if kind == "skip":
            continue
        if kind == "bind":
            op = m[0]
            if op == "=" and by == ":" and state == "value" and expr == [last] and isinstance(last, str):
                expr, state, by = [], "need", op  # what stood after the colon was the target's type
            elif op in ("=", ":", ":=", "=>") and last is not None and state in ("start", "value"):
                if state == "value" and target is not None and len(expr) > 0 and expr[-1] == last:
                    expr.pop()
                    if expr:
                        yield target, expr
                target, expr, state, by = (last if isinstance(last, str) else last.value), [], "need", op
            else:
                target, expr, state, last = None, [], "start", None
            continue
        if kind in ("line", "other"):
            if kind == "line" and state == "need" and m[0] == "\n" and target is not None:
                state = "start"
                target = None
            if target is not None and expr:
                yield target, expr
            target, expr, state, last = None, [], "start", None
            continue
        if kind == "join":
            if state == "value":
                state = "need"
            continue
        word: str | Literal = Literal(m[0][1:-1], m.start() + 1, m.end() - 1) if kind == "text" else m[0]
        if state == "need":
            expr.append(word)
            state = "value"
        elif state == "value":
            if target is not None and expr:
                yield target, expr
            target, expr, state = None, [], "start"
        last = word
    if target is not None and expr:
        yield target, expr


class Value:
    """An expression's literals in order, as shared parts, with what scoring needs of their joined text.

    Parts are literals and other values, never copied, so that repeated joining does not grow; ``head`` is
    the text's beginning, all of it where it is no longer than ``HEAD``.
    """

    HEAD = 64
    __slots__ = ("counts", "head", "length", "parts")

    def __init__(self, parts: list[Literal | Value]):
        self.parts, self.length, self.head, self.counts = parts, 0, "", Counter()
        for p in parts:
            text = p.value if isinstance(p, Literal) else p.head
            self.length += len(text) if isinstance(p, Literal) else p.length
            self.head = (self.head + text[: self.HEAD])[: self.HEAD]
            self.counts.update(text if isinstance(p, Literal) else p.counts)
        if self.length > 1 << 60:  # longer than any text, by doubling: shares are all that counts
            self.counts = Counter({c: n >> 30 or 1 for c, n in self.counts.items()})
            self.length = sum(self.counts.values())


def entropy(counts: Counter) -> float:
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


def score(target: str, value: Value) -> float:
    """How likely ``value`` is a secret, given the name it is bound to (0 to 1)."""
    name = target.lower()
    told = max((w for part, w in SENSITIVE.items() if part in name), default=0.0)
    n, head = value.length, value.head
    if not told or n < 6 or (n <= Value.HEAD and head.lower() in PLACEHOLDERS) or head.startswith(("${", "$(", "<", "{{", "%(")):
        return 0.0
    shape = 0.1 * (n >= 12) + 0.1 * (n >= 20) + 0.1 * any(c.isdigit() for c in value.counts) + 0.1 * (entropy(value.counts) >= 3.0)
    return max(0.0, min(1.0, told + shape - 0.3 * (" " in value.counts)))


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Spans of literals that reach a sensitive target, directly or through constants bound before."""
    low = text.lower()
    if not any(part in low for part in SENSITIVE):
        return []
    bound: dict[str, Value] = {}  # by the whole name
    last: dict[str, Value] = {}  # by its last part, for names that are not bound as a whole
    out: set[Span] = set()
    seen: dict[int, Value] = {}  # values whose literals are in ``out``
    for target, expr in assignments(text):
        parts = [bound.get(x, last.get(x.rsplit(".", 1)[-1])) if isinstance(x, str) else x for x in expr]
        value = Value([p for p in parts if p is not None])
        bound[target] = last[target.rsplit(".", 1)[-1]] = value
        if score(target, value) >= threshold:
            todo = [value]
            while todo:
                v = todo.pop()
                if id(v) not in seen:
                    seen[id(v)] = v
                    out |= {(p.start, 3, p.end, "literal") for p in v.parts if isinstance(p, Literal) and p.end > p.start}
                    todo += [p for p in v.parts if isinstance(p, Value)]
    for m in BARE.finditer(text):
        # a value without quotes may be a name: it counts if nothing is bound to it and it holds a digit
        if m[2] not in bound and any(c.isdigit() for c in m[2]) and score(m[1], Value([Literal(m[2], m.start(2), m.end(2))])) >= threshold:
            out.add((m.start(2), 3, m.end(2), "literal"))
    return sorted(out)


def scan(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of one whole text, by start and then kind."""
    text = text or ""
    return sorted(base_spans(text) + literal_spans(text, threshold))


def told(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: id and ``found``, an array of (kind, start, end), in code points, end exclusive.

    Null and empty texts have none. Rows are independent, so null ids, ties and repeated rows keep a row
    each; an empty table gives no rows; further columns, whatever their names, are ignored. Very long texts
    and lines are read as a whole, in linear time. No shuffle; memory is one batch of texts.
    """
    src = df.select(F.col(f"`{id_col}`"), text_of(f"`{text}`").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e} for s, _, e, k in scan(t.as_py(), threshold)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=[b.schema.names[0], "found"])

    return src.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, found array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ``find_secrets``'s rows."""
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        F.col(f"`{id_col}`"), count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter("found", lambda s: s["kind"] != "literal")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"), count("literal"),
    )
