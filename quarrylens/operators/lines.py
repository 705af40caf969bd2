"""Lines, line ranges and line classes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(files: DataFrame, text: str = "content", key: str = "path") -> DataFrame:
    """(key, line_no, raw): lines from 1 without their ends, no last empty line. No shuffle."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select(key, F.posexplode(parts).alias("pos", "raw")).select(key, (F.col("pos") + 1).cast("bigint").alias("line_no"), F.regexp_replace("raw", "\r\\z", "").alias("raw"))


def parse_range(text: str) -> tuple[int, int | None]:
    """``n``, ``a:b``, ``:b`` or ``a:`` as (start, end); no end means to the end of the file."""
    m = re.fullmatch(r"\s*(?:(\d+)|(\d*)\s*:\s*(\d*))\s*", text)
    if not m or not any(m.groups()):
        raise ValueError(f"not a line range: {text!r}")
    if m[1]:
        start = end = int(m[1])
    else:
        start, end = int(m[2] or 1), int(m[3]) if m[3] else None
    if start < 1 or end is not None and end < start:
        raise ValueError(f"not a line range: {text!r}")
    return start, end


def line_range(of: DataFrame, spec: str) -> DataFrame:
    """The lines of a range, with their own numbers."""
    start, end = parse_range(spec)
    return of.where(F.col("line_no") >= start if end is None else F.col("line_no").between(start, end))


def is_blank(raw: Column) -> Column:
    return raw.rlike(r"^\s*$")


def is_empty_or_comment(raw: Column, mark: str) -> Column:
    return is_blank(raw) | F.regexp_replace(raw, r"^\s+", "").startswith(mark)


def braces(clean: Column) -> Column:
    """Opening minus closing braces of a line."""
    bare = lambda c: F.length(clean) - F.length(F.replace(clean, F.lit(c), F.lit("")))
    return (bare("{") - bare("}")).cast("bigint")


def running_depth(of: DataFrame, text: str = "raw", key: str = "path") -> DataFrame:
    """Brace depth after each line, and before it."""
    w = Window.partitionBy(key).orderBy("line_no")
    d = of.withColumn("delta", braces(F.col(text)))
    d = d.withColumn("depth", F.sum("delta").over(w))
    return d.withColumn("before", F.coalesce(F.lag("depth").over(w), F.lit(0)))


def line_classes(clean_lines: DataFrame) -> DataFrame:
    """Per file: total, blank, comment and code lines. Blank is tested first; a line of nothing but comment and
    literals is a comment, and so is one that starts with ``#!``."""
    raw, clean = F.col("raw"), F.col("clean")
    kind = F.when(is_blank(raw), "blank").when(raw.rlike(r"^\s*#!") | is_blank(clean), "comment").otherwise("code")
    k = clean_lines.withColumn("class", kind)
    count = lambda c: F.count_if(F.col("class") == c)
    return k.groupBy("path").agg(F.count("*").alias("total_lines"), count("blank").alias("blank_lines"), count("comment").alias("comment_lines"), count("code").alias("code_lines"))


def partial_functions(functions: DataFrame, spec: str, total: DataFrame) -> DataFrame:
    """Functions that a line range cuts: (path, name, start, end, cut), cut is start, end or spans."""
    start, end = parse_range(spec)
    f = functions.join(total.select("path", F.col("total_lines").alias("n")), "path")
    last = F.col("n") if end is None else F.lit(end)
    cut = (
        F.when((F.col("start") < start) & F.col("end").between(F.lit(start), last), "start")
        .when(F.col("start").between(F.lit(start), last) & (F.col("end") > last), "end")
        .when((F.col("start") < start) & (F.col("end") > last), "spans")
    )
    return f.withColumn("cut", cut).where("cut is not null").select("path", "name", "start", "end", "cut")
