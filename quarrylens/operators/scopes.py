"""Snapping line ranges to Python scopes, and the filter that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import parse_range


def snap_ranges(scopes: DataFrame, start: int, end: int) -> DataFrame:
    """(path, start, end, reason): the range that whole scopes make of ``start``-``end`` in each file.

    A start outside all scopes jumps to the next one; inside a function the range becomes that function; an end
    beyond it is clipped; in a class with the end in a method it goes to the class's end. Of scopes that hold a line
    the last in the file counts. One aggregate a file: lookups are conditional extremes, not joins.
    """
    s = scopes.select("path", F.struct("name", "kind", "start", "end").alias("s"), "start", "end")
    holds = lambda line: (F.col("start") <= line) & (F.col("end") >= line)
    got = s.groupBy("path").agg(
        F.max_by("s", F.when(holds(start), F.col("start"))).alias("a"),
        F.max_by("s", F.when(holds(end), F.col("start"))).alias("b"),
        F.min_by("s", F.when(F.col("start") > start, F.col("start"))).alias("next"),
    )
    plain = F.struct(F.lit(start).cast("bigint").alias("start"), F.lit(end).cast("bigint").alias("end"), F.lit("").alias("reason"))
    of = lambda first, last, why: F.struct(first.cast("bigint").alias("start"), last.cast("bigint").alias("end"), F.lit(why).alias("reason"))
    fixed = (
        F.when(F.col("a").isNull() & F.col("next").isNotNull(), of(F.col("next.start"), F.col("next.end"), "next scope"))
        .when(F.col("a").isNull() & F.col("b").isNotNull(), of(F.lit(start), F.col("b.end"), "end inside scope"))
        .when(F.col("a").isNull(), plain)
        .when((F.col("a.kind") == "function") & (F.col("a.start") != start), of(F.col("a.start"), F.col("a.end"), "whole function"))
        .when((F.col("a.kind") == "function") & (F.col("a.end") < end), of(F.lit(start), F.col("a.end"), "clipped"))
        .when((F.col("a.kind") == "class") & (F.col("b.kind") == "function") & (F.col("a.start") != F.col("b.start")), of(F.lit(start), F.col("a.end"), "class end"))
        .otherwise(plain)
    )
    return got.select("path", fixed.alias("x")).select("path", "x.*")


def functions_in_range(functions: DataFrame, scopes: DataFrame, spec: str) -> DataFrame:
    """Functions that lie in the snapped range of their file."""
    start, end = parse_range(spec)
    snapped = snap_ranges(scopes, start, end if end is not None else 2**31 - 1).select("path", F.col("start").alias("a"), F.col("end").alias("b"))
    return functions.join(snapped, "path").where((F.col("start") >= F.col("a")) & (F.col("end") <= F.col("b"))).drop("a", "b")
