"""Scoring a map against known symbols, token savings, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens


def match_counts(truth: DataFrame, found: DataFrame, tolerance: int = 2) -> DataFrame:
    """(path, kind, name, truth, found, matched): greedy nearest pairing within ``tolerance`` lines, each used once.

    Groups are the symbols of one name in one file; only groups with several lines on both sides go through the greedy rule.
    """
    side = lambda d, truth: d.select("path", "kind", "name", F.lit(truth).alias("is_truth"), "line")
    return match_sides(side(truth, True).union(side(found, False)), tolerance)


def match_sides(sides: DataFrame, tolerance: int = 2) -> DataFrame:
    """``match_counts`` of one table (path, kind, name, is_truth, line) that holds both sides: one exchange."""
    of = lambda truth, c: F.array_sort(F.collect_list(F.when(F.col("is_truth") == truth, F.col("line")))).alias(c)
    both = sides.groupBy("path", "kind", "name").agg(of(True, "t"), of(False, "f"))
    near = F.exists("t", lambda a: F.exists("f", lambda b: F.abs(a - b) <= tolerance)).cast("bigint")
    matched = F.when((F.size("t") <= 1) | (F.size("f") <= 1), near).otherwise(_paired(F.col("t"), F.col("f"), tolerance))
    return both.select("path", "kind", "name", F.size("t").cast("bigint").alias("truth"), F.size("f").cast("bigint").alias("found"), matched.alias("matched"))


def _paired(truth: Column, found: Column, tolerance: int) -> Column:
    """``paired`` of two sorted arrays as an expression."""

    def step(state: Column, line: Column) -> Column:
        left = state["left"]
        best = F.array_min(F.transform(left, lambda x, i: F.struct(F.abs(x - line).alias("off"), x.alias("x"), i.alias("i"))))
        rest = F.concat(F.slice(left, F.lit(1), best["i"]), F.slice(left, best["i"] + 2, F.size(left)))
        hit = best["off"] <= tolerance
        return F.when(hit, F.struct(rest.alias("left"), (state["n"] + 1).alias("n"))).otherwise(state)

    return F.aggregate(truth, F.struct(found.alias("left"), F.lit(0).cast("bigint").alias("n")), step, lambda s: s["n"])


def paired(truth: list[int], found: list[int], tolerance: int) -> int:
    """How many of ``truth`` get a partner: each in turn takes the nearest that is left."""
    left, n = list(found), 0
    for line in truth:
        best = min(left, key=lambda x: (abs(x - line), x), default=None)
        if best is not None and abs(best - line) <= tolerance:
            left.remove(best)
            n += 1
    return n


def score(counts: DataFrame) -> DataFrame:
    """(truth, found, matched, recall, precision) over files that both sides have; 1 where there is nothing."""
    t = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("truth", "found", "matched")])
    share = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col("matched") / F.col(c))
    return t.withColumns({"recall": share("truth"), "precision": share("found")})


def file_overlap(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(path, side): both, only truth, or only found."""
    a = truth.select("path").distinct().withColumn("a", F.lit(1))
    b = found.select("path").distinct().withColumn("b", F.lit(1))
    return a.join(b, "path", "full_outer").select("path", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("b").isNull(), "truth").otherwise("found").alias("side"))


def token_savings(files: DataFrame, maps: DataFrame) -> DataFrame:
    """(raw_tokens, map_tokens, saving) of texts against their maps."""
    raw = files.agg(F.sum(tokens(F.coalesce("content", F.lit("")))).alias("raw_tokens"))
    own = maps.agg(F.sum(tokens(F.col("map"))).alias("map_tokens"))
    return raw.crossJoin(own).withColumn("saving", 1 - F.col("map_tokens") / F.col("raw_tokens"))  # one row each


def latency_percentiles(values: DataFrame, column: str = "value", accuracy: int = 10_000) -> DataFrame:
    """(n, p50, p99, most): the values at places n*50/100 and n*99/100 of the sorted list, counted from zero. Nulls do not count.

    Approximate percentiles bracket each place; values before the bracket are counted and only values inside are
    ordered, so the exact result needs no global sort. Two scalar passes; an empty table gives nulls.
    """
    v = values.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    slack = 2.0 / accuracy
    marks = [(q, max(0.0, q / 100 - slack), min(1.0, q / 100 + slack)) for q in (50, 99)]
    told = v.agg(F.count("*").alias("n"), F.max("v").alias("most"), F.percentile_approx("v", [x for _, a, b in marks for x in (a, b)], accuracy).alias("p")).first()
    places = []
    for k, (q, _, _) in enumerate(marks):
        if not told.n:
            places.append(None)
            continue
        low, high, place = told.p[2 * k], told.p[2 * k + 1], min(told.n - 1, told.n * q // 100)
        before = v.where(F.col("v") < low).count()
        inside = v.where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + before  # over the bracket's distinct values
        places.append(inside.select("v", upto.alias("upto")).where(F.col("upto") > place).agg(F.min("v")).first()[0])
    return values.sparkSession.createDataFrame([(told.n, *places, told.most)], f"n bigint, p50 {dict(v.dtypes)['v']}, p99 {dict(v.dtypes)['v']}, most {dict(v.dtypes)['v']}")
