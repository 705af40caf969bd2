"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the output over its share of the input. A
document's count is the inverse of the Poisson distribution at a uniform number hashed from the seed
and the document, so it does not depend on how rows are dealt and needs no state. Documents are then
exploded by their counts and put in a global random order. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, text_of

#: Sources whose rates are broadcast at most; with more, rates are joined by an exchange.
BROADCAST_SOURCES = 100_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 sum, the same on every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_count(u: Column, mean: Column) -> Column:
    """The least n with P(X <= n) > u for X Poisson with ``mean``; 0 for a mean that is null or not positive.

    Terms are summed in log space up to mean + 12 sqrt(mean) + 40, beyond which less than 2^-52 is left.
    """
    mean = F.greatest(F.coalesce(mean, F.lit(0.0)), F.lit(0.0))
    most = F.floor(mean + F.sqrt(mean) * 12 + 40).cast("int")
    # u and the logarithm travel in the accumulator: a column inside a lambda is evaluated anew at each step
    start = F.struct(u.alias("u"), F.log(mean).alias("log_mean"), F.lit(0).alias("n"), (-mean).alias("log_p"), F.exp(-mean).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        log_p = s["log_p"] + s["log_mean"] - F.log(k.cast("double"))
        more = F.struct(s["u"].alias("u"), s["log_mean"].alias("log_mean"), (s["n"] + 1).alias("n"), log_p.alias("log_p"), (s["cdf"] + F.exp(log_p)).alias("cdf"))
        return F.when(s["cdf"] > s["u"], s).otherwise(more)

    return F.when(mean <= 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["n"]))


def source_rates(df: DataFrame, source: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, budget: float = 1.0) -> DataFrame:
    """(source, n, rate): documents of each source and the mean count of each of them.

    Target weights are ``weights`` (missing sources: 0) or the input shares to ``power``, scaled to sum 1;
    the output has ``budget`` times the input's documents in the mean.
    """
    sizes = df.select(F.col(f"`{source}`").alias("__source")).groupBy("__source").agg(F.count("*").alias("n"))
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("__source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(w)
    sizes = cut(sizes.withColumn("w", w))
    total = sizes.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    if not total.n or not total.w:
        return sizes.select("__source", "n", F.lit(0.0).alias("rate"))
    return sizes.select("__source", "n", (F.col("w") * F.lit(budget * total.n) / F.lit(float(total.w)) / F.col("n")).alias("rate"))


def mix(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: dict[str, float] | None = None, power: float = 0.5, budget: float = 1.0, seed: int = 7) -> DataFrame:
    """``df`` with each row repeated by its count, in a global random order.

    Added columns: ``n_copies`` (the row's count), ``replica`` (0 to n_copies - 1) and ``shuffle_key`` (the
    place in the order, in [0, 1)). Rows are told apart by (id, MD5 of the text): repeated rows and null ids
    with equal texts share their count and keys. A null source is a source of its own. Rows with count 0
    do not appear. An empty table gives no rows. Columns of ``df`` with the added names are replaced.
    """
    rows = df.drop("n_copies", "replica", "shuffle_key")
    rates = cut(source_rates(rows, source, weights, power, budget))
    few = rates.count() <= BROADCAST_SOURCES
    digest, name, rate = scratch(rows, "__digest"), scratch(rows, "__source"), scratch(rows, "__rate")
    side = rates.select(F.col("__source").alias(name), F.col("rate").alias(rate))
    side = F.broadcast(side) if few else side
    ident = F.col(f"`{id_col}`")
    counted = (
        rows.join(side, rows[source].eqNullSafe(side[name]), "inner" if few else "left")
        .withColumn(digest, F.md5(text_of(f"`{text}`").cast("binary")))
        .withColumn("n_copies", poisson_count(uniform(seed, ident, F.col(digest)), F.col(rate)))
        .where("n_copies > 0")
    )
    copies = counted.withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    copies = copies.withColumn("shuffle_key", uniform(seed + 1, ident, F.col(digest), F.col("replica")))
    # keys are uniform, so equal ranges of them are equal parts: no sampling pass
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = scratch(copies, "__place")
    dealt = copies.withColumn(place, F.floor(F.col("shuffle_key") * parts).cast("int")).repartitionById(parts, F.col(place))
    ordered = dealt.sortWithinPartitions("shuffle_key", digest)
    return ordered.select(*[f"`{c}`" for c in rows.columns], "n_copies", "replica", "shuffle_key")
