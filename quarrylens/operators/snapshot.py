"""Shards of a map, their checksums, and incremental change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import shard_key

VERSION = "1.0"


def shard_checksums(files: DataFrame, split_by: str = "dir") -> DataFrame:
    """(shard, files, checksum): SHA-256 over the shard's ``path:sum`` lines in path order; null content counts by path only.

    What meets in one row is a digest per file, not its text.
    """
    line = F.concat(F.col("path"), F.lit(":"), F.coalesce(F.sha2("content", 256), F.lit("")))
    keyed = files.select(shard_key(F.col("path"), split_by).alias("shard"), line.alias("line"))
    return keyed.groupBy("shard").agg(F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("checksum"))


def manifest(files: DataFrame, functions: DataFrame, types: DataFrame, split_by: str = "dir", keep_empty: bool = False) -> DataFrame:
    """(shard, files, total_functions, total_classes, checksum); files with symbols count, all feed the checksum.

    Shards without symbols are left out unless ``keep_empty``.
    """
    key = shard_key(F.col("path"), split_by).alias("shard")
    per = functions.groupBy("path").agg(F.count("*").alias("f")).join(types.groupBy("path").agg(F.count("*").alias("t")), "path", "full_outer")
    totals = per.groupBy(key).agg(F.count("*").alias("files"), F.sum(F.coalesce("f", F.lit(0))).alias("total_functions"), F.sum(F.coalesce("t", F.lit(0))).alias("total_classes"))
    sums = shard_checksums(files, split_by).select("shard", "checksum")
    out = sums.join(totals, "shard", "left" if keep_empty else "inner")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("shard", zero("files"), zero("total_functions"), zero("total_classes"), "checksum")


def changed_shards(old: DataFrame, new: DataFrame) -> DataFrame:
    """(shard, change): added, changed or removed between two checksum tables; equal ones are left out."""
    a, b = old.select("shard", F.col("checksum").alias("was")), new.select("shard", F.col("checksum").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, "shard", "full_outer").select("shard", change.alias("change")).where("change is not null")


def merge_manifest(old: DataFrame, updated: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Updated rows, and the others carried over. With ``present`` (shard), rows of shards that are gone are pruned."""
    kept = old.join(updated.select("shard"), "shard", "left_anti")
    if present is not None:
        kept = kept.join(present.select("shard").distinct(), "shard", "left_semi")
    return updated.unionByName(kept, allowMissingColumns=True)


def with_depends_on(manifest_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The manifest with each shard's sorted ``depends_on``."""
    deps = edges.groupBy(F.col("src").alias("shard")).agg(F.array_sort(F.collect_set("dst")).alias("depends_on"))
    return manifest_rows.join(deps, "shard", "left").withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>")))


def incremental(files: DataFrame, old: DataFrame, split_by: str = "dir") -> DataFrame:
    """The files of shards whose checksum is new or different: all that has to be parsed again."""
    now = shard_checksums(files, split_by)
    dirty = now.join(old.select("shard", "checksum"), ["shard", "checksum"], "left_anti").select("shard")
    return files.withColumn("shard", shard_key(F.col("path"), split_by)).join(dirty, "shard", "left_semi").drop("shard")
