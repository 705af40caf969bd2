"""A training-corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. The first three filter and the fourth repeats rows, all with the
columns of ``docs``; the last adds each row's place. In every stage null ids, null, empty and very long texts, ties,
repeated rows, empty tables and further columns of any name have the result that its operator's docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import work_dir
from quarrylens.llm.decontaminate import drop_leaks
from quarrylens.llm.near_copies import drop_near_copies
from quarrylens.llm.mixing import mix
from quarrylens.llm.sharding import shard_by_bytes
from quarrylens.llm.toxicity import drop_toxic

SHARDS = 40


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7. Null and empty texts score as texts without words; equal texts stay or go together."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a Jaccard similarity of 0.8 or more: the one with the smallest doc_id.

    Candidates come from SimHash tries, and whole sets decide. Texts without words are one group; of repeated rows one stays, and a null id only where its group has no other.
    """
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; those without words leak none."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their Poisson counts, sources at the square root of their shares, in random order.

    A null source is one of its own; a document whose count is 0 does not appear.
    """
    return mix(docs).drop("n_copies", "replica", "shuffle_key")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, shard and slot, text_crc32 and law; 40 shards of near-equal bytes.

    Columns of ``docs`` with one of these five names are replaced.
    """
    rows = docs.withColumns({"text_crc32": F.crc32(F.coalesce("text", F.lit(""))), "law": F.lit("bytes")})
    return shard_by_bytes(rows, SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Components of similar texts and a trained classifier have no SQL; tests/llm compares the rows of all stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_dir(spark, "pipeline")
    for n, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{n}-{name}")
        docs = spark.read.parquet(f"{folder}/{n}-{name}")
    return docs
