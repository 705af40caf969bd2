"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components by SimHash over 4-word shingles, linked at 4 or fewer differing bits."""
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item, as (doc_id, item_id) pairs."""
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_assignment_lexer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    from .secrets import digest, find_secrets

    return digest(find_secrets(table(spark, sf_dir, "documents")))


def op3_checked_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    from .pii import digest, find_personal_data

    return digest(find_personal_data(table(spark, sf_dir, "documents")))


def op6_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_loser_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page, read back through the merged capture index."""
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of near-equal bytes."""
    return sharded(table(spark, sf_dir, "documents"))


def sharded(docs: DataFrame) -> DataFrame:
    """The shard digest of each document: law ``bytes``; grown_shard is for the law ``key`` only."""
    from .sharding import shard_by_bytes

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return shard_by_bytes(rows.withColumn("text_crc32", F.crc32("text"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding near-duplicates at cosine 0.93 or more within a label."""
    from .imi import cosine_links

    return cosine_links(table(spark, sf_dir, "embeddings"))


def op9_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files in Arrow fixed-size lists, and what they say about each document."""
    import public_tokenizers

    from .tokens import token_round_trip

    return token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, with their texts, mixed to the square root of their sources' shares by Poisson replication."""
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "text", "n_copies", "replica", "shuffle_key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_template_windows": op1_template_windows,
    "op2_assignment_lexer": op2_assignment_lexer,
    "op3_checked_patterns": op3_checked_patterns,
    "op4_histogram_sort": op4_histogram_sort,
    "op5_simhash": op5_simhash,
    "op6_counterfactual": op6_counterfactual,
    "op7_loser_tree": op7_loser_tree,
    "op8_multi_index": op8_multi_index,
    "op9_arrow_tokens": op9_arrow_tokens,
    "op10_poisson_mix": op10_poisson_mix,
}
