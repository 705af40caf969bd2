"""A file stream that keeps a map up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import parse, relation
from ..sources.scan import language_of


def file_stream(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """Parquet files of (path, content) that arrive in ``root``."""
    return spark.readStream.schema("path string, content string").option("maxFilesPerTrigger", max_files).parquet(root)


def function_stream(files: DataFrame) -> DataFrame:
    """Functions of arriving files; stateless, so it runs as it is on a stream."""
    return relation(parse(files.withColumn("lang", language_of(F.col("path"))), ("functions",)), "functions")


def keep_map(files: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's functions to a folder of its own below ``table``; ``latest`` reads the newest of each file.

    A batch that runs again replaces its folder, so restarts neither lose nor repeat rows.
    """

    def put(batch: DataFrame, n: int) -> None:
        found = parse(batch.withColumn("lang", language_of(F.col("path"))), ("functions",))
        found.select("path", "lang", "functions").write.mode("overwrite").parquet(f"{table}/batch={n}")

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """Functions of the newest version of each file."""
    rows = spark.read.parquet(table)
    newest = rows.groupBy("path").agg(F.max_by(F.struct("lang", "functions"), "batch").alias("x"))
    return newest.select("path", "x.lang", F.explode("x.functions").alias("f")).select("path", "lang", "f.*")
