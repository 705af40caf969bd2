"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the session names in ``spark.checkpoint.dir``; only where that is unset (tests,
    one machine) a folder below the warehouse is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have.rstrip("/")
    own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    spark.sparkContext.setCheckpointDir(own)
    return own


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit(""))


def scratch(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` does not use (case-insensitively)."""
    used = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in used:
        n += 1
        name = f"{stem}_{n}"
    return name


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """Partitions so that each has about ``per_part`` rows; grows with the rows, without an upper end."""
    return max(least, -(-rows // per_part))


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: ``(node, root)``, root the smallest node.

    Each round every node takes the least label among itself and its neighbours, then labels jump to
    their own label, so the rounds grow with the logarithm of a component's diameter. Labels are
    pre-aggregated before each exchange and a hub's edges may be split by the skew-join rule, since
    the aggregation above the join exchanges anew. Nodes without edges are not returned.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    both = cut(both.union(both.select("v", "u")).where("u <> v").distinct())
    label = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    while True:
        near = (
            both.join(label.select(F.col("node").alias("v"), "root"), "v")
            .groupBy("u").agg(F.min("root").alias("near"))
        )
        step = label.join(near, label.node == near.u, "left").select(
            "node", "root", F.least("root", F.coalesce("near", "root")).alias("now")
        )
        up = label.select(F.col("node").alias("now"), F.col("root").alias("far"))
        nxt = cut(step.join(up, "now", "left").select("node", F.col("root").alias("was"), F.least("now", F.coalesce("far", "now")).alias("root")))
        moved = nxt.where("was <> root").limit(1).count()
        label = nxt.select("node", "root")
        if not moved:
            return label


def with_keep(named: DataFrame, hot_members: int = 10_000, most_hot: int = 50_000) -> DataFrame:
    """(fp, root, keep) of ``named`` (fp, least, root): keep is the least ``least`` of all that have the root.

    Roots with over ``hot_members`` members, and over one in ``most_hot`` of all rows, are not exchanged: there are fewer than
    ``most_hot`` of them, and what they keep is broadcast. Others are too small to weigh on a task.
    """
    named = cut(named)
    of_root = cut(named.groupBy("root").agg(F.min("least").alias("keep"), F.count("*").alias("n")))
    is_hot = F.col("n") > max(hot_members, named.count() // most_hot)
    slim, cold = named.select("fp", "root"), of_root.where(~is_hot).select("root", "keep")
    hot = of_root.where(is_hot).select("root", F.col("keep").alias("hot"))
    if not hot.limit(1).count():
        return slim.join(cold, "root").select("fp", "root", "keep")
    told = slim.join(F.broadcast(hot), "root", "left")
    rest = told.where("hot is null").select("fp", "root").join(cold, "root").select("fp", "root", "keep")
    return told.where("hot is not null").select("fp", "root", F.col("hot").alias("keep")).union(rest)


def worker_cache(key: str, make):
    """``make()``, kept for the life of this Python process (workers serve many tasks)."""
    import sys
    import types

    store = sys.modules.setdefault("_quarrylens_worker_cache", types.ModuleType("_quarrylens_worker_cache"))
    if not hasattr(store, "items"):
        store.items = {}
    if key not in store.items:
        store.items[key] = make()
    return store.items[key]


def file_system(uri: str):
    """(pyarrow file system, path) of a shared folder or file; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def attempt_name(path: str) -> str:
    """A name for what a task attempt writes before it is moved to ``path`` as a whole."""
    return f"{path}.{uuid.uuid4().hex}.tmp"
