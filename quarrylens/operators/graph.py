"""Call graphs: who calls what, in which file, and what is reachable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .parse import parse


def outermost(functions: DataFrame) -> DataFrame:
    """Functions that no other of their file holds: those that start after every earlier one has ended."""
    w = Window.partitionBy("path").orderBy("start", F.col("end").desc())
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return functions.withColumn("before", before).where(F.col("before").isNull() | (F.col("start") > F.col("before"))).drop("before")


def callers(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls with the outermost function around them: an interval join as one ordered pass.

    Outermost functions of a file do not overlap, so in line order the last one that started is the only one that
    can hold a call. No pairs are formed, and a long file stays linear.
    """
    marks = outermost(functions).select("path", F.col("start").alias("line"), F.lit(0).alias("what"), F.struct("start", "end", F.col("name").alias("caller")).alias("f"), F.lit(None).cast("string").alias("receiver"), F.lit(None).cast("string").alias("callee"))
    sites = calls.select("path", "line", F.lit(1).alias("what"), F.lit(None).cast("struct<start:bigint,end:bigint,caller:string>").alias("f"), "receiver", F.col("name").alias("callee"))
    order = Window.partitionBy("path").orderBy("line", "what").rowsBetween(Window.unboundedPreceding, 0)
    return (
        marks.union(sites).withColumn("at", F.last("f", ignorenulls=True).over(order))
        .where("what = 1 and at is not null and line <= at.end")
        .select("path", "line", "receiver", "callee", F.col("at.caller").alias("caller"))
    )


def call_edges(calls: DataFrame, functions: DataFrame, aliases: DataFrame | None = None, scope: str = "dir") -> DataFrame:
    """(path, caller, callee, line): the first line of each pair in each file.

    Bare calls need a function of that name, in the file (``scope`` file) or anywhere (``dir``); calls on a
    receiver are kept as ``receiver.name``, or by what ``aliases`` (path, alias, target) says. Calls outside
    functions and of a function to itself are left out.
    """
    at = callers(calls, functions)
    known = functions.select("path", F.col("name").alias("callee")).distinct() if scope == "file" else functions.select(F.col("name").alias("callee")).distinct()
    bare = at.where("receiver = ''").join(known, ["path", "callee"] if scope == "file" else ["callee"], "left_semi").select("path", "caller", "callee", "line")
    qualified = at.where("receiver <> ''")
    if aliases is not None:
        qualified = qualified.join(aliases.select("path", F.col("alias").alias("receiver"), "target"), ["path", "receiver"], "left").withColumn("receiver", F.coalesce("target", "receiver"))
    qualified = qualified.select("path", "caller", F.concat("receiver", F.lit("."), "callee").alias("callee"), "line")
    return bare.union(qualified).where("caller <> callee").groupBy("path", "caller", "callee").agg(F.min("line").alias("line"))


def file_marks(files: DataFrame, aliases: DataFrame | None = None, scope: str = "dir", keep: Callable[[Column], Column] | None = None, **how) -> DataFrame:
    """(path, caller, callee, line): functions (``caller`` null) and the calls of ``call_edges``, from one reading of (path, content, lang).

    A path is one file, which makes its calls distinct while it is read. What is left to ask of other files is whether bare calls
    without a function in their own file have one elsewhere: they meet the functions of that name in one exchange, in which all
    other rows go by their file. ``keep`` (of the callee) leaves out calls and functions before that; a name's rows stay or go together.
    """
    parsed = parse(files, ("edges",), **how)
    if aliases is None:
        e = parsed.select("path", F.explode("edges").alias("x")).select("path", "x.*")
    else:
        of = aliases.groupBy("path").agg(F.collect_list(F.struct("alias", "target")).alias("of"))
        e = parsed.join(of, "path", "left").select("path", "of", F.explode("edges").alias("x")).select("path", "of", "x.*")
        named = F.filter("of", lambda a: (a["alias"] == F.col("receiver")) & (F.col("receiver") != ""))
        stands = F.when(F.size(named) > 0, F.transform(named, lambda a: F.coalesce(a["target"], F.col("receiver")))).otherwise(F.array("receiver"))
        e = e.select("path", "caller", F.explode(stands).alias("receiver"), "callee", "line", "own")
    bare = F.col("receiver") == ""
    e = e.select("path", "caller", F.when(bare, F.col("callee")).otherwise(F.concat("receiver", F.lit("."), "callee")).alias("callee"), "line", bare.alias("bare"), (F.col("own") & bare).alias("own"))
    e = e.where("caller is null or caller <> callee")
    if keep is not None:
        e = e.where(keep(F.col("callee")))
    if aliases is not None:  # two receivers may stand for one target; the rows lie by path, so this is no exchange
        e = e.groupBy("path", "caller", "callee", "bare", "own").agg(F.min("line").alias("line"))
    if scope == "file":
        e = e.where("caller is null or own or not bare")
    else:
        asked = F.expr("caller is null or bare and not own")
        place = F.when(asked, F.col("callee")).otherwise(F.col("path"))
        known = F.max(F.expr("caller is null")).over(Window.partitionBy("place"))
        e = e.withColumn("place", place).withColumn("known", known).where("known or own or not bare")
    return e.select("path", "caller", "callee", "line")


def file_edges(files: DataFrame, aliases: DataFrame | None = None, scope: str = "dir", keep: Callable[[Column], Column] | None = None, **how) -> DataFrame:
    """``call_edges`` of (path, content, lang), each file read once."""
    return file_marks(files, aliases, scope, keep, **how).where("caller is not null")


def totals(marks: DataFrame) -> DataFrame:
    """(functions, calls, files) of ``file_marks``: distinct names, calls, and files that have any."""
    call = F.col("caller").isNotNull()
    return marks.agg(F.count_distinct(F.when(~call, F.col("callee"))).alias("functions"), F.count_if(call).alias("calls"), F.count_distinct(F.when(call, F.col("path"))).alias("files"))


def reverse(edges: DataFrame) -> DataFrame:
    """(callee, callers): distinct callers, sorted."""
    return edges.select("caller", "callee").distinct().groupBy("callee").agg(F.array_sort(F.collect_list("caller")).alias("callers"))


def callers_of(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("callee") == name).select("caller").distinct()


def steps(edges: DataFrame) -> DataFrame:
    """Distinct (caller, callee), computed once, kept in the shared folder and laid out by caller: what ``walk`` goes over."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(edges.select("caller", "callee").repartition(n, "caller").distinct().sortWithinPartitions("caller"))


def roots(edges: DataFrame) -> DataFrame:
    """(node): callers that nothing calls."""
    return edges.select(F.col("caller").alias("node")).distinct().join(edges.select(F.col("callee").alias("node")), "node", "left_anti")


#: Up to so many rows of a frontier are broadcast.
FEW = 100_000
#: From so many rows on, what is seen is not exchanged for few new ones.
MANY = 2_000_000


def reachable(edges: DataFrame, roots: DataFrame, depth: int = 0, checkpoint_every: int = 4) -> DataFrame:
    """(node, hops) of all that ``roots`` (node) reach, by shortest distance; ``depth`` 0 has no bound."""
    return walk(steps(edges), roots, depth, checkpoint_every)


def walk(edges: DataFrame, roots: DataFrame, depth: int = 0, checkpoint_every: int = 4) -> DataFrame:
    """``reachable`` over what ``steps`` gave.

    A frontier at a time: its out-edges, less what has been reached. Every ``checkpoint_every`` rounds the
    plan is cut in the shared folder, so it does not grow with the distance.
    """
    seen = cut(roots.select("node", F.lit(0).cast("bigint").alias("hops")).distinct())
    frontier, hop, total = seen, 0, 0
    while not depth or hop < depth:
        rows = frontier.count()
        if not rows:
            break
        total += rows
        hop += 1
        at = frontier.select(F.col("node").alias("caller"))
        new = edges.join(F.broadcast(at) if rows <= FEW else at, "caller", "left_semi").select(F.col("callee").alias("node")).distinct()
        met = seen
        if rows <= FEW and total >= MANY:  # most often few are new, too: then what is seen is only passed over
            new = cut(new)
            if new.count() <= FEW:
                met = seen.join(F.broadcast(new), "node", "left_semi")
        frontier = cut(new.join(met, "node", "left_anti").withColumn("hops", F.lit(hop).cast("bigint")))
        seen = seen.union(frontier)
        if hop % checkpoint_every == 0:
            seen = cut(seen)
    return seen


def reachable_within(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """(node, hops) within a number of hops of one function. The edges are computed once, not in every round."""
    return reachable(edges, edges.sparkSession.createDataFrame([(root,)], "node string"), depth)


def cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)


def edges_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (caller, callee) that leave the nodes, those that ``reachable`` found for example."""
    return edges.join(nodes.select(F.col("node").alias("caller")), "caller", "left_semi").select("caller", "callee").distinct()


def nesting(functions: DataFrame) -> DataFrame:
    """(path, name, start, end, parent, depth): the outermost function that strictly holds each, and how many are open at its start.

    Starts and ends of a file are one ordered list; the running sum of +1 and -1 is the depth, and the last
    outermost function is the only one that can be the parent.
    """
    f = functions.select("path", "name", "start", "end")
    top = outermost(f).select("path", F.col("start").alias("line"), F.lit(1).alias("what"), F.lit(0).alias("step"), F.struct("name", "start", "end").alias("top"), F.lit(None).cast("struct<name:string,start:bigint,end:bigint>").alias("own"))
    none = F.lit(None).cast("struct<name:string,start:bigint,end:bigint>")
    starts = f.select("path", F.col("start").alias("line"), F.lit(2).alias("what"), F.lit(1).alias("step"), none.alias("top"), F.struct("name", "start", "end").alias("own"))
    ends = f.select("path", (F.col("end") + 1).alias("line"), F.lit(0).alias("what"), F.lit(-1).alias("step"), none.alias("top"), none.alias("own"))
    order = Window.partitionBy("path").orderBy("line", "what", F.col("own.end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    held = top.union(starts).union(ends).withColumns({"depth": F.sum("step").over(order), "at": F.last("top", ignorenulls=True).over(order)}).where("own is not null")
    inside = (F.col("at.start") < F.col("own.start")) & (F.col("at.end") > F.col("own.end"))
    return held.select("path", "own.name", "own.start", "own.end", F.when(inside, F.col("at.name")).alias("parent"), (F.col("depth") - 1).alias("depth"))
