"""Imports: classes of dependencies, resolution to shards, and the shard graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, dir_name, shard_key

#: What may follow an import's path to make a file's, in order.
SUFFIXES = ("", ".go", ".py", ".js", ".ts", ".java", ".cs", ".rs", ".swift", ".kt", ".rb", ".php", ".scala", "/index.js", "/index.ts")
#: Names that count as a language's own library: first parts of module paths. Ours; extend as needed.
STDLIB = {
    "py": ("os", "sys", "re", "json", "math", "time", "typing", "collections", "itertools", "functools", "pathlib", "datetime", "logging", "random"),
    "go": ("fmt", "os", "io", "strings", "strconv", "sync", "time", "errors", "bufio", "bytes", "context", "net", "path", "regexp", "sort", "encoding", "math"),
    "java": ("java", "javax"),
    "js": ("fs", "path", "http", "https", "os", "util", "events", "stream", "crypto", "url"),
    "rust": ("std", "core", "alloc"),
    "cs": ("System",),
}
FEW, LOW = 3, 0.20


def dependency_class(module: Column, lang: str, internal: Column) -> Column:
    """internal (relative, or a file of the tree), stdlib, or external."""
    head = F.substring_index(F.substring_index(module, "/", 1), ".", 1)
    return F.when(internal | module.startswith("."), "internal").when(head.isin(*STDLIB.get(lang, ())), "stdlib").otherwise("external")


def import_counts(imports: DataFrame, files: DataFrame, lang: str, module: str = "value") -> DataFrame:
    """(module, class, count). Modules of the tree are found by an equi-join on file stems, not by search."""
    stems = files.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("stem")).select(F.explode(F.array("stem", base_name(F.col("stem")))).alias("stem")).distinct()
    path = F.replace(F.col(module), F.lit("."), F.lit("/"))
    known = imports.withColumn("stem", path).join(stems.withColumn("own", F.lit(True)), "stem", "left")
    kind = dependency_class(F.col(module), lang, F.coalesce("own", F.lit(False)))
    return known.groupBy(F.col(module).alias("module"), kind.alias("class")).agg(F.count("*").alias("count"))


def aliases(imports: DataFrame, value: str = "value") -> DataFrame:
    """(path, alias, target): an import is known by the last part of its path."""
    name = base_name(F.col(value))
    return imports.select("path", name.alias("alias"), name.alias("target")).distinct()


def _climb(parts, part):
    """A path's parts so far and one more; ``..`` takes the last one off."""
    last = F.get(parts, F.size(parts) - 1)
    up = (part == "..") & (F.size(parts) > 0) & (last != "..")
    return F.when(up, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(F.array_append(parts, part))


def resolve(imports: DataFrame, files: DataFrame, module_prefix: str = "", alias_map: dict[str, str] | None = None, split_by: str = "dir", strict: bool = False) -> DataFrame:
    """(path, value, shard, target): the shard of each resolvable import, null where no file answers to it.

    In order: the module prefix, aliases, relative imports. Each import becomes its candidate paths with ranks,
    which meet the files in one equi-join; a folder counts by the shard of its own files. Imports that fit none of
    the three are left out. Dots of a relative import are all trimmed, unless ``strict`` climbs a folder for each ``../``.
    """
    imp, here = F.col("value"), dir_name(F.col("path"))
    join = lambda a, b: F.regexp_replace(F.concat_ws("/", F.when(a != "", a), F.when(b != "", b)), "/+", "/")
    kind, base = F.lit(None).cast("string"), F.lit(None).cast("string")
    bare = F.regexp_replace(imp, r"^\.+", "")
    relative = F.regexp_replace(join(here, F.replace(bare, F.lit("."), F.lit("/"))), "^/", "")
    if strict:
        up = F.regexp_replace(join(here, F.regexp_replace(imp, r"^\./", "")), r"^/", "")
        up = F.array_join(F.aggregate(F.split(up, "/"), F.array().cast("array<string>"), _climb), "/")
        relative = F.when(imp.startswith("./") | imp.startswith("../"), up).otherwise(relative)
    kind, base = F.when(imp.startswith("."), "relative"), F.when(imp.startswith("."), relative)
    for prefix, target in reversed((alias_map or {}).items()):
        hit = imp.startswith(prefix)
        kind = F.when(hit, "alias").otherwise(kind)
        base = F.when(hit, F.regexp_replace(F.concat(F.lit(target), F.substring(imp, len(prefix) + 1, 1 << 30)), "/$", "")).otherwise(base)
    if module_prefix:
        hit = imp.startswith(module_prefix)
        kind = F.when(hit, "module").otherwise(kind)
        base = F.when(hit, F.regexp_replace(F.substring(imp, len(module_prefix) + 1, 1 << 30), "^/", "")).otherwise(base)
    want = imports.select("path", "value", kind.alias("kind"), base.alias("base")).where("kind is not null")
    own = files.select("path", shard_key(F.col("path"), split_by).alias("target")).distinct()
    places = own.select(F.concat(F.lit("f:"), "path").alias("place"), "target")
    folders = own.groupBy(F.concat(F.lit("d:"), dir_name(F.col("path"))).alias("place")).agg(F.min("target").alias("target"))
    # a module prefix names folders only
    as_files = F.transform(F.array(*[F.lit(s) for s in SUFFIXES]), lambda s: F.concat(F.lit("f:"), F.col("base"), s))
    tries = F.when(F.col("kind") == "module", F.array(F.concat(F.lit("d:"), "base"))).otherwise(F.concat(as_files, F.array(F.concat(F.lit("d:"), "base"))))
    tried = want.select("path", "value", F.posexplode(tries).alias("rank", "place"))
    met = tried.join(places.union(folders), "place", "left")
    best = met.groupBy("path", "value").agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("rank"))).alias("target"))
    return best.select("path", "value", shard_key(F.col("path"), split_by).alias("shard"), "target")


def shard_edges(resolved: DataFrame) -> DataFrame:
    return resolved.where("target is not null and shard <> target").select(F.col("shard").alias("src"), F.col("target").alias("dst")).distinct()


def shard_listing(edges: DataFrame, files: DataFrame, split_by: str = "dir") -> DataFrame:
    """(shard, depends_on, depended_by), sorted lists; every file's shard is a node."""
    nodes = files.select(shard_key(F.col("path"), split_by).alias("shard")).union(edges.select("src")).union(edges.select("dst")).distinct()
    out = edges.groupBy(F.col("src").alias("shard")).agg(F.array_sort(F.collect_set("dst")).alias("depends_on"))
    into = edges.groupBy(F.col("dst").alias("shard")).agg(F.array_sort(F.collect_set("src")).alias("depended_by"))
    empty = F.array().cast("array<string>")
    return nodes.join(out, "shard", "left").join(into, "shard", "left").select("shard", F.coalesce("depends_on", empty).alias("depends_on"), F.coalesce("depended_by", empty).alias("depended_by"))


def resolution(resolved: DataFrame) -> DataFrame:
    """(resolvable, resolved, warn): a warning where few of several resolvable imports were found."""
    s = resolved.agg(F.count("*").alias("resolvable"), F.count("target").alias("resolved"))
    return s.withColumn("warn", (F.col("resolvable") >= FEW) & (F.col("resolved") < F.col("resolvable") * LOW))
