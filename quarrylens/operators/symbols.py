"""Symbols of a file tree: functions, classes and types together, bodies, methods, and the map entry point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scan import scan
from .lines import running_depth
from .parse import errors, parse, relation


def symbols(functions: DataFrame, classes: DataFrame, types: DataFrame) -> DataFrame:
    """(path, kind, name, start, end): functions, classes, and the types that are no class of that name and start."""
    f = functions.select("path", F.lit("function").alias("kind"), "name", "start", "end")
    c = classes.select("path", F.lit("class").alias("kind"), "name", "start", "end")
    t = types.select("path", "kind", "name", "start", "end").join(classes, ["path", "name", "start"], "left_anti").select("path", "kind", "name", "start", "end")
    return f.union(c).union(t)


def file_symbols(files: DataFrame, **how) -> DataFrame:
    """``symbols`` of (path, content, lang), each file read once and nothing exchanged."""
    return relation(parse(files, ("symbols",), **how), "symbols").select("path", "kind", "name", "start", "end")


def bodies(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, name, start, end, body): each function's own lines. A file's lines and functions meet as two arrays in one row, once."""
    all_lines = lines.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]).alias("all"))
    spans = functions.groupBy("path").agg(F.collect_list(F.struct("name", "start", "end")).alias("spans"))

    def own(x):
        cut = F.slice("all", x["start"].cast("int"), (x["end"] - x["start"] + 1).cast("int"))
        return F.struct(x["name"].alias("name"), x["start"].alias("start"), x["end"].alias("end"), F.array_join(cut, "\n").alias("body"))

    return spans.join(all_lines, "path").select("path", F.inline(F.transform("spans", own)))


def methods(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(path, class_name, start, name): functions under each class of their name in the file."""
    c = classes.select("path", F.col("name").alias("class_name"), F.col("start").alias("class_start"))
    return functions.where("class_name <> ''").join(c, ["path", "class_name"]).select("path", "class_name", "class_start", "name", "start")


def orphans(functions: DataFrame) -> DataFrame:
    return functions.where("class_name = ''")


def tree_summary(functions: DataFrame, nested: DataFrame) -> DataFrame:
    """(functions, total_lines, max_depth) of a tree."""
    lines = functions.agg(F.count("*").alias("functions"), F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).alias("total_lines"))
    return lines.crossJoin(nested.agg(F.coalesce(F.max("depth") + 1, F.lit(0)).alias("max_depth")))  # one row each


def file_maps(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(path, functions, classes): arrays of (name, line) in line order; files without symbols do not appear."""
    of = lambda d, c: d.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "name"))), lambda x: F.struct(x["name"].alias("name"), x["start"].alias("line"))).alias(c))
    empty = F.array().cast("array<struct<name:string,line:bigint>>")
    return of(functions, "functions").join(of(classes, "classes"), "path", "full_outer").select("path", F.coalesce("functions", empty).alias("functions"), F.coalesce("classes", empty).alias("classes"))


class CodeMap:
    """Entry point: a tree, or any DataFrame of (path, content, lang), parsed once; relations are views of it."""

    def __init__(self, files: DataFrame, want: tuple[str, ...] = ("functions", "classes", "types", "fields", "calls"), names: list[str] | None = None, strict: bool = False):
        self.files = files
        self.parsed = parse(files, want, names, strict=strict)

    @classmethod
    def scan(cls, spark: SparkSession, root: str, mode: str = "all", lang: str | None = None, recursive: bool = True, use_ignore: bool = True, **how) -> CodeMap:
        wants = {"functions": ("functions", "classes"), "structs": ("types", "fields"), "all": ("functions", "classes", "types", "fields", "calls")}
        if mode not in wants:
            raise ValueError(f"mode is one of {', '.join(wants)}")
        return cls(scan(spark, root, lang, recursive, use_ignore), wants[mode], **how)

    def cache(self) -> CodeMap:
        self.parsed = self.parsed.persist()
        return self

    @property
    def errors(self) -> DataFrame:
        """(path, lang, error) of the files that were not read."""
        return errors(self.parsed)

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("parsed", "files") or name not in self.parsed.columns:
            raise AttributeError(name)
        return relation(self.parsed, name)


def functions_by_window(clean_lines: DataFrame, text: str = "raw", header: str = r"^\s*func\s+(?:\([^)]*\)\s+)?([\p{L}\p{Nd}_]+)(?:\[[^\]]*\])?\s*\(") -> DataFrame:
    """(path, name, start, end) of functions in sanitised lines of a language whose functions nest, without Python.

    With D the running brace depth, a header on a line whose depth before was d ends at the first later line that
    brings D back down to d. Per (file, depth) that is the next such line: one window over the headers' and the
    closing lines' rows, partitioned by both, so no file is one task's sort of pairs.
    """
    of = running_depth(clean_lines, text)
    of = of.select("path", "line_no", "before", "depth", "delta", F.regexp_extract(text, header, 1).alias("name"), F.contains(F.col(text), F.lit("{")).alias("brace"))
    head = of.where("name <> ''")
    once = head.where("delta = 0 and brace").select("path", "name", F.col("line_no").alias("start"), F.col("line_no").alias("end"))
    opened = head.where("not (delta = 0 and brace)").select("path", F.col("before").alias("level"), "line_no", "name", F.lit(None).cast("bigint").alias("close"))
    closing = of.where("depth < before").select("path", F.col("depth").alias("level"), "line_no", F.lit(None).cast("string").alias("name"), F.col("line_no").alias("close"))
    after = Window.partitionBy("path", "level").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    spans = opened.union(closing).withColumn("end", F.first("close", ignorenulls=True).over(after)).where("name is not null and end is not null")
    return spans.select("path", "name", F.col("line_no").alias("start"), "end").union(once)
