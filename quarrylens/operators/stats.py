"""Call frequencies, complexity rollups, imports and decorators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import complexity_level, complexity_score
from ..languages import CALL, IDENT, PROFILES


def call_names(files: DataFrame, text: str = "content", exclude: tuple[str, ...] = (), key: str = "path") -> DataFrame:
    """(key, name): every ``name(`` of a text, keywords left out. Codegen all the way; no Python.

    ``files`` are the sanitised lines of ``parse`` with ``text`` "clean", so that comments and literals hold no calls.
    """
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(CALL.replace("{IDENT}", IDENT)), F.lit(1))
    names = files.select(key, F.explode(found).alias("name"))
    return names.where(~F.col("name").isin(*exclude)) if exclude else names


def call_counts(names: DataFrame, key: str | None = "path") -> DataFrame:
    """Calls by name, in each file or (``key`` None) in all."""
    return names.groupBy(*([key] if key else []), "name").agg(F.count("*").alias("count"))


def top_calls(counts: DataFrame, n: int = 10, key: str | None = None) -> DataFrame:
    """The ``n`` most frequent names (0: all), ties by name; in each file if ``key`` is given."""
    order = [F.col("count").desc(), F.col("name")]
    if key is None:
        ranked = counts.orderBy(*order)
        return ranked.limit(n) if n else ranked
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= n) if n else ranked


def distinct_matches(lines: DataFrame, lang: str, what: str = "imports") -> DataFrame:
    """(path, value, nth): distinct imports or decorators of each file in first-seen order, from raw lines.

    Imports are all groups of a line's first match, decorators its first group.
    """
    p = PROFILES[lang]
    pattern = (p.imports if what == "imports" else p.decorator).replace("{IDENT}", IDENT)
    groups = range(1, (pattern.count("(") - pattern.count("(?") - pattern.count("\\(")) + 1) if what == "imports" else range(1, 2)
    hits = lines.where(F.col("raw").rlike(pattern))
    values = F.array(*[F.regexp_extract("raw", pattern, g) for g in groups])
    each = hits.select("path", "line_no", F.posexplode(values).alias("pos", "value")).where("value <> ''")
    first = each.groupBy("path", "value").agg(F.min(F.struct("line_no", "pos")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("at"))
    return first.select("path", "value", nth.cast("bigint").alias("nth"))


def complexity(parsed: DataFrame) -> DataFrame:
    """(path, name, start, end, lines_of_code, depth, complexity, level) from functions with their depths."""
    return parsed.withColumns({"complexity": complexity_score(F.col("depth")), "level": complexity_level(F.col("depth"))})


def complexity_by_file(c: DataFrame) -> DataFrame:
    return c.groupBy("path").agg(F.count("*").alias("functions"), F.avg("complexity").alias("average"), F.max("complexity").alias("most"))


def complexity_project(c: DataFrame) -> DataFrame:
    """Mean of the files' maxima; files without functions do not count."""
    by = complexity_by_file(c)
    return by.agg(F.count("*").alias("files"), F.sum("functions").alias("functions"), F.avg("most").alias("average"))


def complexity_filter(c: DataFrame, least_depth: int = 0, no_simple: bool = False) -> DataFrame:
    out = c.where(F.col("depth") >= least_depth)
    return out.where(F.col("depth") > 2) if no_simple else out


def complexity_levels(c: DataFrame) -> DataFrame:
    return c.groupBy("level").agg(F.count("*").alias("n"))


def complexity_top(c: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most complex functions with their rank, ties by file and start."""
    top = c.orderBy(F.col("complexity").desc(), "path", "start").limit(n)
    rank = F.row_number().over(Window.orderBy(F.col("complexity").desc(), "path", "start"))  # over n rows
    return top.withColumn("rank", rank.cast("bigint"))
