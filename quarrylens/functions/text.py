"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def indent_level(line: Column, tab: int = 4) -> Column:
    """Leading blanks, a tab as ``tab`` of them."""
    head = F.regexp_extract(line, "^[ \t]*", 0)
    tabs = F.length(head) - F.length(F.replace(head, F.lit("\t"), F.lit("")))
    return (F.length(head) + tabs * (tab - 1)).cast("bigint")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    """The parent folder; empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def shard_key(path: Column, split_by: str = "dir") -> Column:
    return path if split_by == "file" else dir_name(path)


def shard_name(key: Column) -> Column:
    """A shard's file name; the root is ``root``."""
    bare = F.regexp_replace(F.regexp_replace(key, r"[/.]", "_"), "^_+", "")
    return F.concat(F.when(bare == "", "root").otherwise(bare), F.lit(".json"))


def complexity_score(depth: Column) -> Column:
    return F.when(depth <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), depth - 1)).cast("bigint")


def complexity_level(depth: Column) -> Column:
    return F.when(depth <= 2, "SIMPLE").when(depth == 3, "MODERATE").when(depth == 4, "HIGH").when(depth == 5, "VERY_HIGH").otherwise("CRITICAL")


def strip_comments(code: Column) -> Column:
    return F.substring_index(F.substring_index(code, "//", 1), "#", 1)


def class_kind(declaration: Column) -> Column:
    """The kind of a declaration by the word in it."""
    low = F.lower(declaration)
    out = F.lit("")
    for word in ("class", "struct", "interface", "enum", "trait", "union", "object", "record", "protocol", "module")[::-1]:
        out = F.when(low.contains(word), word).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Estimated tokens of a text: a quarter of its characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def name_list(spec: Column) -> Column:
    """Comma-separated names, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(spec, ","), F.trim), lambda x: x != "")
