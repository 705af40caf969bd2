"""Token search over texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETWEEN = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), ""))


def token_index(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(term, id): the inverted index; write it partitioned by a prefix of the term to search it again and again."""
    return docs.select(F.explode(terms(F.col(text))).alias("term"), F.col(id_col))


def search(docs: DataFrame, term: str, id_col: str, text: str, n: int = 20) -> DataFrame:
    """The first ``n`` ids whose text has the term. ``contains`` drops most texts before they are split."""
    low = term.lower()
    hits = docs.where(F.contains(F.lower(F.col(text)), F.lit(low))).where(F.array_contains(terms(F.col(text)), low))
    return hits.select(id_col).orderBy(id_col).limit(n)
