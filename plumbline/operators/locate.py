"""Ranked look-up of symbols by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def simple_name(name: Column) -> Column:
    """The last part that isn't empty after dots, colons and backslashes."""
    return F.regexp_extract(name, r"([^.:\\]+)[.:\\]*$", 1)


def match_rank(name: Column, query: str, exact: bool = False) -> Column:
    """0 the same, 1 but for case, 2 the simple name, 3 that but for case, 4 a prefix, 5 contained; null otherwise."""
    q, simple, low = F.lit(query), simple_name(name), F.lower(F.lit(query))
    rank = F.when(name == q, 0)
    if exact:
        return rank.when(simple == q, 2)
    rank = rank.when(F.lower(name) == low, 1).when(simple == q, 2).when(F.lower(simple) == low, 3)
    return rank.when(F.startswith(F.lower(name), low) | F.startswith(F.lower(simple), low), 4).when(F.contains(F.lower(name), low), 5)


def located(symbols: DataFrame, query: str, n: int = 20, exact: bool = False, kind: str | None = None) -> DataFrame:
    """The n best matches (100 at most), by rank, then name and path. symbols: name, kind, path."""
    rows = symbols.withColumn("rank", match_rank(F.col("name"), query, exact)).where("rank is not null")
    if kind:
        rows = rows.where(F.col("kind") == kind)
    return rows.orderBy("rank", "name", "path").limit(min(n, 100))
