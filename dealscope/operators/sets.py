"""Set operations on keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(links: DataFrame, done: DataFrame, key: str, ok: Column | None = None) -> DataFrame:
    """Links not yet done; ``ok`` says which rows of ``done`` count."""
    d = done.filter(ok) if ok is not None else done
    return links.join(d.select(key).distinct(), key, "left_anti")


def union_of(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def overlap(a: DataFrame, b: DataFrame, key: str, of: int) -> DataFrame:
    """One row: common keys, and their share of ``of``."""
    both = a.select(key).intersect(b.select(key))
    return both.agg(F.count("*").alias("common"), (F.count("*") / F.lit(float(of))).alias("overlap"))


def members(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_semi")


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def constant_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(column, n_distinct) of the columns with fewer than two distinct values."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in wanted])
    return counts.unpivot([], list(wanted), "column_name", "n_distinct").filter("n_distinct < 2")
