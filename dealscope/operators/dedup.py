"""Keep-first dedup and duplicate audits; null keys never match."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _complete(key: Sequence[str | Column]) -> Column:
    return reduce(lambda a, b: a & b, [(F.col(k) if isinstance(k, str) else k).isNotNull() for k in key], F.lit(True))


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by ``order``; null is a key value like any other."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def keep_first_complete(df: DataFrame, key: Sequence[str | Column], order: Sequence[str | Column], also: Column | None = None) -> DataFrame:
    """Keep-first on rows whose key has no null (and ``also`` holds); other rows stay.

    Rows with an incomplete key are set apart before the shuffle, so that they
    do not meet in one task.
    """
    whole = F.coalesce(_complete(key) & (also if also is not None else F.lit(True)), F.lit(False))
    w = Window.partitionBy(*key).orderBy(*order)
    first = df.filter(whole).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return first.unionByName(df.filter(~whole))


def without_relists(df: DataFrame, order: Sequence[str | Column], lat: str = "lat", lon: str = "lon", area: str = "area_total_m2", price: str = "price_tenge", complex_col: str = "complex_name", floor: str = "floor", floors: str = "floor_total") -> DataFrame:
    """Two passes: the same place, area and price; then the same complex (or cell of about 11 m), area, price and floors."""
    once = keep_first_complete(df, [lat, lon, area, price], order)
    cell = F.concat(F.lit("ll:"), F.coalesce(F.bround(lat, 4).cast("string"), F.lit("nan")), F.lit(","), F.coalesce(F.bround(lon, 4).cast("string"), F.lit("nan")))
    place = F.when(F.col(complex_col).isNotNull(), F.concat(F.lit("cx:"), F.col(complex_col).cast("string"))).otherwise(cell)
    placed = once.withColumn("__place", place)
    some = F.col(lat).isNotNull() | F.col(complex_col).isNotNull()
    return keep_first_complete(placed, ["__place", area, price, floor, floors], order, some).drop("__place")


def duplicate_audit(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: members of groups of two or more, extra copies, and groups; null matches null."""
    groups = df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("members"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("extra"), F.count("*").alias("groups"))
