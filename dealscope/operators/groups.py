"""Group statistics, joined back to rows where asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.operators.ranking import MOST_IN_GROUP, largest_group, positions
from dealscope.session import stored

#: Figures of so many groups are broadcast to the rows; more meet them by shuffle.
FEW_GROUPS = 100_000


def group_median(df: DataFrame, key: str, value: str, min_n: int = 5, prefix: str = "", most: int = MOST_IN_GROUP) -> DataFrame:
    """(key, median, count of values, too few) of each non-null key; the median is given even where few.

    Groups of more than ``most`` rows are not held by one task: their middle values come from :func:`positions`.
    """
    rows = df.filter(F.col(key).isNotNull())
    if largest_group(rows, key) <= most:
        return rows.groupBy(key).agg(F.median(value).alias(f"{prefix}median"), F.count(value).alias(f"{prefix}count"), (F.count(value) < min_n).alias(f"{prefix}insufficient_n"))
    place = positions(rows.filter(F.col(value).isNotNull()).select(key, value), key, value)
    # the two middle places, the same one in an odd group
    middle = [F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)]
    has = [((F.col("before") <= m) & (m < F.col("before") + F.col("times"))).cast("int") for m in middle]
    halves = place.withColumn("__has", has[0] + has[1]).filter("__has > 0").groupBy(key).agg((F.sum(F.col(value) * F.col("__has")) / 2).alias(f"{prefix}median"), F.first("n").alias(f"{prefix}count"))
    found = rows.select(key).distinct().join(halves, key, "left").fillna(0, [f"{prefix}count"])
    return found.withColumn(f"{prefix}insufficient_n", F.col(f"{prefix}count") < min_n)


def left_by_key(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Rows with their key's row of ``stats``; null keys match nothing, and are dealt out so that they do not meet in one task."""
    spread = F.when(F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(200)).cast("int")).otherwise(F.lit(0))
    return df.withColumn("__spread", spread).join(stats.withColumn("__spread", F.lit(0)), [key, "__spread"], "left").drop("__spread")


def by_group(df: DataFrame, stats: DataFrame, key: str, how: str = "inner", few: int = FEW_GROUPS) -> DataFrame:
    """Rows with their group's row of ``stats``, inner or left.

    A shuffle by few keys would put each group's rows in one task, so figures of up to ``few`` groups go to the rows instead.
    """
    known = stored(stats, "groups")
    if known.limit(few + 1).count() <= few:
        return df.join(F.broadcast(known), key, how)
    return left_by_key(df, known, key) if how == "left" else df.join(known, key)


def with_group_median(df: DataFrame, key: str, value: str, min_n: int = 5, prefix: str = "") -> DataFrame:
    """Rows with their group's median, count and flag; null keys match nothing."""
    return by_group(df, group_median(df, key, value, min_n, prefix), key, "left")


def value_counts(df: DataFrame, c: str, with_null: bool = True, name: str = "n") -> DataFrame:
    rows = df if with_null else df.filter(F.col(c).isNotNull())
    return rows.groupBy(c).agg(F.count("*").alias(name)).orderBy(F.desc(name), F.col(c).asc_nulls_last())


def group_sizes(df: DataFrame, key: str, least: int = 5) -> DataFrame:
    """One row: groups, singletons, groups of ``least`` or more, and rows in those."""
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("groups"),
        F.count_if(F.col("n") == 1).alias("singletons"),
        F.count_if(F.col("n") >= least).alias("large_groups"),
        F.coalesce(F.sum(F.when(F.col("n") >= least, F.col("n"))), F.lit(0)).cast("bigint").alias("rows_in_large"),
    )


def conditional_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])


def waterfall(df: DataFrame, rules: Sequence[tuple[str, Column]], rest: str, name: str = "bucket") -> DataFrame:
    """Rows by the first rule that holds."""
    chain = F.lit(rest)
    for label, rule in reversed(rules):
        chain = F.when(F.coalesce(rule, F.lit(False)), label).otherwise(chain)
    return df.groupBy(chain.alias(name)).agg(F.count("*").alias("n"))


def distinct_sorted(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c)


def constant_of_group(df: DataFrame, key: str, value: str) -> DataFrame:
    """A value that is the same throughout a group, whatever rows have it."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias(value))


def group_total(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the sum and count of their group, 0 where the key is null."""
    sums = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("group_sum"), F.count(value).alias("group_count"))
    return by_group(df, sums, key, "left").fillna(0, ["group_sum", "group_count"])
