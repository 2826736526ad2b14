"""Ranks in groups, ordered limits and running ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealscope.session import stored


#: Rows of one group that a single task may rank; larger groups are placed by range partitioning.
MOST_IN_GROUP = 500_000


def largest_group(df: DataFrame, group: str) -> int:
    return df.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def positions(known: DataFrame, group: str, value: str, partitions: int = 200) -> DataFrame:
    """(group, value, times, before, n) of each distinct value of a group: how often it occurs, how many of the group are smaller, and the group's size.

    Equal values are counted first, then range partitioned by group and value; what lies before a partition comes
    from a row a partition and group, so that a large group is spread over many tasks.
    """
    counts = known.groupBy(group, value).agg(F.count("*").alias("times"))
    parted = stored(counts.repartitionByRange(partitions, group, value).withColumn("__part", F.spark_partition_id()), "positions")
    in_group = Window.partitionBy(group)
    earlier = in_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parted.groupBy(group, "__part").agg(F.sum("times").alias("__n"))
    sums = sums.select(group, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(in_group).alias("n"))
    inside = Window.partitionBy(group, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = parted.withColumn("__own", F.coalesce(F.sum("times").over(inside), F.lit(0))).join(sums, [group, "__part"])
    return placed.select(group, value, "times", (F.col("__before") + F.col("__own")).alias("before"), "n")


def percentile_rank(df: DataFrame, group: str, value: str, name: str, most: int = MOST_IN_GROUP) -> DataFrame:
    """(smallest rank - 1) / (n - 1) among the group's values; 0 for a single one; null where key or value is null.

    Rows without a key or value stay apart from the shuffle's groups.  Groups of up to ``most`` rows are ranked by a
    window, larger ones by :func:`positions`, to the same ranks.
    """
    is_known = F.col(group).isNotNull() & F.col(value).isNotNull()
    known = df.filter(is_known)
    if largest_group(known, group) <= most:
        ranked = known.withColumn(name, F.percent_rank().over(Window.partitionBy(group).orderBy(value)))
    else:
        place = positions(known.select(group, value), group, value).select(group, value, F.when(F.col("n") > 1, F.col("before") / (F.col("n") - 1)).otherwise(0.0).alias(name))
        ranked = known.join(place, [group, value]).select(*df.columns, name)
    return ranked.unionByName(df.filter(~is_known).withColumn(name, F.lit(None).cast("double")))


def smallest(df: DataFrame, value: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The k rows of least value, ties by the other columns."""
    return df.filter(F.col(value).isNotNull()).orderBy(value, *tie).limit(k)


def numbered(df: DataFrame, key: str | Column, name: str, partitions: int = 64) -> DataFrame:
    """Rows with their place from 0 in order of key; equal keys follow each other in any order.

    Places come from a range partitioning, written once, and its partitions' counts, so that
    no single task sorts everything and no row is counted in one place and numbered in another.
    """
    k = F.col(key) if isinstance(key, str) else key
    parted = stored(df.withColumn("__key", k).repartitionByRange(partitions, "__key").withColumn("__part", F.spark_partition_id()), "parted")
    counts = parted.groupBy("__part").agg(F.count("*").alias("__n"))
    # at most `partitions` rows
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__key")) - 1
    return parted.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + place).cast("bigint")).drop("__part", "__before", "__key")


def next_ids(new: DataFrame, key: str | Column, known: DataFrame, known_id: str, name: str = "row_id", partitions: int = 64) -> DataFrame:
    """New rows numbered on from the largest known id, in order of key."""
    last = known.agg(F.coalesce(F.max(known_id), F.lit(0)).cast("bigint")).first()[0]
    return numbered(new, key, name, partitions).withColumn(name, F.col(name) + F.lit(last + 1))


def default_row_numbers(links: DataFrame, position: str, url: str = "url", given: str = "source_row", partitions: int = 64) -> DataFrame:
    """Links with a url; a missing row number is the number of links before it, plus 2."""
    kept = links.filter(F.trim(F.coalesce(F.col(url), F.lit(""))) != "")
    placed = numbered(kept, position, "__place", partitions)
    return placed.withColumn(given, F.coalesce(F.col(given), (F.col("__place") + 2).cast("int"))).drop("__place")
