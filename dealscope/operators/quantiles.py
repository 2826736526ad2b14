"""Exact quantiles of many groups and columns at once.

A value's bucket is a step of its logarithm, the same for all groups, so counts by bucket add up over tasks and say in which
bucket each wanted place lies.  Only the values of those buckets are counted one by one, in a second pass; what a task
holds is a group's buckets, or a thin slice of the values of one bucket, never a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealscope.session import stored

#: Buckets an octave, as a power of two, and slices of a wanted bucket.
_BITS, _SLICES = 12, 1 << 20
#: Wanted buckets up to this number are broadcast to the rows; more meet them by shuffle.
_FEW = 100_000


def _bucket(x: Column) -> Column:
    """A whole number that never falls as x grows; nan is the largest."""
    size = F.floor((F.log2(F.abs(x)) + 1080) * (1 << _BITS))
    return F.when(F.isnan(x), F.lit(1 << 41)).when(F.abs(x) == float("inf"), F.signum(x).cast("long") * F.lit(1 << 40)).when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("long") * size).cast("long")


def _located(counts: DataFrame, by: Sequence[str], step: str, wanted: DataFrame) -> DataFrame:
    """(*by, step, place, offset): the step that holds each wanted offset of its ``by`` group, and the offset in it.

    ``counts`` has (*by, step, times), ``wanted`` (*by, place, offset).
    """
    before = F.coalesce(F.sum("times").over(Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = counts.withColumn("__before", before).join(wanted, list(by))
    inside = met.filter((F.col("offset") >= F.col("__before")) & (F.col("offset") < F.col("__before") + F.col("times")))
    return inside.select(*by, step, "place", (F.col("offset") - F.col("__before")).alias("offset"))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str | Column, points: Sequence[float]) -> DataFrame:
    """(*keys, n, q): each group's number of values and its quantiles at ``points``, by linear interpolation.

    Rows without a key or value are left out; groups without values are absent.  ``df`` is read twice.  Without keys there is one group.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    by = [*keys] or ["__all"]
    rows = (df if keys else df.withColumn("__all", F.lit(0))).select(*by, x.alias("__x")).dropna().withColumn("__b", _bucket(F.col("__x")))
    counts = stored(rows.groupBy(*by, "__b").agg(F.count("*").alias("times")), "buckets")
    octaves = counts.groupBy(*by, F.shiftright("__b", _BITS).alias("__o")).agg(F.sum("times").alias("times"))
    sizes = octaves.groupBy(*by).agg(F.sum("times").alias("n"))
    ends = [f(F.lit(float(p)) * (F.col("n") - 1)) for p in points for f in (F.floor, F.ceil)]
    wanted = sizes.select(*by, F.explode(F.array_distinct(F.array(*ends))).alias("place")).withColumn("offset", F.col("place"))
    in_octave = _located(octaves, by, "__o", wanted)
    in_bucket = stored(_located(counts.withColumn("__o", F.shiftright("__b", _BITS)), [*by, "__o"], "__b", in_octave).drop("__o"), "wanted")
    needed = in_bucket.select(*by, "__b").distinct()
    few = needed.limit(_FEW + 1).count() <= _FEW
    values = rows.join(F.broadcast(needed) if few else needed, [*by, "__b"], "left_semi").groupBy(*by, "__b", "__x").agg(F.count("*").alias("times"))
    values = stored(values, "values")
    ends_of = values.groupBy(*by, "__b").agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    share = (F.col("__x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    sliced = values.join(ends_of, [*by, "__b"]).withColumn("__s", F.when(F.col("__hi") > F.col("__lo"), F.floor(share * _SLICES)).otherwise(0).cast("long")).drop("__lo", "__hi")
    slices = sliced.groupBy(*by, "__b", "__s").agg(F.sum("times").alias("times"))
    in_slice = _located(slices, [*by, "__b"], "__s", in_bucket)
    found = _located(sliced, [*by, "__b", "__s"], "__x", in_slice)
    at = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("place", "__x"))).alias("__at"))

    def quantile(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.element_at("__at", F.floor(place)), F.element_at("__at", F.ceil(place))
        return F.when(low == high, low).otherwise(low + (place - F.floor(place)) * (high - low))

    out = sizes.join(at, by).withColumn("q", F.array(*[quantile(p) for p in points]))
    return out.select(*keys, "n", "q")
