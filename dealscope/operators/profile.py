"""Distribution figures: exact quantiles, robust scores, correlations, missing values, outliers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.operators.groups import by_group
from dealscope.operators.quantiles import group_quantiles

#: Values that one task may hold to pick quantiles from; more are counted by buckets first.
MOST_VALUES = 1_000_000


def exact_quantiles(df: DataFrame, c: str | Column, points: Sequence[float], most: int = MOST_VALUES) -> list[float | None]:
    """Quantiles of the non-null values, by linear interpolation; nulls where there are none.

    Beyond ``most`` values they come from :func:`group_quantiles`, to the same results.
    """
    x = df.select((F.col(c) if isinstance(c, str) else c).cast("double").alias("x")).filter("x is not null")
    if x.limit(most + 1).count() <= most:
        return list(x.agg(F.percentile("x", F.array(*[F.lit(float(p)) for p in points]))).first()[0] or [None] * len(points))
    return list(group_quantiles(x, [], "x", points).first()["q"])


def column_quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float], most: int = MOST_VALUES) -> dict[str, list[float | None]]:
    """:func:`exact_quantiles` of several columns in the same passes."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if x.limit(most + 1).count() <= most:
        row = x.agg(*[F.percentile(c, F.array(*[F.lit(float(p)) for p in points])).alias(c) for c in columns]).first()
        return {c: list(row[c] or [None] * len(points)) for c in columns}
    found = {r["column_name"]: list(r["q"]) for r in group_quantiles(x.unpivot([], list(columns), "column_name", "value"), ["column_name"], "value", points).collect()}
    return {c: found.get(c, [None] * len(points)) for c in columns}


def quantiles(df: DataFrame, c: str, points: Sequence[float]) -> DataFrame:
    """(point, value), by linear interpolation; values are null where there are none."""
    at = F.posexplode(F.array(*[F.lit(float(p)) for p in points])).alias("__k", "point")
    found = group_quantiles(df, [], c, points).select(F.posexplode("q").alias("__k", "value"))
    return df.sparkSession.range(1).select(at).join(found, "__k", "left").select("point", "value")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: count, mean, sample deviation, least, quartiles, greatest; null where there are no values."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "value")
    q = group_quantiles(long, ["column_name"], "value", [0.25, 0.5, 0.75])
    plain = long.groupBy("column_name").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    met = plain.join(q.select("column_name", "q"), "column_name", "left")
    return met.select("column_name", "n", "mean", "sd", "min", *[F.element_at("q", k + 1).alias(f"q{p}") for k, p in enumerate((25, 50, 75))], "max")


def robust_z(df: DataFrame, c: str, name: str, where: Column | None = None, negate: bool = False) -> DataFrame:
    """(x - median) / (1.4826 MAD) over the rows where ``where`` holds; 0 everywhere if the MAD is 0 or unknown."""
    x = F.when(F.coalesce(where, F.lit(False)), F.col(c)) if where is not None else F.col(c)
    x = -x if negate else x
    with_x = df.withColumn("__x", x.cast("double"))
    m = exact_quantiles(with_x, "__x", [0.5])[0]
    s = None if m is None else exact_quantiles(with_x, F.abs(F.col("__x") - F.lit(m)), [0.5])[0]
    z = (F.col("__x") - F.lit(m)) / F.lit(s * 1.4826) if s else F.lit(0.0)
    return with_x.withColumn(name, z).drop("__x")


def population_z(df: DataFrame, c: str, name: str, negate: bool = False) -> DataFrame:
    stats = df.agg(F.avg(c).alias("__m"), F.stddev_pop(c).alias("__s"))
    z = F.try_divide(F.col(c) - F.col("__m"), F.col("__s"))
    return df.crossJoin(F.broadcast(stats)).withColumn(name, -z if negate else z).drop("__m", "__s")


def pearson(a: Column | str, b: Column | str) -> Column:
    """Aggregate correlation over the rows that have both; null where one of them does not vary."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation(df: DataFrame, a: str, b: str, where: Column | None = None) -> DataFrame:
    rows = df.filter(where) if where is not None else df
    return rows.agg(pearson(a, b).alias("correlation"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, correlation) of each unordered pair, over the rows that have both."""
    pairs = list(combinations_with_replacement(columns, 2))
    cells = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pearson(a, b).alias("correlation")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return cells.select(F.explode(F.array(*[F.col(f"c{k}") for k in range(len(pairs))])).alias("c")).select("c.*")


def missingness(df: DataFrame, columns: Sequence[str], unknown: dict[str, str] | None = None) -> DataFrame:
    """One row a column: present, missing, coverage; a column's ``unknown`` value counts as missing."""
    known = {c: F.col(c).isNotNull() if c not in (unknown or {}) else F.coalesce(F.col(c) != unknown[c], F.lit(False)) for c in columns}
    counted = df.agg(F.count("*").alias("__all"), *[F.count_if(known[c]).alias(c) for c in columns])
    long = counted.unpivot(["__all"], list(columns), "column_name", "present")
    return long.select("column_name", "present", (F.col("__all") - F.col("present")).alias("missing"), F.try_divide(F.col("present"), F.col("__all")).alias("coverage"))


def list_counts(df: DataFrame, list_col: str, name: str = "item") -> DataFrame:
    """How often each item occurs in the lists."""
    return df.select(F.explode(list_col).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def iqr_outliers(df: DataFrame, group: str, value: str, least: int = 10) -> DataFrame:
    """(group, n, outliers, share) of groups of ``least`` values or more: strictly outside 1.5 quartile ranges."""
    rows = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).select(group, value)
    q = group_quantiles(rows, [group], value, [0.25, 0.75]).filter(F.col("n") >= least).select(group, F.element_at("q", 1).alias("q1"), F.element_at("q", 2).alias("q3"))
    far = (F.col(value) < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) | (F.col(value) > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return by_group(rows, q, group).groupBy(group).agg(F.count("*").alias("n"), F.count_if(far).alias("outliers"), (F.count_if(far) / F.count("*")).alias("share"))


def ratio_outliers(df: DataFrame, group: str, value: str, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Rows whose value is outside [low, high] times the group's median."""
    medians = group_quantiles(df, [group], value, [0.5]).select(group, F.element_at("q", 1).alias("group_median"))
    r = F.try_divide(F.col(value), F.col("group_median"))
    return by_group(df, medians, group).withColumn("ratio", r).filter((F.col("ratio") < low) | (F.col("ratio") > high))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins from 1; values at the upper end are in the last bin, values outside are left out."""
    x = df.select(value.cast("double").alias("x")).filter((F.col("x") >= low) & (F.col("x") <= high))
    return x.groupBy(F.least(F.lit(bins), F.floor((F.col("x") - low) / ((high - low) / bins)).cast("int") + 1).alias("bin")).agg(F.count("*").alias("n"))


def smallest_mode(c: Column | str) -> Column:
    """Most frequent value, the smallest on ties."""
    return F.mode(c, True)
