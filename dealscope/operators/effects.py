"""Leave-one-out group effects with shrinkage, and leave-one-out kernel means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.functions.numeric import key_of
from dealscope.operators.groups import left_by_key
from dealscope.operators.radius import kernel_sums
from dealscope.session import stored


def loo_effect(df: DataFrame, group: str, value: str, shrink: float, effect: str, others: str) -> DataFrame:
    """Sum of the group's other values over (their number + shrink).

    Rows whose value is null are not fitted: they add nothing and receive the
    effect of all fitted members.  A null group has effect 0, and -1 others on a
    fitted row.  The sums are aggregated before the join back, so a large group is
    summed in parts.
    """
    sums = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.sum(value).alias("__s"), F.count(value).alias("__c"))
    joined = left_by_key(df, sums, group)
    fitted = F.col(value).isNotNull().cast("int")
    n = F.coalesce(F.col("__c"), F.lit(0)) - fitted
    total = F.coalesce(F.col("__s"), F.lit(0.0)) - F.coalesce(F.col(value), F.lit(0.0))
    e = F.when(F.col(group).isNull(), 0.0).when(n + shrink > 0, total / (n + F.lit(float(shrink)))).otherwise(0.0)
    return joined.withColumns({effect: e, others: n.cast("bigint")}).drop("__s", "__c")


def nested_effects(df: DataFrame, value: str, levels: Sequence[tuple[str, float]], location: str = "location") -> DataFrame:
    """Effects of each level in turn on what the coarser ones leave; ``location`` is their sum."""
    out = df.withColumn(location, F.lit(0.0))
    for group, shrink in levels:
        out = out.withColumn("__left", F.col(value) - F.col(location))
        out = loo_effect(out, group, "__left", shrink, f"{group}_effect", f"{group}_n_others")
        out = out.withColumn(location, F.col(location) + F.col(f"{group}_effect")).drop("__left")
    return out


def cell_effects(cells: DataFrame, levels: Sequence[tuple[str, float]], n: str, columns: Sequence[str]) -> DataFrame:
    """The nested effects of all rows from one row a cell, a cell being the rows that share all level keys.

    ``cells`` has the level keys, ``n`` fitted rows and the sums of some values over them, ``columns``.  All levels are linear in the
    values, so each column is worked out by itself.  After all levels a fitted row of value v is left with left_of_value * v - off_{column},
    which each level changes by the same factors throughout a cell; at_{column} is the location of rows that are not fitted, and
    {level}_n the fitted rows of the level's group.  A group's sums are aggregated before they are joined back to its cells, and every
    second level is written, so that no group is in one task and plans stay short.
    """
    out = cells.withColumn("left_of_value", F.lit(1.0)).withColumns({f"{p}_{c}": F.lit(0.0) for c in columns for p in ("off", "at")})
    for k, (group, shrink) in enumerate(levels, 1):
        known = F.col(group).isNotNull()
        rest = {c: F.col("left_of_value") * F.col(c) - F.col(f"off_{c}") * F.col(n) for c in columns}
        sums = out.filter(known).groupBy(group).agg(F.sum(n).alias("__n"), *[F.sum(v).alias(f"__s_{c}") for c, v in rest.items()])
        out = left_by_key(out, sums, group)
        others, everyone = F.col("__n") - 1 + F.lit(float(shrink)), F.col("__n") + F.lit(float(shrink))
        share = F.when(known & (others > 0), 1 / others).otherwise(0.0)
        at = F.when(known & (everyone > 0), 1 / everyone).otherwise(0.0)
        total = {c: F.coalesce(F.col(f"__s_{c}"), F.lit(0.0)) for c in columns}
        changed = {f"off_{c}": (1 + share) * F.col(f"off_{c}") + share * v for c, v in total.items()} | {f"at_{c}": F.col(f"at_{c}") + at * v for c, v in total.items()}
        changed |= {"left_of_value": (1 + share) * F.col("left_of_value"), f"{group}_n": F.coalesce(F.col("__n"), F.lit(0.0)).cast("long")}
        out = out.withColumns(changed).drop("__n", *[f"__s_{c}" for c in columns])
        out = out if k % 2 and k < len(levels) else stored(out, "effects")
    return out


def kernel_means(df: DataFrame, row_id: str, value: str, width_km: float, cutoff_km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(id, smooth, n_eff, sum_w): kernel means of the others' values within the cutoff; null values and places are left out.

    n_eff is (sum w)^2 / sum w^2.  Rows without neighbours are absent.  Rows at one place are one place of the kernel, and
    weigh 1 for each other.
    """
    rows = df.select(row_id, F.col(value).cast("double").alias("__v"), *[(F.col(c).cast("double") + F.lit(0.0)).alias(k) for c, k in ((lat, "lat"), (lon, "lon"))]).dropna(subset=["lat", "lon"])
    places = stored(rows.groupBy("lat", "lon").agg(F.count("__v").cast("double").alias("times"), F.coalesce(F.sum("__v"), F.lit(0.0)).alias("total")), "places")
    near = kernel_sums(places, ["total"], width_km, cutoff_km).withColumnRenamed("total", "far_total")
    met = rows.join(places.join(near, ["lat", "lon"], "left").fillna(0.0, ["sum_w", "sum_w2", "far_total"]), ["lat", "lon"])
    others = F.col("times") - F.col("__v").isNotNull().cast("int")
    here = F.when(others > 0, F.col("total") - F.coalesce("__v", F.lit(0.0))).otherwise(0.0)
    met = met.withColumns({"sum_w": F.col("sum_w") + others, "sum_w2": F.col("sum_w2") + others, "__wv": F.col("far_total") + here}).filter("sum_w > 0")
    smooth = F.when(F.col("sum_w") > 1e-12, F.col("__wv") / F.col("sum_w")).otherwise(0.0)
    n_eff = F.when(F.col("sum_w2") > 0, F.col("sum_w") * F.col("sum_w") / F.col("sum_w2")).otherwise(0.0)
    return met.select(row_id, smooth.alias("smooth"), n_eff.alias("n_eff"), "sum_w")


def shrunk(smooth: Column | str, sum_w: Column | str, shrink: float) -> Column:
    a = F.col(smooth) if isinstance(smooth, str) else smooth
    w = F.col(sum_w) if isinstance(sum_w, str) else sum_w
    return a * w / (w + F.lit(float(shrink)))


def building_key(complex_col: str = "complex_name", lat: str = "lat", lon: str = "lon", floors: str = "floor_total", year: str = "build_year") -> Column:
    """One building: its complex (or cell of about 11 m), floors and year; -1 where unknown."""
    f, y = F.coalesce(F.col(floors).cast("int"), F.lit(-1)), F.coalesce(F.col(year).cast("int"), F.lit(-1))
    place = F.concat(F.lit("ll:"), key_of(F.bround(lat, 4), F.bround(lon, 4), sep=","))
    return F.concat_ws("|", F.when(F.col(complex_col).isNotNull(), F.concat(F.lit("cx:"), F.col(complex_col).cast("string"))).otherwise(place), f.cast("string"), y.cast("string"))
