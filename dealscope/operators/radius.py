"""Exact neighbour joins within a radius, and figures of everything near a place.

Pairs come from cells, a halo, an equi-join, then the exact distance.  A cell is at least the radius wide in both axes, its
longitude step taken at the highest latitude present, so that all neighbours of a point lie in its cell or the
eight around it.  Figures come from a cell tree (:mod:`dealscope.operators.celltree`), without a row a pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealscope.functions.geo import gaussian, haversine_km
from dealscope.operators.celltree import CellTree, cell_steps, cell_tree, leaf_pairs, measured_sums, near_sums, rough_cell, squared_chord_of, squared_chords
from dealscope.session import stored


def _points(df: DataFrame, row_id: str, lat: str, lon: str, value: str | None) -> DataFrame:
    p = df.select(F.col(row_id).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), (F.col(value).cast("double") if value else F.lit(0.0)).alias("v"))
    return p.dropna()


def _cells(p: DataFrame, radius_km: float) -> DataFrame:
    dy, dx = cell_steps(p, radius_km)
    return p.withColumns({"cy": F.floor(F.col("lat") / dy), "cx": F.floor(F.col("lon") / dx)})


def _dealt(cell: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Each cell's own points, dealt into parts b of about ``block``, and the points in and around it, for every part; both with the cell's key (cy, cx)."""
    around = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    halo = cell.withColumn("o", F.explode(F.array(*around))).withColumns({"cy": F.col("cy") + F.col("o.a"), "cx": F.col("cx") + F.col("o.b")}).drop("o")
    counts = cell.groupBy("cy", "cx").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    own = cell.join(counts, ["cy", "cx"]).withColumn("b", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    halo = halo.join(counts, ["cy", "cx"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["cy", "cx", "b", "id", "lat", "lon", "v"]
    return own.select(*columns), halo.select(*columns)


def neighbour_pairs(df: DataFrame, radius_km: float, row_id: str, lat: str = "lat", lon: str = "lon", value: str | None = None, block: int = 2048) -> DataFrame:
    """(i, j, distance_km, v) for all ordered pairs within the radius, i not j; v is j's value.

    Rows with a null coordinate or value take no part.  Points at one place are neighbours.  A crowded cell's points meet
    those around it in parts of about ``block``.
    """
    own, halo = _dealt(_cells(_points(df, row_id, lat, lon, value), radius_km), block)
    own = own.select(F.col("id").alias("i"), "lat", "lon", "cy", "cx", "b")
    halo = halo.select(F.col("id").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "v", "cy", "cx", "b")
    near = own.join(halo, ["cy", "cx", "b"]).filter(F.col("i") != F.col("j")).withColumn("distance_km", haversine_km("lat", "lon", "lat2", "lon2"))
    return near.filter(F.col("distance_km") <= radius_km).select("i", "j", "distance_km", "v")


def radius_stats(df: DataFrame, radius_km: float, row_id: str, value: str, lat: str = "lat", lon: str = "lon", per_leaf: int = 512) -> DataFrame:
    """(id, n, mean, median) of the others within the radius; every row of df has a result.

    Rows without a place or value, or without neighbours, have n 0 and null figures.
    """
    return radii_stats(df, [radius_km], row_id, value, lat, lon, per_leaf).withColumnsRenamed({f"{c}_0": c for c in ("n", "mean", "median")})


def radii_stats(df: DataFrame, radii: Sequence[float], row_id: str, value: str, lat: str = "lat", lon: str = "lon", per_leaf: int = 512, most_near: int = 4096) -> DataFrame:
    """(id, n_k, mean_k, median_k) of the others within each radius k, over one cell tree; every row of df has a result.

    Rows at one place are one place with their number, sum and counts of values by range.  Sums over the places near, whole leaves by
    their totals, give numbers, means, and the ranges that hold the middle values; only the values of those
    ranges are then looked at, in ranges of about ``most_near``.
    """
    points = _points(df, row_id, lat, lon, value)
    # -0.0 is the place 0.0
    points = points.withColumns({c: F.col(c) + F.lit(0.0) for c in ("lat", "lon")})
    values = stored(points.groupBy("lat", "lon", "v").agg(F.count("*").alias("times")), "values")
    edges = _ranges(values, max(radii), most_near)
    # the range of a value is the number of edges up to it
    of_value = F.size(F.filter(F.array(*[F.lit(x) for x in edges]), lambda e: e <= F.col("v"))) if edges else F.lit(0)
    counts = {f"h{k}": F.sum(F.when(of_value == k, F.col("times")).otherwise(0)).cast("double") for k in range(len(edges) + 1)}
    places = values.groupBy("lat", "lon").agg(F.sum(F.col("v") * F.col("times")).alias("s"), *[c.alias(k) for k, c in counts.items()])
    tree = cell_tree(places, max(radii), ["s", *counts], per_leaf)
    sums, pairs = near_sums(tree, radii, ["s", *counts])
    total = {f"all_{k}": sum((F.col(f"{h}_{k}") for h in counts), F.lit(0.0)).cast("long") for k in range(len(radii))}
    sums = stored(sums.withColumns(total), "near")
    middle = _middle_values(tree, pairs, sums, values.withColumn("range", of_value), radii, len(edges) + 1)
    out = points.join(sums.select("lat", "lon", *[f"s_{k}" for k in range(len(radii))], *total), ["lat", "lon"])
    figures = out.select("id", "lat", "lon", "v", *[f"s_{k}" for k in range(len(radii))], *total).join(middle, ["lat", "lon"], "left")
    found = [F.col("id")]
    for k in range(len(radii)):
        n = F.col(f"all_{k}") - 1
        # the row's own value leaves the sorted values one shorter: what stands after it moves up
        places_of = [F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")]
        held = [F.col(f"m{k}")[p - places_of[0]] for p in places_of]
        after = [F.col(f"m{k}")[p - places_of[0] + 1] for p in places_of]
        left = [F.when(F.col("v") > a, a).otherwise(b) for a, b in zip(held, after, strict=True)]
        some = n > 0
        found += [n.alias(f"n_{k}"), F.when(some, (F.col(f"s_{k}") - F.col("v")) / n).alias(f"mean_{k}"), F.when(some, (left[0] + left[1]) / 2).alias(f"median_{k}")]
    s = figures.select(*found)
    rows = df.select(F.col(row_id).alias("id")).join(s, "id", "left")
    return rows.select(F.col("id").alias(row_id), *[c for k in range(len(radii)) for c in (F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}"), F.col(f"mean_{k}"), F.col(f"median_{k}"))])


def _ranges(values: DataFrame, reach_km: float, most_near: int) -> list[float]:
    """Edges of value ranges, as many as leave about ``most_near`` values a range to the fullest neighbourhood; at most 255."""
    cells = values.groupBy(rough_cell(reach_km)).agg(F.count("*").alias("n"))
    fullest = 9 * (cells.agg(F.max("n")).first()[0] or 0)
    most = min(256, -(-fullest // most_near))
    if most < 2:
        return []
    points = F.array(*[F.lit(k / most) for k in range(1, most)])
    return sorted(set(values.agg(F.percentile_approx("v", points, 10_000)).first()[0]))


def _middle_values(tree: CellTree, pairs: DataFrame, sums: DataFrame, values: DataFrame, radii: Sequence[float], n_ranges: int) -> DataFrame:
    """(lat, lon, m0, m1, ...): for each place and radius the sorted values near it from place (n - 2) div 2 on, three or fewer, n with its own ones."""
    def places_of(n: Column) -> Column:
        first = F.floor((n - 2) / 2).cast("long")
        return F.sequence(first, F.least(first + 2, n - 1))

    wanted = []
    for k in range(len(radii)):
        counts = F.array(*[F.col(f"h{r}_{k}").cast("long") for r in range(n_ranges)])
        wanted.append(sums.filter(F.col(f"all_{k}") > 1).select("leaf", "lat", "lon", F.lit(k).alias("k"), places_of(F.col(f"all_{k}")).alias("places"), counts.alias("__h")))
    rows = wanted[0]
    for w in wanted[1:]:
        rows = rows.unionByName(w)
    # for each range, how many values stand before it; then the places that fall into it, counted from its start
    before = F.transform(F.sequence(F.lit(0), F.lit(n_ranges - 1)), lambda r: F.aggregate(F.slice("__h", 1, r), F.lit(0).cast("long"), lambda t, x: t + x))
    rows = rows.withColumn("__b", before)
    inside = F.transform(F.sequence(F.lit(0), F.lit(n_ranges - 1)), lambda r: F.struct(
        r.alias("range"),
        F.transform(F.filter("places", lambda p: (p >= F.col("__b")[r]) & (p < F.col("__b")[r] + F.col("__h")[r])), lambda p: p - F.col("__b")[r]).alias("offsets"),
    ))
    rows = rows.select("leaf", "lat", "lon", "k", F.explode(F.filter(inside, lambda x: F.size(x["offsets"]) > 0)).alias("x")).select("leaf", "lat", "lon", "k", "x.range", "x.offsets")
    rows = stored(rows, "wanted")
    of_leaf = tree.places().withColumnRenamed("leaf", "near").join(values, ["lat", "lon"])
    needed = rows.select("leaf", "k", "range").distinct()
    hows = F.array(*[F.col(f"r{k}") for k in range(len(radii))])
    met = needed.join(pairs.select("leaf", "near", hows.alias("how")), "leaf").filter(F.col("how")[F.col("k")] > 0).select("leaf", "near", "k", "range").join(of_leaf, ["near", "range"])
    both = met.select("leaf", "k", "range", "lat", "lon", "v", "times", F.lit(None).cast("array<bigint>").alias("offsets")).unionByName(rows.select("leaf", "k", "range", "lat", "lon", F.lit(0.0).alias("v"), F.lit(0).cast("long").alias("times"), "offsets"))
    reach = list(radii)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["offsets"].notna()
        mine, near = pdf[own], pdf[~own].sort_values("v", kind="stable")
        lat, lon, v, times = (near[c].to_numpy() for c in ("lat", "lon", "v", "times"))
        radius, out = squared_chord_of(reach[int(pdf["k"].iloc[0])]), []
        stripe = max(1, 4_000_000 // max(1, len(near)))
        for at in range(0, len(mine), stripe):
            part = mine[at : at + stripe]
            inside = squared_chords(part["lat"].to_numpy(), part["lon"].to_numpy(), lat, lon) <= radius
            # the value at an offset is the first one up to which there are more values than that
            upto = np.cumsum(inside * times, axis=1)
            for a, b, offsets, row in zip(part["lat"], part["lon"], part["offsets"], upto, strict=True):
                out.append((a, b, pdf["k"].iloc[0], pdf["range"].iloc[0], v[np.searchsorted(row, offsets, side="right")].tolist()))
        return pd.DataFrame(out, columns=["lat", "lon", "k", "range", "found"])

    found = both.groupBy("leaf", "k", "range").applyInPandas(pick, "lat double, lon double, k int, range int, found array<double>")
    held = [F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("range", "found")))), lambda x: x["found"])).alias(f"m{k}") for k in range(len(radii))]
    return found.groupBy("lat", "lon").agg(*held)


def kernel_sums(places: DataFrame, columns: Sequence[str], width_km: float, cutoff_km: float, times: str = "times", per_leaf: int = 128) -> DataFrame:
    """(lat, lon, sum_w, sum_w2, {column}): Gaussian-weighted sums over the other places within the cutoff.

    ``places`` have different (lat, lon) and no nulls; ``times`` is how often a place counts in the sums of weights.  No pair of
    places is a row.
    """
    held = list(dict.fromkeys([times, *columns]))
    tree = cell_tree(places, cutoff_km, held, per_leaf)
    pairs = leaf_pairs(tree, [cutoff_km], shortcuts=False)
    s = measured_sums(tree, pairs, [cutoff_km], held, width_km, [times])
    return s.select("lat", "lon", F.col(f"{times}_0").alias("sum_w"), F.col(f"{times}_0_sq").alias("sum_w2"), *[F.col(f"{c}_0").alias(c) for c in columns])


def kernel_edges(df: DataFrame, width_km: float, cutoff_km: float, row_id: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(i, j, w) with Gaussian weights of the distance, within the cutoff, i not j; for few neighbours, else see :func:`kernel_sums`."""
    return neighbour_pairs(df, cutoff_km, row_id, lat, lon).select("i", "j", gaussian("distance_km", width_km).alias("w"))


def landmark_distances(df: DataFrame, row_id: str, lat: str, lon: str, landmarks: DataFrame) -> DataFrame:
    """(id, name, distance_km, nearest) for each row and each of a few landmarks (name, lat, lon)."""
    spots = landmarks.select("name", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    if (n := spots.limit(10_001).count()) > 10_000:
        raise ValueError(f"more than {n - 1} landmarks: use neighbour_pairs")
    far = df.select(F.col(row_id), F.col(lat).alias("__a"), F.col(lon).alias("__b")).crossJoin(F.broadcast(spots)).withColumn("distance_km", haversine_km("__a", "__b", "__lat", "__lon"))
    nearest = F.row_number().over(Window.partitionBy(row_id).orderBy("distance_km", "name")) == 1
    return far.select(row_id, "name", "distance_km", nearest.alias("nearest"))
