"""An adaptive cell tree over places, and sums over everything near each of them.

Cells of the reach's width or more are split in four while they hold more than ``per_leaf`` places; the leaves, with their places
packed as arrays, are what is joined.  Two leaves meet only if their boxes are near enough.  Where all
of a leaf is within the radius of all of another, its totals are added without any distance; else the distances are one
numpy matrix.  There is never a row a pair of places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.functions.geo import EARTH_KM
from dealscope.session import stored

_KM_PER_DEGREE = math.pi * EARTH_KM / 180
#: So many split cells are broadcast to the places; more are joined by shuffle.
BROADCAST_CELLS = 100_000
#: Boxes nearer than this to a radius count as cut by it, so that rounding never decides.
_MARGIN_KM = 1e-7


def lat_step(reach_km: float) -> float:
    """Degrees of latitude of cells that are ``reach_km`` high."""
    return reach_km / _KM_PER_DEGREE * 1.0000001


def cell_steps(points: DataFrame, reach_km: float) -> tuple[float, float]:
    """Degrees of latitude and longitude of cells at least ``reach_km`` wide wherever there are points."""
    return _steps(points.agg(F.max(F.abs("lat"))).first()[0] or 0.0, reach_km)


def _steps(top: float, reach_km: float) -> tuple[float, float]:
    lat = lat_step(reach_km)
    return lat, min(360.0, lat / max(1e-6, math.cos(math.radians(min(89.999, top)))) * 1.001)


def rough_cell(reach_km: float) -> Column:
    """A cell of about the reach's width, whatever latitudes there are; for counting how full such cells are."""
    y = F.floor(F.col("lat") / lat_step(reach_km))
    return F.struct(y, F.floor(F.col("lon") * F.cos(F.radians(y * lat_step(reach_km))) / lat_step(reach_km)))


def squared_chords(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Squares of the straight lines through the unit globe from each of the first places to each of the second ones, degrees given.

    Differences of coordinates keep short lines as exact as the haversine formula does.
    """

    def units(lat: np.ndarray, lon: np.ndarray) -> list[np.ndarray]:
        a, b = np.radians(lat), np.radians(lon)
        return [np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)]

    total = np.zeros((len(lat1), len(lat2)))
    for u, v in zip(units(lat1, lon1), units(lat2, lon2), strict=True):
        d = u[:, None] - v
        d *= d
        total += d
    return total


def squared_chord_of(km: float) -> float:
    return (2 * math.sin(min(math.pi / 2, km / (2 * EARTH_KM)))) ** 2


@dataclass
class CellTree:
    """``leaves``: leaf, cell (cy, cx), box, and lat, lon and each column as arrays of one order."""

    leaves: DataFrame
    columns: list[str]

    def places(self) -> DataFrame:
        """(leaf, lat, lon) of every place."""
        return self.leaves.select("leaf", F.explode(F.arrays_zip("lat", "lon")).alias("p")).select("leaf", "p.lat", "p.lon")


def cell_tree(places: DataFrame, reach_km: float, columns: Sequence[str], per_leaf: int = 512, depth: int = 10) -> CellTree:
    """The tree over ``places``, which have different (lat, lon), known, and number columns without nulls.

    Counting decides the splits: a cell's places are counted at every level at once.  Cells of the last level that
    still hold too many are dealt into parts.  Where places are few, cells are wider than the reach, so that leaves are worth a matrix.
    """
    n, cells, top = places.agg(F.count("*"), F.approx_count_distinct(rough_cell(reach_km)), F.max(F.abs("lat"))).first()
    wider = min(8, max(0, math.ceil(math.log(per_leaf * max(1, cells) / (4 * max(1, n)), 4))))
    dy, dx = (step * (1 << wider) for step in _steps(top or 0.0, reach_km))
    depth += wider
    fine = places.select("lat", "lon", *columns).withColumns({"__y": F.floor(F.col("lat") / dy * (1 << depth)), "__x": F.floor(F.col("lon") / dx * (1 << depth))})
    at = [F.expr(f"shiftright({c}, {depth} - l)").alias(a) for c, a in (("__y", "y"), ("__x", "x"))]
    counts = fine.select("__y", "__x", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("l")).groupBy("l", *at).agg(F.count("*").alias("n")).filter(F.col("n") > per_leaf)
    # a few cells are taken as they are, more are written
    found = counts.limit(BROADCAST_CELLS + 1).collect()
    few = len(found) <= BROADCAST_CELLS
    heavy = places.sparkSession.createDataFrame(found, counts.schema) if few else stored(counts, "cells")
    deepest = max((r["l"] for r in found), default=None) if few else depth
    level, part = F.lit(0), F.lit(0)
    for k in range(0 if deepest is None else deepest + 1):
        cells = heavy.filter(F.col("l") == k).select(F.col("y").alias(f"__y{k}"), F.col("x").alias(f"__x{k}"), F.col("n").alias(f"__n{k}"))
        keys = [F.shiftright(c, depth - k) == F.col(f"{c}{k}") for c in ("__y", "__x")]
        fine = fine.join(F.broadcast(cells) if few else cells, keys[0] & keys[1], "left").drop(f"__y{k}", f"__x{k}")
        if k < depth:
            level = level + F.col(f"__n{k}").isNotNull().cast("int")
        else:
            part = F.coalesce(F.pmod(F.xxhash64("lat", "lon"), F.ceil(F.col(f"__n{k}") / per_leaf)), F.lit(0))
    own = [F.expr(f"shiftright({c}, {depth} - __level)") for c in ("__y", "__x")]
    fine = fine.withColumn("__level", level).withColumn("leaf", F.concat_ws("/", F.col("__level").cast("string"), *[c.cast("string") for c in own], part.cast("string")))
    placed = fine.select("leaf", F.shiftright("__y", depth).alias("cy"), F.shiftright("__x", depth).alias("cx"), "lat", "lon", *columns)
    box = [f(c).alias(f"{f.__name__}_{c}") for c in ("lat", "lon") for f in (F.min, F.max)]
    packed = placed.groupBy("leaf").agg(F.first("cy").alias("cy"), F.first("cx").alias("cx"), *box, F.collect_list(F.struct("lat", "lon", *columns)).alias("__p"), *[F.sum(c).alias(f"all_{c}") for c in columns])
    held = ["lat", "lon", *columns]
    leaves = packed.select("leaf", "cy", "cx", "min_lat", "max_lat", "min_lon", "max_lon", *[F.col(f"__p.{c}").alias(c) for c in held], *[f"all_{c}" for c in columns])
    return CellTree(stored(leaves, "leaves"), list(columns))


def _bounds(a: str, b: str) -> tuple[Column, Column]:
    """Least and greatest km between the places of two boxes, whose columns start with ``a`` and ``b``."""

    def gap(c: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(f"{a}min_{c}") - F.col(f"{b}max_{c}"), F.col(f"{b}min_{c}") - F.col(f"{a}max_{c}"))

    def span(c: str) -> Column:
        return F.greatest(F.col(f"{a}max_{c}") - F.col(f"{b}min_{c}"), F.col(f"{b}max_{c}") - F.col(f"{a}min_{c}"))

    ends = [F.abs(F.radians(F.col(f"{s}{m}_lat"))) for s in (a, b) for m in ("min", "max")]
    crosses = F.greatest(F.col(f"{a}max_lat"), F.col(f"{b}max_lat")) * F.least(F.col(f"{a}min_lat"), F.col(f"{b}min_lat")) <= 0
    narrow, wide = F.cos(F.greatest(*ends)), F.when(crosses, 1.0).otherwise(F.cos(F.least(*ends)))

    def km(lat: Column, lon: Column, shrink: Column) -> Column:
        h = F.pow(F.sin(F.radians(lat) / 2), F.lit(2.0)) + F.pow(shrink * F.sin(F.radians(F.least(lon, F.lit(180.0))) / 2), F.lit(2.0))
        return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))

    return km(gap("lat"), gap("lon"), narrow), km(span("lat"), span("lon"), wide)


def leaf_pairs(tree: CellTree, radii: Sequence[float], shortcuts: bool = True) -> DataFrame:
    """(leaf, near, r0, r1, ...) for the leaves that come within the largest radius of each other, a leaf and itself included.

    rk is 2 where all of ``near`` is within radius k of all of ``leaf`` (with ``shortcuts``), 1 where that has to be measured, 0
    where nothing is.
    """
    boxes = ["leaf", "cy", "cx", "min_lat", "max_lat", "min_lon", "max_lon"]
    around = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    own = tree.leaves.select(*[F.col(c).alias(f"a_{c}") for c in boxes]).withColumn("o", F.explode(F.array(*around)))
    own = own.withColumns({"cy": F.col("a_cy") + F.col("o.a"), "cx": F.col("a_cx") + F.col("o.b")})
    near = tree.leaves.select("cy", "cx", *[F.col(c).alias(f"b_{c}") for c in boxes if c not in ("cy", "cx")])
    low, high = _bounds("a_", "b_")
    met = own.join(near, ["cy", "cx"]).withColumns({"__low": low, "__high": high}).filter(F.col("__low") <= max(radii) + _MARGIN_KM)
    how = [F.when((F.col("__high") <= r - _MARGIN_KM) & F.lit(shortcuts), 2).when(F.col("__low") <= r + _MARGIN_KM, 1).otherwise(0).cast("int").alias(f"r{k}") for k, r in enumerate(radii)]
    return stored(met.select(F.col("a_leaf").alias("leaf"), F.col("b_leaf").alias("near"), *how), "pairs")


def measured_sums(tree: CellTree, pairs: DataFrame, radii: Sequence[float], columns: Sequence[str], width_km: float | None = None, squares: Sequence[str] = ()) -> DataFrame:
    """(lat, lon, {column}_{k}) for each place and radius k: sums of the columns over the places near it.

    Each place near counts once, itself too; with ``width_km`` it counts by a Gaussian weight of its distance, itself not at all, and
    {column}_{k}_sq are sums by the squares of the weights.
    """
    names = [f"{c}_{k}" for k in range(len(radii)) for c in columns] + [f"{c}_{k}_sq" for k in range(len(radii)) for c in squares]
    a = tree.leaves.select("leaf", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = tree.leaves.select(F.col("leaf").alias("near"), *[F.col(c).alias(f"b_{c}") for c in ("lat", "lon", *columns)])
    cut = pairs.filter(F.greatest(*[(F.col(f"r{k}") == 1).cast("int") for k in range(len(radii))], F.lit(0)) == 1)
    met = cut.join(b, "near").join(a, "leaf")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pd.DataFrame]:
            for lat, lon, total in held.values():
                yield pd.DataFrame({"lat": lat, "lon": lon} | {c: total[:, k] for k, c in enumerate(names)})
            held.clear()

        for pdf in batches:
            for r in pdf.to_dict("records"):
                if r["leaf"] not in held:
                    # rows come leaf by leaf from a sort, in any order from a broadcast
                    if len(held) >= 64:
                        yield from out()
                    held[r["leaf"]] = (r["a_lat"], r["a_lon"], np.zeros((len(r["a_lat"]), len(names))))
                total = held[r["leaf"]][2]
                far = squared_chords(r["a_lat"], r["a_lon"], r["b_lat"], r["b_lon"])
                v = np.column_stack([r[f"b_{c}"] for c in columns])
                sq = [columns.index(c) for c in squares]
                for k, radius in enumerate(radii):
                    if r[f"r{k}"] != 1:
                        continue
                    near = far <= squared_chord_of(radius)
                    w = near.astype(float)
                    if width_km is not None:
                        w[near] = np.exp(-0.5 * (2 * EARTH_KM / width_km * np.arcsin(np.minimum(1.0, np.sqrt(far[near]) / 2))) ** 2)
                        if r["leaf"] == r["near"]:
                            np.fill_diagonal(w, 0.0)
                    total[:, k * len(columns) : (k + 1) * len(columns)] += w @ v
                    if sq:
                        first = len(radii) * len(columns) + k * len(sq)
                        total[:, first : first + len(sq)] += (w * w) @ v[:, sq]
        yield from out()

    sums = met.mapInPandas(run, ", ".join(f"{c} double" for c in ("lat", "lon", *names)))
    return sums.groupBy("lat", "lon").agg(*[F.sum(c).alias(c) for c in names])


def whole_sums(tree: CellTree, pairs: DataFrame, radii: Sequence[float], columns: Sequence[str]) -> DataFrame:
    """(leaf, {column}_{k}): totals of the leaves that are within radius k as a whole."""
    totals = tree.leaves.select(F.col("leaf").alias("near"), *[F.col(f"all_{c}") for c in columns])
    whole = pairs.filter(F.greatest(*[F.col(f"r{k}") for k in range(len(radii))], F.lit(0)) == 2).join(totals, "near")
    return whole.groupBy("leaf").agg(*[F.sum(F.when(F.col(f"r{k}") == 2, F.col(f"all_{c}")).otherwise(0.0)).alias(f"{c}_{k}") for k in range(len(radii)) for c in columns])


def near_sums(tree: CellTree, radii: Sequence[float], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(lat, lon, leaf, {column}_{k}) of every place, itself included, and the leaf pairs."""
    pairs = leaf_pairs(tree, radii)
    names = [f"{c}_{k}" for k in range(len(radii)) for c in columns]
    measured = measured_sums(tree, pairs, radii, columns).withColumnsRenamed({c: f"m_{c}" for c in names})
    whole = whole_sums(tree, pairs, radii, columns).withColumnsRenamed({c: f"w_{c}" for c in names})
    out = tree.places().join(measured, ["lat", "lon"], "left").join(whole, "leaf", "left")
    return out.select("leaf", "lat", "lon", *[(F.coalesce(f"m_{c}", F.lit(0.0)) + F.coalesce(f"w_{c}", F.lit(0.0))).alias(c) for c in names]), pairs
