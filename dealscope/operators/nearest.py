"""The nearest of a table's places or line segments to each row, by growing rings of cells.

Rows are gathered into small cells, and the search is for those: round by round the ring grows fourfold, until what was found bounds
the distance of all rows in the cell by the ring's width.  What can be nearest to some row in the cell are then the
targets whose distance from its centre is within twice its half width of the best; rows meet only those, and take the nearest exactly.
Every join is on cell keys.  Longitudes do not wrap around.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealscope.functions.geo import EARTH_KM, haversine_km
from dealscope.operators.celltree import cell_steps, lat_step
from dealscope.session import stored

#: Rings are up to 2 ** 26 first cells wide: from a metre on that goes around the earth.
_WIDEST = 26
#: Rounding may not part a target from its bound.
_MARGIN_KM = 1e-7


def _segment_degrees(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column, shrink: Column) -> Column:
    """Degrees of :func:`segment_km`, worked out factor by factor from the left and squared by products, as plain SQL would: where segments tie, the last bit decides."""
    ax, ay, dx, by = (lon1 - lon) * shrink, lat1 - lat, lon2 - lon1, lat2 - lat1
    along = F.try_divide(-(ax * dx * shrink + ay * by), dx * shrink * dx * shrink + by * by)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    east, north = ax + t * dx * shrink, ay + t * by
    return F.sqrt(east * east + north * north)


def segment_km(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column, shrink: Column) -> Column:
    """km from a place to a segment on the plane that touches at the place: east-west degrees count ``shrink``, the cosine of its latitude."""
    return F.radians(_segment_degrees(lat, lon, lat1, lon1, lat2, lon2, shrink)) * EARTH_KM


def _crossed(targets: DataFrame, dy: float, dx: float) -> DataFrame:
    """``targets`` once for every cell (y, x) that their segment from (lat1, lon1) to (lat2, lon2) touches, or a cell more on either side."""
    south, north = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    rows = targets.withColumn("y", F.explode(F.sequence(F.floor(south / dy), F.floor(north / dy))))

    def lon_at(edge: Column) -> Column:
        t = F.coalesce(F.try_divide(edge - F.col("lat1"), F.col("lat2") - F.col("lat1")), F.lit(0.0))
        return F.col("lon1") + t * (F.col("lon2") - F.col("lon1"))

    level = F.col("lat1") == F.col("lat2")
    enter, leave = F.greatest(south, F.col("y") * dy), F.least(north, (F.col("y") + 1) * dy)
    a, b = F.when(level, F.col("lon1")).otherwise(lon_at(enter)), F.when(level, F.col("lon2")).otherwise(lon_at(leave))
    slack = dx * 1e-6
    return rows.withColumn("x", F.explode(F.sequence(F.floor((F.least(a, b) - slack) / dx), F.floor((F.greatest(a, b) + slack) / dx))))


def _spacing(targets: DataFrame) -> float:
    """About half the distance between neighbouring targets, were they spread evenly over their box; 0.01 to 100 km."""
    n, a, b, c, d = targets.agg(F.count("*"), F.min("lat1"), F.max("lat1"), F.min("lon1"), F.max("lon1")).first()
    if not n:
        return 1.0
    high, wide = math.radians(b - a) * EARTH_KM, math.radians(d - c) * EARTH_KM * math.cos(math.radians((a + b) / 2))
    return min(100.0, max(0.01, math.sqrt(high * wide / n) / 2))


def _nearest(df: DataFrame, row_id: str, lat: str, lon: str, targets: DataFrame, exact: Callable[[Column, Column], Column], low: Callable, high: Callable, first_km: float) -> DataFrame:
    """(row_id, name, distance_km); ``targets`` (target, name, lat1, lon1, lat2, lon2); ``exact`` gives the metres from a row, ``low`` and ``high`` km from the centre of a cell."""
    rows = df.select(F.col(row_id).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).dropna()
    ends = [F.struct(F.col(f"lat{k}").alias("lat"), F.col(f"lon{k}").alias("lon")) for k in (1, 2)]
    everywhere = rows.select("lat", "lon").unionByName(targets.select(F.explode(F.array(*ends)).alias("e")).select("e.lat", "e.lon"))
    dy, dx = cell_steps(everywhere, first_km)
    placed = rows.withColumns({"cy": F.floor(F.col("lat") / dy), "cx": F.floor(F.col("lon") / dx)})
    cells = placed.select("cy", "cx").distinct().withColumns({"lat": (F.col("cy") + 0.5) * dy, "lon": (F.col("cx") + 0.5) * dx})
    # at each latitude of a cell half its width is at most this
    half = F.radians(F.sqrt(F.pow(F.lit(dy), F.lit(2.0)) + F.pow(F.lit(dx) * F.cos(F.radians(F.least(F.abs("cy"), F.abs(F.col("cy") + 1)) * dy)), F.lit(2.0))) / 2) * EARTH_KM
    open_cells = stored(cells.withColumn("half", half), "cells")
    halo = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    chosen: list[DataFrame] = []
    for k in range(0, _WIDEST + 1, 2):
        wide = 1 << k
        near = _crossed(targets, dy * wide, dx * wide).withColumn("o", F.explode(F.array(*halo)))
        near = near.select("target", "lat1", "lon1", "lat2", "lon2", (F.col("y") + F.col("o.a")).alias("y"), (F.col("x") + F.col("o.b")).alias("x")).distinct()
        keyed = open_cells.withColumns({"y": F.shiftright("cy", k), "x": F.shiftright("cx", k)})
        met = keyed.join(near, ["y", "x"]).withColumns({"low": low(F.col("lat"), F.col("lon"), F.col("cy")) - F.col("half"), "high": high(F.col("lat"), F.col("lon"), F.col("cy")) + F.col("half")})
        met = stored(met.select("cy", "cx", "target", "low", "high"), "ring")
        bounds = met.groupBy("cy", "cx").agg(F.min("high").alias("bound")).filter(F.col("bound") + _MARGIN_KM <= first_km * wide)
        chosen.append(met.join(bounds, ["cy", "cx"]).filter(F.col("low") <= F.col("bound") + _MARGIN_KM).select("cy", "cx", "target"))
        open_cells = stored(open_cells.join(bounds.select("cy", "cx"), ["cy", "cx"], "left_anti"), "cells")
        if open_cells.isEmpty() or targets.isEmpty():
            break
    candidates = chosen[0]
    for c in chosen[1:]:
        candidates = candidates.unionByName(c)
    candidates = candidates.join(targets, "target")
    found = placed.join(candidates, ["cy", "cx"]).select("id", F.struct(exact(F.col("lat"), F.col("lon")).alias("metres"), "name").alias("d"))
    best = found.groupBy("id").agg(F.min("d").alias("d"))
    return df.select(F.col(row_id).alias("id")).join(best, "id", "left").select(F.col("id").alias(row_id), "d.name", (F.col("d.metres") / 1000).alias("distance_km"))


def nearest_place(df: DataFrame, row_id: str, places: DataFrame, lat: str = "lat", lon: str = "lon", first_km: float | None = None) -> DataFrame:
    """(row_id, name, distance_km) of the nearest of ``places`` (name, lat, lon) by great circles, the smallest name on ties.

    ``first_km`` is the width of the cells that rows are gathered into, by default half the places' spacing.
    Rows are known by ``row_id``, unique.  Rows without a place, and all rows where there are no places, have nulls; places with a null are left out.
    """
    known = places.select("name", F.col("lat").cast("double").alias("lat1"), F.col("lon").cast("double").alias("lon1")).dropna(subset=["lat1", "lon1"])
    # places at one spot are one target
    known = known.groupBy("lat1", "lon1").agg(F.min("name").alias("name")).withColumns({"lat2": F.col("lat1"), "lon2": F.col("lon1"), "target": F.concat_ws(",", "lat1", "lon1")})

    def km(a: Column, b: Column, _: Column | None = None) -> Column:
        return haversine_km(a, b, "lat1", "lon1")

    def metres(a: Column, b: Column) -> Column:
        return F.lit(1000.0) * km(a, b)

    known = stored(known, "targets")
    return _nearest(df, row_id, lat, lon, known, metres, km, km, first_km or _spacing(known))


def nearest_segment(df: DataFrame, row_id: str, segments: DataFrame, lat: str = "lat", lon: str = "lon", first_km: float | None = None) -> DataFrame:
    """(row_id, name, distance_km) of the nearest of ``segments`` (name, lat1, lon1, lat2, lon2), the smallest name on ties.

    The distance is that on the plane which touches at the row's place (see :func:`segment_km`), good for segments that are near.  A segment
    is found in every cell that it crosses.  Rows without a place, and all rows where there are no segments, have nulls; segments with a null are left out.
    """
    ends = ["lat1", "lon1", "lat2", "lon2"]
    known = segments.select("name", *[F.col(c).cast("double").alias(c) for c in ends]).dropna(subset=ends)
    known = known.groupBy(*ends).agg(F.min("name").alias("name")).withColumn("target", F.concat_ws(",", *ends))
    known = stored(known, "targets")
    first_km = first_km or _spacing(known)
    step = lat_step(first_km)

    def with_cosine(of: Callable[[Column], Column]) -> Callable:
        return lambda a, b, cy: segment_km(a, b, *[F.col(c) for c in ends], of(cy))

    # over the latitudes of a cell the cosine is least at the one end and greatest at the other, or at the equator
    low = with_cosine(lambda cy: F.cos(F.radians(F.greatest(F.abs(cy), F.abs(cy + 1)) * step)))
    high = with_cosine(lambda cy: F.cos(F.radians(F.least(F.abs(cy), F.abs(cy + 1)) * step)))

    def metres(a: Column, b: Column) -> Column:
        return F.lit(1000 * EARTH_KM) * F.radians(_segment_degrees(a, b, *[F.col(c) for c in ends], F.cos(F.radians(a))))

    return _nearest(df, row_id, lat, lon, known, metres, low, high, first_km)


def segments_of(lines: DataFrame, line: str, order: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(name, lat1, lon1, lat2, lon2): the segments between consecutive points of each line, named by it."""
    after = Window.partitionBy(line).orderBy(order)
    both = lines.select(F.col(line).alias("name"), F.col(lat).alias("lat1"), F.col(lon).alias("lon1"), F.lead(lat).over(after).alias("lat2"), F.lead(lon).over(after).alias("lon2"))
    return both.filter(F.col("lat2").isNotNull())


def station_columns(df: DataFrame, row_id: str, stations: DataFrame, lines: DataFrame, lat: str = "lat", lon: str = "lon", first_km: float | None = None) -> DataFrame:
    """``df`` with station_name, station_distance_m, line_name and line_distance_m, from a user's stations and line segments.

    Distances are written, as models read them many times.
    """
    near = nearest_place(df, row_id, stations, lat, lon, first_km).select(row_id, F.col("name").alias("station_name"), (F.col("distance_km") * 1000).alias("station_distance_m"))
    line = nearest_segment(df, row_id, lines, lat, lon, first_km).select(row_id, F.col("name").alias("line_name"), (F.col("distance_km") * 1000).alias("line_distance_m"))
    return df.join(stored(near, "stations"), row_id, "left").join(stored(line, "lines"), row_id, "left")
