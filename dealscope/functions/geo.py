"""Distances, grids and map tiles as column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscope.functions.numeric import col, flag

#: Mean earth radius, and places of the city.
EARTH_KM = 6371.0088
CENTRE = (51.1282, 71.4306)
PARK = (51.1300, 71.4460)
EMBANKMENT = (51.1215, 71.4330)
MALLS = {
    "khan_shatyr": (51.1330, 71.4087),
    "mega_silkway": (51.0916, 71.4168),
    "asia_park": (51.1255, 71.4189),
    "keruen": (51.1274, 71.4162),
    "keruen_city": (51.1064, 71.4667),
    "saryarka": (51.1198, 71.3805),
}
BASE_MALL = "khan_shatyr"
METRES_PER_DEGREE = 111_000.0
GRID_LATITUDE = 51.1


def _lit(x: Column | str | float) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else col(x)


def haversine_km(lat1: Column | str | float, lon1: Column | str | float, lat2: Column | str | float, lon2: Column | str | float) -> Column:
    """Great-circle distance; null where any coordinate is null."""
    a, b, c, d = (F.radians(_lit(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2.0))
    # not least(): it would skip a null
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def grid_cell(lat: Column | str, lon: Column | str, metres: float = 500.0, latitude: float = GRID_LATITUDE) -> Column:
    """Id of the square cell of about ``metres``; null where a coordinate is null."""
    across = metres / (METRES_PER_DEGREE * math.cos(math.radians(latitude)))
    return F.concat(F.floor(col(lat) / F.lit(metres / METRES_PER_DEGREE)).cast("string"), F.lit("_"), F.floor(col(lon) / F.lit(across)).cast("string"))


def landmark_columns(lat: str, lon: str, near_km: float = 1.0, malls: Mapping[str, tuple[float, float]] = MALLS, base: str = BASE_MALL) -> dict[str, Column]:
    """Distances to centre, park and embankment, and nearness of the malls.

    The base mall has a column of its own but does not count in near_mall_1km.
    Unknown coordinates give unknown flags.
    """
    park, bank = haversine_km(lat, lon, *PARK), haversine_km(lat, lon, *EMBANKMENT)
    near = {f"mall_{k}_1km": haversine_km(lat, lon, *p) < near_km for k, p in malls.items()}
    known = col(lat).isNotNull() & col(lon).isNotNull()
    any_ = F.lit(False)
    for k, c in near.items():
        if k != f"mall_{base}_1km":
            any_ = any_ | c
    return {
        "distance_to_center_km": haversine_km(lat, lon, *CENTRE),
        "distance_to_park_km": park,
        "near_park_1km": park < near_km,
        "distance_to_embankment_km": bank,
        "near_embankment_1km": bank < near_km,
        **near,
        "near_mall_1km": F.when(known, flag(any_)),
    }


def gaussian(distance: Column | str, width: float) -> Column:
    return F.exp(F.lit(-0.5) * F.pow(col(distance) / F.lit(width), F.lit(2.0)))


def tile_x(lon: Column | str, zoom: int) -> Column:
    return F.floor((col(lon) + 180.0) / 360.0 * float(1 << zoom)).cast("int")


def tile_y(lat: Column | str, zoom: int) -> Column:
    return F.floor((1 - F.asinh(F.tan(F.radians(col(lat)))) / math.pi) / 2 * float(1 << zoom)).cast("int")


def tile_lon(x: Column | str, zoom: int) -> Column:
    return col(x) / float(1 << zoom) * 360.0 - 180.0


def tile_lat(y: Column | str, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * col(y) / float(1 << zoom)))))


def box_tiles(lat: Sequence[float], lon: Sequence[float], zoom: int) -> tuple[Column, Column]:
    """(first, last) tile numbers of a box: structs of x and y; y grows southwards."""
    west, east = (tile_x(F.lit(float(v)), zoom) for v in lon)
    south, north = (tile_y(F.lit(float(v)), zoom) for v in lat)
    first = F.struct(F.least(west, east).alias("x"), F.least(south, north).alias("y"))
    return first, F.struct(F.greatest(west, east).alias("x"), F.greatest(south, north).alias("y"))


def tile_grid(spark: SparkSession, lat: Sequence[float], lon: Sequence[float], zoom: int) -> DataFrame:
    """(x, y, west, north) of every tile that covers the box."""
    first, last = box_tiles(lat, lon, zoom)
    ends = spark.range(1).select(first.alias("a"), last.alias("b"))
    rows = ends.select("a", "b", F.explode(F.sequence("a.y", "b.y")).alias("y"))
    tiles = rows.select(F.explode(F.sequence("a.x", "b.x")).alias("x"), "y")
    return tiles.withColumns({"west": tile_lon("x", zoom), "north": tile_lat("y", zoom)})


def tiles_of(points: DataFrame, zoom: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The same for the box that holds all the points; none where there are no places."""
    ends = points.agg(F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"))
    ends = ends.select(tile_x("west", zoom).alias("x0"), tile_x("east", zoom).alias("x1"), tile_y("north", zoom).alias("y0"), tile_y("south", zoom).alias("y1"))
    tiles = ends.select("x0", "x1", F.explode(F.sequence("y0", "y1")).alias("y")).select(F.explode(F.sequence("x0", "x1")).alias("x"), "y")
    return tiles.withColumns({"west": tile_lon("x", zoom), "north": tile_lat("y", zoom)})
