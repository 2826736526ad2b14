"""Distance-band models of two years' prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from dealscope.operators.did import NEAR_BANDS, NEAR_CONTROL, Band, between_sample, did, near_sample
from dealscope.operators.quality import CheckFailed, require_count

#: Line distance bands in metres, and the control.
BETWEEN_BANDS: tuple[Band, ...] = tuple((f"line_{k}_{k + 100}", float(k), float(k + 100)) for k in range(0, 1000, 100))
BETWEEN_CONTROL = (1000.0, 1500.0)
#: Parts of the names of location groups.
FORBIDDEN = ("nearest_segment", "segment", "grid_cell", "cell_id")


def near_stations(df: DataFrame, controls: Sequence[str], cluster: str = "grid_cell_id", y: str = "ln_price_m2", period: str = "year2026", distance: str = "station_distance_m", expected: int | None = None) -> tuple[DataFrame, dict]:
    rows = near_sample(df, distance, NEAR_BANDS, NEAR_CONTROL)
    if expected is not None:
        require_count(rows, expected, "observations")
    return did(rows, y, period, NEAR_BANDS, controls, cluster)


def between_stations(df: DataFrame, controls: Sequence[str], cluster: str = "grid_cell_id", y: str = "ln_price_m2", period: str = "year2026", line: str = "line_distance_m", station: str = "station_distance_m", bands: Sequence[Band] = BETWEEN_BANDS, control: tuple[float, float] = BETWEEN_CONTROL, forbidden: Sequence[str] = FORBIDDEN, expected: tuple[int, int] | None = None) -> tuple[DataFrame, dict]:
    """Location groups may not also be controls, by any part of their names; ``expected`` is (observations, clusters)."""
    if bad := [c for c in controls if any(f in c for f in forbidden)]:
        raise CheckFailed(f"location groups among the controls: {bad}")
    rows = between_sample(df, line, station, bands, control)
    table, info = did(rows, y, period, bands, controls, cluster)
    if expected is not None and (info["n"], info["clusters"]) != tuple(expected):
        raise CheckFailed(f"{info['n']} observations in {info['clusters']} clusters, not {expected}")
    return table, info
