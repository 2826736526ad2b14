"""Difference in differences by distance band."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealscope.functions.numeric import bands
from dealscope.operators.ols import cluster_covariance, ols
from dealscope.operators.quality import exactly_one, require
from dealscope.operators.sets import constant_columns, missing_columns

#: Distance bands in metres.
NEAR_BANDS = (("band_0_300", 0.0, 300.0), ("band_300_700", 300.0, 700.0), ("band_700_1000", 700.0, 1000.0), ("band_1000_1500", 1000.0, 1500.0))
NEAR_CONTROL = (1500.0, 2000.0)

Band = tuple[str, float, float]


def near_sample(df: DataFrame, distance: str, spec: Sequence[Band] = NEAR_BANDS, control: tuple[float, float] = NEAR_CONTROL) -> DataFrame:
    """Rows up to the control's outer end (inclusive) with band columns; each is in one band or the control."""
    rows = df.filter(F.col(distance).between(spec[0][1], control[1])).withColumns(bands(distance, spec))
    is_control = F.coalesce(F.col(distance).between(*control), F.lit(False)).cast("int")
    return require(rows.withColumn("control", is_control), {"one band": exactly_one(*[b[0] for b in spec], "control")})


def between_sample(df: DataFrame, line_distance: str, station_distance: str, spec: Sequence[Band], control: tuple[float, float], exclude_m: float = 500.0) -> DataFrame:
    """The same by distance to the line, without rows within ``exclude_m`` of a station."""
    far = df.filter(F.col(station_distance) > exclude_m)
    return require(near_sample(far, line_distance, spec, control), {"stations excluded": F.col(station_distance) > exclude_m})


def did(df: DataFrame, y: str, period: str, spec: Sequence[Band], controls: Sequence[str], cluster: str) -> tuple[DataFrame, dict]:
    """y on period, bands, period x band and controls, with cluster-robust errors; one row a band.

    ``period`` is 0 or 1.  Missing values, absent or constant columns are refused.
    Columns: band, n_before, n_after, n, coefficient, error, p, effect and its 95 % ends in percent.
    """
    names = [b[0] for b in spec]
    if gone := missing_columns(df, [y, period, cluster, *names, *controls]):
        raise ValueError(f"columns absent: {gone}")
    if flat := [r[0] for r in constant_columns(df, [period, *names, *controls]).collect()]:
        raise ValueError(f"constant columns: {flat}")
    rows = df.withColumns({f"{period}_x_{b}": F.col(period) * F.col(b) for b in names})
    x = [period, *names, *[f"{period}_x_{b}" for b in names], *controls]
    fit = ols(rows, y, x, missing="raise")
    cov, g = cluster_covariance(rows, fit, y, cluster)
    table = {r[0]: r for r in fit.table(cov, g - 1)}
    counts = rows.agg(*[F.count_if((F.col(b) == 1) & (F.col(period) == p)) for b in names for p in (0, 1)]).first()
    q = t_quantile(0.975, g - 1)
    out = []
    for k, b in enumerate(names):
        _, coef, se, _, p = table[f"{period}_x_{b}"]
        effect = [100 * (math.exp(v) - 1) for v in (coef, coef - q * se, coef + q * se)]
        out.append((b, counts[2 * k], counts[2 * k + 1], counts[2 * k] + counts[2 * k + 1], coef, se, p, *effect))
    schema = "band string, n_before long, n_after long, n long, coefficient double, error double, p double, effect_pct double, low_pct double, high_pct double"
    return df.sparkSession.createDataFrame(out, schema), {"n": fit.n, "clusters": g, "r2": fit.r2}


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on its tail."""
    from dealscope.operators.ols import p_value

    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if p_value(mid, df) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2
