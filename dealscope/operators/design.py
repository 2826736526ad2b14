"""Design columns: imputation, treatment coding, cubic B-splines."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.functions.numeric import clip, missing, ratio, truth
from dealscope.operators.profile import column_quantiles, exact_quantiles


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the column's median over all rows."""
    medians = column_quantiles(df, columns, [0.5])
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0])) for c in columns})


def hedonic_inputs(df: DataFrame, area: tuple[float, float] = (15, 400), age_most: float = 80, ceiling: tuple[float, float] = (2.2, 4.5)) -> DataFrame:
    """The listing model's inputs, without nulls: clipped, imputed, with indicators of what was missing."""
    tall = F.when(F.col("ceiling_height_m").between(*ceiling), F.col("ceiling_height_m"))
    out = df.withColumns({
        "ln_area": clip("ln_area", _ln(area[0]), _ln(area[1])),
        "building_age": clip("building_age", high=age_most),
        "ceiling_miss": missing(tall),
        "ceiling_height_m": tall,
        "floor_miss": missing("floor"),
        "floor_rel": F.coalesce(F.when(F.col("floor_total") > 0, ratio("floor", "floor_total")), F.lit(0.5)),
        "building_type": F.coalesce("building_type", F.lit("unknown")),
        "apartment_condition": F.coalesce("apartment_condition", F.lit("unknown")),
        "rooms_bucket": F.coalesce("rooms_bucket_estimated", F.lit("unknown")),
        **{c: truth(c) for c in ("floor_is_first", "floor_is_last", "former_dormitory", "exchange_possible", "is_under_construction", "price_is_installment")},
    })
    return impute_median(out, ["ln_area", "building_age", "ceiling_height_m"])


def _ln(x: float) -> float:
    return math.log(x)


def fold_unseen(df: DataFrame, columns: Sequence[str], fit: Column) -> DataFrame:
    """Levels that occur only outside the fit rows become the fit rows' mode, the smallest on ties.

    Columns of more levels than :func:`levels` takes are refused.
    """
    rows = df.filter(fit)
    mode = rows.agg(*[F.mode(c, True).alias(c) for c in columns]).first()
    return df.withColumns({c: F.when(F.col(c).isin(*levels(rows, c)), F.col(c)).otherwise(F.lit(mode[c])) for c in columns})


def levels(df: DataFrame, c: str, most: int = 1000) -> list[str]:
    """Sorted distinct values; more than ``most`` are refused."""
    found = [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{c} has more than {most} levels")
    return sorted(found)


def treatment(c: str, found: Sequence[str]) -> dict[str, Column]:
    """0/1 columns of all levels but the first."""
    return {f"{c}_{k}": (F.coalesce(F.col(c) == v, F.lit(False))).cast("double") for k, v in enumerate(found) if k}


def spline_knots(df: DataFrame, c: str, df_spline: int = 5, degree: int = 3) -> list[float]:
    """Full knot sequence: inner knots at equal quantiles, the ends repeated."""
    inner = df_spline - degree
    low, high = df.agg(F.min(c), F.max(c)).first()
    return [low] * (degree + 1) + exact_quantiles(df, c, [(k + 1) / (inner + 1) for k in range(inner)]) + [high] * (degree + 1)


def spline(c: str, knots: Sequence[float], degree: int = 3, prefix: str = "bs") -> dict[str, Column]:
    """B-spline columns by the Cox-de Boor recursion, the first left out; the right end belongs to the last span."""
    x = F.col(c).cast("double")
    last = max(k for k in range(len(knots) - 1) if knots[k] < knots[k + 1])
    basis: list[Column] = []
    for k in range(len(knots) - 1):
        low, high = F.lit(float(knots[k])), F.lit(float(knots[k + 1]))
        inside = (x >= low) & ((x <= high) if k == last else (x < high)) if knots[k] < knots[k + 1] else F.lit(False)
        basis.append(F.when(inside, 1.0).otherwise(0.0))
    for d in range(1, degree + 1):
        step = []
        for k in range(len(basis) - 1):
            a, b = knots[k + d] - knots[k], knots[k + d + 1] - knots[k + 1]
            term = F.lit(0.0)
            if a > 0:
                term = term + (x - float(knots[k])) / float(a) * basis[k]
            if b > 0:
                term = term + (float(knots[k + d + 1]) - x) / float(b) * basis[k + 1]
            step.append(term)
        basis = step
    return {f"{prefix}{k}": b for k, b in enumerate(basis) if k}
