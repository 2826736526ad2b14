"""The hierarchical price model: attributes by least squares, location by nested leave-one-out effects and a kernel.

A fitted row's location is (1 - alpha) * r + g, r being its residual of the attributes.  alpha depends on counts alone, and g is linear in
the sums of residuals of each spot (the rows of one place that share all location keys).  So the levels and the kernel are
worked out once, for the spots' sums of 1, of each attribute and of y; their g for any coefficients
is a combination of those.  With the attributes' cross-products, plain and weighted by alpha, a round is then a product of small matrices on the
driver, and rows are read to sum the spots, for the cross-products, and for the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.functions.numeric import first_failing, row_mean, standard_error, within
from dealscope.operators.effects import cell_effects
from dealscope.operators.ols import Products, checked, cluster_covariance, fitted, moments, original, solve
from dealscope.operators.profile import robust_z
from dealscope.operators.radius import kernel_sums
from dealscope.session import stored


@dataclass(frozen=True)
class Settings:
    """Fixed values of the model."""

    levels: tuple[tuple[str, float], ...] = (("district", 2.0), ("grid_cell_id", 1.0), ("complex_name", 2.0), ("building", 2.0))
    width_km: float = 0.1
    cutoff_km: float = 0.5
    kernel_shrink: float = 3.0
    rounds: int = 6
    building_n: int = 2
    complex_n: int = 3
    kernel_n: float = 10.0


def fit_reason(lat_box: tuple[float, float] = (50.95, 51.30), lon_box: tuple[float, float] = (71.15, 71.75), area: tuple[float, float] = (15, 400), price: tuple[float, float] = (150_000, 3_000_000)) -> Column:
    """Why a row is not fitted, by the first rule that fails; empty where it is."""
    return first_failing([
        ("no_price", F.col("ln_price_m2").isNull()),
        ("no_latlon", F.col("lat").isNull() | F.col("lon").isNull()),
        ("latlon_outside_astana", ~within("lat", *lat_box) | ~within("lon", *lon_box)),
        ("area_lt_15", F.col("area_total_m2") < area[0]),
        ("area_gt_400", F.col("area_total_m2") > area[1]),
        ("price_m2_lt_150k", F.col("price_m2") < price[0]),
        ("price_m2_gt_3M", F.col("price_m2") > price[1]),
    ])


def _sums(rows: DataFrame, left: Sequence[str], right: Sequence[str], weight: str | None = None) -> np.ndarray:
    """left' right over the rows, plain or with ``weight``: partial sums per task, then their sum."""
    p, q = len(left), len(right)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, p, q))
        for pdf in batches:
            a, b = pdf[list(left)].to_numpy(float), pdf[list(right)].to_numpy(float)
            total[0] += a.T @ b
            if weight:
                total[1] += (a * pdf[weight].to_numpy(float)[:, None]).T @ b
        yield pd.DataFrame({"k": np.arange(total.size), "s": total.ravel()})

    held = rows.select(*dict.fromkeys([*left, *right, *([weight] if weight else [])]))
    out = np.zeros(2 * p * q)
    for k, s in held.mapInPandas(part, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        out[k] = s
    return out.reshape(2, p, q)


def hierarchical_fit(df: DataFrame, row_id: str, y: str, x: Sequence[str], fit: str, settings: Settings = Settings(), lat: str = "lat", lon: str = "lon", complex_level: str = "complex_name", building_level: str = "building") -> tuple[DataFrame, dict]:
    """Rows with residual columns, and figures of the fit.

    ``fit`` is a boolean column; other rows get group effects but no residual.
    ``x`` are numeric columns without nulls, ``y`` has none on fitted rows.  Rows are known by ``row_id``, unique.  Rows without a
    place have no kernel term.
    """
    x, levels = list(x), [k for k, _ in settings.levels]
    place = {f"__{k}": F.col(c).cast("double") + F.lit(0.0) for k, c in (("lat", lat), ("lon", lon))}
    base = df.select(row_id, F.col(fit).alias("__fit"), F.col(y).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in x], *levels, *[c.alias(k) for k, c in place.items()])
    # keys as texts; null keys are left out of them, so that no two cells or spots have the same
    base = stored(base.withColumn("__cell", F.to_json(F.struct(*levels))).withColumn("__spot", F.to_json(F.struct("__lat", "__lon", "__cell"))), "base")
    ok = F.col("__fit")
    rows = base.filter(ok)
    n, mean, scale, spread = moments(rows, x, "__y")
    # columns c0 (ones), c1.. (attributes, standardised), cy
    design = ["c0", *[f"c{k}" for k in range(1, len(x) + 1)]]
    values = {"c0": F.lit(1.0)} | {f"c{k}": (F.col(c) - float(mean[k])) / float(scale[k]) for k, c in enumerate(x, 1)} | {"cy": F.col("__y")}
    spots = base.groupBy("__spot").agg(*[F.first(c).alias(c) for c in ("__cell", "__lat", "__lon", *levels)], *[F.coalesce(F.sum(F.when(ok, v)), F.lit(0.0)).alias(c) for c, v in values.items()])
    spots = stored(spots, "spots")
    met = _met(spots, levels, list(values), settings)
    g_of = [f"g_{c}" for c in values]
    crossed = _sums(met, g_of, design)[0]
    weighed = rows.join(met.select("__spot", "alpha"), "__spot").select("alpha", *[v.alias(c) for c, v in values.items()])
    plain, by_alpha = _sums(weighed, design, [*design, "cy"], "alpha")
    pr = checked(Products(["const", *x], n, mean, scale, plain[:, :-1]))
    beta = np.linalg.solve(pr.gram, plain[:, -1])
    for _ in range(settings.rounds - 1):
        # the design times y less location, from the coefficients of the round before
        rest = pr.gram @ beta + by_alpha[:, -1] - by_alpha[:, :-1] @ beta - crossed.T @ np.append(-beta, 1.0)
        beta = np.linalg.solve(pr.gram, rest)
    plainly = original(pr, beta)

    def combined(prefix: str) -> Column:
        return sum((F.lit(float(w)) * F.col(f"{prefix}_{c}") for c, w in zip(values, np.append(-beta, 1.0), strict=True)), F.lit(0.0))

    at = met.select("__spot", "alpha", combined("g").alias("__g"), combined("at").alias("__at"), *[f"{k}_n" for k in levels], "__kn")
    state = base.join(at, "__spot").withColumn("__attr", fitted(pr, plainly).predict())
    state = state.withColumn("__loc", F.when(ok, (1 - F.col("alpha")) * (F.col("__y") - F.col("__attr")) + F.col("__g")).otherwise(F.col("__at")))
    state = state.withColumns({f"{k}_n_others": F.col(f"{k}_n") - ok.cast("int") for k in levels}).withColumn("__kn", F.when(ok, F.col("__kn")).otherwise(0.0))
    state = stored(state.drop("alpha", "__g", "__at", "__cell", "__spot", *[f"{k}_n" for k in levels]), "state")
    predicted = F.col("__attr") + F.col("__loc")
    out = state.select(
        row_id,
        ok.alias("fit_ok"),
        F.when(ok, predicted).alias("predicted_ln_price_m2"),
        F.when(ok, F.exp(predicted)).alias("predicted_price_m2"),
        F.when(ok, F.col("__y") - predicted).alias("hier_residual_ln"),
        F.when(ok, F.col(f"{building_level}_n_others")).otherwise(0).alias("building_n_others"),
        F.when(ok & F.col(complex_level).isNotNull(), F.col(f"{complex_level}_n_others")).otherwise(0).alias("complex_n_others"),
        F.col("__kn").alias("__kn"),
    )
    reliable = F.col("fit_ok") & ((F.col("building_n_others") >= settings.building_n) | (F.col("complex_n_others") >= settings.complex_n) | (F.col("__kn") >= settings.kernel_n))
    out = out.withColumn("residual_reliable", reliable).withColumn("residual_pct", F.exp("hier_residual_ln") - 1)
    stats = out.agg(F.stddev_pop(F.when(F.col("residual_reliable"), F.col("hier_residual_ln"))), F.sum(F.col("hier_residual_ln") * F.col("hier_residual_ln"))).first()
    n_eff = F.col("building_n_others") + 0.5 * F.col("complex_n_others") + 0.5 * F.col("__kn")
    z = F.col("hier_residual_ln") / standard_error(float(stats[0] or 0.0), n_eff)
    out = out.withColumn("residual_n_eff", F.when(F.col("fit_ok"), n_eff)).withColumn("residual_z", z).withColumn("kernel_eff_n", F.bround("__kn", 2)).drop("__kn")
    info = {"n_fit": n, "sigma_reliable": stats[0], "r2_loo": 1 - stats[1] / (spread * n), "beta": dict(zip(pr.names, plainly.tolist(), strict=True)), "location": state.select(row_id, F.col("__loc").alias("location")), "state": state, "products": pr}
    return out, info


def _met(spots: DataFrame, levels: Sequence[str], columns: Sequence[str], settings: Settings) -> DataFrame:
    """Each spot with alpha, and for each column g_{column} and at_{column}: what levels and kernel make of its sums; {level}_n and __kn.

    g is the part of a fitted row's location that its own residual has no part in, at the location of other rows.
    """
    cells = spots.groupBy("__cell").agg(*[F.first(k).alias(k) for k in levels], *[F.sum(c).alias(c) for c in columns])
    effects = cell_effects(cells, settings.levels, columns[0], columns)
    spots = spots.drop(*levels).join(effects.drop(*levels, *columns), "__cell")
    left = {f"h_{c}": F.col("left_of_value") * F.col(c) - F.col(f"off_{c}") * F.col(columns[0]) for c in columns}
    placed = spots.filter(F.col("__lat").isNotNull() & F.col("__lon").isNotNull())
    places = placed.groupBy(F.col("__lat").alias("lat"), F.col("__lon").alias("lon")).agg(F.sum(columns[0]).alias("times"), *[F.sum(v).alias(k) for k, v in left.items()])
    places = stored(places.filter("times > 0"), "places")
    near = kernel_sums(places, list(left), settings.width_km, settings.cutoff_km).withColumnsRenamed({k: f"far_{k}" for k in left})
    # rows at one place are neighbours of weight 1
    joined = places.join(near, ["lat", "lon"], "left").fillna(0.0, ["sum_w", "sum_w2", *[f"far_{k}" for k in left]])
    weight, squares = (F.col(c) + F.col("times") - 1 for c in ("sum_w", "sum_w2"))
    kappa = F.when(weight > 1e-12, 1 / (weight + settings.kernel_shrink)).otherwise(0.0)
    joined = joined.select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), kappa.alias("__kappa"), F.when(squares > 0, weight * weight / squares).otherwise(0.0).alias("__kn"), *[(F.col(k) + F.col(f"far_{k}")).alias(f"t_{k[2:]}") for k in left])
    out = spots.join(joined, ["__lat", "__lon"], "left").fillna(0.0, ["__kappa", "__kn", *[f"t_{c}" for c in columns]])
    more = 1 + F.col("__kappa")
    g = [(more * F.col(f"off_{c}") + F.col("__kappa") * F.col(f"t_{c}")).alias(f"g_{c}") for c in columns]
    return stored(out.select("__spot", *columns, (more * F.col("left_of_value")).alias("alpha"), *g, *[f"at_{c}" for c in columns], *[f"{k}_n" for k in levels], "__kn"), "spots")


def coefficients(info: dict, cluster: str = "grid_cell_id") -> DataFrame:
    """(name, coefficient, error, statistic, p) of the attributes at the converged location terms.

    Least squares of y less location on the attributes, with errors clustered by ``cluster`` (null is one
    cluster) and normal p-values; ``info`` is that of :func:`hierarchical_fit`.
    """
    pr: Products = info["products"]
    rows = info["state"].filter("__fit").withColumn("__t", F.col("__y") - F.col("__loc"))
    fit = fitted(pr, solve(pr, rows, "__t"))
    cov, _ = cluster_covariance(rows, fit, "__t", cluster)
    return rows.sparkSession.createDataFrame(fit.table(cov, normal=True), "name string, coefficient double, error double, statistic double, p double")


def composite_score(df: DataFrame, spatial: str = "spatial_price_pct_vs_avg", spatial_ok: str = "spatial_rank_reliable", residual: str = "residual_pct", residual_ok: str = "residual_reliable", name: str = "good_deal_score") -> DataFrame:
    """Mean of the robust scores of -spatial and -residual, each where its own flag holds; higher is better."""
    scored = robust_z(df, spatial, "__zs", F.col(spatial_ok), negate=True)
    scored = robust_z(scored, residual, "__zr", F.col(residual_ok), negate=True)
    return scored.withColumn(name, row_mean("__zs", "__zr")).drop("__zs", "__zr")
