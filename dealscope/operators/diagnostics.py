"""Model diagnostics: variance inflation, cross-validation, residual tables, agreement of signals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.operators.ols import moments, products
from dealscope.operators.profile import exact_quantiles, pearson
from dealscope.operators.ranking import smallest
from dealscope.operators.sets import overlap
from dealscope.session import stored


def variance_inflation(df: DataFrame, columns: Sequence[str], limit: float = 10.0) -> DataFrame:
    """(column, vif, high) over the rows that have all columns: diagonal of the inverse correlation matrix."""
    pr = products(df.dropna(subset=list(columns)), columns)
    corr = pr.gram[1:, 1:] / pr.n
    vif = np.diag(np.linalg.inv(corr))
    return df.sparkSession.createDataFrame([(c, float(v), bool(v > limit)) for c, v in zip(columns, vif, strict=True)], "column_name string, vif double, high boolean")


def _sums_by(rows: DataFrame, y: str, x: Sequence[str], key: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """One row a key: n, and the sums of products of the standardised design (its constant first) and y; with the design's means and deviations.

    g is the design's products, row by row, b those with y, s that of y with itself.
    """
    _, mean, scale, _ = moments(rows, x)
    columns = {"__c0": F.lit(1.0)} | {f"__c{k}": (F.col(c).cast("double") - float(mean[k])) / float(scale[k]) for k, c in enumerate(x, 1)}
    coded = rows.select(F.col(key).alias("key"), F.col(y).cast("double").alias("__y"), *[v.alias(c) for c, v in columns.items()])
    names = list(columns)
    pairs = [(a, b) for a in range(len(names)) for b in range(a, len(names))]
    sums = [F.sum(F.col(names[a]) * F.col(names[b])).alias(f"g{a}_{b}") for a, b in pairs] + [F.sum(F.col(c) * F.col("__y")).alias(f"b{k}") for k, c in enumerate(names)]
    grouped = coded.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("__y") * F.col("__y")).alias("s"), F.sum("__y").alias("t"), *sums)
    g = F.array(*[F.col(f"g{min(a, b)}_{max(a, b)}") for a in range(len(names)) for b in range(len(names))])
    return grouped.select("key", "n", "s", "t", g.alias("g"), F.array(*[F.col(f"b{k}") for k in range(len(names))]).alias("b")), mean, scale


def _total(parts: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the parts' g and b over all keys."""
    row = parts.agg(*[F.sum(F.col("g")[k]) for k in range(p * p)], *[F.sum(F.col("b")[k]) for k in range(p)]).first()
    return np.array(row[: p * p]).reshape(p, p), np.array(row[p * p :])


def cross_validated(df: DataFrame, y: str, x: Sequence[str], folds: int, key: str | Column, hashed: bool = True) -> DataFrame:
    """(fold, n, rmse, r2) of least squares fitted without the fold; rows of one key share a fold.

    The fold is a hash of the key, or with ``hashed`` false the whole number ``key``, modulo ``folds``.
    """
    k = F.col(key) if isinstance(key, str) else key
    rows = df.dropna(subset=[y, *x]).withColumn("__fold", F.pmod(F.crc32(k.cast("string").cast("binary")) if hashed else k, F.lit(folds)).cast("int"))
    return group_validated(rows, y, x, "__fold").select(F.col("group").alias("fold"), "n", "rmse", "r2")


def group_validated(df: DataFrame, y: str, x: Sequence[str], group: str) -> DataFrame:
    """(group, n, rmse, r2) of each group by the least squares of all other rows.

    The sums of all rows less a group's own are those of the others, so one grouped pass serves any number of groups; a group's errors
    follow from its own sums.  Rows with a null are left out.  r2 is 1 less the mean squared error over the group's variance, null
    where that is 0; rmse and r2 are null where the other rows do not determine the coefficients.
    """
    rows = df.dropna(subset=[y, *x, group])
    parts, _, _ = _sums_by(rows, y, x, group)
    parts = stored(parts, "parts")
    p = len(x) + 1
    g_all, b_all = _total(parts, p)

    def left_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, n, s, t, g, b in zip(pdf["key"], pdf["n"], pdf["s"], pdf["t"], pdf["g"], pdf["b"], strict=True):
                g, b = np.array(g).reshape(p, p), np.array(b)
                rest = g_all - g
                rmse = r2 = None
                if rest[0, 0] >= p - 0.5 and np.linalg.matrix_rank(rest / rest[0, 0], tol=1e-9) == p:
                    beta = np.linalg.solve(rest, b_all - b)
                    mean_square = max(0.0, s - 2 * beta @ b + beta @ g @ beta) / n
                    spread = s / n - (t / n) ** 2
                    rmse, r2 = float(np.sqrt(mean_square)), 1 - mean_square / spread if spread > 1e-12 * abs(s / n) else None
                out.append((key, n, rmse, r2))
            yield pd.DataFrame(out, columns=["group", "n", "rmse", "r2"])

    kind = parts.schema["key"].dataType.simpleString()
    return parts.mapInPandas(left_out, f"group {kind}, n long, rmse double, r2 double")


def residuals_by_fitted(df: DataFrame, fitted: str, residual: str, bins: int = 20) -> DataFrame:
    """(bin, n, mean_fitted, mean_residual, sd_residual) over equal-width bins of the fitted values."""
    ends = df.agg(F.min(fitted).alias("__lo"), F.max(fitted).alias("__hi"))
    at = F.least(F.lit(bins), F.floor(F.coalesce(F.try_divide(F.col(fitted) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0)) * bins).cast("int") + 1)
    rows = df.filter(F.col(fitted).isNotNull() & F.col(residual).isNotNull()).crossJoin(F.broadcast(ends))
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(fitted).alias("mean_fitted"), F.avg(residual).alias("mean_residual"), F.stddev_samp(residual).alias("sd_residual"))


def normal_quantiles(df: DataFrame, residual: str, points: int = 19) -> DataFrame:
    """(point, observed, normal): residual quantiles in units of their deviation against normal ones."""
    ps = [(k + 1) / (points + 1) for k in range(points)]
    mean, sd = df.agg(F.avg(residual), F.stddev_samp(residual)).first()
    rows = [(p, (v - mean) / sd if sd else None, NormalDist().inv_cdf(p)) for p, v in zip(ps, exact_quantiles(df, residual, ps), strict=True) if v is not None]
    return df.sparkSession.createDataFrame(rows, "point double, observed double, normal double")


def agreement(df: DataFrame, a: str, b: str, a_ok: str, b_ok: str, row_id: str, k: int = 300) -> DataFrame:
    """One row: correlation over rows reliable in both, and the share common to both lists of k lowest."""
    both = df.filter(F.col(a_ok) & F.col(b_ok)).agg(pearson(a, b).alias("correlation"))
    common = overlap(smallest(df.filter(a_ok), a, k, [row_id]), smallest(df.filter(b_ok), b, k, [row_id]), row_id, k)
    return both.crossJoin(common)
