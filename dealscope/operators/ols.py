"""Least squares from distributed cross-products, with cluster-robust errors.

Columns are centred and scaled before their products are summed, which keeps the
normal equations well conditioned; the small system is solved on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RankDeficient(ValueError):
    """The design has fewer independent columns than coefficients."""


@dataclass
class Fit:
    """Coefficients by name, the constant first."""

    names: list[str]
    beta: np.ndarray
    n: int
    r2: float
    r2_adjusted: float
    sigma2: float
    inverse: np.ndarray  # inverse of X'X

    def predict(self) -> Column:
        out = F.lit(float(self.beta[0]))
        for name, b in zip(self.names[1:], self.beta[1:], strict=True):
            out = out + F.lit(float(b)) * F.col(name).cast("double")
        return out

    def table(self, covariance: np.ndarray | None = None, df: float | None = None, normal: bool = False) -> list[tuple[str, float, float, float, float]]:
        """(name, coefficient, error, statistic, p) rows; t with ``df`` degrees, or normal."""
        cov = self.sigma2 * self.inverse if covariance is None else covariance
        dof = self.n - len(self.beta) if df is None else df
        rows = []
        for k, name in enumerate(self.names):
            se = math.sqrt(max(float(cov[k, k]), 0.0))
            t = float(self.beta[k]) / se if se else math.nan
            rows.append((name, float(self.beta[k]), se, t, p_value(t, None if normal else dof)))
        return rows


@dataclass
class Products:
    """Sums over rows of the standardised design: what all fits on these rows share."""

    names: list[str]
    n: int
    mean: np.ndarray
    scale: np.ndarray
    gram: np.ndarray


def _checked(df: DataFrame, x: Sequence[str], extra: Sequence[str], missing: str) -> DataFrame:
    used = [*x, *extra]
    if missing == "drop":
        return df.dropna(subset=used)
    if n := df.filter(F.greatest(*[F.col(c).isNull().cast("int") for c in used], F.lit(0)) == 1).count():
        raise ValueError(f"{n} rows with a missing value")
    return df


def moments(df: DataFrame, x: Sequence[str], y: str | None = None) -> tuple[int, np.ndarray, np.ndarray, float | None]:
    """Rows, means and deviations of the design (its constant first), and the variance of y; constant columns are refused."""
    stats = df.agg(F.count("*"), F.var_pop(y) if y else F.lit(None), *[f(F.col(c).cast("double")) for c in x for f in (F.avg, F.stddev_pop)]).first()
    n = stats[0]
    mean = np.array([0.0] + [stats[2 + 2 * k] or 0.0 for k in range(len(x))])
    scale = np.array([1.0] + [(stats[3 + 2 * k] or 0.0) for k in range(len(x))])
    if n < len(x) + 1 or (scale == 0).any():
        raise RankDeficient(f"{n} rows, constant columns: {[c for c, s in zip(x, scale[1:], strict=True) if s == 0]}")
    return n, mean, scale, stats[1]


def checked(pr: Products) -> Products:
    if np.linalg.matrix_rank(pr.gram / pr.n, tol=1e-9) < len(pr.gram):
        raise RankDeficient("dependent columns")
    return pr


def original(pr: Products, beta: np.ndarray) -> np.ndarray:
    """Coefficients of the standardised design on the columns' own scale."""
    out = beta / pr.scale
    out[0] -= (out[1:] * pr.mean[1:]).sum()
    return out


def products(df: DataFrame, x: Sequence[str]) -> Products:
    n, mean, scale, _ = moments(df, x)
    return checked(Products(["const", *x], n, mean, scale, _matrix(df, x, mean, scale, [])))


def _matrix(df: DataFrame, x: Sequence[str], mean: np.ndarray, scale: np.ndarray, ys: Sequence[str]) -> np.ndarray:
    """Cross-products of the standardised design (with its constant), or of it with ys: partial sums per batch, then their sum."""
    p, q = len(x) + 1, len(ys)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, q or p))
        for pdf in batches:
            a = np.column_stack([np.ones(len(pdf)), pdf[list(x)].to_numpy(float)])
            a = (a - mean) / scale
            total += a.T @ (pdf[list(ys)].to_numpy(float) if q else a)
        yield pd.DataFrame({"k": np.arange(total.size), "s": total.ravel()})

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*x, *ys])]).mapInPandas(part, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(p * (q or p))
    for k, s in rows:
        out[k] = s
    return out.reshape(p, q or p)


def solve(pr: Products, df: DataFrame, y: str | Column) -> np.ndarray:
    """Coefficients on the original scale, with one pass of plain sums for X'y."""
    value = (F.col(y) if isinstance(y, str) else y).cast("double")
    sums = [F.sum((F.col(c).cast("double") - float(m)) / float(k) * value) for c, m, k in zip(pr.names[1:], pr.mean[1:], pr.scale[1:], strict=True)]
    return original(pr, np.linalg.solve(pr.gram, np.array(df.agg(F.sum(value), *sums).first(), float)))


def fitted(pr: Products, beta: np.ndarray) -> Fit:
    """A fit of given coefficients, without figures of its residuals."""
    return Fit(pr.names, beta, pr.n, math.nan, math.nan, math.nan, _inverse(pr))


def _inverse(pr: Products) -> np.ndarray:
    t = np.diag(1 / pr.scale)
    t[0, 1:] = -pr.mean[1:] / pr.scale[1:]
    return t @ np.linalg.inv(pr.gram) @ t.T


def ols(df: DataFrame, y: str, x: Sequence[str], missing: str = "drop") -> Fit:
    """y on a constant and x; rows with a null are dropped, or refused where ``missing`` is raise."""
    rows = _checked(df, x, [y], missing)
    pr = products(rows, x)
    beta = solve(pr, rows, y)
    fit = fitted(pr, beta)
    ss = rows.select((F.col(y) - fit.predict()).alias("e"), F.col(y).cast("double").alias("y")).agg(F.sum(F.col("e") * F.col("e")), F.var_pop("y")).first()
    ssr, sst = ss[0], ss[1] * pr.n
    k = len(x) + 1
    fit.r2 = 1 - ssr / sst if sst else math.nan
    fit.r2_adjusted = 1 - (1 - fit.r2) * (pr.n - 1) / (pr.n - k) if pr.n > k else math.nan
    fit.sigma2 = ssr / (pr.n - k) if pr.n > k else math.nan
    return fit


def with_residuals(df: DataFrame, fit: Fit, y: str, predicted: str = "predicted", residual: str = "residual") -> DataFrame:
    """Rows with prediction and residual; null where an input is null."""
    return df.withColumn(predicted, fit.predict()).withColumn(residual, F.col(y) - F.col(predicted))


def cluster_covariance(df: DataFrame, fit: Fit, y: str, cluster: str, correct: bool = True) -> tuple[np.ndarray, int]:
    """Sandwich covariance from the clusters' score sums, and the number of clusters.

    Null clusters are one cluster.  ``correct`` applies G/(G-1) * (N-1)/(N-K).
    """
    names = fit.names
    rows = df.dropna(subset=[y, *names[1:]])
    e = F.col(y) - fit.predict()
    scores = rows.groupBy(cluster).agg(*[F.sum(e * (F.lit(1.0) if c == "const" else F.col(c).cast("double"))).alias(f"s{k}") for k, c in enumerate(names)])
    k = len(names)
    meat_cells = scores.agg(F.count("*"), *[F.sum(F.col(f"s{a}") * F.col(f"s{b}")) for a in range(k) for b in range(a, k)]).first()
    meat, at = np.zeros((k, k)), 1
    for a in range(k):
        for b in range(a, k):
            meat[a, b] = meat[b, a] = meat_cells[at] or 0.0
            at += 1
    g = meat_cells[0]
    cov = fit.inverse @ meat @ fit.inverse
    if correct and g > 1 and fit.n > k:
        cov *= g / (g - 1) * (fit.n - 1) / (fit.n - k)
    return cov, g


def p_value(t: float, df: float | None) -> float:
    """Two-sided; Student's t with df degrees, normal where df is None."""
    if math.isnan(t):
        return math.nan
    if df is None:
        return math.erfc(abs(t) / math.sqrt(2))
    return _beta_inc(df / 2, 0.5, df / (df + t * t))


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total
