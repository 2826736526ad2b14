"""Least squares by a formula, such as ``y ~ C(district) + bs(ln_area, df=5) + new * year2026``.

Terms are columns, ``C(x)`` (levels), ``bs(x, df=5, degree=3)`` (B-splines) and ``log(x)``, joined by ``+``; ``a:b`` is their product
and ``a * b`` is ``a + b + a:b``.  Text columns are levels without ``C``.  Levels and knots are recorded from the rows that are fitted, so that
new rows are coded alike.  Levels are coded without the first where the term without them is in the formula too (for a
term of its own: always, as there is a constant), and in full where it is not.
"""

from __future__ import annotations

import ast
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dealscope.operators.design import levels, spline, spline_knots
from dealscope.operators.ols import Fit, cluster_covariance, ols
from dealscope.session import dealt, stored


@dataclass(frozen=True)
class Factor:
    """``kind`` is plain, level, spline or log; ``options`` are the spline's (df, degree)."""

    kind: str
    column: str
    options: tuple[int, int] = (5, 3)

    def label(self) -> str:
        return {"plain": self.column, "level": f"C({self.column})", "log": f"log({self.column})", "spline": f"bs({self.column}, df={self.options[0]}, degree={self.options[1]})"}[self.kind]


Term = tuple[Factor, ...]


def _factor(node: ast.expr) -> Factor:
    if isinstance(node, ast.Name):
        return Factor("plain", node.id)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.args and all(isinstance(a, ast.Name) for a in node.args):
        column, kind = node.args[0].id, {"C": "level", "bs": "spline", "log": "log"}.get(node.func.id)
        given = {k.arg: ast.literal_eval(k.value) for k in node.keywords}
        if kind and len(node.args) == 1 and set(given) <= ({"df", "degree"} if kind == "spline" else set()):
            return Factor(kind, column, (given.get("df", 5), given.get("degree", 3)))
    raise ValueError(f"not a term: {ast.unparse(node)}")


def _terms(node: ast.expr) -> list[Term]:
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Mult, ast.Pow)):
        left, right = _terms(node.left), _terms(node.right)
        crossed = [tuple(dict.fromkeys((*a, *b))) for a in left for b in right]
        out = {ast.Add: left + right, ast.Pow: crossed, ast.Mult: left + right + crossed}[type(node.op)]
        seen: dict[frozenset[Factor], Term] = {}
        for t in out:
            seen.setdefault(frozenset(t), t)
        return list(seen.values())
    return [(_factor(node),)]


def parsed(formula: str) -> tuple[Factor, list[Term]]:
    """The response (plain or log) and the terms, lower orders first."""
    left, tilde, right = formula.partition("~")
    if not tilde or "**" in formula or "~" in right:
        raise ValueError(f"not a formula: {formula}")
    try:
        # a colon binds tighter than a star, as the power does in Python
        y, terms = _factor(ast.parse(left.strip(), mode="eval").body), _terms(ast.parse(right.strip().replace(":", "**"), mode="eval").body)
    except SyntaxError as e:
        raise ValueError(f"not a formula: {formula}") from e
    if y.kind not in ("plain", "log"):
        raise ValueError(f"not a response: {left}")
    return y, sorted(terms, key=len)


@dataclass
class Design:
    """What a formula makes of rows: recorded levels and knots, and the columns of each term."""

    response: Factor
    terms: list[Term]
    levels: dict[Factor, list] = field(default_factory=dict)
    knots: dict[Factor, list[float]] = field(default_factory=dict)

    @classmethod
    def of(cls, formula: str, df: DataFrame) -> Design:
        response, terms = parsed(formula)
        texts = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
        terms = [tuple(Factor("level", f.column) if f.kind == "plain" and f.column in texts else f for f in t) for t in terms]
        design = cls(response, terms)
        if gone := [c for c in design.columns_used() if c not in df.columns]:
            raise ValueError(f"columns absent: {gone}")
        rows = design.complete(df)
        for f in dict.fromkeys(f for t in terms for f in t):
            if f.kind == "level":
                design.levels[f] = levels(rows, f.column)
            elif f.kind == "spline":
                if f.options[0] < f.options[1]:
                    raise ValueError(f"fewer columns than the degree: {f.label()}")
                design.knots[f] = spline_knots(rows, f.column, *f.options)
        return design

    def columns_used(self) -> list[str]:
        return list(dict.fromkeys([self.response.column, *[f.column for t in self.terms for f in t]]))

    def complete(self, df: DataFrame) -> DataFrame:
        """Rows without a null in any column of the formula, and with logarithms of positive numbers only."""
        rows = df.dropna(subset=self.columns_used())
        for c in {f.column for f in [self.response, *[f for t in self.terms for f in t]] if f.kind == "log"}:
            rows = rows.filter(F.col(c) > 0)
        return rows

    def _parts(self, f: Factor, full: bool) -> list[tuple[str, Column]]:
        x = F.col(f.column)
        if f.kind == "level":
            # a level that was not recorded has no code, and so no prediction
            known = F.when(x.isin(*self.levels[f]), F.lit(0.0))
            return [(f"{f.label()}[{v}]" if full else f"{f.label()}[T.{v}]", F.when(x == v, 1.0).otherwise(known)) for v in self.levels[f][0 if full else 1 :]]
        if f.kind == "spline":
            return [(f"{f.label()}[{k}]", v) for k, v in enumerate(spline(f.column, self.knots[f], f.options[1]).values())]
        return [(f.label(), F.ln(x) if f.kind == "log" else x.cast("double"))]

    def columns(self) -> dict[str, Column]:
        """The design's columns but the constant, by name."""
        present = {frozenset(t) for t in self.terms} | {frozenset()}
        out: dict[str, Column] = {}
        for term in self.terms:
            parts = [self._parts(f, frozenset(term) - {f} not in present) for f in term]
            for chosen in product(*parts):
                value = chosen[0][1]
                for _, v in chosen[1:]:
                    value = value * v
                out[":".join(k for k, _ in chosen)] = value
        return out

    def target(self) -> Column:
        return F.ln(self.response.column) if self.response.kind == "log" else F.col(self.response.column).cast("double")


@dataclass
class FormulaFit:
    """``fit`` on columns __x0, __x1, ...; ``names`` are theirs, the constant first."""

    design: Design
    fit: Fit
    names: list[str]
    covariance: np.ndarray | None
    clusters: int | None

    def table(self) -> list[tuple[str, float, float, float, float]]:
        """(name, coefficient, error, statistic, p), Student's t by the clusters where there are any, else by the rows."""
        rows = self.fit.table(self.covariance, self.clusters - 1 if self.clusters else None)
        return [(name, *r[1:]) for name, r in zip(self.names, rows, strict=True)]

    def predicted(self) -> Column:
        """Of any rows; null where an input is null or a level was not among the fitted rows."""
        out = F.lit(float(self.fit.beta[0]))
        for v, b in zip(self.design.columns().values(), self.fit.beta[1:], strict=True):
            out = out + F.lit(float(b)) * v
        return out

    def with_predictions(self, df: DataFrame, predicted: str = "predicted", residual: str = "residual") -> DataFrame:
        p = self.predicted()
        return df.withColumns({predicted: p, residual: self.design.target() - p})


def fit_formula(df: DataFrame, formula: str, cluster: str | None = None, missing: str = "drop") -> FormulaFit:
    """Least squares of the formula; with ``cluster`` errors are robust to it.

    Rows with a null in a column of the formula or the cluster, or a logarithm's argument that is not positive, are dropped, or refused where
    ``missing`` is raise.  Dependent or constant columns are refused.  The coded rows are written once, as several passes read them.
    """
    design = Design.of(formula, df)
    rows = design.complete(df)
    rows = rows.filter(F.col(cluster).isNotNull()) if cluster else rows
    if missing == "raise" and (n := df.count() - rows.count()):
        raise ValueError(f"{n} rows with a missing value")
    columns = design.columns()
    inner = [f"__x{k}" for k in range(len(columns))]
    coded = dealt(rows).select(design.target().alias("__y"), *[v.alias(k) for k, v in zip(inner, columns.values(), strict=True)], *([F.col(cluster).alias("__cluster")] if cluster else []))
    coded = stored(coded, "coded")
    fit = ols(coded, "__y", inner)
    cov, g = cluster_covariance(coded, fit, "__y", "__cluster") if cluster else (None, None)
    return FormulaFit(design, fit, ["Intercept", *columns], cov, g)


def columns_of(formula: str, df: DataFrame) -> tuple[DataFrame, Sequence[str]]:
    """``df`` with the formula's design columns added, named as in the table, and their names."""
    columns = Design.of(formula, df).columns()
    return df.withColumns(columns), list(columns)
