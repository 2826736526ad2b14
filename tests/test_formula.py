import math
import random

import numpy as np
import pytest

from dealscope.operators import diagnostics
from dealscope.operators.formula import Design, Factor, columns_of, fit_formula, parsed
from dealscope.operators.ols import RankDeficient


def made(spark, n=300):
    rng = random.Random(12)
    rows = [(rng.choice("abc"), rng.choice(["u", "v"]), rng.uniform(1, 9), rng.randint(0, 1), rng.gauss(0, 1)) for _ in range(n)]
    rows = [(*r, math.exp(0.3 * r[2] - 0.02 * r[2] ** 2 + (r[0] == "b") + 0.5 * r[3] * (r[1] == "v") + 0.1 * r[4])) for r in rows]
    return rows, spark.createDataFrame([*rows, (None, "u", 1.0, 1, 0.0, 1.0), ("a", "u", 2.0, None, 0.0, 1.0), ("a", "u", 2.0, 1, 0.0, -1.0)], "g string, h string, x double, late int, e double, y double")


def test_parsing():
    g, x, late = Factor("level", "g"), Factor("plain", "x"), Factor("plain", "late")
    assert parsed("y ~ C(g) + x:late") == (Factor("plain", "y"), [(g,), (x, late)])
    assert parsed("log(y) ~ C(g) * x + x")[1] == [(g,), (x,), (g, x)]
    assert parsed("y ~ late + bs(x, df=4)")[1] == [(late,), (Factor("spline", "x", (4, 3)),)]
    assert parsed("y ~ C(g) * x:late")[1] == [(g,), (x, late), (g, x, late)]
    for bad in ("y", "y ~", "y ~ x ~ late", "y ~ x ** 2", "y ~ x - 1", "y ~ f(x)", "y ~ C(g, x)", "C(y) ~ x", "y ~ bs(x, knots=3)", "y ~ x +"):
        with pytest.raises(ValueError):
            parsed(bad)


def design_of(rows, levels_of_interaction):
    out = []
    for g, h, x, late, *_ in rows:
        row = [1.0, *(float(g == k) for k in "bc"), float(late), x, x * x]
        out.append(row + [float(h == k) * late for k in levels_of_interaction])
    return np.array(out)


def test_coefficients_equal_numpy(spark):
    rows, df = made(spark)
    df = df.withColumn("x2", df["x"] * df["x"])
    y = np.log([r[5] for r in rows])
    # late is in the formula and h is not: h is coded without its first level beside late; alone with late it is coded in full
    for formula, inner, drop_late in (("log(y) ~ g + late + x + x2 + h:late", "v", False), ("log(y) ~ g + x + x2 + h:late", "uv", True)):
        fit = fit_formula(df, formula)
        m = design_of(rows, inner)
        m = np.delete(m, 3, axis=1) if drop_late else m
        want = np.linalg.lstsq(m, y, rcond=None)[0]
        assert fit.fit.n == len(rows)
        if drop_late:
            assert fit.names[-2:] == ["C(h)[u]:late", "C(h)[v]:late"] and fit.fit.beta == pytest.approx(want, abs=1e-9)
        else:
            assert fit.names == ["Intercept", "C(g)[T.b]", "C(g)[T.c]", "late", "x", "x2", "C(h)[T.v]:late"]
            assert fit.fit.beta == pytest.approx(want, abs=1e-9)
    errors = {r[0]: r[2] for r in fit_formula(df, "log(y) ~ g + x", "h").table()}
    assert set(errors) == {"Intercept", "C(g)[T.b]", "C(g)[T.c]", "x"} and all(v > 0 for v in errors.values())


def test_new_rows_are_coded_alike(spark):
    rows, df = made(spark)
    fit = fit_formula(df, "log(y) ~ C(g) + bs(x, df=5) + late")
    knots = fit.design.knots[Factor("spline", "x", (5, 3))]
    assert knots[0] == min(r[2] for r in rows) and len(knots) == 10
    inner = [r for r in rows if 3 < r[2] < 6]
    one = spark.createDataFrame(inner[:5], "g string, h string, x double, late int, e double, y double")
    whole = {(r["x"], r["e"]): r["p"] for r in fit.with_predictions(df, "p", "r").collect()}
    got = fit.with_predictions(one, "p", "r").collect()
    assert all(r["p"] == pytest.approx(whole[r["x"], r["e"]], abs=1e-12) and r["r"] == pytest.approx(math.log(r["y"]) - r["p"]) for r in got)
    odd = spark.createDataFrame([("z", 4.0, 1, 1.0), (None, 4.0, 1, 1.0), ("a", None, 1, 1.0)], "g string, x double, late int, y double")
    assert [r["p"] for r in fit.with_predictions(odd, "p", "r").collect()] == [None] * 3
    spread, names = columns_of("y ~ C(g) * late", df.drop("e"))
    assert names == ["C(g)[T.b]", "C(g)[T.c]", "late", "C(g)[T.b]:late", "C(g)[T.c]:late"] and set(names) < set(spread.columns)


def test_refusals(spark):
    _, df = made(spark, 60)
    with pytest.raises(ValueError, match="3 rows"):
        fit_formula(df, "log(y) ~ g + late", missing="raise")
    with pytest.raises(ValueError, match="absent"):
        Design.of("y ~ nothing", df)
    with pytest.raises(RankDeficient):
        fit_formula(df.withColumn("twice", df["x"] * 2), "y ~ x + twice")


def test_leaving_groups_out_equals_plain_fits(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randint(0, 40)}", rng.gauss(5, 2), rng.gauss(0, 1)) for _ in range(400)] + [("lone", 1.0, 2.0), (None, 1.0, 1.0), ("g1", None, 1.0)]
    rows = [(g, x, z, None if x is None else 2 + 3 * x - z + rng.gauss(0, 0.5)) for g, x, z in rows]
    got = {r["group"]: r for r in diagnostics.group_validated(spark.createDataFrame(rows, "g string, x double, z double, y double").repartition(4), "y", ["x", "z"], "g").collect()}
    known = [r for r in rows if None not in r]
    assert set(got) == {r[0] for r in known}
    for g, r in got.items():
        m, y, own = np.array([[1, x, z] for _, x, z, _ in known]), np.array([v for *_, v in known]), np.array([k[0] == g for k in known])
        e = y[own] - m[own] @ np.linalg.lstsq(m[~own], y[~own], rcond=None)[0]
        assert r["n"] == own.sum() and r["rmse"] == pytest.approx(float(np.sqrt((e * e).mean())), rel=1e-6)
        assert r["r2"] == (pytest.approx(1 - (e * e).mean() / y[own].var(), abs=1e-6) if own.sum() > 1 else None)
    two = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("b", 3.0, 1.0)], "g string, x double, y double")
    assert {r["group"]: r["rmse"] is None for r in diagnostics.group_validated(two, "y", ["x"], "g").collect()} == {"a": False, "b": True}
