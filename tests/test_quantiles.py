import math
import random

import numpy as np
import pytest

from dealscope.operators import profile, quantiles

POINTS = [0.0, 0.013, 0.25, 0.5, 0.501, 0.99, 1.0]


def test_groups_of_all_kinds_equal_numpy(spark):
    rng = random.Random(5)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(900)],
        "equal": [7.25] * 500,
        "mostly": [7.25] * 400 + [rng.random() for _ in range(30)],
        "wide": [math.exp(rng.uniform(-600, 600)) * rng.choice([-1, 1]) for _ in range(300)],
        "near": [1.7e9 + rng.random() for _ in range(700)],
        "zeros": [0.0, -0.0, 5e-324, -5e-324, 0.0, 1e308, -1e308],
        "one": [3.0],
        "whole": [float(rng.randint(-5, 5)) for _ in range(200)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("none", None), (None, 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").selectExpr("*", "v as n", "g as q", "1 as times").repartition(5)
    got = {r["g"]: (r["n"], r["q"]) for r in quantiles.group_quantiles(df, ["g"], "v", POINTS).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        s = sorted(values)
        want = [s[math.floor(p * (len(s) - 1))] + (p * (len(s) - 1) % 1) * (s[math.ceil(p * (len(s) - 1))] - s[math.floor(p * (len(s) - 1))]) for p in POINTS]
        assert got[g][0] == len(values) and got[g][1] == pytest.approx(want, rel=1e-12, abs=1e-300), g


def test_without_keys_and_values_and_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(float(k % 97),) for k in range(1000)] + [(None,)], "v double")
    want = np.quantile([k % 97 for k in range(1000)], POINTS).tolist()
    assert profile.exact_quantiles(df, "v", POINTS, most=10) == pytest.approx(want) == profile.exact_quantiles(df, "v", POINTS)
    two = df.selectExpr("v", "-v as w", "cast(null as double) as u")
    plain = {"v": pytest.approx(want), "w": pytest.approx(np.quantile([-(k % 97) for k in range(1000)], POINTS).tolist()), "u": [None] * len(POINTS)}
    assert profile.column_quantiles(two, ["v", "w", "u"], POINTS) == plain == profile.column_quantiles(two, ["v", "w", "u"], POINTS, most=10)
    monkeypatch.setattr(quantiles, "_FEW", 0)
    assert quantiles.group_quantiles(df, [], "v", POINTS).first()["q"] == pytest.approx(want)
    empty = df.filter("false")
    assert quantiles.group_quantiles(empty, [], "v", POINTS).count() == 0 and profile.exact_quantiles(empty, "v", [0.5]) == [None]
    assert [tuple(r) for r in profile.quantiles(empty, "v", [0.5]).collect()] == [(0.5, None)]
    odd = spark.createDataFrame([(math.inf,), (-math.inf,), (math.nan,), (1.0,)], "v double")
    assert quantiles.group_quantiles(odd, [], "v", [0.0]).first()["q"] == [-math.inf]
    assert [tuple(r)[:2] for r in profile.describe(empty, ["v"]).collect()] in ([], [("v", 0)])
