import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealscope.llm.negatives import MOST, hard_negatives, scores

ROWS = "vec_id long, embedding array<double>, label int"


def brute(rows):
    ok = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []

    def first(t):
        return (-t[0], t[1] is None, t[1] or 0)

    for k, (i, v, label) in enumerate(ok):
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, m) for q, (j, w, m) in enumerate(ok) if q != k]
        other = sorted(((s, j) for s, j, m in scored if m != label), key=first)
        for s, j in sorted(((s, j) for s, j, m in scored if m == label), key=first)[:5]:
            found = [(t, u) for t, u in other if 50 * s <= 100 * t <= 95 * s][:3]
            out += [(i, j, rank, u, s, t) for rank, (t, u) in enumerate(found, 1)]
    return sorted(out, key=str)


def mined(df, **options):
    return sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 50 == 0, **options).collect()), key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(5)
    rows = [(k * 10 if k % 3 else k * 25, [rng.choice([0.1, -0.3, 0.5, 0.02]) for _ in range(4)], rng.choice([0, 1, 2, 3, None])) for k in range(200)]
    # null ids and vectors, null and non-finite components, short vectors, repeated anchors, and many ties
    rows += [(None, [0.5] * 4, 1), (5, None, 1), (50, [1.0, None, 0.1, 0.1], 2), (100, [float("nan")] * 4, 2), (150, [float("inf"), 0.1, 0.1, 0.1], 1), (200, [], 1), (250, [0.5, 0.1], 1)]
    return rows + [(50, [0.5] * 4, 1)] * 3 + [(k, [0.5, 0.5, 0.1, 0.5], 2) for k in range(1001, 1060)]


def test_windows_equal_brute_force_for_any_blocks(spark, vectors):
    df = spark.createDataFrame(vectors, ROWS).selectExpr("*", "vec_id as row", "label as block", "label as q").repartition(5)
    want = brute(vectors)
    assert len(want) > 500 and mined(df, per_block=37, anchors_per_block=5) == want


def test_no_rows_and_single_labels(spark, vectors):
    df = spark.createDataFrame(vectors, ROWS)
    assert mined(df.limit(0)) == [] and mined(df.filter("label = 1")) == [] and mined(df.filter("vec_id % 50 > 0")) == []


def test_scores_are_exact_and_saturate():
    rng = random.Random(1)
    for size in (1e3, 1e8, 1e12, 1e200):
        a, b = (np.floor(np.array([[rng.uniform(-size, size) for _ in range(6)] for _ in range(4)])) for _ in range(2))
        want = [[max(-MOST, min(MOST, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for q in b] for p in a]
        assert [[int(x) for x in row] for row in scores(a, b)] == want
    assert scores(np.ones((2, 3)), np.ones((1, 2))).tolist() == [[2], [2]] and scores(np.ones((2, 0)), np.ones((1, 2))).tolist() == [[0], [0]]


def test_nothing_goes_through_the_driver(spark, vectors):
    df = spark.createDataFrame(vectors, ROWS)
    status = spark._jsparkSession.sharedState().statusStore()
    before = status.executionsCount()
    plans = [hard_negatives(df, F.col("vec_id") % 50 == 0, per_block=37, anchors_per_block=5)]
    runs = status.executionsList()
    told = [runs.apply(k).physicalPlanDescription() for k in range(before, runs.size())] + [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert len(told) > 5 and not [t for t in told if "BroadcastExchange" in t or "BroadcastHashJoin" in t]
