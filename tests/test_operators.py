import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealscope.operators import dedup, design, diagnostics, did, effects, groups, hierarchical, ols, profile, quality, radius, ranking, sets


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_keep_first_is_stable_and_idempotent(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3), (None, "d", 4), (None, "e", 5)], "k int, v string, o int")
    once = dedup.keep_first(df, ["k"], ["o"])
    assert rows(once) == rows(dedup.keep_first(once, ["k"], ["o"])) == sorted([(1, "a", 1), (2, "c", 3), (None, "d", 4)], key=str)
    assert dedup.keep_first_complete(df, ["k"], ["o"]).count() == 4


def test_relists_in_two_passes(spark):
    data = [
        (1, 51.1, 71.4, 50.0, 10, None, 2, 9),
        (2, 51.1, 71.4, 50.0, 10, "x", 3, 9),  # same place, area, price
        (3, 51.10001, 71.4, 50.0, 10, None, 2, 9),  # same cell and floors as 1
        (4, 51.2, 71.4, 50.0, 10, "x", 5, 9),
        (5, 51.3, 71.4, 50.0, 10, "x", 5, 9),  # same complex as 4
        (6, None, None, 50.0, 10, None, 5, 9),
        (7, None, None, 50.0, 10, None, 5, 9),  # no place, no complex: kept
    ]
    df = spark.createDataFrame(data, "id int, lat double, lon double, area_total_m2 double, price_tenge int, complex_name string, floor int, floor_total int")
    assert sorted(r[0] for r in dedup.without_relists(df, ["id"]).select("id").collect()) == [1, 4, 6, 7]


def test_group_median_flags_few_and_skips_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0), (None, 7.0)], "k string, v double")
    assert rows(groups.group_median(df, "k", "v", 2)) == [("a", 2.0, 2, False), ("b", 5.0, 1, True)]
    assert groups.with_group_median(df, "k", "v").filter("k is null").first()["median"] is None
    assert tuple(groups.group_sizes(df, "k", 2).first()) == (2, 1, 1, 3)


def test_percentile_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0), (None, 4.0)], "g string, v double")
    got = rows(ranking.percentile_rank(df, "g", "v", "p"))
    assert got == sorted([("a", 1.0, 0.0), ("a", 1.0, 0.0), ("a", 3.0, 1.0), ("a", None, None), ("b", 2.0, 0.0), (None, 4.0, None)], key=str)


def test_large_groups_are_ranked_by_ranges_alike(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.5, rng.randrange(40) / 4, rng.random()])) for _ in range(900)] + [("c", 2.0), ("d", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    assert rows(ranking.percentile_rank(df, "g", "v", "p")) == rows(ranking.percentile_rank(df, "g", "v", "p", most=10))
    assert rows(groups.group_median(df, "g", "v", 3)) == rows(groups.group_median(df, "g", "v", 3, most=10))


def test_quantiles_by_narrowing_equal_plain_ones(spark):
    rng = np.random.default_rng(4)
    for values in (rng.normal(0, 1, 5000), np.repeat([1.0, 2.0, 3.0], 1000), np.append(np.full(3000, 7.0), rng.random(50))):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        points = [0.0, 0.013, 0.25, 0.5, 0.501, 0.99, 1.0]
        got = profile.exact_quantiles(df, "v", points, most=300)
        assert got == pytest.approx(np.quantile(values, points).tolist(), abs=1e-12)
    assert profile.exact_quantiles(df.filter("false"), "v", [0.5]) == [None]


def test_rows_at_one_place_weigh_as_pairs_do(spark):
    rng = random.Random(8)
    spots = [(51.1 + rng.gauss(0, 0.002), 71.4 + rng.gauss(0, 0.002)) for _ in range(12)]
    data = [(k, *rng.choice(spots), rng.uniform(1, 2), "d", "g", rng.choice([None, "x", "y"]), f"b{k % 9}", float(k % 3), k % 10 != 0) for k in range(120)]
    df = spark.createDataFrame(data, "id int, lat double, lon double, y double, district string, grid_cell_id string, complex_name string, building string, x double, fit boolean")
    out, _ = hierarchical.hierarchical_fit(df, "id", "y", ["x"], "fit")
    got = {r["id"]: r["kernel_eff_n"] for r in out.collect()}
    known = [d for d in data if d[9]]
    for d in data:
        w = [math.exp(-0.5 * (km / 0.1) ** 2) for e in known if e[0] != d[0] and (km := distance(d, e)) <= 0.5] if d[9] else []
        assert got[d[0]] == pytest.approx(sum(w) ** 2 / sum(v * v for v in w) if w else 0.0, abs=0.006)


def distance(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def test_next_ids_follow_text_order(spark):
    new = spark.createDataFrame([(str(k),) for k in (3, 20, 1, 100)], "k string")
    known = spark.createDataFrame([(7,)], "n int")
    assert rows(ranking.next_ids(new, "k", known, "n", "id", 3)) == [("1", 8), ("100", 9), ("20", 10), ("3", 11)]


def test_default_row_numbers_count_links_before(spark):
    links = spark.createDataFrame([(0, "u0", None), (1, "", None), (2, "u2", 50), (3, "u3", None)], "p int, url string, source_row int")
    assert [r["source_row"] for r in ranking.default_row_numbers(links, "p").orderBy("p").collect()] == [2, 50, 4]


def test_sets(spark):
    a, b = (spark.createDataFrame([(k,) for k in x], "k int") for x in ((1, 2, 3), (3, 4)))
    assert rows(sets.pending(a, b, "k")) == [(1,), (2,)] and rows(sets.union_of(a, b, "k")) == [(1,), (2,), (3,), (4,)]
    assert tuple(sets.overlap(a, b, "k", 4).first()) == (1, 0.25)
    assert sets.missing_columns(a, ["k", "z"]) == ["z"]


def test_quality_raises(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "x int, c string")
    with pytest.raises(quality.CheckFailed):
        quality.require(df, {"known": F.col("x") > 0})
    with pytest.raises(quality.CheckFailed):
        quality.require_categories(df, "c", ["a"])
    with pytest.raises(quality.CheckFailed):
        quality.require_count(df, 3)
    out, got = quality.stored_checked(df.repartition(3), "checked", {"some": F.col("c").isNotNull()}, rows=df.count(), figures={"most": F.max("x"), "none": F.count_if(F.col("x").isNull())})
    assert got == {"rows": df.count(), **df.agg(F.max("x").alias("most"), F.count_if(F.col("x").isNull()).alias("none")).first().asDict()} and out.count() == got["rows"]
    for bad in ({"checks": {"known": F.col("x") > 0}}, {"rows": 99}):
        with pytest.raises(quality.CheckFailed):
            quality.stored_checked(df, "checked", **bad)
    assert quality.stored_checked(df.filter("false"), "checked", {"known": F.col("x") > 0}, rows=0)[1] == {"rows": 0}
    assert quality.require_categories(df, "c", ["b", "a"]) is df


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(3)
    data = [(k, 51.1 + rng.gauss(0, 0.02), 71.4 + rng.gauss(0, 0.03), rng.uniform(1, 9)) for k in range(300)]
    data += [(300, 51.1, 71.4, 2.0), (301, 51.1, 71.4, 4.0), (302, None, 71.4, 1.0), (303, 51.1, 71.4, None), (304, 10.0, 10.0, 1.0)]
    return data, spark.createDataFrame(data, "id int, lat double, lon double, v double")


def brute(data, km):
    def dist(a, b):
        la, lb = math.radians(a[1]), math.radians(b[1])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))

    known = [d for d in data if None not in d]
    out = {d[0]: [] for d in data}
    for a in known:
        out[a[0]] = [b[3] for b in known if b[0] != a[0] and dist(a, b) <= km]
    return out


@pytest.mark.parametrize("km", [1.0, 3.0])
def test_radius_joins_equal_brute_force(places, km):
    data, df = places
    expected = brute(data, km)
    for f in (radius.radius_stats, lambda *a: radius.radius_stats(*a, per_leaf=8), lambda *a: radius.radii_stats(a[0], [a[1], 0.3], *a[2:], per_leaf=15, most_near=90).withColumnsRenamed({f"{c}_0": c for c in ("n", "mean", "median")})):
        got = {r["id"]: r for r in f(df, km, "id", "v").collect()}
        assert len(got) == len(data)
        for k, v in expected.items():
            assert got[k]["n"] == len(v)
            assert got[k]["median"] == (pytest.approx(float(np.median(v))) if v else None)
            assert got[k]["mean"] == (pytest.approx(float(np.mean(v))) if v else None)


def test_many_rows_at_one_place_and_few_far_ones(spark):
    # values 0 .. n - 1 at one place; 1 km and 3 km away one row each
    n = 100_000
    hot = spark.range(n).selectExpr("id", "51.0D as lat", "71.0D as lon", "cast(id as double) as v")
    far = spark.createDataFrame([(n, 51.0, 71.0128, -1.0), (n + 1, 51.0, 71.0385, 1e9), (n + 2, 51.0, 75.0, 5.0)], "id long, lat double, lon double, v double")
    got = radius.radii_stats(hot.unionByName(far), [1.0, 3.0], "id", "v")
    assert got.count() == n + 3
    by = {r["id"]: r for r in got.filter(f"id < 2 or id > {n - 2}").collect()}
    total = n * (n - 1) / 2
    assert (by[0]["n_0"], by[0]["mean_0"], by[0]["median_0"]) == (n, pytest.approx((total - 1) / n), n / 2 - 0.5)
    assert (by[0]["n_1"], by[0]["mean_1"], by[0]["median_1"]) == (n + 1, pytest.approx((total - 1 + 1e9) / (n + 1)), n / 2)
    assert by[n - 1]["median_0"] == (n - 2) / 2 - 0.5 and by[n]["n_0"] == n and by[n]["median_0"] == n / 2 - 0.5
    assert by[n + 2]["n_1"] == 0 and by[n + 2]["mean_1"] is None and by[n + 2]["median_1"] is None


def test_kernel_means_equal_brute_force(places):
    data, df = places
    got = {r["id"]: r for r in effects.kernel_means(df, "id", "v", 0.3, 1.0).collect()}
    for i, lat, lon, v in data:
        if lat is None or lon is None:
            assert i not in got
            continue
        near = [(math.exp(-0.5 * (km / 0.3) ** 2), w[3]) for w in data if w[0] != i and None not in w and (km := distance((i, lat, lon), w)) <= 1.0]
        if not near:
            assert i not in got
            continue
        sw, sw2 = sum(w for w, _ in near), sum(w * w for w, _ in near)
        assert (got[i]["sum_w"], got[i]["n_eff"], got[i]["smooth"]) == (pytest.approx(sw), pytest.approx(sw * sw / sw2), pytest.approx(sum(w * x for w, x in near) / sw))


def test_kernel_edges_are_symmetric(places):
    e = {(r[0], r[1]): r[2] for r in radius.kernel_edges(places[1].dropna(), 0.3, 1.0, "id").collect()}
    assert e and all(e[j, i] == pytest.approx(w) for (i, j), w in e.items()) and (300, 301) in e


def test_loo_effect(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "a", None), (4, "b", 5.0), (5, None, 7.0)], "id int, g string, v double")
    got = {r["id"]: (r["e"], r["n"]) for r in effects.loo_effect(df, "g", "v", 0.0, "e", "n").collect()}
    assert got == {1: (3.0, 1), 2: (1.0, 1), 3: (2.0, 2), 4: (0.0, 0), 5: (0.0, -1)}


def made(n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(50, 3, (n, 2)) * [1, 1e4]
    g = rng.integers(0, 20, n)
    y = 3 + 0.5 * x[:, 0] - 2e-5 * x[:, 1] + rng.normal(0, 1, n) + rng.normal(0, 0.5, 20)[g]
    return x, g, y


def test_ols_and_clusters_equal_numpy(spark):
    x, g, y = made()
    data = [(float(a), float(b), int(c), float(d)) for (a, b), c, d in zip(x, g, y, strict=True)] + [(None, 1.0, 1, 1.0)]
    df = spark.createDataFrame(data, "a double, b double, g int, y double")
    fit = ols.ols(df, "y", ["a", "b"])
    m = np.column_stack([np.ones(len(y)), x])
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    e = y - m @ beta
    assert fit.n == len(y) and fit.beta == pytest.approx(beta, rel=1e-6)
    assert fit.r2 == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum())
    inv = np.linalg.inv(m.T @ m)
    s = np.stack([(m * e[:, None])[g == k].sum(axis=0) for k in np.unique(g)])
    k, n = len(np.unique(g)), len(y)
    cov = inv @ s.T @ s @ inv * k / (k - 1) * (n - 1) / (n - 3)
    got, clusters = ols.cluster_covariance(df, fit, "y", "g")
    assert clusters == k and np.sqrt(np.diag(got)) == pytest.approx(np.sqrt(np.diag(cov)), rel=1e-5)
    with pytest.raises(ValueError, match="missing"):
        ols.ols(df, "y", ["a", "b"], missing="raise")
    with pytest.raises(ols.RankDeficient):
        ols.ols(df.withColumn("c", F.col("a") * 2 + 1), "y", ["a", "c"])


def test_t_tail_values():
    assert ols.p_value(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert ols.p_value(1.959963984540054, None) == pytest.approx(0.05, abs=1e-9)
    assert did.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-6)


def test_spline_is_a_partition_of_unity(spark):
    df = spark.createDataFrame([(float(k),) for k in range(101)], "x double")
    knots = design.spline_knots(df, "x")
    cols = design.spline("x", knots)
    assert len(cols) == 5 and knots[4:6] == pytest.approx([100 / 3, 200 / 3])
    for r in df.select(*[c.alias(k) for k, c in cols.items()], "x").collect():
        total = sum(r[k] for k in cols)
        assert -1e-12 <= total <= 1 + 1e-12 and (r["x"] == 0) == (total == 0)
    assert df.select(cols["bs5"].alias("b")).orderBy(F.desc("x")).first()[0] == pytest.approx(1.0)


def test_design_folds_and_codes(spark):
    df = spark.createDataFrame([("a", True), ("b", True), ("b", True), ("z", False)], "c string, f boolean")
    out = design.fold_unseen(df, ["c"], F.col("f"))
    assert design.levels(out, "c") == ["a", "b"] and out.filter("c = 'b'").count() == 3
    assert list(design.treatment("c", ["a", "b"])) == ["c_1"]


def test_robust_z_and_composite(spark):
    data = [(k, float(v), k != 5, float(-v), True) for k, v in enumerate([1, 2, 3, 4, 100, 7])]
    df = spark.createDataFrame(data, "id int, s double, so boolean, r double, ro boolean")
    got = {r["id"]: r["score"] for r in hierarchical.composite_score(df, "s", "so", "r", "ro", "score").collect()}

    def z(x):
        med = np.median(x)
        return (x - med) / (1.4826 * np.median(np.abs(x - med)))

    s, r = z(-np.array([1, 2, 3, 4, 100.0])), z(np.array([1, 2, 3, 4, 100, 7.0]))
    for k in range(6):
        assert got[k] == pytest.approx((s[k] + r[k]) / 2 if k < 5 else r[5])
    flat = profile.robust_z(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v", "z")
    assert [x["z"] for x in flat.collect()] == [0.0, 0.0]


def test_profile_tables(spark):
    df = spark.createDataFrame([("a", float(v), "x") for v in range(10)] + [("a", 100.0, "u"), ("b", 1.0, None)], "g string, v double, e string")
    assert rows(profile.iqr_outliers(df, "g", "v")) == [("a", 11, 1, pytest.approx(1 / 11))]
    assert {r[0]: tuple(r)[1:] for r in profile.missingness(df, ["e"], {"e": "u"}).collect()} == {"e": (10, 2, pytest.approx(10 / 12))}
    assert sum(r["n"] for r in profile.histogram(df, F.col("v"), 0, 9, 3).collect()) == 11
    assert profile.correlation_matrix(df, ["v", "v"]).count() == 3


def test_hierarchical_fit_equals_numpy(spark):
    rng = np.random.default_rng(9)
    n = 120
    lat, lon = 51.1 + rng.normal(0, 0.003, n), 71.4 + rng.normal(0, 0.004, n)
    d, g, c, b = rng.integers(0, 3, n), rng.integers(0, 8, n), rng.integers(0, 15, n), rng.integers(0, 40, n)
    x = rng.normal(0, 1, (n, 2))
    y = 1 + x @ [0.3, -0.2] + rng.normal(0, 0.2, 15)[c] + rng.normal(0, 0.1, n)
    fit = np.arange(n) % 10 != 0
    comp = [None if k % 9 == 0 else f"c{c[k]}" for k in range(n)]
    data = [(k, float(y[k]), float(x[k, 0]), float(x[k, 1]), bool(fit[k]), f"d{d[k]}", f"g{g[k]}", comp[k], f"b{b[k]}", float(lat[k]), float(lon[k])) for k in range(n)]
    df = spark.createDataFrame(data, "id int, y double, x1 double, x2 double, fit boolean, district string, grid_cell_id string, complex_name string, building string, lat double, lon double")
    out, info = hierarchical.hierarchical_fit(df, "id", "y", ["x1", "x2"], "fit")

    la, lo = np.radians(lat), np.radians(lon)
    h = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la[:, None]) * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
    dist = 2 * 6371.0088 * np.arcsin(np.sqrt(h))
    w = np.exp(-0.5 * (dist / 0.1) ** 2) * (dist <= 0.5)
    np.fill_diagonal(w, 0)
    w[:, ~fit] = 0
    m = np.column_stack([np.ones(n), x])
    loc = np.zeros(n)
    for _ in range(6):
        beta = np.linalg.lstsq(m[fit], (y - loc)[fit], rcond=None)[0]
        r = np.where(fit, y - m @ beta, np.nan)
        loc = np.zeros(n)
        for key, lam in ((d, 2.0), (g, 1.0), (np.array([k or "" for k in comp]), 2.0), (b, 2.0)):
            v, new = r - loc, np.zeros(n)
            for k in range(n):
                if key[k] == "":
                    continue
                others = (key == key[k]) & fit & (np.arange(n) != k)
                new[k] = v[others].sum() / (others.sum() + lam)
            loc = loc + new
        v = np.where(fit, r - loc, 0)
        sw = w.sum(axis=1)
        smooth = np.where(sw > 1e-12, w @ v / np.maximum(sw, 1e-300), 0)
        loc = loc + np.where(fit, smooth * sw / (sw + 3), 0)
    expected = np.where(fit, y - m @ beta - loc, np.nan)
    got = {r["id"]: r for r in out.collect()}
    for k in range(n):
        assert got[k]["hier_residual_ln"] == (pytest.approx(expected[k], abs=1e-9) if fit[k] else None)
    assert info["n_fit"] == fit.sum()


def test_diagnostics(spark):
    x, _, y = made(200)
    df = spark.createDataFrame([(k, float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, y double")
    vif = {r[0]: r[1] for r in diagnostics.variance_inflation(df, ["a", "b"]).collect()}
    assert vif["a"] == pytest.approx(1 / (1 - np.corrcoef(x.T)[0, 1] ** 2), rel=1e-6)
    cv = diagnostics.cross_validated(df, "y", ["a", "b"], 4, "id").collect()
    assert sum(r["n"] for r in cv) == 200 and all(0.5 < r["rmse"] < 2 for r in cv)
    fitted = ols.with_residuals(df, ols.ols(df, "y", ["a", "b"]), "y")
    assert sum(r["n"] for r in diagnostics.residuals_by_fitted(fitted, "predicted", "residual").collect()) == 200
    assert diagnostics.normal_quantiles(fitted, "residual").count() == 19
