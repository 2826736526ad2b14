import math
import random

import pytest

from dealscope.operators import nearest

R = 6371.0088


def haversine(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.asin(min(1, math.sqrt(h)))


def to_segment(p, s):
    c = math.cos(math.radians(p[0]))
    ax, ay, bx, by = (s[1] - p[1]) * c, s[0] - p[0], (s[3] - s[1]) * c, s[2] - s[0]
    t = max(0.0, min(1.0, -(ax * bx + ay * by) / (bx * bx + by * by))) if bx or by else 0.0
    return math.radians(math.hypot(ax + t * bx, ay + t * by)) * R


@pytest.fixture(scope="module")
def spread():
    rng = random.Random(6)
    # a dense town, a far village, both sides of the equator, rows without a place
    rows = [(51 + rng.gauss(0, 0.05), 71 + rng.gauss(0, 0.08)) for _ in range(150)] + [(rng.uniform(-3, 60), rng.uniform(20, 90)) for _ in range(40)] + [(0.0, 30.0), (-0.0, -10.0)]
    rows = [(k, *p) for k, p in enumerate(rows)] + [(900, None, 71.0), (901, 51.0, None)]
    spots = [(f"s{k:02}", 51 + rng.gauss(0, 0.04), 71 + rng.gauss(0, 0.05)) for k in range(40)] + [("far", -1.0, 30.0), ("twin", 51.0, 71.0), ("also", 51.0, 71.0), ("none", None, 1.0)]
    return rows, spots


@pytest.mark.parametrize("first_km", [None, 0.05, 40.0])
def test_nearest_place_equals_brute_force(spark, spread, first_km):
    rows, spots = spread
    df = spark.createDataFrame(rows, "id int, lat double, lon double").selectExpr("*", "id as name", "id as cy")
    got = {r["id"]: (r["name"], r["distance_km"]) for r in nearest.nearest_place(df, "id", spark.createDataFrame(spots, "name string, lat double, lon double"), first_km=first_km).collect()}
    assert len(got) == len(rows)
    for i, *p in rows:
        if None in p:
            assert got[i] == (None, None)
            continue
        km, name = min((haversine(p, s[1:]), s[0]) for s in spots if None not in s)
        assert got[i][1] == pytest.approx(km, abs=1e-9) and (got[i][0] == name or km == pytest.approx(min(haversine(p, s[1:]) for s in spots if s[0] == got[i][0]), abs=1e-9))
    assert all(name != "twin" for name, _ in got.values())


def test_nearest_segment_equals_brute_force(spark, spread):
    rows, spots = spread
    rng = random.Random(7)
    stops = [(f"l{k % 3}", k, s[1], s[2]) for k, s in enumerate(spots) if s[1] is not None]
    rng.shuffle(stops)
    lines = nearest.segments_of(spark.createDataFrame(stops, "line string, k int, lat double, lon double"), "line", "k")
    level = [("level", 51.2, 70.5, 51.2, 71.5), ("upright", 50.5, 70.9, 51.5, 70.9), ("point", 50.8, 71.3, 50.8, 71.3), ("none", None, 1.0, 1.0, 1.0)]
    lines = lines.unionByName(spark.createDataFrame(level, "name string, lat1 double, lon1 double, lat2 double, lon2 double"))
    plain = [tuple(r) for r in lines.collect() if r[1] is not None]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")
    got = {r["id"]: (r["name"], r["distance_km"]) for r in nearest.nearest_segment(df, "id", lines).collect()}
    assert len(got) == len(rows)
    for i, *p in rows:
        if None in p:
            assert got[i] == (None, None)
        else:
            km, name = min((to_segment(p, s[1:]), s[0]) for s in plain)
            assert got[i] == (name, pytest.approx(km, abs=1e-9)), (i, p)


def test_without_rows_or_targets(spark, spread):
    rows, spots = spread
    df, places = spark.createDataFrame(rows[:3], "id int, lat double, lon double"), spark.createDataFrame(spots, "name string, lat double, lon double")
    assert [tuple(r)[1:] for r in nearest.nearest_place(df, "id", places.limit(0)).collect()] == [(None, None)] * 3
    assert nearest.nearest_place(df.limit(0), "id", places).count() == 0


def test_segments_that_tie_are_chosen_as_by_sql(spark, tmp_path):
    """Places on two lines at once: the last bit of distances of about 1e-12 m decides, so it has to be that of the SQL."""
    duckdb = pytest.importorskip("duckdb")
    from dealscope.plans import catalogue, oracle

    con = duckdb.connect()
    con.sql(f"COPY (SELECT 6535 + i AS c_custkey FROM range(1500) r(i)) TO '{tmp_path}/customer.parquet'")
    con.sql(f"COPY (SELECT i AS s_suppkey, 'S' || i AS s_name FROM range(6001) r(i)) TO '{tmp_path}/supplier.parquet'")
    for t in ("customer", "supplier"):
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    want = con.sql(oracle.ORACLE_SQL["nearest_stations"]).fetchall()
    got = catalogue.QUERIES["nearest_stations"](spark, str(tmp_path)).collect()
    assert len(want) == 1500 and sorted(map(tuple, got)) == sorted(want)
