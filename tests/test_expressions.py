import math

import pytest
from pyspark.sql import functions as F

from dealscope.functions import geo, numeric, text


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()[0]


@pytest.mark.parametrize(("value", "expected"), [(None, None), (30.0, "studio"), (45.0, "1-room"), (45.1, "2-room"), (90.0, "3-room"), (91.0, "4+room")])
def test_rooms(spark, value, expected):
    assert one(spark, value, "double", numeric.rooms_bucket) == expected


def test_flags_are_never_unknown(spark):
    df = spark.createDataFrame([(None,), (1.0,), (5.0,)], "x double")
    rows = df.select(numeric.within("x", 1, 3).alias("w"), numeric.missing("x").alias("m"), numeric.truth(F.col("x") > 2).alias("t"), numeric.bands("x", [("b", 0, 5)])["b"].alias("b")).collect()
    assert [tuple(r) for r in rows] == [(False, 1, 0, 0), (True, 0, 0, 1), (False, 0, 1, 0)]


def test_first_rule_wins_and_unknown_does_not_hold(spark):
    df = spark.createDataFrame([(None, 1), (1, 9), (9, None)], "a int, b int")
    rule = numeric.first_failing([("a", F.col("a") > 5), ("b", F.col("b") > 5)])
    assert [r[0] for r in df.select(rule).collect()] == ["", "b", "a"]


def test_clip_keeps_null_and_ratio_is_safe(spark):
    df = spark.createDataFrame([(None, 1.0), (9.0, 0.0), (6.0, 3.0)], "a double, b double")
    rows = df.select(numeric.clip("a", 0, 7), numeric.ratio("a", "b"), numeric.log_positive("b"), numeric.row_mean("a", "b")).collect()
    assert [tuple(r) for r in rows] == [(None, None, 0.0, 1.0), (7.0, None, None, 4.5), (6.0, 2.0, pytest.approx(math.log(3)), 4.5)]


@pytest.mark.parametrize(("value", "expected"), [(2.5, 2), (3.5, 4), (-2.5, -2), (None, None)])
def test_scaled_is_half_even(spark, value, expected):
    assert one(spark, value, "double", lambda c: numeric.scaled(c, 1.0)) == expected


def test_index_in_refuses_unseen(spark):
    df = spark.createDataFrame([("b",), (None,)], "x string")
    assert [r[0] for r in df.select(numeric.index_in("x", ["a", "b"])).collect()] == [1, -1]
    with pytest.raises(Exception, match="outside the domain"):
        df.select(numeric.index_in("x", ["a"])).collect()


def test_age_and_year(spark):
    df = spark.createDataFrame([("2026-07-13T1", 2030), ("x", 2000), (None, None), ("2026", 2020)], "t string, b int")
    assert [r[0] for r in df.select(numeric.age(numeric.iso_year("t"), "b")).collect()] == [0, None, None, 6]


def test_haversine_of_known_places(spark):
    d = spark.range(1).select(geo.haversine_km(*geo.CENTRE, *geo.MALLS["khan_shatyr"])).first()[0]
    assert d == pytest.approx(1.619, abs=0.001)


def test_null_place_gives_unknown_flags(spark):
    df = spark.createDataFrame([(None, 71.4), (51.1255, 71.4189)], "lat double, lon double")
    rows = df.withColumns(geo.landmark_columns("lat", "lon")).withColumn("cell", geo.grid_cell("lat", "lon")).collect()
    assert rows[0]["near_mall_1km"] is None and rows[0]["cell"] is None and rows[0]["mall_keruen_1km"] is None
    assert rows[1]["near_mall_1km"] is True and rows[1]["mall_asia_park_1km"] is True


def test_base_mall_does_not_count(spark):
    df = spark.createDataFrame([(51.1330, 71.4007)], "lat double, lon double")
    row = df.withColumns(geo.landmark_columns("lat", "lon")).first()
    assert row["mall_khan_shatyr_1km"] is True and row["near_mall_1km"] is False


def test_segments_take_the_first_and_the_specific_label(spark):
    t = "Площадь 54,5 м² Площадь кухни — 10 Пол ламинат, Площадь 99 Балкон остеклён да"
    found = spark.createDataFrame([(t,)], "t string").select(text.segments("t").alias("s"))
    row = found.select(*[text.labelled(F.col("s"), k).alias(k) for k in ("Площадь", "Площадь кухни", "Пол", "Балкон остеклён", "Дверь")]).first()
    assert tuple(row) == ("54,5 м²", "10", "ламинат", "да", None)


def test_price_and_district(spark):
    df = spark.createDataFrame([("от 41 500 000 ₸ Астана, Есильский р-н показать на карте",), ("Астана, р-н Байконур показать на карте",), ("",), (None,)], "t string")
    rows = df.select(text.price("t"), text.district("t")).collect()
    assert [tuple(r) for r in rows] == [(41500000, "Есильский"), (None, "Байконур"), (None, None), (None, None)]


@pytest.mark.parametrize(("value", "expected"), [("Да, есть", True), (" нет", False), ("может", None), (None, None)])
def test_yes_no(spark, value, expected):
    assert one(spark, value, "string", text.yes_no) is expected


@pytest.mark.parametrize(("value", "expected"), [("Свежий ремонт ", "fresh_renovation"), ("черновая отделка", "rough"), ("x", "needs_renovation"), ("", "unknown"), (None, "unknown")])
def test_condition(spark, value, expected):
    assert one(spark, value, "string", text.condition) == expected


def test_small_parsers(spark):
    df = spark.createDataFrame([("9 из 12", "до 3,25 м", "2026 г", "a, b ,c", "  монолит x")], "f string, n string, y string, l string, w string")
    floor, floors = text.floor_pair("f")
    row = df.select(floor, floors, text.first_number("n"), text.leading_year("y"), text.comma_list("l"), text.first_token("w"), text.comma_list(F.lit(None).cast("string"))).first()
    assert tuple(row) == (9, 12, 3.25, 2026, ["a", "b", "c"], "монолит", [])


def test_ids_and_coordinates(spark):
    df = spark.createDataFrame([("https://x/a/show/123", '{"lat": "51.1", "lng":71.43}')], "u string, h string")
    assert tuple(df.select(text.show_id("u", end=True), text.latitude("h"), text.longitude("h"), text.latitude("u")).first()) == ("123", "51.1", "71.43", "")
    with pytest.raises(Exception, match="without an id"):
        df.select(text.show_id("h", end=True)).collect()
