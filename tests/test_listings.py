import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from dealscope.operators import hierarchical
from dealscope.operators.did import near_sample
from dealscope.operators.quality import CheckFailed
from dealscope.plans import listings, models, reports

RAW = "source_row int, url string, status string, http_status int, advert_info string, parameters string, lat double, lon double, fetched_at string, error string"


def advert(price="41 500 000", district="Есильский", area="54,5", floor="3 из 9", year="2020", more=""):
    return f"{price} ₸ Астана, {district} р-н показать на карте Тип дома монолитный Год постройки {year} Этаж {floor} Площадь {area} м², Площадь кухни — 10 м² {more}"


def test_parse_fields_and_warnings(spark):
    data = [
        (1, "u/a/show/1", "ok", 200, advert(more="Жилой комплекс Северный Рассрочка"), "Балкон балкон Балкон остеклён да Безопасность решетки, видео Возможен обмен нет", 51.1, 71.4, "2026-07-13T10:00", ""),
        (2, "u/a/show/2", "error", 404, None, None, None, None, None, "gone"),
        (3, "u/a/show/3", "ok", 200, "нет цены", "Астана, р-н Байконур показать на карте | Площадь 30 м²", 51.1, 71.4, "bad", ""),
    ]
    got = {r["source_row"]: r for r in listings.parsed(spark.createDataFrame(data, RAW), 2026).collect()}
    a = got[1]
    assert (a["price_tenge"], a["district"], a["city"], a["area_total_m2"], a["kitchen_area_m2"]) == (41500000, "Есильский", "Астана", 54.5, 10.0)
    assert (a["floor"], a["floor_total"], a["floor_is_first"], a["floor_is_last"]) == (3, 9, False, False)
    assert a["price_is_installment"] and a["building_type"] == "монолитный" and a["is_under_construction"] is False
    assert a["balcony_glazed"] is True and a["balcony"] == "балкон" and a["security_features"] == ["решетки", "видео"] and a["exchange_possible"] is False
    assert a["rooms_bucket_estimated"] == "2-room" and a["parse_warnings"] == [] and a["apartment_condition"] == "unknown"
    b = got[2]
    assert b["price_tenge"] is None and b["price_is_installment"] is False and b["security_features"] == [] and len(b["parse_warnings"]) == 1
    c = got[3]
    assert c["area_total_m2"] == 30.0 and len(c["parse_warnings"]) == 3 and c["parse_warnings"][0].startswith("pipe")


@pytest.fixture(scope="module")
def raw(spark):
    rng = random.Random(2)
    data = []
    for k in range(160):
        area, year, cx = rng.randint(20, 120), rng.randint(1990, 2026), rng.randint(0, 9)
        price = f"{int(area * rng.uniform(4e5, 9e5)):,}".replace(",", " ")
        text = advert(price, rng.choice(["Есильский", "Алматинский"]), str(area), f"{rng.randint(1, 9)} из 9", str(year), f"Жилой комплекс К{cx}" if cx else "")
        data.append((k, f"https://x/a/show/{k}", "ok", 200, text, f"Высота потолков {rng.choice([2.5, 2.7, 3.0])} Пол ламинат", 51.1 + cx / 1000 + rng.gauss(0, 0.002), 71.4 + rng.gauss(0, 0.003), "2026-07-13", ""))
    data.append((200, *data[5][1:]))  # a relist
    return spark.createDataFrame(data, RAW)


def test_pipeline_from_scrape_to_map(raw):
    features = listings.featured(listings.parsed(raw, 2026), raw).persist()
    assert features.count() == 160
    assert features.filter(F.col("n_neighbors_3km") < F.col("n_neighbors_1km")).count() == 0
    ranked, info = listings.ranked(features)
    ranked = ranked.persist()
    assert ranked.count() == 160 and info["n_fit"] == ranked.filter("fit_excl_reason = ''").count()
    assert ranked.filter("percentile_rank_in_district not between 0 and 1").count() == 0
    assert ranked.filter("good_deal_score is not null").count() > 100
    tables = reports.parse_report(listings.parsed(raw, 2026)) | reports.feature_report(features) | reports.ranking_report(ranked, 20) | reports.profile_report(ranked)
    assert len(reports.as_lines(tables)) > 80 and tables["duplicates"].first()["extra"] == 0
    assert sum(r["n"] for r in tables["waterfall"].collect()) == info["n_fit"]
    categories = {c: sorted({r[0] for r in ranked.select(c).dropna().distinct().collect()}) for c in listings.CATEGORIES}
    box = ((51.095, 51.3), (71.0, 71.8))
    shown = listings.map_rows(ranked, categories, box)
    assert len(shown.columns) == 24
    own = {r["source_row"]: r for r in ranked.collect() if box[0][0] <= r["lat"] <= box[0][1]}
    names = sorted({r["complex_name"] for r in own.values() if r["complex_name"]})
    got = {r["id"]: r for r in shown.collect()}
    assert set(got) == set(own) and 0 < len(got) < 160

    def times(v, k):
        return None if v is None else round(v * k)

    for k, r in own.items():
        c = categories
        assert tuple(got[k]) == (
            k, round(r["lat"], 6), round(r["lon"], 6), times(r["price_tenge"], 0.001), r["area_total_m2"], r["build_year"], r["floor"], r["floor_total"],
            *[c[x].index(r[x]) if r[x] is not None else -1 for x in c], names.index(r["complex_name"]) if r["complex_name"] else -1,
            times(r["spatial_price_pct_vs_avg"], 1000), int(r["spatial_rank_reliable"]), r["n_neighbors_3km"], times(r["spatial_price_pct_vs_avg_1km"], 1000), int(r["spatial_rank_reliable_1km"]), r["n_neighbors_1km"],
            times(r["residual_pct"], 1000), int(r["residual_reliable"]), times(r["residual_z"], 100), times(r["predicted_price_m2"], 1), times(r["good_deal_score"], 1000),
        )
    figures = listings.map_figures(ranked, box).first()
    assert figures["rows_shown"] == len(got) and figures["rows_excluded_bbox"] == 160 - len(got) and figures["rows_excluded_no_coords"] == 0
    assert figures["strong_deals"] == sum(r["residual_reliable"] and r["residual_z"] <= -1.5 for r in own.values())
    payload = json.loads(listings.map_payload(ranked, "now", categories, box))
    assert len(payload["rows"]) == len(got) and [x[0] for x in payload["complexes"]] == names and payload["meta"]["rows_shown"] == len(got)
    assert {tuple(x) for x in payload["rows"]} == {tuple(r) for r in got.values()}
    assert payload["meta"]["city_median_price_m2"] == int(statistics.median(r["price_m2"] for r in own.values()))
    with pytest.raises(CheckFailed):
        listings.map_rows(ranked, categories | {"rooms_bucket_estimated": categories["rooms_bucket_estimated"][:1]})
    table = {r["name"]: r for r in hierarchical.coefficients(info).collect()}
    assert set(table) == set(info["beta"]) and all(r["error"] > 0 and 0 <= r["p"] <= 1 for r in table.values())


def test_repeated_error_rows_stay_what_they_are(spark):
    rows = [(7, "u/a/show/7", "error", 404, None, None, None, None, None, "gone")] * 2 + [(8, f"u/a/show/{k}", "ok", 200, advert(str(40_000_000 + k * 1_000_000), area=str(40 + k)), "", 51.1 + k / 1000, 71.4, "2026-07-13", "") for k in range(6)]
    raw = spark.createDataFrame(rows, RAW)
    features = listings.featured(listings.parsed(raw, 2026), raw)
    assert features.count() == len(rows) and features.filter("source_row = 7").count() == 2
    assert features.select("row_id").distinct().count() == len(rows)


def test_distance_models(spark):
    rng = random.Random(4)
    data = []
    for k in range(600):
        d, late = rng.uniform(0, 2000), k % 2
        y = 10 + (0.2 if d < 300 and late else 0) + rng.gauss(0, 0.02) + 0.01 * late
        data.append((float(y), late, d, rng.uniform(0, 3000), f"g{rng.randint(0, 30)}", rng.random()))
    df = spark.createDataFrame(data, "ln_price_m2 double, year2026 int, station_distance_m double, line_distance_m double, grid_cell_id string, c double")
    table, info = models.near_stations(df, ["c"])
    got = {r["band"]: r for r in table.collect()}
    assert info["n"] == 600 and got["band_0_300"]["coefficient"] == pytest.approx(0.2, abs=0.03) and got["band_0_300"]["p"] < 0.01
    assert abs(got["band_700_1000"]["coefficient"]) < 0.03 and got["band_0_300"]["low_pct"] < got["band_0_300"]["effect_pct"] < got["band_0_300"]["high_pct"]
    assert models.between_stations(df, ["c"])[0].count() == 10
    with pytest.raises(CheckFailed):
        models.between_stations(df, ["c", "grid_cell_id"])
    with pytest.raises(CheckFailed):
        models.between_stations(df.withColumn("nearest_segment_id", F.lit(1)), ["c", "nearest_segment_id"])
    with pytest.raises(CheckFailed):
        near_sample(df, "station_distance_m", (("a", 0.0, 500.0), ("b", 400.0, 1500.0)))


def test_small_helpers(spark):
    df = spark.createDataFrame([("Есиль", 10, 2.0, 3.0), ("Нура", 3, 2.0, 3.0), (None, None, 2.0, 3.0)], "d string, complex_listing_count int, e double, m double").withColumns({"complex_median_price_m2": F.lit(4.0), "district_median_price_m2": F.lit(2.0)})
    names = spark.createDataFrame([("Есиль", "Есильский")], "name string, standard string")
    assert sorted(str(r["d"]) for r in reports.normalised(df, "d", names).collect()) == ["None", "Есильский", "Нура"]
    assert [r["expected"] for r in reports.complex_or_district(df, "e", "m").collect()] == [2.0, 6.0, 6.0]
    assert spark.range(1).select(reports.rooms_of_title(F.lit("2-комнатная квартира"))).first()[0] == 2
    assert reports.stacked([df, names]).count() == 4
