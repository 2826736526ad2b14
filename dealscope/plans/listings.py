"""The listing pipeline: parse, features, ranking, export, profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.functions import text as T
from dealscope.functions.geo import grid_cell, landmark_columns
from dealscope.functions.numeric import age, index_in, iso_year, log_positive, ratio, relative_columns, rooms_bucket, scaled
from dealscope.operators.dedup import keep_first, without_relists
from dealscope.operators.design import fold_unseen, hedonic_inputs, levels, spline, spline_knots, treatment
from dealscope.operators.effects import building_key
from dealscope.operators.groups import constant_of_group, left_by_key, with_group_median
from dealscope.operators.hierarchical import Settings, composite_score, fit_reason, hierarchical_fit
from dealscope.operators.profile import exact_quantiles
from dealscope.operators.quality import require_categories, stored_checked
from dealscope.operators.radius import radii_stats
from dealscope.operators.ranking import numbered, percentile_rank
from dealscope.session import stored
from dealscope.sources.sinks import json_payload, json_rows


def parsed(raw: DataFrame, this_year: int) -> DataFrame:
    """Typed fields of each scraped listing, by column expressions alone.

    Rows with an error or without text keep their keys, one warning and the
    unknown condition.  ``this_year`` stands in where the fetch time has no year.
    """
    advert, params = F.coalesce("advert_info", F.lit("")), F.coalesce("parameters", F.lit(""))
    bad = F.coalesce(F.col("status") == "error", F.lit(False)) | (F.trim(advert) == "")
    d = raw.withColumns({"__a": T.segments(advert), "__p": T.segments(params), "__bad": bad})

    def field(label: str) -> Column:
        return F.coalesce(T.labelled(F.col("__a"), label), T.labelled(F.col("__p"), label))

    price, district, area = T.price(advert), T.district(advert), T.first_number(field("Площадь"))
    built, (floor, floors) = T.leading_year(field("Год постройки")), T.floor_pair(field("Этаж"))
    year = F.coalesce(iso_year("fetched_at"), F.lit(this_year))
    fields: dict[str, Column] = {
        "price_tenge": price,
        "price_is_installment": price.isNotNull() & advert.contains(T.INSTALMENT),
        "city": F.when(district.isNotNull(), T.CITY),
        "district": district,
        "building_type": T.first_token(field("Тип дома")),
        "complex_name": field("Жилой комплекс"),
        "build_year": built,
        "is_under_construction": built >= year,
        "floor": F.when(floors.isNotNull(), floor),
        "floor_total": floors,
        "floor_is_first": F.when(floors.isNotNull(), floor == 1),
        "floor_is_last": F.when(floors.isNotNull(), floor == floors),
        "area_total_m2": area,
        "kitchen_area_m2": T.first_number(field("Площадь кухни")),
        "apartment_condition": T.condition(field("Состояние квартиры")),
        "bathroom": field("Санузел"),
        "balcony": field("Балкон"),
        "balcony_glazed": T.yes_no(field("Балкон остеклён")),
        "door": field("Дверь"),
        "phone": field("Телефон"),
        "internet": field("Интернет"),
        "parking": field("Парковка"),
        "furnished": field("Квартира меблирована"),
        "flooring": field("Пол"),
        "ceiling_height_m": T.first_number(field("Высота потолков")),
        "security_features": T.comma_list(field("Безопасность")),
        "former_dormitory": T.yes_no(field("Бывшее общежитие")),
        "exchange_possible": T.yes_no(field("Возможен обмен")),
        "rooms": F.lit(None).cast("int"),
        "rooms_bucket_estimated": rooms_bucket(area),
        "rooms_estimate_is_heuristic": area.isNotNull(),
        "parse_warnings": T.messages(
            (T.pipe_fallback(params), "pipe-delimited parameters fallback detected"),
            (price.isNull(), "price not found in advert_info"),
            (district.isNull(), "district prefix not found in advert_info"),
        ),
    }
    none = F.array().cast("array<string>")
    empty = {
        "price_is_installment": F.lit(False),
        "apartment_condition": F.lit("unknown"),
        "security_features": none,
        "rooms_estimate_is_heuristic": F.lit(False),
        "parse_warnings": F.array(F.lit("status=error, no advert_info/parameters to parse")),
    }
    return d.select("source_row", "url", *[F.when(F.col("__bad"), empty[k]).otherwise(v).alias(k) if k in empty else F.when(~F.col("__bad"), v).alias(k) for k, v in fields.items()])


def featured(parsed_rows: DataFrame, raw: DataFrame, order: str = "source_row", min_n: int = 5, figures: dict | None = None) -> DataFrame:
    """Parsed rows with places, without relists, with price, age, distance, neighbour and group features.

    ``figures``, if given, takes the counts of the feature report, observed while the rows are written.
    Rows are numbered in ``row_id`` before any further join, as source rows and urls may repeat.
    """
    places = keep_first(raw.select("source_row", "lat", "lon", "fetched_at"), ["source_row"], ["fetched_at", "lat", "lon"])
    df = left_by_key(parsed_rows, places, "source_row")
    df = numbered(without_relists(df, [order, "url"]), F.struct(order, "url"), "row_id")
    price_m2 = ratio("price_tenge", "area_total_m2")
    df = df.withColumns({
        "price_m2": price_m2,
        "ln_price_m2": log_positive(price_m2),
        "ln_area": log_positive("area_total_m2"),
        "fetch_year": iso_year("fetched_at"),
        "building_age": age(iso_year("fetched_at"), "build_year"),
        "kitchen_area_ratio": ratio("kitchen_area_m2", "area_total_m2"),
        "grid_cell_id": grid_cell("lat", "lon"),
        **landmark_columns("lat", "lon"),
    })
    # the neighbour join reads the rows several times: cut the plan before
    df, before = stored_checked(df, "features")
    near = radii_stats(df, (3.0, 1.0), "row_id", "price_m2")
    for k, km in enumerate((3, 1)):
        near = near.withColumnsRenamed({f"mean_{k}": f"avg_price_m2_within_{km}km_mean", f"median_{k}": f"avg_price_m2_within_{km}km_median", f"n_{k}": f"n_neighbors_{km}km"})
    df = df.join(near, "row_id", "left")
    df = df.withColumn("low_confidence_spatial", F.col("n_neighbors_3km") < 3)
    for key in ("complex_name", "district"):
        prefix = key.split("_")[0] + "_"
        df = with_group_median(df, key, "price_m2", min_n, prefix).withColumnsRenamed({f"{prefix}median": f"{prefix}median_price_m2", f"{prefix}count": f"{prefix}listing_count"})
    n = F.col("n_neighbors_3km")
    counts = {"no_neighbours": F.count_if(n == 0), "few_neighbours": F.count_if(n < 3), "complex_large_enough": F.count_if(~F.col("complex_insufficient_n"))}
    out, got = stored_checked(df, "features", rows=before["rows"], figures=counts)
    if figures is not None:
        figures |= got
    return out


def ranked(features: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, dict]:
    """Features with spatial, percentile, model and composite signals, and figures of the model."""
    df = features.withColumns(relative_columns("price_m2", "avg_price_m2_within_3km_mean", "n_neighbors_3km"))
    df = df.withColumns(relative_columns("price_m2", "avg_price_m2_within_1km_mean", "n_neighbors_1km", "_1km"))
    df = percentile_rank(df, "district", "price_m2", "percentile_rank_in_district")
    df = percentile_rank(stored(df, "ranks"), "complex_name", "price_m2", "percentile_rank_in_complex")
    df, before = stored_checked(df.withColumn("fit_excl_reason", fit_reason()).withColumn("building", building_key()), "ranks")
    design, x = listing_design(df)
    fit, info = hierarchical_fit(design, "row_id", "ln_price_m2", x, "__fit", settings)
    joined, _ = stored_checked(df.join(fit, "row_id", "left"), "ranked", rows=before["rows"])
    return composite_score(joined), info


def listing_design(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Numeric model columns of every row, and their names."""
    rows = hedonic_inputs(df).withColumn("__fit", F.col("fit_excl_reason") == "")
    groups = ["building_type", "apartment_condition", "rooms_bucket"]
    rows = stored(fold_unseen(rows, groups, F.col("__fit")), "design")
    extra = spline("ln_area", spline_knots(rows, "ln_area"))
    for c in groups:
        extra |= treatment(c, levels(rows, c))
    plain = ["building_age", "ceiling_height_m", "ceiling_miss", "floor_is_first", "floor_is_last", "former_dormitory", "exchange_possible", "is_under_construction", "price_is_installment", "floor_rel", "floor_miss"]
    spread = stored(rows.withColumns(extra), "design")
    counts = spread.filter("__fit").agg(*[F.count_distinct(c).alias(c) for c in [*extra, *plain]]).first()
    return spread, [c for c in [*extra, *plain] if counts[c] > 1]


#: The map's box, its categories in order, and the score from which a deal is strong.
BOX = ((50.9, 51.3), (71.0, 71.8))
CATEGORIES = {
    "rooms_bucket_estimated": ("1-room", "2-room", "3-room", "4+room", "studio"),
    "apartment_condition": ("fresh_renovation", "needs_renovation", "rough", "unknown"),
    "building_type": ("иной", "кирпичный", "монолитный", "панельный"),
    "district": ("Алматы", "Байконур", "Есильский", "Нура", "Сарайшык", "Сарыарка"),
}
STRONG_DEAL_Z = -1.5
CLAMPS = {"spatial_pct_clamp": 0.35, "residual_pct_clamp": 0.35, "composite_clamp": 2.5, "strong_deal_z": STRONG_DEAL_Z, "heat_pct_clamp": 0.5}


def _shown(box: tuple[tuple[float, float], tuple[float, float]]) -> Column:
    return F.coalesce(F.col("lat").between(*box[0]) & F.col("lon").between(*box[1]), F.lit(False))


def map_complexes(ranked_rows: DataFrame, box: tuple[tuple[float, float], tuple[float, float]] = BOX) -> DataFrame:
    """(complex_name, complex_index, median) of the shown complexes, numbered from 0 in order of name."""
    medians = constant_of_group(ranked_rows.filter(_shown(box)), "complex_name", "complex_median_price_m2")
    return numbered(medians.withColumn("median", F.col("complex_median_price_m2").cast("bigint")).drop("complex_median_price_m2"), "complex_name", "complex_index")


def map_rows(ranked_rows: DataFrame, categories: dict[str, Sequence[str]] = CATEGORIES, box: tuple[tuple[float, float], tuple[float, float]] = BOX) -> DataFrame:
    """The 24 positional fields of each row whose place is in the box: scaled integers and dictionary places.

    Values outside the categories and urls without an id raise.
    """
    for c, expected in categories.items():
        require_categories(ranked_rows, c, expected)
    named = left_by_key(ranked_rows.filter(_shown(box)), map_complexes(ranked_rows, box).drop("median"), "complex_name")
    flag = {c: F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("spatial_rank_reliable", "spatial_rank_reliable_1km", "residual_reliable")}
    return named.select(
        T.show_id("url", end=True).cast("bigint").alias("id"),
        F.bround("lat", 6).alias("lat"),
        F.bround("lon", 6).alias("lon"),
        scaled("price_tenge", 0.001).alias("price_k"),
        F.bround("area_total_m2", 1).alias("area"),
        F.col("build_year").alias("year"),
        "floor",
        F.col("floor_total").alias("floors"),
        *[index_in(c, expected).alias(c) for c, expected in categories.items()],
        F.coalesce("complex_index", F.lit(-1)).cast("int").alias("complex"),
        scaled("spatial_price_pct_vs_avg", 1000, "int").alias("spatial_pm"),
        flag["spatial_rank_reliable"].alias("spatial_reliable"),
        "n_neighbors_3km",
        scaled("spatial_price_pct_vs_avg_1km", 1000, "int").alias("spatial_pm_1km"),
        flag["spatial_rank_reliable_1km"].alias("spatial_reliable_1km"),
        "n_neighbors_1km",
        scaled("residual_pct", 1000, "int").alias("residual_pm"),
        flag["residual_reliable"].alias("residual_reliable"),
        scaled("residual_z", 100, "int").alias("residual_z100"),
        scaled("predicted_price_m2", 1.0).alias("predicted_m2"),
        scaled("good_deal_score", 1000, "int").alias("score_pm"),
    )


def map_figures(ranked_rows: DataFrame, box: tuple[tuple[float, float], tuple[float, float]] = BOX) -> DataFrame:
    """One row: rows in all, without place, out of the box, shown; nulls and flags of the signals; strong deals; the median price."""
    placed, shown = F.col("lat").isNotNull() & F.col("lon").isNotNull(), _shown(box)

    def n(c: Column) -> Column:
        return F.count_if(shown & F.coalesce(c, F.lit(False)))

    off = {c: ~F.coalesce(F.col(c), F.lit(False)) for c in ("spatial_rank_reliable", "spatial_rank_reliable_1km", "residual_reliable")}
    return ranked_rows.agg(
        F.count("*").alias("source_rows_total"),
        F.count_if(~placed).alias("rows_excluded_no_coords"),
        F.count_if(placed & ~shown).alias("rows_excluded_bbox"),
        F.count_if(shown).alias("rows_shown"),
        n(F.col("spatial_price_pct_vs_avg").isNull()).alias("spatial_null"),
        n(off["spatial_rank_reliable"]).alias("spatial_unreliable"),
        n(F.col("spatial_price_pct_vs_avg_1km").isNull()).alias("spatial_null_1km"),
        n(off["spatial_rank_reliable_1km"]).alias("spatial_unreliable_1km"),
        n(F.col("residual_pct").isNull()).alias("residual_null"),
        n(F.col("residual_pct").isNotNull() & off["residual_reliable"]).alias("residual_unreliable"),
        n(F.col("residual_reliable") & (F.col("residual_z") <= STRONG_DEAL_Z)).alias("strong_deals"),
        n(F.col("good_deal_score").isNull()).alias("composite_null"),
    ).withColumn("city_median_price_m2", F.lit(exact_quantiles(ranked_rows.filter(shown), "price_m2", [0.5])[0]).cast("bigint"))


def map_payload(ranked_rows: DataFrame, generated_at: str, categories: dict[str, Sequence[str]] = CATEGORIES, box: tuple[tuple[float, float], tuple[float, float]] = BOX) -> str:
    """The map's document: meta, dictionaries, medians, complexes and rows; for map-sized tables."""
    figures = map_figures(ranked_rows, box).first().asDict()
    meta = {"generated_at": generated_at, **{k: figures[k] for k in ("source_rows_total", "rows_excluded_no_coords", "rows_excluded_bbox", "rows_shown", "city_median_price_m2")}, **CLAMPS, "bbox_lat": list(box[0]), "bbox_lon": list(box[1])}
    medians = {r[0]: r[1] for r in constant_of_group(ranked_rows.filter(_shown(box)), "district", "district_median_price_m2").collect()}
    names = {"rooms_bucket_estimated": "rooms_buckets", "apartment_condition": "conditions", "building_type": "building_types", "district": "districts"}
    lookups = {names[c]: list(v) for c, v in categories.items()}
    lookups["district_medians"] = {str(k): None if medians.get(d) is None else int(medians[d]) for k, d in enumerate(categories["district"])}
    # a row a complex
    lookups["complexes"] = [[r["complex_name"], r["median"]] for r in map_complexes(ranked_rows, box).orderBy("complex_index").collect()]
    rows = map_rows(ranked_rows, categories, box)
    return json_payload(meta, lookups, json_rows(rows, rows.columns))
