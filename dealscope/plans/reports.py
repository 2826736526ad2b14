"""Figures of each stage as small tables, and the profile of a ranked table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.operators import dedup, diagnostics, groups, profile
from dealscope.functions.text import mentions

#: Fields of the parse report, and the value of one that counts as missing.
PARSED_FIELDS = (
    "price_tenge", "district", "building_type", "complex_name", "build_year", "floor", "area_total_m2", "kitchen_area_m2",
    "apartment_condition", "bathroom", "balcony", "door", "phone", "internet", "parking", "furnished", "flooring", "ceiling_height_m",
)
UNKNOWN = {"apartment_condition": "unknown"}


def metrics(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(metric, value) of aggregate expressions, in one pass and in order."""
    row = df.agg(*[v.cast("double").alias(k) for k, v in values.items()])
    return row.select(F.posexplode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in values]))).orderBy("pos").select("col.metric", "col.value")


def parse_report(parsed: DataFrame) -> dict[str, DataFrame]:
    warned = F.col("parse_warnings")
    return {
        "counts": metrics(parsed, {"rows": F.count("*"), "errors": F.count_if(mentions(warned, "status=error")), "pipe_fallbacks": F.count_if(mentions(warned, "pipe-delimited"))}),
        "coverage": profile.missingness(parsed, PARSED_FIELDS, UNKNOWN),
        "warnings": profile.list_counts(parsed, "parse_warnings", "warning"),
    }


def feature_report(features: DataFrame) -> dict[str, DataFrame]:
    n = F.col("n_neighbors_3km")
    return {
        "counts": metrics(features, {"rows": F.count("*"), "no_neighbours": F.count_if(n == 0), "few_neighbours": F.count_if(n < 3), "complex_large_enough": F.count_if(~F.col("complex_insufficient_n"))}),
        "neighbours": profile.describe(features, ["n_neighbors_3km", "n_neighbors_1km"]),
    }


def ranking_report(ranked: DataFrame, k: int = 300) -> dict[str, DataFrame]:
    reliable = ranked.filter("residual_reliable")
    rules = [("building", F.col("building_n_others") >= 2), ("complex", F.col("complex_n_others") >= 3), ("kernel", F.col("kernel_eff_n") >= 10)]
    return {
        "exclusions": groups.value_counts(ranked.filter("fit_excl_reason <> ''"), "fit_excl_reason"),
        "reliable": metrics(ranked, {c: F.count_if(F.col(c)) for c in ("spatial_rank_reliable", "spatial_rank_reliable_1km", "residual_reliable")} | {"composite": F.count("good_deal_score")}),
        "waterfall": groups.waterfall(ranked.filter("fit_ok"), rules, "thin"),
        "residual_quantiles": profile.quantiles(reliable, "residual_pct", [0.01, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99]),
        "agreement": diagnostics.agreement(ranked, "residual_pct", "spatial_price_pct_vs_avg", "residual_reliable", "spatial_rank_reliable", "row_id", k),
    }


def profile_report(ranked: DataFrame, box: tuple[float, float, float, float] = (50.9, 51.4, 71.0, 71.9)) -> dict[str, DataFrame]:
    """Missing values, distributions, outliers, duplicates, places out of the box, correlations, histograms."""
    numeric = ["price_m2", "area_total_m2", "building_age", "ceiling_height_m", "distance_to_center_km", "n_neighbors_3km", "kitchen_area_ratio", "floor", "floor_total"]
    return {
        "missing": profile.missingness(ranked, [*PARSED_FIELDS, "lat", "lon", "price_m2"], UNKNOWN),
        "numbers": profile.describe(ranked, numeric),
        "districts": groups.value_counts(ranked, "district"),
        "complexes": groups.group_sizes(ranked, "complex_name"),
        "outliers": profile.iqr_outliers(ranked, "district", "price_m2"),
        "far_from_median": profile.ratio_outliers(ranked, "district", "price_m2"),
        "duplicates": dedup.duplicate_audit(ranked, ["lat", "lon", "area_total_m2", "price_tenge"]),
        "sanity": groups.conditional_counts(ranked, {
            "malformed_price": (F.col("price_tenge") <= 0) | (F.col("price_tenge") < 1_000_000),
            "build_year": (F.col("build_year") < 1950) | (F.col("build_year") > 2031),
            "outside_box": ~(F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3])),
        }),
        "correlations": profile.correlation_matrix(ranked, numeric),
        "price_histogram": profile.histogram(ranked, F.log10("price_m2"), 4.0, 7.0, 60),
        "area_histogram": profile.histogram(ranked, F.least(F.col("area_total_m2"), F.lit(250.0)), 0.0, 250.0, 60),
    }


def as_lines(tables: dict[str, DataFrame], most: int = 50) -> list[str]:
    """The tables as text, at most ``most`` rows of each; for reading, not for further work."""
    out: list[str] = []
    for name, t in tables.items():
        out += [f"[{name}]", *(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in t.limit(most).collect())]
    return out


def normalised(df: DataFrame, c: str, mapping: DataFrame) -> DataFrame:
    """Column c by a (name, standard) table; names that it lacks stay."""
    m = mapping.select(F.col("name").alias("__name"), F.col("standard").alias("__standard")).dropDuplicates(["__name"])
    return df.join(m, df[c] == m["__name"], "left").withColumn(c, F.coalesce("__standard", F.col(c))).drop("__name", "__standard")


def rooms_of_title(title: Column | str) -> Column:
    """Number of rooms that a page title begins with."""
    return F.regexp_extract(F.col(title) if isinstance(title, str) else title, r"(\d+)-комнатн", 1).try_cast("int")


def complex_or_district(df: DataFrame, effect: str, district_model: str, least: int = 8) -> DataFrame:
    """``expected``: the complex's own effect from ``least`` listings on, else the district's model times the complex's relative median."""
    adjusted = F.col(district_model) * F.coalesce(F.try_divide(F.col("complex_median_price_m2"), F.col("district_median_price_m2")), F.lit(1.0))
    return df.withColumn("expected", F.when(F.coalesce(F.col("complex_listing_count"), F.lit(0)) >= least, F.col(effect)).otherwise(adjusted))


def stacked(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
