"""Registered queries of the engine's operators over the generic tables, with stand-in columns.

Points of customers are made from their keys by the same arithmetic here and in
the SQL of ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscope.functions import geo, numeric, text
from dealscope.operators import dedup, design, diagnostics, did, effects, formula, groups, hierarchical, nearest, ols, profile, quality, radius, ranking, sets
from dealscope.plans import listings, models, reports
from dealscope.session import dealt, stored
from dealscope.sources.html import div_text_column, listing_rows
from dealscope.sources.sinks import json_rows
from dealscope.streaming.ingest import windowed_counts
from dealscope.streaming.sessions import changes, session_totals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DAY = "yyyy-MM-dd"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, dealt out, as the texts made from them take long to parse."""
    return dealt(table(spark, sf_dir, "part"))


def points(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key).cast("bigint")
    return df.withColumns({"lat": F.lit(50.95) + ((k * 7919) % 10007) / F.lit(10007.0) * 0.30, "lon": F.lit(71.20) + ((k * 104729) % 10007) / F.lit(10007.0) * 0.45})


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(table(spark, sf_dir, "customer"), "c_custkey")


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part: price a unit, brand and type."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size")
    return table(spark, sf_dir, "lineitem").withColumn("unit_price", numeric.ratio("l_extendedprice", "l_quantity")).join(part, "l_partkey")


def r(c: Column | str, digits: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("l_shipdate", F.date_format("l_shipdate", DAY))


@query
def price_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest line items against their brand's median price."""
    p = priced(spark, sf_dir)
    g = groups.with_group_median(p, "p_brand", "unit_price", prefix="brand_")
    ranked = ranking.percentile_rank(g, "p_brand", "unit_price", "rank_in_brand")
    rel = ranked.withColumn("relative", numeric.relative("unit_price", "brand_median"))
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand", r("unit_price").alias("unit_price"), r("brand_median").alias("brand_median"), "brand_count", "brand_insufficient_n", r("rank_in_brand", 9).alias("rank_in_brand"), r("relative", 9).alias("relative")]
    rows = rel.select(*cols)
    return ranking.smallest(rows, "relative", 200, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "unit_price"])


@query
def unit_price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    unit = numeric.ratio("l_extendedprice", "l_quantity")
    year = numeric.iso_year(F.date_format("l_shipdate", DAY))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        r(unit).alias("unit_price"), r(numeric.log_positive(unit)).alias("ln_unit_price"), r(numeric.log_positive("l_quantity")).alias("ln_quantity"),
        year.alias("ship_year"), numeric.age(F.lit(1998), year).alias("age"), numeric.rooms_bucket("l_quantity").alias("size_class"),
        numeric.clip("l_quantity", 5, 40).alias("clipped"), numeric.missing(F.nullif("l_returnflag", F.lit("N"))).alias("not_returned"),
        *[v.alias(k) for k, v in numeric.bands("l_quantity", [("b10", 0, 10), ("b30", 10, 30), ("b50", 30, 50)]).items()],
        numeric.key_of("l_returnflag", "l_linestatus").alias("flags"),
        r(numeric.row_mean("l_discount", "l_tax"), 9).alias("mean_rate"),
        F.bround(F.col("l_quantity") / 4, 0).alias("quarter"),
    )


@query
def fit_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = priced(spark, sf_dir)
    rules = [("no_price", F.col("unit_price").isNull()), ("small", F.col("l_quantity") < 5), ("large", F.col("l_quantity") > 45), ("cheap", F.col("unit_price") < 950), ("dear", F.col("unit_price") > 1900)]
    reason = numeric.first_failing(rules)
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", reason.alias("reason"), (reason == "").alias("fit_ok"), numeric.within("unit_price", 1000, 1500).alias("middle"))


@query
def landmark_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    cols = geo.landmark_columns("lat", "lon")
    return c.select("c_custkey", *[(r(v) if k.startswith("distance") else v).alias(k) for k, v in cols.items()])


@query
def landmark_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's distance to each mall, the nearest marked."""
    spots = spark.createDataFrame([(k, *v) for k, v in geo.MALLS.items()], "name string, lat double, lon double")
    d = radius.landmark_distances(customers(spark, sf_dir), "c_custkey", "lat", "lon", spots)
    return d.select("c_custkey", "name", r("distance_km").alias("distance_km"), "nearest")


@query
def grid_cells_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).withColumn("cell", geo.grid_cell("lat", "lon")).groupBy("cell").agg(F.count("*").alias("n"))


@query
def tile_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = points(table(spark, sf_dir, "supplier"), "s_suppkey")
    t = s.select("s_suppkey", geo.tile_x("lon", 11).alias("x"), geo.tile_y("lat", 11).alias("y"))
    return t.select("*", r(geo.tile_lon("x", 11)).alias("west"), r(geo.tile_lat("y", 11)).alias("north"))


@query
def group_median_min_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups.group_median(priced(spark, sf_dir), "p_brand", "unit_price", min_n=2000)
    return g.select("p_brand", r("median").alias("median"), "count", "insufficient_n")


@query
def percentile_rank_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.percentile_rank(priced(spark, sf_dir), "p_brand", "unit_price", "pct")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand", r("pct", 9).alias("pct"))


@query
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(dedup.keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], LINE))


@query
def dedup_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    li = li.withColumns({"lat": F.when(F.col("l_linenumber") != 7, F.col("l_orderkey") % 100 + 0.25), "lon": (F.col("l_partkey") % 20).cast("double"), "complex_name": F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("c"), F.col("l_suppkey") % 50)), "price": (F.col("l_extendedprice") / 5000).cast("int"), "floor": F.when(F.col("l_tax") > 0.01, F.col("l_linenumber"))})
    out = dedup.without_relists(li, LINE, area="l_quantity", price="price", floors="l_linenumber")
    return _dated(out.select(*LINE))


@query
def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_audit(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def _radius(spark: SparkSession, sf_dir: str, km: float) -> DataFrame:
    s = radius.radius_stats(customers(spark, sf_dir), km, "c_custkey", "c_acctbal")
    return s.select("c_custkey", "n", r("mean", 7).alias("mean"), r("median", 7).alias("median"))


@query
def radius_neighbour_stats_3km(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _radius(spark, sf_dir, 3.0)


@query
def radius_neighbour_stats_1km(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _radius(spark, sf_dir, 1.0)


@query
def spatial_relative_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir).withColumn("price", F.abs("c_acctbal") + 100)
    s = radius.radius_stats(c, 3.0, "c_custkey", "price")
    out = c.select("c_custkey", "price").join(s, "c_custkey").withColumns(numeric.relative_columns("price", "mean", "n"))
    return out.select("c_custkey", "n", r("spatial_price_ratio").alias("ratio"), r("spatial_price_pct_vs_avg").alias("pct"), F.col("spatial_rank_reliable").alias("reliable"))


@query
def kernel_loo_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    m = effects.kernel_means(c, "c_custkey", "c_acctbal", 0.5, 2.0)
    return m.select("c_custkey", r("smooth", 7).alias("smooth"), r("n_eff", 7).alias("n_eff"), r("sum_w", 7).alias("sum_w"), r(effects.shrunk("smooth", "sum_w", 3.0), 7).alias("shrunk"))


@query
def loo_eb_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("v", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")))
    out = effects.loo_effect(c, "c_nationkey", "v", 2.0, "effect", "n_others")
    return out.select("c_custkey", r("effect", 7).alias("effect"), "n_others")


@query
def nested_eb_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = effects.nested_effects(c, "c_acctbal", [("n_regionkey", 2.0), ("c_nationkey", 1.0), ("c_mktsegment", 2.0)], "location")
    return out.select("c_custkey", r("location", 7).alias("location"), "c_nationkey_n_others")


@query
def ols_two_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    fit = ols.ols(li, "l_extendedprice", ["l_quantity", "l_discount"])
    values = [("n", float(fit.n)), ("r2", fit.r2), ("r2_adjusted", fit.r2_adjusted), *[(f"b_{k}", float(b)) for k, b in zip(fit.names, fit.beta, strict=True)]]
    return spark.createDataFrame([(k, round(v, 4)) for k, v in values], "name string, value double")


FORMULA = "price ~ maker + bs(p_size, df=5) + half + maker:half"


def _formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_size", (F.col("p_retailprice") / 100 + (F.col("p_size") % 7)).alias("price"), F.substring("p_brand", 7, 1).alias("maker"), (F.col("p_partkey") % 2).alias("half"))


@query
def formula_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels, a spline and an interaction from one formula."""
    found = formula.fit_formula(_formula(spark, sf_dir), FORMULA).table()
    rows = [(k, *(round(float(v), 6) for v in values[:2])) for k, *values in found]
    return spark.createDataFrame(rows, "name string, coefficient double, error double")


@query
def formula_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of odd keys are fitted, all rows are predicted by the recorded levels and knots."""
    rows = _formula(spark, sf_dir).withColumn("size2", F.col("p_size") * F.col("p_size"))
    fit = formula.fit_formula(rows.filter("p_partkey % 2 = 1 or p_partkey % 3 = 0"), "price ~ C(maker) + p_size + size2", "maker")
    return fit.with_predictions(rows, "predicted", "residual").select("p_partkey", r("predicted", 6).alias("predicted"), r("residual", 6).alias("residual"))


@query
def ols_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    out = ols.with_residuals(li, ols.ols(li, "l_extendedprice", ["l_quantity"]), "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("predicted", 5).alias("predicted"), r("residual", 5).alias("residual"))


@query
def cluster_robust_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir).withColumn("x", F.col("lat") - 51)
    fit = ols.ols(c, "c_acctbal", ["x"])
    cov, g = ols.cluster_covariance(c, fit, "c_acctbal", "c_nationkey")
    rows = [(n, round(b, 4), round(se, 4), g) for n, b, se, *_ in fit.table(cov, g - 1)]
    return spark.createDataFrame(rows, "name string, coefficient double, error double, clusters long")


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir).withColumn("d_m", 1000 * geo.haversine_km("lat", "lon", *geo.CENTRE))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.ln(F.col("o_totalprice") + 1).alias("ln_price"), (F.month("o_orderdate") >= 7).cast("int").alias("late"), F.dayofmonth("o_orderdate").alias("o_day"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations, every 20 on a line in the order of their numbers."""
    return points(table(spark, sf_dir, "supplier"), "s_suppkey").withColumn("line", F.expr("s_suppkey div 20"))


@query
def nearest_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest supplier to each customer, and the nearest segment of the suppliers' lines."""
    s = suppliers(spark, sf_dir)
    stations = s.select(F.col("s_name").alias("name"), "lat", "lon")
    out = nearest.station_columns(customers(spark, sf_dir), "c_custkey", stations, nearest.segments_of(s, "line", "s_suppkey"))
    return out.select("c_custkey", "station_name", r("station_distance_m", 5).alias("station_distance_m"), "line_name", r("line_distance_m", 5).alias("line_distance_m"))


BETWEEN = (("l0", 0.0, 1000.0), ("l1", 1000.0, 2500.0), ("l2", 2500.0, 5000.0))


@query
def did_between_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices by distance from the line through the first five suppliers, without those near a stop."""
    s = suppliers(spark, sf_dir).filter("s_suppkey <= 5")
    c = nearest.station_columns(customers(spark, sf_dir), "c_custkey", s.select(F.col("s_name").alias("name"), "lat", "lon"), nearest.segments_of(s.withColumn("line", F.lit(1)), "line", "s_suppkey"))
    o = table(spark, sf_dir, "orders").select("o_custkey", F.ln(F.col("o_totalprice") + 1).alias("ln_price"), (F.month("o_orderdate") >= 7).cast("int").alias("late"), F.dayofmonth("o_orderdate").alias("o_day"))
    rows = o.join(c.select("c_custkey", "c_nationkey", "station_distance_m", "line_distance_m"), F.col("o_custkey") == F.col("c_custkey"))
    t, _ = models.between_stations(rows, ["o_day"], "c_nationkey", "ln_price", "late", bands=BETWEEN, control=(5000.0, 30000.0))
    return _did_rows(t)


def _did_rows(t: DataFrame) -> DataFrame:
    return t.select("band", "n_before", "n_after", "n", r("coefficient").alias("coefficient"), r("error").alias("error"), r("p", 7).alias("p"), *[r(c, 5).alias(c) for c in ("effect_pct", "low_pct", "high_pct")])


DID_BANDS = (("d0", 0.0, 5000.0), ("d5", 5000.0, 10000.0), ("d10", 10000.0, 15000.0))


@query
def did_band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = did.near_sample(_banded(spark, sf_dir), "d_m", DID_BANDS, (15000.0, 40000.0))
    long = b.select("late", *[x[0] for x in DID_BANDS], "control").unpivot(["late"], [*[x[0] for x in DID_BANDS], "control"], "band", "inside")
    return long.groupBy("band").agg(F.count_if((F.col("inside") == 1) & (F.col("late") == 0)).alias("n_before"), F.count_if((F.col("inside") == 1) & (F.col("late") == 1)).alias("n_after"))


@query
def did_two_by_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = did.near_sample(_banded(spark, sf_dir), "d_m", (("inner", 0.0, 12000.0),), (12000.0, 40000.0))
    t, _ = did.did(b, "ln_price", "late", (("inner", 0.0, 12000.0),), [], "c_nationkey")
    return t.select("band", "n_before", "n_after", "n", r("coefficient").alias("coefficient"), r("effect_pct", 4).alias("effect_pct"))


@query
def did_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = did.near_sample(_banded(spark, sf_dir), "d_m", DID_BANDS, (15000.0, 40000.0))
    t, _ = did.did(b, "ln_price", "late", DID_BANDS, ["o_day"], "c_nationkey")
    return _did_rows(t)


def _hierarchical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    c = customers(spark, sf_dir).join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    c = c.withColumns({"y": F.ln(F.abs("c_acctbal") + 1000), "district": F.col("n_regionkey").cast("string"), "grid_cell_id": geo.grid_cell("lat", "lon", 5000.0), "complex_name": F.when(F.col("c_custkey") % 7 != 0, F.concat("c_mktsegment", F.col("c_nationkey").cast("string"))), "fit": F.col("c_custkey") % 50 != 0, "x1": (F.col("c_custkey") % 13).cast("double"), "x2": (F.col("c_custkey") % 5).cast("double")})
    c = c.withColumn("building", F.concat_ws("|", F.coalesce("complex_name", F.lit("none")), (F.col("c_custkey") % 11).cast("string")))
    return hierarchical.hierarchical_fit(c, "c_custkey", "y", ["x1", "x2"], "fit")


@query
def hierarchical_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = _hierarchical(spark, sf_dir)
    exact = ["predicted_ln_price_m2", "hier_residual_ln", "residual_pct", "residual_n_eff", "residual_z"]
    return out.select("c_custkey", "fit_ok", "building_n_others", "complex_n_others", "kernel_eff_n", "residual_reliable", r("predicted_price_m2", 3).alias("predicted_price_m2"), *[r(c, 7).alias(c) for c in exact])


@query
def hierarchical_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, info = _hierarchical(spark, sf_dir)
    return hierarchical.coefficients(info).select("name", *[r(c, 7).alias(c) for c in ("coefficient", "error", "statistic", "p")])


@query
def hierarchical_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the fit, the deviation of the reliable residuals, and the leave-one-out share of the variance explained."""
    out, info = _hierarchical(spark, sf_dir)
    kept = out.agg(F.count_if("fit_ok").alias("n_fit"), F.stddev_pop(F.when(F.col("residual_reliable"), F.col("hier_residual_ln"))).alias("sigma"))
    return kept.select("n_fit", r("sigma", 7).alias("sigma"), F.round(F.lit(float(info["r2_loo"])), 7).alias("r2_loo"))


@query
def robust_z_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumns({"a": F.col("c_acctbal"), "a_ok": F.col("c_custkey") % 3 != 0, "b": F.col("c_acctbal") * 2 + F.col("c_custkey") % 100, "b_ok": F.col("c_custkey") % 5 != 0})
    return hierarchical.composite_score(c, "a", "a_ok", "b", "b_ok", "score").select("c_custkey", r("score", 7).alias("score"))


@query
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = priced(spark, sf_dir).withColumn("v", F.col("l_extendedprice") * (1 + (F.col("l_orderkey") % 97 == 0).cast("int") * 4))
    return profile.iqr_outliers(p, "p_brand", "v").withColumn("share", r("share", 9))


@query
def ratio_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = profile.ratio_outliers(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", 0.2, 2.0)
    return o.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("ratio").alias("ratio"))


@query
def range_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return groups.conditional_counts(o, {"malformed": (F.col("o_totalprice") <= 0) | (F.col("o_totalprice") < 1000), "early": F.year("o_orderdate") < 1993, "late": F.year("o_orderdate") > 1997})


@query
def missingness_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("discount"), F.when(F.col("l_quantity") < 40, F.col("l_quantity")).alias("quantity"), F.col("l_returnflag").alias("flag"))
    return profile.missingness(li, ["discount", "quantity", "flag"], {"flag": "N"}).withColumn("coverage", r("coverage", 9))


@query
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.value_counts(table(spark, sf_dir, "part"), "p_brand")


@query
def group_size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_sizes(table(spark, sf_dir, "events"), "user_id")


@query
def correlation_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("q", F.when(F.col("l_quantity") > 10, F.col("l_quantity")))
    return profile.correlation_matrix(li, ["q", "l_extendedprice", "l_discount", "l_tax"]).withColumn("correlation", r("correlation"))


@query
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = profile.describe(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return d.select("column_name", "n", *[r(c, 7).alias(c) for c in ("mean", "sd", "min", "q25", "q50", "q75", "max")])


@query
def histogram_log10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(table(spark, sf_dir, "lineitem"), F.log10("l_extendedprice"), 2.0, 6.0, 60)


@query
def quantile_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.quantiles(table(spark, sf_dir, "orders"), "o_totalprice", [0.01, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99]).withColumn("value", r("value", 7))


@query
def reliability_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = groups.group_total(c, "c_nationkey", "c_acctbal")
    return groups.waterfall(n, [("building", F.col("c_custkey") % 3 == 0), ("complex", F.col("group_count") >= 65), ("kernel", F.col("c_acctbal") > 0)], "thin")


@query
def topk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("other", F.col("o_totalprice") + F.col("o_orderkey") % 1000 * 10)
    return sets.overlap(ranking.smallest(o, "o_totalprice", 300, ["o_orderkey"]), ranking.smallest(o, "other", 300, ["o_orderkey"]), "o_orderkey", 300).withColumn("overlap", r("overlap", 9))


@query
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    done = e.filter((F.col("event_type") == "purchase") & (F.col("value") > 80))
    return sets.pending(e, done, "user_id").select("event_id", "user_id")


@query
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("k"))
    return c.join(o, "k", "left_anti")


@query
def set_union_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return sets.union_of(c, s, "k").join(sets.members(c, s, "k").withColumn("both", F.lit(True)), "k", "left").select("k", F.coalesce("both", F.lit(False)).alias("both"))


@query
def id_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    new = e.filter(F.col("event_type") == "purchase").select("event_id")
    return ranking.next_ids(new, F.col("event_id").cast("string"), e, "user_id", "row_id", 8).select("event_id", "row_id")


@query
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("same", F.lit(1))
    return sets.constant_columns(p, ["same", "p_size", "p_brand"])


@query
def category_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    domain = design.levels(o, "o_orderpriority")
    return o.select("o_orderkey", numeric.index_in("o_orderpriority", domain).alias("priority"))


@query
def scaled_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", numeric.scaled("o_totalprice", 0.001).alias("price_k"), numeric.scaled(F.col("o_orderkey") / 4, 1.0).alias("quarter"))


LABELS = ("Kitchen area", "Area", "Type", "Floor", "Phone", "Tags")


def _listing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    t = F.concat(F.lit("Price "), F.col("p_retailprice").cast("bigint").cast("string"), F.lit(" Type "), F.lower("p_brand"), F.lit(", Area "), F.col("p_size").cast("string"), F.lit(",5 m2 Kitchen area 7 Floor "), (F.col("p_partkey") % 9).cast("string"), F.lit(" of 9"), F.when(F.col("p_partkey") % 2 == 0, F.lit(" Phone yes Area 99")).otherwise(F.lit("")), F.lit(" Tags a, b ,c"))
    return p.select("p_partkey", t.alias("advert"), F.concat(F.lit("Phone no Type other"), F.col("p_size").cast("string")).alias("params"))


@query
def label_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _listing_texts(spark, sf_dir).withColumns({"a": text.segments("advert", LABELS), "p": text.segments("params", LABELS)})
    return t.select("p_partkey", *[text.gap_filled(text.labelled(F.col("a"), k), text.labelled(F.col("p"), k)).alias(k.lower().replace(" ", "_")) for k in LABELS])


@query
def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _listing_texts(spark, sf_dir).withColumns({"a": text.segments("advert", LABELS), "p": text.segments("params", LABELS)})
    v = {k: text.gap_filled(text.labelled(F.col("a"), k), text.labelled(F.col("p"), k)) for k in LABELS}
    floor, floors = text.floor_pair(v["Floor"], "of")
    return t.select("p_partkey", text.first_number(v["Area"]).alias("area"), floor.alias("floor"), floors.alias("floors"), text.yes_no(v["Phone"], "yes", "no").alias("phone"), text.first_token(v["Type"]).alias("type"), F.concat_ws("|", text.comma_list(v["Tags"])).alias("tags"))


@query
def url_id_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    made = F.concat(F.col("url"), F.lit("/a/show/"), F.col("page_id").cast("string"))
    return p.select("page_id", text.show_id(made).alias("show_id"), text.show_id("url").alias("no_id"), F.size(text.show_ids(F.concat(made, F.lit(" "), made))).alias("n_ids"), text.occurrences("html", "<p>").alias("paragraphs"))


@query
def page_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    page = F.concat(F.lit('<script>{"lat":51.'), (F.col("page_id") % 997 + 1000).cast("string"), F.lit(',"lng":"71.'), (F.col("page_id") % 991 + 1000).cast("string"), F.lit('"}</script>'))
    return p.select("page_id", text.latitude(page).alias("lat"), text.longitude(page).alias("lon"), text.latitude(F.lit("none")).alias("none"))


@query
def html_div_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", div_text_column("html", ["ad"], ["none"]).alias("ad_text"))


@query
def warnings_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(text.messages((F.col("l_quantity") > 40, "large"), (F.col("l_discount") == 0, "no discount"), (F.col("l_returnflag") == "R", "returned")).alias("w"))
    return profile.list_counts(li, "w", "warning")


@query
def json_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_rows(table(spark, sf_dir, "nation").withColumn("n_none", F.lit(None).cast("int")), ["n_nationkey", "n_name", "n_regionkey", "n_none"])


@query
def modes_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(profile.smallest_mode("p_size").alias("mode_size"))


@query
def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense index of the sorted nation names, joined to the rows."""
    n = groups.distinct_sorted(table(spark, sf_dir, "nation"), "n_name")
    indexed = ranking.next_ids(n, "n_name", n.limit(0).select(F.lit(0).alias("z")), "z", "i", 4)
    return table(spark, sf_dir, "nation").join(indexed, "n_name").select("n_nationkey", (F.col("i") - 1).alias("name_index"))


DISTRICTS = listings.CATEGORIES["district"]


def _raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped rows made from the parts' keys, with every form that the parser knows."""
    k = F.col("p_partkey").cast("bigint")
    name = F.element_at(F.array(*[F.lit(d) for d in DISTRICTS]), (k % 6 + 1).cast("int"))
    place = F.when(k % 7 == 3, F.concat(F.lit(" Астана, р-н "), name, F.lit(" показать на карте"))).when(k % 7 == 5, F.lit("")).otherwise(F.concat(F.lit(" Астана, "), name, F.lit(" р-н показать на карте")))
    price = F.when(k % 11 == 0, F.lit("цена по запросу")).otherwise(F.concat(F.regexp_replace(F.format_number(k * 12345 + 5000000, 0), ",", " "), F.lit(" ₸")))
    advert = F.concat(
        price, place, F.lit(" Тип дома "), F.lower("p_brand"), F.lit(" и др, "),
        F.when(k % 3 != 0, F.concat(F.lit("Жилой комплекс "), F.col("p_name"))).otherwise(F.lit("")),
        F.lit(" Год постройки "), (k % 40 + 1990).cast("string"),
        F.when(k % 5 != 0, F.concat(F.lit(" Этаж "), (k % 9 + 1).cast("string"), F.lit(" из 9"))).otherwise(F.lit("")),
        F.lit(" Площадь "), (k % 90 + 20).cast("string"), F.lit(",5 м², Площадь кухни — "), (k % 9 + 6).cast("string"), F.lit(" м²"),
        F.when(k % 4 == 1, F.lit(" Рассрочка")).otherwise(F.lit("")),
    )
    state = F.when(k % 4 == 1, F.lit("Состояние квартиры Черновая отделка ")).when(k % 4 == 2, F.lit("Состояние квартиры свежий ремонт ")).when(k % 4 == 3, F.lit("Состояние квартиры требует ремонта ")).otherwise(F.lit(""))
    amenities = F.concat(state, F.when(k % 2 == 0, F.lit("Балкон остеклён Да, ")).otherwise(F.lit("Балкон остеклён нет ")), F.lit("Безопасность решетки, видео ,охрана Бывшее общежитие нет"))
    params = F.when(k % 13 == 0, F.concat(F.lit("Астана, "), name, F.lit(" р-н показать на карте | Площадь 30 м² | Санузел раздельный"))).otherwise(amenities)
    failed = k % 17 == 0
    return parts(spark, sf_dir).select(
        k.alias("source_row"), F.concat(F.lit("https://example/a/show/"), k.cast("string")).alias("url"), F.when(failed, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.when(~failed, advert).alias("advert_info"), F.when(~failed, params).alias("parameters"), F.when(k % 19 == 0, F.lit("bad")).otherwise(F.lit("2026-07-13T10:00")).alias("fetched_at"),
    )


@query
def listing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of scraped rows: prices, districts in either word order, floors, years, states, lists, warnings, errors."""
    p = listings.parsed(_raw_listings(spark, sf_dir), 2025)
    plain = ["source_row", "city", "district", "building_type", "complex_name", "area_total_m2", "kitchen_area_m2", "apartment_condition", "bathroom", "rooms_bucket_estimated"]
    flags = ["price_is_installment", "is_under_construction", "floor_is_first", "floor_is_last", "balcony_glazed", "former_dormitory", "rooms_estimate_is_heuristic"]
    numbers = ["price_tenge", "build_year", "floor", "floor_total"]
    return p.select(*plain, *[F.col(c).cast("string").alias(c) for c in flags], *[F.col(c).cast("double").alias(c) for c in numbers], F.concat_ws("|", "security_features").alias("security"), F.concat_ws("|", "parse_warnings").alias("warnings"))


@query
def parse_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parse report's counts and coverage, and rows left after a required column."""
    # three figures read the parsed rows
    p = stored(listings.parsed(_raw_listings(spark, sf_dir), 2025), "parsed")
    tables = reports.parse_report(p)
    coverage = tables["coverage"].select(F.concat(F.lit("present_"), "column_name").alias("metric"), F.col("present").cast("double").alias("value"))
    priced_rows = p.dropna(subset=["price_tenge", "district"]).agg(F.count("*").cast("double").alias("value")).select(F.lit("priced_and_placed").alias("metric"), "value")
    return tables["counts"].unionByName(coverage).unionByName(priced_rows)


@query
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and coordinates of fetched pages; the fallback class where the first has no text."""
    k = F.col("p_partkey").cast("bigint").cast("string")
    params = F.when(F.col("p_partkey") % 3 == 0, F.lit('<div class="params"></div><div class="short">few</div>')).otherwise(F.concat(F.lit('<div id=x class="wide params">size '), F.col("p_size").cast("string"), F.lit("<p>and</p>more</div>")))
    page = F.concat(F.lit('<html><body><div class="offer">'), F.col("p_name"), F.lit(" &amp; <b>"), F.col("p_brand"), F.lit("</b><div>inner<br>text</div></div>"), params, F.lit('<script>{"lat":"51.'), k, F.lit('","lon":71.'), k, F.lit("}</script>"))
    pages = parts(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("url"), page.alias("html"))
    return listing_rows(pages, ["offer"], ["params"], ["short"])


@query
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with spaces, cleaned text with references, script-safe text, rooms in a title."""
    k = F.col("p_partkey").cast("bigint")
    found = F.concat(F.lit("Найдено "), F.regexp_replace(F.format_number(k * 1001, 0), ",", " "), F.lit(" объявлений"))
    messy = F.concat(F.lit("\u00a0 "), F.col("p_name"), F.lit(" &amp;&nbsp; \n &#1072;&lt;"), F.col("p_brand"), F.lit(" \t"))
    return parts(spark, sf_dir).select(
        "p_partkey", text.spaced_count(found, r"(?U)Найдено\s+(\d[\d\s]*)").alias("found"), text.clean(messy).alias("cleaned"), text.script_safe(F.concat(F.lit("</b>"), "p_name")).alias("safe"),
        reports.rooms_of_title(F.concat((k % 5 + 1).cast("string"), F.lit("-комнатная квартира"))).alias("rooms"),
    )


@query
def windowed_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour, by the function that also runs on streams."""
    c = windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")
    return c.select(*[F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x) for x in ("start", "end")], "event_type", "n")


@query
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events without a pause of six hours, by the function that also runs on streams."""
    s = session_totals(table(spark, sf_dir, "events"), "ts", "user_id", "value", "6 hours")
    return s.select("user_id", *[F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(x) for x in ("start", "end")], "n", r("total", 5).alias("total"))


@query
def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose value differs from the last one of their user and type, as the stateful stream finds them."""
    e = table(spark, sf_dir, "events").withColumns({"key": F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), "price": F.floor(F.col("value") / 10)})
    c = changes(e, "key", "ts", "price", "event_id")
    return c.select("key", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"), "before", F.col("price").alias("now"))


@query
def spline_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    columns = design.spline("p_retailprice", design.spline_knots(p, "p_retailprice"))
    return p.select("p_partkey", *[r(v, 7).alias(k) for k, v in columns.items()])


@query
def design_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imputed medians, levels folded into the mode, treatment coding."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("price"), F.col("o_orderpriority").alias("priority"))
    o = design.fold_unseen(design.impute_median(o, ["price"]), ["priority"], F.col("priority") != "5-LOW")
    coded = design.treatment("priority", design.levels(o, "priority"))
    return o.select("o_orderkey", r("price", 7).alias("price"), "priority", *[v.cast("int").alias(k) for k, v in coded.items()])


@query
def hedonic_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing model's inputs from stand-in columns: clips, imputed medians, indicators and truths."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(k % 11 != 0, F.ln(F.col("p_size") * 12)).alias("ln_area"),
        F.when(k % 7 != 0, k % 100).alias("building_age"),
        F.when(k % 3 != 0, 2 + (F.col("p_size") % 40) / 10).alias("ceiling_height_m"),
        F.when(k % 5 != 0, k % 12).alias("floor"),
        F.when(k % 8 != 0, k % 13).alias("floor_total"),
        F.when(k % 4 != 0, F.col("p_type")).alias("building_type"),
        F.when(k % 6 != 0, F.col("p_brand")).alias("apartment_condition"),
        F.when(k % 9 != 0, (k % 4).cast("string")).alias("rooms_bucket_estimated"),
        *[F.when(k % (n + 2) != 0, k % (n + 3) == 0).alias(c) for n, c in enumerate(TRUTHS)],
    )
    numbers = ["ln_area", "building_age", "ceiling_height_m", "floor_rel"]
    out = design.hedonic_inputs(p)
    return out.select("p_partkey", *[r(c, 7).alias(c) for c in numbers], "ceiling_miss", "floor_miss", "building_type", "apartment_condition", "rooms_bucket", *TRUTHS)


#: Columns that count as 1 where true and else as 0.
TRUTHS = ("floor_is_first", "floor_is_last", "former_dormitory", "exchange_possible", "is_under_construction", "price_is_installment")


@query
def variance_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = diagnostics.variance_inflation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return v.select("column_name", r("vif", 6).alias("vif"), "high")


@query
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = diagnostics.cross_validated(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"], 5, "l_orderkey", hashed=False)
    return c.select("fold", "n", r("rmse", 4).alias("rmse"), r("r2", 8).alias("r2"))


@query
def leave_one_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's prices by the least squares of all other brands."""
    v = diagnostics.group_validated(table(spark, sf_dir, "part"), "p_retailprice", ["p_size"], "p_brand")
    return v.select(F.col("group").alias("p_brand"), "n", r("rmse", 5).alias("rmse"), r("r2", 7).alias("r2"))


@query
def residuals_by_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    out = diagnostics.residuals_by_fitted(ols.with_residuals(li, ols.ols(li, "l_extendedprice", ["l_quantity"]), "l_extendedprice"), "predicted", "residual")
    return out.select("bin", "n", *[r(c, 3).alias(c) for c in ("mean_fitted", "mean_residual", "sd_residual")])


@query
def population_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.population_z(table(spark, sf_dir, "customer"), "c_acctbal", "z", negate=True).select("c_custkey", r("z", 7).alias("z"))


@query
def constant_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") > 1, F.concat(F.lit("of "), F.col("l_returnflag"))).alias("label"))
    return groups.constant_of_group(li, "l_returnflag", "label")


@query
def checked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass the checks: conditions on every row, known categories, one band each, no rows lost in a join."""
    o = table(spark, sf_dir, "orders")
    o = quality.require_categories(o, "o_orderpriority", design.levels(o, "o_orderpriority"))
    banded = o.withColumns(numeric.bands("o_totalprice", [("low", 0, 150000), ("high", 150000, 1e12)]))
    banded, before = quality.stored_checked(banded.select("o_orderkey", "o_custkey", "o_totalprice", "low", "high"), "banded", {"priced": F.col("o_totalprice") > 0, "one band": quality.exactly_one("low", "high")})
    named = banded.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    named, _ = quality.stored_checked(named.select("o_orderkey", "low", "high", "c_mktsegment"), "named", rows=before["rows"])
    return named


@query
def standard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by a mapping, and the expected value of a complex or else of its district."""
    names = spark.createDataFrame([("FRANCE", "France"), ("CHINA", "China")], "name string, standard string")
    n = table(spark, sf_dir, "nation").withColumns({"complex_listing_count": F.col("n_nationkey"), "complex_median_price_m2": F.col("n_nationkey") * 2.0, "district_median_price_m2": F.col("n_regionkey") * 4.0, "effect": F.lit(5.0), "model": F.lit(3.0)})
    return reports.complex_or_district(reports.normalised(n, "n_name", names), "effect", "model").select("n_nationkey", "n_name", r("expected").alias("expected"))


@query
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map tiles that cover the customers' places."""
    return geo.tiles_of(customers(spark, sf_dir), 14).select("x", "y", r("west").alias("west"), r("north").alias("north"))
