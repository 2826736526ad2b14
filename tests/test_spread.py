import pytest
from pyspark.sql import functions as F

from dealscope.operators import formula
from dealscope.plans import catalogue, listings


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    """Parts in a single row group, which one task reads."""
    d = str(tmp_path_factory.mktemp("parts"))
    rows = spark.range(0, 400, 1, 1).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("name "), "id").alias("p_name"), F.concat(F.lit("Brand#"), F.col("id") % 5 + 1, F.lit("1")).alias("p_brand"),
        F.lit("TYPE").alias("p_type"), (F.col("id") * 7 % 50 + 1).cast("int").alias("p_size"), (F.col("id") * 1.5).alias("p_retailprice"),
    )
    rows.write.parquet(f"{d}/part.parquet")
    return d


@pytest.mark.parametrize("name", ["listing_pages", "listing_fields", "label_segmentation", "parsed_values", "page_texts"])
def test_parsing_is_dealt_out(spark, one_file, name):
    out = catalogue.QUERIES[name](spark, one_file)
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > spark.sparkContext.defaultParallelism and sum(r[1] for r in sizes) == 400


def test_rows_of_a_report_are_parsed_once(spark, one_file, monkeypatch):
    parsed = listings.parsed
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    count = F.udf(told, "string").asNondeterministic()
    monkeypatch.setattr(listings, "parsed", lambda raw, year: parsed(raw.withColumn("url", count("url")), year))
    catalogue.QUERIES["parse_coverage"](spark, one_file).collect()
    assert seen.value == 400


def test_coded_rows_of_a_formula_are_dealt_out_and_coded_once(spark, one_file, monkeypatch):
    found = []
    fit = formula.ols
    monkeypatch.setattr(formula, "ols", lambda rows, *a: found.append(rows) or fit(rows, *a))
    catalogue.QUERIES["formula_coefficients"](spark, one_file).collect()
    assert len(found[0].inputFiles()) > spark.sparkContext.defaultParallelism
