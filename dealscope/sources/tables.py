"""Readers: CSV with declared or text columns, URL lists, metadata files, JSON lines with other lines kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dealscope.functions.geo import CENTRE, EMBANKMENT, MALLS, PARK
from dealscope.operators.ranking import default_row_numbers

#: Columns of a raw scrape.
RAW_COLUMNS = ("source_row", "url", "status", "http_status", "advert_info", "parameters", "lat", "lon", "fetched_at", "error")
_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "enforceSchema": False}


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV table with a header; quoted fields may hold commas and line ends. Without a schema all columns are text."""
    if schema is not None:
        return spark.read.options(**_CSV).schema(schema).csv(path)
    return without_bom(spark.read.options(**_CSV, inferSchema=False).csv(path))


def without_bom(df: DataFrame) -> DataFrame:
    """The byte order mark taken off the first column's name."""
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip("﻿").strip('"')) if first.startswith("﻿") else df


def number(c: str, kind: str):
    """A text column as a number by way of double; null where it is none."""
    return F.col(c).try_cast("double").cast(kind) if kind not in ("int", "bigint") else F.col(c).try_cast("double").try_cast(kind)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A raw scrape with typed columns; empty texts are null."""
    df = read_csv(spark, path)
    df = df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in df.columns})
    return df.withColumns({"source_row": number("source_row", "int"), "http_status": number("http_status", "int"), "lat": number("lat", "double"), "lon": number("lon", "double")})


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(source_row, url) of a list's non-blank urls; missing row numbers follow the place in the list."""
    df = read_csv(spark, path)
    if "source_row" not in df.columns:
        df = df.withColumn("source_row", F.lit(None).cast("string"))
    placed = df.select(number("source_row", "int").alias("source_row"), F.trim("url").alias("url")).withColumn("__pos", F.monotonically_increasing_id())
    return default_row_numbers(placed, "__pos").drop("__pos")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the lines ``key: value``, split at the first colon; value as a number in ``number``."""
    lines = spark.read.text(path).filter(F.instr("value", ":") > 0)
    parts = F.split("value", ":", 2)
    return lines.select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value")).withColumn("number", F.col("value").try_cast("double"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(line, data): parsed where a line is JSON, else data is null and the line stays; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumnRenamed("value", "line")
    parsed = F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("data", parsed).withColumn("data", F.when(F.col("data._bad").isNull(), F.col("data").dropFields("_bad")))


def landmarks(spark: SparkSession) -> DataFrame:
    """(name, lat, lon) of the known places."""
    places = {"center": CENTRE, "park": PARK, "embankment": EMBANKMENT, **MALLS}
    return spark.createDataFrame([(k, *v) for k, v in places.items()], "name string, lat double, lon double")
