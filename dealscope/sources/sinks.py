"""Writers: fixed-order tables, resumable appends, reports, compact JSON, page templates."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealscope.operators.sets import pending


def write_table(df: DataFrame, path: str, columns: Sequence[str] | None = None, kind: str = "parquet") -> None:
    """Overwrites ``path`` with the columns in order, as parquet or csv; arrays become JSON text in csv."""
    out = df.select(*columns) if columns else df
    if kind == "csv":
        out = out.withColumns({c: F.to_json(c) for c, t in out.dtypes if t.startswith(("array", "struct", "map"))})
        out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        out.write.mode("overwrite").format(kind).save(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the table at ``path`` does not hold; their number."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    new = pending(df, spark.read.parquet(path), key) if there else df
    new = new.dropDuplicates([key]).persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").parquet(path)
        return n
    finally:
        new.unpersist()


def json_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(row_json): each row as a compact JSON array of its columns; nulls stay null."""
    parts = [F.coalesce(F.get_json_object(F.to_json(F.struct(F.col(c).alias("v"))), "$.v"), F.lit("null")) if t not in ("string",) else F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit("")) for c, t in df.select(*columns).dtypes]
    fixed = [F.when(p == "", F.lit("null")).otherwise(p) for p in parts]
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *fixed), F.lit("]")).alias("row_json"))


def json_payload(meta: dict, lookups: dict, rows: DataFrame, most: int = 2_000_000) -> str:
    """One document of meta, lookup lists and rows, without spaces; for map-sized tables of ``most`` rows or fewer."""
    found = [r[0] for r in rows.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} rows: write json_rows instead")
    head = json.dumps({"meta": meta, **lookups}, ensure_ascii=False, separators=(",", ":"))
    return f'{head[:-1]},"rows":[{",".join(found)}]}}'


def merged_template(template: str, payload: str, image: bytes, bounds: Sequence[float], marks: Sequence[str] = ("__DATA__", "__IMAGE__", "__BOUNDS__"), kind: str = "image/png") -> str:
    """The template with data, image and bounds put in; each mark must occur."""
    if gone := [m for m in marks if m not in template]:
        raise ValueError(f"marks absent: {gone}")
    uri = f"data:{kind};base64,{base64.b64encode(image).decode()}"
    values = (payload.replace("</", "<\\/"), uri, json.dumps(list(bounds)))
    for m, v in zip(marks, values, strict=True):
        template = template.replace(m, v)
    return template
