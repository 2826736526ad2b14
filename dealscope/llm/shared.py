"""Shared storage, written intermediate tables and joins that survive hot keys."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows, so at most 1/HOT_SHARE keys are.
HOT_SHARE = 0.002


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one of this process only where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='llm-')}")
        found = _OWN[0]
    return found.rstrip("/")


_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    Results may read these tables until they are materialised; then :func:`release` drops them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: DataFrame | None = None) -> int:
    """Deletes the intermediate tables that this process has written, but for those that ``keep`` reads; their number.

    Call it once the operators' results are stored elsewhere, or in ``keep``.
    """
    held = {f.rsplit("/", 1)[0] for f in keep.inputFiles()} if keep is not None else set()
    stay = [p for p in _WRITTEN if any(h.endswith(p.split(":", 1)[-1].lstrip("/")) for h in held)]
    gone = [p for p in _WRITTEN if p not in stay]
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN[:] = stay
    return len(gone)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; at the end what it freed goes back to the system, as Python workers wait on for further tasks."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return task


#: In Arrow batches a column of whole numbers with nulls would turn to floats; their least value stands for null there.
_LEAST = {"tinyint": -(1 << 7), "smallint": -(1 << 15), "int": -(1 << 31), "bigint": -(1 << 63)}


def held_id(df: DataFrame, c: str) -> Column:
    """Column ``c`` for a trip through Arrow, null written as its type's least value."""
    kind = df.schema[c].dataType.simpleString()
    return F.coalesce(F.col(c), F.lit(_LEAST[kind]).cast(kind)) if kind in _LEAST else F.col(c)


def given_id(df: DataFrame, c: str = "id") -> Column:
    """The id after the trip, null again."""
    kind = df.schema[c].dataType.simpleString()
    return F.nullif(F.col(c), F.lit(_LEAST[kind]).cast(kind)) if kind in _LEAST else F.col(c)


def text_sha256(text: str) -> Column:
    """The SHA-256 of a text column in hex digits; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def row_key(i: Column, sha256: Column) -> Column:
    """A key of the rows with this id, null or not, and the text of this hexadecimal digest."""
    return F.concat(F.unhex(sha256), F.when(i.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), i.cast("string"))).cast("binary"))


def no_clash(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def look_up(rows: DataFrame, stats: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` to one ``stats`` row a key, without meeting a hot key's rows in one task.

    Keys whose ``weight`` (their number of ``rows``) exceeds HOT_SHARE of ``total`` are
    at most 1 / HOT_SHARE; only those are broadcast, the rest join by shuffle.
    ``how`` is inner or left.
    """
    bound = max(1, int(total * HOT_SHARE))
    hot = stats.filter(F.col(weight) > bound)
    hot_rows = rows.join(F.broadcast(hot), key, "inner")
    cold_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return hot_rows.unionByName(cold_rows.join(stats.filter(F.col(weight) <= bound), key, how).select(hot_rows.columns))


def words(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
