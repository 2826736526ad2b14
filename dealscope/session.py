"""Session settings that the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # else each column expression looks up its line of code
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(name: str = "dealscope", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_OWN: list[str] = []
_STORED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='dealscope-')}")
        found = _OWN[0]
    return found.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder: cuts the plan, survives lost executors, and has known sizes.

    Results may read it until they are written; then :func:`drop_stored` removes it.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _STORED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over four tasks a core: few files or row groups would keep work that is much for its bytes on few cores."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def drop_stored(spark: SparkSession) -> int:
    """Removes the tables that this process has stored; their number."""
    n = len(_STORED)
    while _STORED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
