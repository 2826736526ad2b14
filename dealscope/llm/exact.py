"""Exact dedup against a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by digest.  New data comes in batches of
descending ids: a batch is reduced to one row a digest, anti-joined by sort-merge
against the index, and what is new is appended in the same layout, so the index side
is never shuffled, and of equal texts the largest id is the one that is held.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from dealscope.llm.shared import look_up, written


class DigestIndex:
    """A catalogue table (digest, keep_id) of all texts seen so far."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = 32):
        self.spark, self.table, self.buckets = spark, table, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.read.table(self.table)

    def not_held(self, digests: DataFrame) -> DataFrame:
        """The rows of ``digests`` that the index lacks, dealt like its buckets."""
        dealt = digests.repartition(self.buckets, "digest")
        return dealt.hint("merge").join(self.read().select("digest"), "digest", "left_anti") if self.exists() else dealt

    def add(self, digests: DataFrame) -> None:
        """Append the digests not yet held; ``digests`` has one row (digest, keep_id) a digest.

        Rows are dealt by their bucket, so that an append adds one file a bucket, however many partitions there are.
        """
        new = self.not_held(digests).select("digest", "keep_id").repartition(F.pmod(F.hash("digest"), F.lit(self.buckets)))
        new.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


@contextmanager
def passing_index(spark: SparkSession, name: str) -> Iterator[DigestIndex]:
    """An index of its own name for one run; its table goes at the end, also after a failure."""
    index = DigestIndex(spark, f"{name}_{uuid.uuid4().hex}")
    try:
        yield index
    finally:
        index.drop()


def _descending(seen: DataFrame, batches: int) -> Iterator[Column]:
    """Conditions that deal the rows into ranges of ids, the largest ids first and null ids last.

    The ends are about evenly spread; ids that are not numbers are one range.
    """
    ends: list = []
    if isinstance(seen.schema["id"].dataType, NumericType) and batches > 1:
        points = F.array(*[F.lit((batches - k) / batches) for k in range(1, batches)])
        ends = sorted({x for x in seen.agg(F.percentile_approx("id", points, 1000)).first()[0] or []}, reverse=True)
    above = F.lit(True)
    for end in ends:
        inside = F.col("id") >= F.lit(end)
        yield F.coalesce(inside & above, F.lit(False))
        above = ~inside
    yield F.coalesce(above, F.lit(True))


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", *, batches: int = 4) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, as UTF-8; null counts as empty.  The documents
    enter ``index`` in ``batches`` ranges of descending ids, so of equal texts the row with
    the largest id stays; a text that an earlier call put into ``index`` stays with that
    call's id.  group_size counts the rows of this call.  Repeated rows (same id, same
    text) are all marked alike.  Null ids are smaller than any other; a group of null
    ids keeps them.  Other columns are ignored.  An empty table gives no rows.  The result
    does not read ``index``, which may be dropped or added to afterwards.
    """
    seen = written(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest")), "digests")
    for inside in _descending(seen, batches):
        index.add(seen.filter(inside).groupBy("digest").agg(F.max("id").alias("keep_id")))
    sizes = seen.groupBy("digest").agg(F.count("*").alias("group_size")).repartition(index.buckets, "digest")
    stats = written(sizes.hint("merge").join(index.read(), "digest"), "stats")
    out = look_up(seen, stats, "digest", "group_size", seen.count())
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
