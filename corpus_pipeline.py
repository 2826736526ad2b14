"""A training corpus from raw documents, in stages that each write what they keep."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscope.llm.bpe import encode_decode
from dealscope.llm.exact import deduplicate, passing_index
from dealscope.llm.minhash import near_duplicates
from dealscope.llm.mix import mixed_rows
from dealscope.llm.shared import release, row_key, text_sha256, written
from dealscope.llm.toxicity import without_toxic

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _kept(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text are among ``rows`` (doc_id, text_sha256), one of each; ids may be null or shared.

    One shuffle of the texts serves the join and the choice of one of equal rows.
    """
    wanted = rows.select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("__key"))
    return docs.select(*COLUMNS).withColumn("__key", row_key(F.col("doc_id"), text_sha256("text"))).join(wanted, "__key", "left_semi").dropDuplicates(["__key"]).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted on the labels of ``sf_dir``, predicts toxic go.

    Each row is decided by its own text; rows without text stay unless the machine calls
    the empty text toxic.  An empty table gives no rows.
    """
    return without_toxic(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of identical texts stays: the one with the largest doc_id, null ids only where there is no other.

    Null counts as the empty text; of rows with equal id and text one stays.
    """
    with passing_index(spark, "corpus_digests") as index:
        decided = deduplicate(docs, index)
    return _kept(docs, decided.filter("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id.

    A group that has only null ids keeps the row of the smallest digest; rows without words are linked with nothing and stay.
    """
    decided = near_duplicates(docs, percent=80, with_digest=True).filter("kept")
    # rows that share the kept id, or have none, can meet in one group
    first = decided.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_sha256")).alias("one")).select("one.*")
    return _kept(docs, first.unionByName(decided.filter("component is null").select("doc_id", "text_sha256")))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; rows without words once."""
    return mixed_rows(docs.select(*COLUMNS))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the digest of what they decode to; null texts have none."""
    return encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("mix sources", mix_stage),
    ("byte-level bpe", bpe_stage),
]

#: The learned toxicity scores of the first stage have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again; a stage's own tables go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
            release(spark, keep=docs)
    return docs
