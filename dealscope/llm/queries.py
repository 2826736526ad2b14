"""Registered queries of the text operators: thin views over their results, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscope.llm.boilerplate import without_boilerplate
from dealscope.llm.bpe import encode_decode, with_token_counts
from dealscope.llm.chat import read_digests, windows
from dealscope.llm.chunks import repeated_passages
from dealscope.llm.exact import deduplicate, passing_index
from dealscope.llm.gif import media_features, texts_as_media
from dealscope.llm.html_main import extract_main
from dealscope.llm.licenses import labels_of, scan
from dealscope.llm.merkle import tamper_report
from dealscope.llm.minhash import near_duplicates
from dealscope.llm.mix import mix
from dealscope.llm.negatives import hard_negatives
from dealscope.llm.toxicity import toxicity

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with passing_index(spark, "text_digests") as index:
        return deduplicate(_table(spark, sf_dir, "documents"), index)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, digests_only=True)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    counted = with_token_counts(turns.unionByName(extra), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, "text", "n_tokens")
    return read_digests(windows(counted, tokens_col="n_tokens"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(_table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(texts_as_media(_table(spark, sf_dir, "documents")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = without_boilerplate(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_report(_table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels_of(scan(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_mix_sources": op6_mix_sources,
    "op7_html_main_text": op7_html_main_text,
    "op8_toxicity": op8_toxicity,
    "op9_gif_media": op9_gif_media,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_license_scan": op13_license_scan,
}


def _tree(name: str, nodes: str) -> str:
    """Parts of a WITH RECURSIVE: the levels of 8-ary trees over ``nodes`` (g, pos, size, digest), and each node's siblings."""
    left = "ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    right = "ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
    run = "PARTITION BY g, k, pos // 8"
    return f"""{name} AS (
            SELECT g, 0 AS k, pos, size, digest FROM {nodes}
            UNION ALL
            SELECT g, k + 1, pos // 8, (any_value(size) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE size > 1 GROUP BY g, k, pos // 8
        ), {name}_steps AS MATERIALIZED (
            SELECT g, k, pos, coalesce(string_agg(digest, '') OVER ({run} {left}), '') AS l, coalesce(string_agg(digest, '') OVER ({run} {right}), '') AS r FROM {name} WHERE size > 1
        )"""


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The CRC-32 of the digits of doc_id, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b:
            list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, e: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384) ELSE d // 2 END)))"""

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_line_dedup": """
        WITH lines AS (
            SELECT row_id, doc_id, source, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM (SELECT *, row_number() OVER () AS row_id FROM documents WHERE text IS NOT NULL)
        ), spread AS (
            SELECT line FROM lines WHERE trim(line, ' ') <> ''
            GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= 5
        ), per_doc AS (
            SELECT row_id, any_value(doc_id) AS doc_id, count(*) AS n_lines,
                   count(*) FILTER (spread.line IS NOT NULL) AS n_removed,
                   coalesce(string_agg(lines.line, chr(10) ORDER BY pos) FILTER (spread.line IS NULL), '') AS text
            FROM lines LEFT JOIN spread ON lines.line = spread.line GROUP BY row_id
        )
        SELECT doc_id, n_lines, n_removed, sha256(text) AS text_sha256 FROM per_doc
        UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::double)) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS MATERIALIZED (
            SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::bigint AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r
        ), p AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5
        ), n AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                   row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id)::int AS rank
            FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """,
    "op12_merkle_manifest": f"""
        WITH RECURSIVE leaves AS MATERIALIZED (
            SELECT doc_id, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {_leaf("text")}) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size, {_leaf("text")} AS digest,
                   CASE WHEN {_CRC32} % 3 = 0 THEN {_leaf(_ASCII_LOWER)} ELSE {_leaf("text")} END AS given
            FROM documents
        ), {_tree("trees", "leaves")}, tops AS MATERIALIZED (
            SELECT 0 AS g, g AS lang, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS size, digest FROM trees WHERE size = 1
        ), {_tree("top", "tops")}, climbed AS (
            SELECT doc_id, g, pos, digest AS leaf, 0 AS k, pos AS place, given AS folded, '' AS proof FROM leaves
            UNION ALL
            SELECT doc_id, c.g, c.pos, leaf, c.k + 1, place // 8, sha256(l || folded || r), proof || l || r
            FROM climbed c JOIN trees_steps s ON s.g IS NOT DISTINCT FROM c.g AND s.k = c.k AND s.pos = c.place
        ), at_top AS (
            SELECT doc_id, c.g, c.pos, leaf, t.digest AS subroot, 0 AS k, t.pos AS place, folded, proof
            FROM (SELECT *, max(k) OVER (PARTITION BY g, pos) AS last FROM climbed) c JOIN tops t ON t.lang IS NOT DISTINCT FROM c.g WHERE c.k = c.last
            UNION ALL
            SELECT doc_id, a.g, a.pos, leaf, subroot, a.k + 1, place // 8, sha256(l || folded || r), proof || l || r
            FROM at_top a JOIN top_steps s ON s.k = a.k AND s.pos = a.place
        )
        SELECT doc_id, leaf, subroot, top.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = top.digest AS verified
        FROM (SELECT *, max(k) OVER (PARTITION BY g, pos) AS last FROM at_top) a, top WHERE a.k = a.last AND top.size = 1
    """,
}
