"""Repeated passages by content-defined chunking.

A gear rolling hash over the last 16 bytes marks cut points, so where a text is
cut depends on the bytes nearby alone: insertions elsewhere do not move the
chunks.  All of it is numpy on whole batches: the gear sum of 16 bytes is built
by doubling (1, 2, 4, 8, 16), equal bit for bit to the rolling form.  A cut with
another within ``shortest`` bytes before it in the same text is dropped, again a local rule.  Chunks
have no greatest length; nothing of a text is left out.

A digest has 64 bits.  Two different chunks may share one in a corpus of many
billions, but a passage counts only from several chunks in a row on, whose
digests would all have to agree by chance.

With cuts about 32 bytes apart, of a repeated passage of 51 words at least 20 lie in
whole chunks 995 times in 1000 (measured on 400 passages), which is why that is
the least that counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealscope.llm import shingles as S
from dealscope.llm.minhash import _slices
from dealscope.llm.shared import given_id, held_id, look_up, no_clash, written

_WINDOW = 16


def _gear(seed: int) -> np.ndarray:
    return S.mix64(np.arange(256, dtype=np.uint64) + np.uint64(seed << 8)).astype(np.uint32)


def cut_texts(texts: list[str | None], *, bits: int = 4, shortest: int = 16, seed: int = 3) -> dict[str, np.ndarray]:
    """Chunks of every text: its number, its span in characters, its words, and a digest."""
    pad = b"\0" * _WINDOW
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(pad + b"".join(e + pad for e in encoded), dtype=np.uint8)
    sizes = np.array([len(e) for e in encoded], dtype=np.int64)
    begin = _WINDOW + np.concatenate(([0], np.cumsum(sizes + _WINDOW)[:-1])).astype(np.int64)
    h = _gear(seed)[buf]
    for span in (1, 2, 4, 8):
        later = h.copy()
        later[span:] += h[:-span] << np.uint32(span)
        h = later
    mark = (h & np.uint32(((1 << bits) - 1) << (_WINDOW - bits))) == 0
    # a cut stands before byte i + 1, moved on to the start of a character
    at = np.flatnonzero(mark) + 1
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    at = lead[np.minimum(np.searchsorted(lead, at), len(lead) - 1)]
    at = np.unique(at)
    doc = np.searchsorted(begin, at, side="right") - 1
    inside = (doc >= 0) & (at > begin[np.maximum(doc, 0)]) & (at < (begin + sizes)[np.maximum(doc, 0)])
    at, doc = at[inside], doc[inside]
    # marks of the padding, whose windows hold the text before, are gone by now
    keep = np.ones(len(at), bool)
    keep[1:] = (np.diff(at) >= shortest) | (np.diff(doc) != 0)
    at = at[keep]
    full = np.flatnonzero(sizes)
    starts = np.sort(np.concatenate((at, begin[full])))
    doc = np.searchsorted(begin, starts, side="right") - 1
    ends = np.empty_like(starts)
    if len(starts):
        ends[:-1] = starts[1:]
        ends[-1] = len(buf)
        ends = np.minimum(ends, (begin + sizes)[doc])
    white = (buf == 32) | ((buf >= 9) & (buf <= 13)) | (buf == 0)
    word_start = np.zeros(len(buf) + 1, np.int64)
    word_start[2:] = np.cumsum(~white[1:] & white[:-1])
    first_char = np.zeros(len(buf) + 1, np.int64)
    first_char[1:] = np.cumsum((buf & 0xC0) != 0x80)
    length = ends - starts
    cover = np.repeat(starts - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(int(length.sum()))
    offset = cover - np.repeat(starts, length)
    out = {"doc": doc, "start": first_char[starts] - first_char[begin[doc]], "end": first_char[ends] - first_char[begin[doc]], "n_words": word_start[ends] - word_start[starts]}
    edges = np.concatenate(([0], np.cumsum(length)[:-1])) if len(length) else np.empty(0, np.int64)
    longest = int(length.max()) if len(length) else 1
    powers = S._powers(S.multipliers(1, 11)[0], longest + 1)
    value = (buf[cover].astype(np.uint64) + np.uint64(1)) * powers[offset]
    sums = np.add.reduceat(value, edges) if len(edges) else np.empty(0, np.uint64)
    out["digest"] = S.mix64(sums + length.astype(np.uint64)).view(np.int64)
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits: int = 4, shortest: int = 16) -> DataFrame:
    """(id, row, seq, start, end, n_words, digest) of every chunk; start and end are characters of the text.

    ``row`` is a hash of the text and tells rows apart that share an id.  Null and empty
    texts have no chunks.
    """
    source = docs.select(held_id(docs, id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _slices(pdf):
                c = cut_texts(part["text"].tolist(), bits=bits, shortest=shortest)
                doc = c.pop("doc")
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.empty(0, np.int64)
                seq = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
                yield pd.DataFrame({"id": part["id"].to_numpy()[doc], "row": part["row"].to_numpy()[doc], "seq": seq, **c}).astype({"seq": "int32", "start": "int32", "end": "int32", "n_words": "int32"})

    out = source.mapInPandas(run, f"id {kind}, row long, seq int, start int, end int, n_words int, digest long")
    return out.withColumn("id", given_id(out))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_words: int = 20, bits: int = 4, shortest: int = 16) -> DataFrame:
    """One row a repeated passage of a document: id, span_start, span_end, n_words, keeper_id, removed.

    A chunk repeats when its digest occurs twice or more in the table.  Runs of
    repeated chunks that follow each other in a document count from ``least_words``
    words on; shorter ones are left alone.  A run is dealt into passages where the
    document that keeps its chunks changes, or whether they are there for the first time, by
    (id, position).  A passage is ``removed`` unless it is the first place of its chunks, so
    every chunk stays at its first place; keeper_id is the id that keeps it there, and
    n_words are those of the passage.  Parts of fewer than ``least_words`` words make no holes: they go where all beside
    them goes, and else stay.  Documents without repeated passages have no rows.  Null and
    empty texts have none; null ids come last as keepers; rows that share an id are rows of their
    own, in the order of a hash of their texts, and equal rows are further occurrences, all but one of them
    removed whole; other columns are ignored; an empty table gives no rows.
    """
    spans = _passages(docs, id_col, text_col, least_words=least_words, bits=bits, shortest=shortest)
    copies = F.when(F.col("rest"), F.sequence(F.lit(2).cast("long"), F.col("copies"))).otherwise(F.array(F.lit(1).cast("long")))
    every = spans.withColumn("copy", F.explode(copies))
    return every.select(F.col("id").alias(id_col), F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"), "n_words", "keeper_id", "removed")


def _passages(docs: DataFrame, id_col: str, text_col: str, *, least_words: int = 20, bits: int = 4, shortest: int = 16) -> DataFrame:
    """(id, row, copies, rest, span_start, span_end, n_words, keeper_id, removed) of each passage.

    Equal rows (same id, same text) count once, with their number as ``copies``; ``rest`` are
    the passages of all of them but the first.
    """
    all_chunks = written(chunks(docs, id_col, text_col, bits=bits, shortest=shortest), "chunks").withColumn("copies", F.lit(1).cast("long"))
    equal_rows = not all_chunks.filter("seq = 0").groupBy("id", "row").count().filter("count > 1").isEmpty()
    if equal_rows:
        values = [F.first(c).alias(c) for c in ("start", "end", "n_words", "digest")]
        all_chunks = written(all_chunks.groupBy("id", "row", "seq").agg(*values, F.sum("copies").alias("copies")), "chunks")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "seq")
    stats = all_chunks.groupBy("digest").agg(F.sum("copies").alias("times"), F.count("*").alias("places"), F.min(place).alias("keeper")).filter("times > 1").drop("times")
    found = look_up(all_chunks, stats, "digest", "places", all_chunks.count())
    here = found.select("id", "row", "copies", F.lit(False).alias("rest"), "seq", "start", "end", "n_words", F.col("keeper.id").alias("keeper_id"), (~place.eqNullSafe(F.col("keeper"))).alias("again"))
    if equal_rows:
        here = here.unionByName(here.filter("copies > 1").withColumn("rest", F.lit(True)).withColumn("again", F.lit(True)))
    each = ("id", "row", "copies", "rest")
    inside = Window.partitionBy(*each).orderBy("seq")
    goes_on = (F.lag("seq").over(inside) + 1).eqNullSafe(F.col("seq")) & F.lag("again").over(inside).eqNullSafe(F.col("again")) & F.lag("keeper_id").over(inside).eqNullSafe(F.col("keeper_id"))
    dealt = here.withColumn("run", F.col("seq") - F.row_number().over(inside)).withColumn("begins", (~goes_on).cast("int"))
    dealt = dealt.withColumn("part", F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    spans = dealt.groupBy(*each, "run", "part").agg(
        F.min("start").alias("span_start"), F.max("end").alias("span_end"), F.sum("n_words").cast("long").alias("n_words"), F.first("keeper_id").alias("keeper_id"), F.first("again").alias("removed")
    )
    spans = spans.withColumn("run_words", F.sum("n_words").over(Window.partitionBy(*each, "run"))).filter(F.col("run_words") >= least_words)
    return _settled(spans, each, least_words)


def _settled(spans: DataFrame, each: Sequence[str], least_words: int) -> DataFrame:
    """The parts of runs without holes of a few words: short parts go the way of what stands beside them.

    A part is settled if it stays, or if its keeper has ``least_words`` words of the run.  Others, up to ``least_words`` in a row, are
    removed where the settled parts on both sides are, or on the one side there is; else they stay, and are then their own
    keepers.  Parts that are now of one kind are joined, and what would be removed alone with fewer words stays.
    """
    run = Window.partitionBy(*each, "run")
    order = run.orderBy("part")
    of_keeper = F.sum("n_words").over(Window.partitionBy(*each, "run", "removed", "keeper_id"))
    rows = spans.withColumn("settled", ~F.col("removed") | (of_keeper >= least_words))
    stays = F.struct(F.lit(False).alias("removed"), F.col("id").alias("keeper_id"))
    rows = rows.withColumn("state", F.when(F.col("settled"), F.struct("removed", "keeper_id"))).withColumn("group", F.sum(F.col("settled").cast("int")).over(order))
    before = F.last("state", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("state", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    unsettled = F.sum(F.when(~F.col("settled"), F.col("n_words")).otherwise(0)).over(Window.partitionBy(*each, "run", "group"))
    rows = rows.withColumns({"before": before, "after": after, "unsettled": unsettled})
    sides = F.filter(F.array("before", "after"), lambda x: x.isNotNull())
    gone = (F.size(sides) > 0) & F.forall(sides, lambda x: x["removed"]) & (F.col("unsettled") < least_words)
    rows = rows.withColumn("state", F.coalesce("state", F.when(gone, F.coalesce("before", "after")).otherwise(stays)))
    rows = rows.withColumn("changed", (~F.lag("state").over(order).eqNullSafe(F.col("state"))).cast("int"))
    rows = rows.withColumn("piece", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*each, "run", "piece").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.sum("n_words").alias("n_words"), F.first("state").alias("state"))
    state = F.when(F.col("state.removed") & (F.col("n_words") < least_words), stays).otherwise(F.col("state"))
    return out.withColumn("state", state).select(*each, "span_start", "span_end", "n_words", "state.keeper_id", "state.removed")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the removed passages cut out of their texts; rows and columns stay.

    Every row has its own passages cut, null and shared ids included; of equal rows (same id,
    same text) one stays whole but for passages of earlier places.  Null texts are returned as they are.
    """
    own, row, rest, spans_col = no_clash(docs, "own_id"), no_clash(docs, "own_row"), no_clash(docs, "own_rest"), no_clash(docs, "spans")
    gone = _passages(docs, id_col, text_col, **options).filter("removed")
    spans = gone.groupBy(F.col("id").alias(own), F.col("row").alias(row), F.col("rest").alias(rest)).agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias(spans_col))
    spans = written(spans, "spans")
    key, later = no_clash(docs, "row_key"), no_clash(docs, "later")
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    if spans.filter(rest).isEmpty():
        keyed = keyed.withColumn(later, F.lit(False))
    else:
        keyed = keyed.withColumn(later, F.row_number().over(Window.partitionBy(id_col, key).orderBy(key)) > 1)
    joined = keyed.join(spans, keyed[id_col].eqNullSafe(spans[own]) & (keyed[key] == spans[row]) & (keyed[later] == spans[rest]), "left")
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    cut = F.aggregate(
        spans_col,
        start,
        lambda acc, s: F.struct(F.concat(acc["kept"], F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), (s["span_start"] - acc["at"])).cast("int"))).alias("kept"), F.greatest(acc["at"], s["span_end"]).alias("at")),
        lambda acc: F.concat(acc["kept"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return joined.withColumn(text_col, F.when(F.col(spans_col).isNotNull(), cut).otherwise(text)).select(*docs.columns)
