"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and the beginnings of words, hashed into
buckets.  The machine scores bias + sum of term weights + the interactions of
all pairs of terms, each pair by the product of two short vectors, so that two
terms can mean more together (an insult and a group) than the sum of both.

Fitting takes a bounded sample of labelled rows.  Buckets are kept that go with
the label, in the sample or among the texts that hold an insult-like term; on
those a term that is harmless alone shows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.llm.shared import given_id, held_id, lean, text_sha256, written

_WORD = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (3, 4, 5, 6, 7)
_MAX_REMEMBERED = 1 << 18


def buckets_of(word: str, bits: int) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings."""
    shift = 64 - bits
    own = xxhash.xxh64_intdigest(word, 1) >> shift
    return (own, *(xxhash.xxh64_intdigest(word[:k], 2) >> shift for k in _BEGINNINGS if len(word) > k))


def terms(text: str | None, bits: int, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Sorted distinct buckets of a whole text; ``known`` remembers words."""
    found: set[int] = set()
    for w in set(_WORD.findall((text or "").lower())):
        b = known.get(w)
        if b is None:
            if len(known) >= _MAX_REMEMBERED:
                known.clear()
            b = known[w] = buckets_of(w, bits)
        found.update(b)
    return np.sort(np.fromiter(found, np.int32, len(found)))


@dataclass
class Machine:
    """Weights and vectors of the kept buckets; others count as nothing."""

    bits: int
    bias: float
    weight: dict[int, float]
    vector: dict[int, np.ndarray]

    def score(self, active: list[int]) -> float:
        z = self.bias
        if active:
            z += sum(self.weight[b] for b in active)
            v = np.array([self.vector[b] for b in active])
            s = v.sum(axis=0)
            z += 0.5 * float(s @ s - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def scorer(self):
        """A function of a text; remembers the kept buckets of each word."""
        known: dict[str, tuple[int, ...]] = {}
        weight = self.weight

        def run(text: str | None) -> float:
            active: set[int] = set()
            for w in set(_WORD.findall((text or "").lower())):
                b = known.get(w)
                if b is None:
                    if len(known) >= _MAX_REMEMBERED:
                        known.clear()
                    b = known[w] = tuple(x for x in buckets_of(w, self.bits) if x in weight)
                if b:
                    active.update(b)
            return self.score(sorted(active))

        return run


def _association(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Signed root of the likelihood ratio of a of na against b of nb."""
    a, b = a.astype(float), b.astype(float)
    p = (a + b) / (na + nb)

    def part(k: np.ndarray, n: int) -> np.ndarray:
        e1, e0 = n * p, n * (1 - p)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / e1), 0) + np.where(n - k > 0, (n - k) * np.log((n - k) / e0), 0)

    g = 2 * (part(a, na) + part(b, nb))
    return np.sign(a / na - b / nb) * np.sqrt(np.maximum(g, 0))


#: Buckets below this association, or in fewer rows, may go with the label by chance.
_CHANCE, _FEWEST = 3.3, 3
#: From this association on a bucket goes with label 1 beyond doubt.
_TELLING = 6.0


@dataclass
class Counts:
    """Rows of each label; buckets, and how many rows of each label hold them."""

    positive: int
    negative: int
    bucket: np.ndarray
    with_positive: np.ndarray
    with_negative: np.ndarray

    def standing_out(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted buckets that stand out from chance, and their association."""
        a = _association(self.with_positive, self.with_negative, max(1, self.positive), max(1, self.negative))
        keep = (np.abs(a) > _CHANCE) & (self.with_positive + self.with_negative >= _FEWEST)
        order = np.argsort(self.bucket[keep])
        return self.bucket[keep][order], a[keep][order]


def counts_of(rows: list[np.ndarray], labels: np.ndarray) -> Counts:
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate([*rows, np.empty(0, np.int32)])
    used, at = np.unique(flat, return_inverse=True)
    of_one = np.repeat(labels == 1, sizes)
    return Counts(int((labels == 1).sum()), int((labels != 1).sum()), used, np.bincount(at[of_one], minlength=len(used)), np.bincount(at[~of_one], minlength=len(used)))


def telling(counts: Counts) -> np.ndarray:
    bucket, a = counts.standing_out()
    return bucket[a > _TELLING]


def holding(rows: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Which rows hold any of the (sorted) wanted buckets."""
    return np.array([bool(np.isin(r, wanted, assume_unique=True).any()) for r in rows], dtype=bool)


def choose(everything: Counts, near: Counts, kept: int) -> np.ndarray:
    """Sorted buckets to keep: those that go with the label, among all rows or among rows with a telling bucket.

    Only what stands out from chance is kept, the strongest ``kept`` of it.
    """
    bucket, alone = everything.standing_out()
    strength = dict(zip(bucket.tolist(), np.where(alone > 0, alone, 0.7 * -alone).tolist(), strict=True))
    if near.positive > 20 and near.negative > 20:
        for b, a in zip(*(x.tolist() for x in near.standing_out()), strict=True):
            strength[b] = max(strength.get(b, 0.0), abs(a))
    strong = sorted((b for b, v in strength.items() if v > _CHANCE), key=lambda b: (-strength[b], b))[:kept]
    return np.array(sorted(strong), dtype=np.int32)


def descend(rows: list[np.ndarray], labels: np.ndarray, strong: np.ndarray, *, bits: int, rank: int = 4, epochs: int = 30, rate: float = 0.1, ridge: float = 1e-3, seed: int = 11) -> Machine:
    """Weights and vectors by Adagrad; ``rows`` hold buckets of ``strong`` only."""
    pos = int(labels.sum())
    neg = len(labels) - pos
    if not pos or not neg:
        return Machine(bits, 8.0 if pos else -8.0, {}, {})
    sizes = np.array([len(r) for r in rows])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    local = np.searchsorted(strong, np.concatenate([*rows, np.empty(0, np.int32)]))
    rng = np.random.default_rng(seed)
    k = len(strong)
    w, v = np.zeros(k), rng.normal(0, 0.01, (k, rank))
    gw, gv, b, gb = np.full(k, 1e-6), np.full((k, rank), 1e-6), float(np.log(pos / neg)), 1e-6
    batch = 256
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            counts = sizes[own]
            idx = np.concatenate([local[starts[i] : starts[i + 1]] for i in own])
            seg = np.repeat(np.arange(len(own)), counts)
            vi = v[idx]
            s = np.stack([np.bincount(seg, vi[:, f], len(own)) for f in range(rank)], axis=1)
            z = b + np.bincount(seg, w[idx], len(own)) + 0.5 * ((s * s).sum(axis=1) - np.bincount(seg, (vi * vi).sum(axis=1), len(own)))
            err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[own]
            gbias = err.mean()
            gb += gbias * gbias
            b -= rate * gbias / np.sqrt(gb)
            e = err[seg] / len(own)
            used = np.unique(idx)
            dw = np.bincount(idx, e, k)[used] + ridge * w[used] / len(own)
            gw[used] += dw * dw
            w[used] -= rate * dw / np.sqrt(gw[used])
            pull = e[:, None] * (s[seg] - vi)
            dv = np.stack([np.bincount(idx, pull[:, f], k) for f in range(rank)], axis=1)[used] + ridge * v[used] / len(own)
            gv[used] += dv * dv
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
    return Machine(bits, b, dict(zip(strong.tolist(), w.tolist(), strict=True)), dict(zip(strong.tolist(), v, strict=True)))


def fit(rows: list[np.ndarray], labels: np.ndarray, *, bits: int, kept: int = 4096, **options) -> Machine:
    """A machine from rows (sorted bucket lists) in memory; :func:`train` does the same on tables."""
    everything = counts_of(rows, labels)
    near = holding(rows, telling(everything))
    strong = choose(everything, counts_of([r for r, n in zip(rows, near, strict=True) if n], labels[near]), kept)
    return descend([r[np.isin(r, strong, assume_unique=True)] for r in rows], labels, strong, bits=bits, **options)


def held_out(id_col: str | Column) -> Column:
    """Rows whose label is never learnt: crc32 of the id as text is a multiple of 5."""
    own = (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")
    return F.crc32(F.coalesce(own, F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample: int = 30_000, bits: int = 20, kept: int = 4096) -> Machine:
    """Fit on at most ``sample`` labelled rows, chosen by a hash of their ids and texts, not held out.

    Null labels, null ids and labels without a document are left out; an id that is
    labelled twice takes its larger label; rows of equal id and text count once.
    Without any label the machine scores 0.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    known = written(known.filter(~held_out("id")).withColumn("draw", F.xxhash64("id")), "known")
    # a draw below this leaves `sample` rows or a few more, so that not every task sends its lowest `sample` to the driver
    share = (sample + 8 * sample**0.5 + 64) / max(1, known.count())
    low = known.filter(F.col("draw") < F.lit(int(min(1.0, share) * 2.0**64 - 2.0**63 - 2048))) if share < 1 else known
    known = low.orderBy("draw", "id").limit(sample).select("id", "y")
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), "id")
    # an id may stand on many rows: equal rows count once, and the draw is made again among the rows
    texts = written(found.groupBy(F.xxhash64("id", text_sha256("text")).alias("draw")).agg(F.first("y").alias("y"), F.first("text").alias("text")), "texts")
    if texts.count() > sample:
        beyond = texts.select("draw").orderBy("draw").limit(sample + 1).agg(F.max("draw")).first()[0]
        texts = texts.filter(F.col("draw") < beyond)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[str, tuple[int, ...]] = {}
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"], "terms": [terms(t, bits, memory).tobytes() for t in pdf["text"]]})

    held = written(texts.select("y", "text").mapInPandas(lean(run), "y int, terms binary"), "terms")
    everything = _table_counts(held, None)
    strong = choose(everything, _table_counts(held, telling(everything)), kept)

    def only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = (np.frombuffer(t, np.int32) for t in pdf["terms"])
            yield pd.DataFrame({"y": pdf["y"], "terms": [r[np.isin(r, strong, assume_unique=True)].tobytes() for r in rows]})

    # at most `sample` rows of at most `kept` buckets, as Arrow; sorted, so that fits agree
    found = held.mapInPandas(lean(only), "y int, terms binary").toArrow().sort_by([("terms", "ascending"), ("y", "ascending")])
    rows = [np.frombuffer(t, np.int32) for t in found["terms"].to_pylist()]
    return descend(rows, found["y"].to_numpy().astype(int), strong, bits=bits)


def _table_counts(held: DataFrame, wanted: np.ndarray | None) -> Counts:
    """Counts over the rows, or over those that hold a wanted bucket; summed per batch, then by bucket.

    Only buckets that stand out from chance come to the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, y = [np.frombuffer(t, np.int32) for t in pdf["terms"]], pdf["y"].to_numpy()
            if wanted is not None:
                near = holding(rows, wanted)
                rows, y = [r for r, n in zip(rows, near, strict=True) if n], y[near]
            c = counts_of(rows, y)
            yield pd.DataFrame({"bucket": np.append(c.bucket, -1), "p": np.append(c.with_positive, c.positive), "n": np.append(c.with_negative, c.negative)})

    sums = written(held.mapInPandas(lean(run), "bucket long, p long, n long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "counts")
    pos, neg = next(((int(r[1]), int(r[2])) for r in sums.filter("bucket < 0").collect()), (0, 0))

    def part(k: str, of: int, share: Column) -> Column:
        inside, outside = F.col(k), F.lit(of) - F.col(k)
        # null, and so not standing out, where one of the labels has no rows
        return F.when(inside > 0, inside * F.log(F.try_divide(inside, of * share))).otherwise(0.0) + F.when(outside > 0, outside * F.log(F.try_divide(outside, of * (1 - share)))).otherwise(0.0)

    share = (F.col("p") + F.col("n")) / F.lit(float(max(1, pos + neg)))
    ratio = 2 * (part("p", max(1, pos), share) + part("n", max(1, neg), share))
    strong = sums.filter((F.col("bucket") >= 0) & (F.col("p") + F.col("n") >= _FEWEST) & (F.coalesce(ratio, F.lit(0.0)) > (_CHANCE - 0.1) ** 2)).toArrow()
    bucket, p, n = (strong[c].to_numpy() for c in ("bucket", "p", "n"))
    return Counts(pos, neg, bucket.astype(np.int32), p, n)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample: int = 30_000, bits: int = 20, machine: Machine | None = None) -> DataFrame:
    """One row a document: id, held_out, score in 0 to 1, predicted (1 from 0.5 on).

    Whole texts are scored, and by their text alone; null and empty texts have
    the score of a text without terms.  Repeated rows give repeated results; a null
    id counts as the empty text when the held-out rows are drawn; other columns are ignored; an empty table
    gives no rows.
    """
    machine = machine or train(docs, labels, id_col, text_col, label_col, sample=sample, bits=bits)
    source = docs.select(held_id(docs, id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = shared.value.scorer()
        for pdf in batches:
            s = np.array([score(t) for t in pdf["text"]], dtype=float)
            yield pd.DataFrame({"id": pdf["id"], "held_out": pdf["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    out = source.mapInPandas(lean(run), f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumn("id", given_id(out)).withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample: int = 30_000, bits: int = 20, machine: Machine | None = None) -> DataFrame:
    """The rows of ``docs`` whose text the machine does not predict toxic; all columns stay, and nothing is shuffled.

    Each row is decided by its own text, so null, shared and repeated ids make no difference.
    """
    machine = machine or train(docs, labels, id_col, text_col, label_col, sample=sample, bits=bits)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
