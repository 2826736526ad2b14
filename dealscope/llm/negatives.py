"""Hard-negative mining by distributed radix selection.

A window is an anchor with a range of scores and a kind of rows: those of the anchor's label, or of any other.
Anchors meet all rows block by block, as matrix products.  For each open window a pass counts
the scores of each of its range's 2^bits equal parts; the counts are summed over the blocks, the part that holds the k-th
best score becomes the window's range, and the next pass refines it.  Once few scores are
left, one last pass gathers the rows from the window's threshold on.  Only counts and those rows are shuffled.
Tables here are much larger than their files, by whose size Spark picks broadcasts, so every join is a merge join: none goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealscope.llm.shared import lean, written

#: Scores beyond this, either way, count as this.
MOST = 1 << 61
#: Whole numbers up to here are exact as double.
_EXACT = 1 << 53
_LARGEST = float(np.finfo(float).max)
#: A window is closed once it has at most so many rows more than are wanted.
_SLACK = 32
#: Histograms of so many anchor blocks are held by a task before it passes them on.
_HELD_BLOCKS = 64
#: Blocks are dealt to so many tasks at most.
_MOST_PARTS = 2000


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) of each component, as double."""

    def one(x: Column) -> Column:
        v = x.cast("double") * 256
        # floor() gives a long, which does not hold the largest values; those are whole already
        return F.when(F.abs(v) < float(_EXACT), F.floor(v).cast("double")).otherwise(F.greatest(F.least(v, F.lit(_LARGEST)), F.lit(-_LARGEST)))

    return F.transform(vector, one)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact; missing components count as 0, sums beyond MOST as MOST."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    bound = d * float(np.abs(a).max()) * float(np.abs(b).max())
    if bound < _EXACT:
        return a @ b.T
    if bound < MOST:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


def _packed(rows: DataFrame, per_block: int, n: int) -> DataFrame:
    """Rows (row, id, label, q) dealt into blocks of about ``per_block``: block, row, id, label as arrays and q as one matrix."""
    blocks = max(1, -(-n // per_block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = max(map(len, pdf["q"]))
        q = np.zeros((len(pdf), wide))
        for k, v in enumerate(pdf["q"]):
            q[k, : len(v)] = v
        # null ids come last where scores tie
        missing = pdf["missing"].to_numpy()
        one = {"block": pdf["block"].iloc[0], "row": pdf["row"].to_numpy().tobytes(), "id": pdf["id"].to_numpy().astype(np.int64).tobytes(), "missing": missing.tobytes(), "label": pdf["label"].to_numpy().astype(np.int64).tobytes(), "q": q.tobytes()}
        return pd.DataFrame([one])

    plain = dealt.select("block", "row", F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.col("id").isNull().alias("missing"), F.col("label").cast("long").alias("label"), "q")
    return plain.groupBy("block").applyInPandas(pack, "block int, row binary, id binary, missing binary, label binary, q binary")


_OF_BLOCK = ("row", "id", "missing", "label", "q")
_OF_WINDOW = ("row", "number", "same", "low", "high")


class _Block:
    def __init__(self, r: dict, side: str):
        self.row, self.id, self.label = (np.frombuffer(r[f"{side}_{c}"], np.int64) for c in ("row", "id", "label"))
        self.missing = np.frombuffer(r[f"{side}_missing"], np.bool_)
        self.q = np.frombuffer(r[f"{side}_q"], np.float64).reshape(len(self.row), -1)


def _met(anchors: DataFrame, blocks: DataFrame, n_blocks: int, windows: DataFrame) -> DataFrame:
    """Each anchor block with open windows, as arrays, beside each block of rows."""
    own = windows.groupBy("block").agg(F.collect_list(F.struct(*_OF_WINDOW)).alias("w"))
    own = own.select("block", *[F.col(f"w.{c}").alias(f"w_{c}") for c in _OF_WINDOW])
    a = anchors.join(own.hint("merge"), "block").select(F.col("block").alias("a_block"), *[F.col(c).alias(f"a_{c}") for c in _OF_BLOCK], *[f"w_{c}" for c in _OF_WINDOW])
    # each block of rows is sent once, the anchors once for each of them
    a = a.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    # products take long for their bytes: a number of partitions of their own keeps blocks from being put together by size
    parts = min(_MOST_PARTS, 2 * n_blocks)
    b = blocks.select("block", *[F.col(c).alias(f"b_{c}") for c in _OF_BLOCK]).repartition(parts, "block")
    return a.repartition(parts, "block").join(b.hint("merge"), "block")


def _pairs(pdf: pd.DataFrame) -> Iterator[tuple]:
    """For each joined row, each anchor and kind of rows: the anchor block, the anchor, its windows (number, low, high), the rows, and the places and scores of those of that kind."""
    for r in pdf.to_dict("records"):
        a, b = _Block(r, "a"), _Block(r, "b")
        s = scores(a.q, b.q)
        at = {row: k for k, row in enumerate(a.row.tolist())}
        of: dict[tuple[int, bool], list[tuple[int, int, int]]] = {}
        for row, number, same, low, high in zip(*(r[f"w_{c}"].tolist() for c in _OF_WINDOW), strict=True):
            of.setdefault((row, same), []).append((number, low, high))
        for (row, same), own in of.items():
            k = at[row]
            fits = np.flatnonzero((b.label == a.label[k]) & (b.row != row) if same else b.label != a.label[k])
            yield r["a_block"], row, own, b, fits, s[k, fits]


def _shift(low: int, high: int, bits: int) -> int:
    return max(0, (high - low).bit_length() - bits)


def _histograms(met: DataFrame, bits: int) -> DataFrame:
    """(row, number, counts h0.. of the 2^bits parts of the window's range), one row a window and task or group of blocks."""
    parts = 1 << bits
    columns = [f"h{k}" for k in range(parts)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, dict[tuple[int, int], np.ndarray]] = {}

        def out() -> Iterator[pd.DataFrame]:
            keys = [k for of in held.values() for k in of]
            if keys:
                counts = np.array([h for of in held.values() for h in of.values()], dtype=np.int64)
                yield pd.DataFrame({"row": [k[0] for k in keys], "number": [k[1] for k in keys]} | {c: counts[:, k] for k, c in enumerate(columns)})
            held.clear()

        for pdf in batches:
            for a_block, row, own, _, _, s in _pairs(pdf):
                if a_block not in held and len(held) >= _HELD_BLOCKS:
                    yield from out()
                of = held.setdefault(a_block, {})
                # of later passes' narrow ranges few scores are left to sort
                ordered = np.sort(s[(s >= min(w[1] for w in own)) & (s <= max(w[2] for w in own))])
                for number, low, high in own:
                    step = 1 << _shift(low, high, bits)
                    edges = np.array([min(low + k * step, high + 1) for k in range(parts + 1)], dtype=ordered.dtype)
                    counts = np.diff(np.searchsorted(ordered, edges))
                    key = (row, number)
                    of[key] = of[key] + counts if key in of else counts
        yield from out()

    return met.mapInPandas(lean(run), ", ".join(["row long, number int", *(f"{c} long" for c in columns)])).groupBy("row", "number").agg(*[F.sum(c).alias(c) for c in columns])


def _narrowed(windows: DataFrame, sums: DataFrame, k: int, bits: int) -> DataFrame:
    """Windows with the part of their range that holds the k-th best score; ``open`` while that has many rows and several scores.

    ``above`` counts the scores over the range, all of which are wanted.
    """
    parts = 1 << bits
    joined = windows.join(sums.hint("merge"), ["row", "number"], "left")
    counts = F.array(*[F.coalesce(F.col(f"h{p}"), F.lit(0)) for p in range(parts)])
    joined = joined.withColumn("__h", counts).drop(*[f"h{p}" for p in range(parts)])
    # from the best part down: how many scores are there before this part's
    over = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.aggregate(F.slice("__h", p + 2, parts), F.lit(0).cast("long"), lambda t, x: t + x))
    joined = joined.withColumn("__over", over)
    reached = F.filter(F.sequence(F.lit(parts - 1), F.lit(0), F.lit(-1)), lambda p: F.col("above") + F.element_at("__over", p + 1) + F.element_at("__h", p + 1) >= k)
    joined = joined.withColumn("__p", F.element_at(F.concat(reached, F.array(F.lit(-1))), 1))
    shift = F.greatest(F.lit(0), F.length(F.bin(F.col("high") - F.col("low"))) - bits)
    step = F.when(F.col("high") > F.col("low"), F.call_function("shiftleft", F.lit(1).cast("long"), shift.cast("int"))).otherwise(F.lit(1).cast("long"))
    part_low = F.col("low") + F.col("__p") * step
    inside = F.element_at("__h", F.col("__p") + 1)
    found = F.col("__p") >= 0
    out = joined.select(
        "block", "row", "number", "same", "top",
        F.when(found, part_low).otherwise(F.col("low")).alias("low"),
        F.when(found, F.least(part_low + step - 1, F.col("high"))).otherwise(F.col("high")).alias("high"),
        F.when(found, F.col("above") + F.element_at("__over", F.col("__p") + 1)).otherwise(F.col("above")).alias("above"),
        # without a k-th score every row is wanted, and the window's own low end is the threshold
        F.when(found, inside).otherwise(F.lit(0)).alias("inside"),
    )
    return out.withColumn("open", (F.col("low") < F.col("high")) & (F.col("above") + F.col("inside") > k + _SLACK))


def select_best(anchors: DataFrame, blocks: DataFrame, n_blocks: int, windows: DataFrame, k: int, *, bits: int = 4) -> DataFrame:
    """(row, number, rank, id, score): of each window's rows the first k, by descending score, ties by smaller id, null ids last.

    ``windows`` has block and row of the anchor, a number, same (rows of the anchor's label but the anchor, or of other labels),
    low and high (whole scores, both included).
    """
    state = written(windows.select("block", "row", "number", "same", F.col("high").alias("top"), "low", "high", F.lit(0).cast("long").alias("above"), F.lit(0).cast("long").alias("inside"), F.lit(True).alias("open")), "windows")
    closed = state.filter(~F.col("open"))
    for _ in range(64):
        opened = state.filter("open")
        if opened.isEmpty():
            break
        now = _narrowed(opened, _histograms(_met(anchors, blocks, n_blocks, opened), bits), k, bits)
        state = written(now, "windows")
        closed = closed.unionByName(state.filter(~F.col("open")))
    thresholds = closed.select("block", "row", "number", "same", "low", F.col("top").alias("high"))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[pd.DataFrame] = []
            for _, row, own, b, fits, s in _pairs(pdf):
                for number, low, high in own:
                    keep = np.flatnonzero((s >= low) & (s <= high))
                    # of one block no more than k rows can be among the first k
                    keep = keep[np.lexsort((b.id[fits[keep]], b.missing[fits[keep]], -s[keep]))[:k]]
                    ids = pd.arrays.IntegerArray(b.id[fits[keep]], b.missing[fits[keep]])
                    out.append(pd.DataFrame({"row": row, "number": number, "id": ids, "score": s[keep].astype(np.int64)}))
            yield from ([pd.concat(out)] if out else [])

    found = _met(anchors, blocks, n_blocks, thresholds).mapInPandas(lean(gather), "row long, number int, id long, score long")
    order = Window.partitionBy("row", "number").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, bits: int = 4, per_block: int = 4096, anchors_per_block: int = 512) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor, positive and negative.

    Components become floor(256 x); scores are whole inner products, shorter vectors filled up with 0, sums beyond 2^61 cut to it.
    An anchor's ``positives`` are its best other rows of the same label, ties by smaller id; a
    positive's ``negatives`` the best rows of other labels whose score is from ``low_percent`` to ``high_percent`` of the
    positive's.  Rows with a null label, vector or component, or one that is not finite, take no part.  Repeated rows are
    rows of their own, anchors included; null ids come last in ties and are no anchors unless ``anchor`` says so.  Other columns are ignored.
    An empty table, a label with one row, or windows without rows give no rows.  No row is left out and no number of candidates is capped.
    """
    x = F.col(vector_col)
    ok = F.col(label_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    usable = rows.filter(F.coalesce(ok, F.lit(False))).select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), whole_numbers(x).alias("q"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    usable = written(usable.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_anchors, norm = usable.agg(F.count("*"), F.count_if("anchor"), F.max(F.aggregate("q", F.lit(0.0), lambda t, v: t + v * v))).first()
    blocks = written(_packed(usable, per_block, n), "blocks")
    n_blocks = max(1, -(-n // per_block))
    anchors = written(_packed(usable.filter("anchor"), anchors_per_block, n_anchors), "anchors")
    # no score is beyond the largest squared length
    most = int(min(float(MOST), (norm or 0.0) * (1 + 1e-9) + 1))
    a_blocks = max(1, -(-n_anchors // anchors_per_block))
    own = usable.filter("anchor").select(F.pmod(F.xxhash64("row"), F.lit(a_blocks)).cast("int").alias("block"), "row", F.col("id").alias("anchor_id"))
    whole = own.select("block", "row", F.lit(0).alias("number"), F.lit(True).alias("same"), F.lit(-most).cast("long").alias("low"), F.lit(most).cast("long").alias("high"))
    best = written(select_best(anchors, blocks, n_blocks, whole, positives, bits=bits), "positives")
    # percentages without large products: s * p div 100, floor and ceiling
    score = F.col("score")
    floor_high = F.expr(f"score div 100 * {high_percent} + (score % 100) * {high_percent} div 100")
    ceil_low = F.expr(f"score div 100 * {low_percent} + ((score % 100) * {low_percent} + 99) div 100")
    windows = best.join(own.hint("merge"), "row").select("block", "row", F.col("rank").alias("number"), F.lit(False).alias("same"), ceil_low.alias("low"), floor_high.alias("high"), "score")
    # a window of a score below 0 is empty
    windows = windows.filter("score >= 0 and low <= high").drop("score")
    found = select_best(anchors, blocks, n_blocks, windows, negatives, bits=bits).select("row", "number", "rank", F.col("id").alias("negative_id"), score.alias("negative_score"))
    pairs = best.join(own.select("row", "anchor_id").hint("merge"), "row").select("row", F.col("rank").alias("number"), "anchor_id", F.col("id").alias("positive_id"), score.alias("positive_score"))
    return found.join(pairs.hint("merge"), ["row", "number"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
