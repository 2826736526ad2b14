"""MinHash near-duplicates by tensored banding, with every link confirmed on full sets.

Two collections of ``side`` half-bands hold ``rows`` minima each.  Table (i, j)
is keyed by half i of the first and half j of the second, so side * side tables
of 2 * rows minima need only 2 * side * rows minima: the square root of what
independent tables take.  Half-bands that no other text shares are dropped
before the products are formed.

A similarity of s meets in some table with probability
(1 - (1 - s**rows)**side)**2: 0.9998 at 0.85 for rows 3, side 10.

Confirmation is exact and does not form all pairs of a bucket:

* equal shingle sets are one node;
* a node's private shingles are those of no other candidate.  They lie outside
  every intersection and inside every union, so the counts of two nodes alone
  rule out most pairs that cannot reach the threshold;
* a bucket is first a star around its member with the smallest private share;
* only members outside the bucket's largest component are then compared with
  its members of other components.  For those the private shingles are counted
  anew: now all that occur in the node's own component alone, and a node that keeps
  too few others meets nobody.  Members meet by size bands as wide as the threshold
  allows, large buckets in salted parts, and a pair is formed in the first table
  that it shares, not in each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.llm import shingles as S
from dealscope.llm.components import components
from dealscope.llm.shared import given_id, held_id, lean, look_up, text_sha256, written

#: Members of a bucket, or pairs of a node, that one task meets at most.
PART = 2048


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = 5,
    percent: int = 80,
    rows: int = 3,
    side: int = 10,
    seed: int = 1,
    with_digest: bool = False,
) -> DataFrame:
    """One row a document: id, n_shingles, component_id, kept.

    With ``with_digest`` also text_sha256, and component: a key of the component that is
    there for null and shared ids too, and null for an empty set.

    Two documents are linked when 100 * |intersection| >= percent * |union| of
    their sets of distinct shingles.  Null and empty texts and texts without
    words have an empty set and no links.  Ties: component_id is the smallest id
    reachable.  Repeated rows give repeated results.  A row whose id is null links its
    neighbours like any other; its component_id is the smallest id of the others,
    or null where none of them has an id.  Other columns are ignored.  An empty
    table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_key"))
    carried = ["text_sha256"] if with_digest else []
    signed = written(_signatures(source.withColumn("text_sha256", text_sha256("text")) if with_digest else source, shingle, rows, side, seed), "signed")
    nodes = written(
        signed.filter("n_shingles > 0").groupBy("node").agg(F.min("id").alias("id"), F.max(F.struct("id", "text_key")).alias("one"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves"), F.count("*").alias("copies")),
        "nodes",
    )
    n_nodes, n_rows = nodes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    sides = written(_shared_halves(nodes, side, n_nodes), "sides")
    sets = written(_candidate_sets(source, nodes.join(sides.select("node"), "node", "left_semi").select("one.*"), shingle), "sets")
    live = written(_private_counts(sets).filter(100 * F.col("private") <= (100 - percent) * F.col("n")), "live")
    tables = written(_tables(sides.join(live, "node")), "tables")

    centres = written(tables.groupBy("table").agg(F.min(F.struct((F.col("private") / F.col("n")).alias("share"), "node", "n", "private")).alias("c"), F.count("*").alias("size")).filter("size > 1"), "centres")
    met = written(look_up(tables, centres, "table", "size", tables.count()).select("table", "node", "n", "private", "i", "j", "c"), "met")
    star = met.select(F.col("c.node").alias("a"), F.col("node").alias("b"), F.col("c.n").alias("na"), F.col("n").alias("nb"), F.col("c.private").alias("pa"), F.col("private").alias("pb"))
    labels = components(_confirmed(_possible(star, percent), sets, percent))

    # labels are told apart by a hash of 64 bits here
    labelled = written(met.join(labels, "node", "left").select("table", "node", "n", "i", "j", F.xxhash64(F.coalesce("label", "node")).alias("label")), "labelled")
    several = labelled.groupBy("table").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("table")
    open_ = written(labelled.join(several, "table", "left_semi"), "open")
    if not open_.isEmpty():
        crossing = written(_confirmed(_possible(_across(open_, nodes, sets, side, percent), percent), sets, percent, crowded="ab"), "links")
        of_a, of_b = (labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")) for end in "ab")
        crossing = crossing.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        over = written(components(crossing).select(F.col("node").alias("label"), F.col("label").alias("top")), "over")
        alone = over.select(F.col("label").alias("node"), "label").join(labels.select("node"), "node", "left_anti")
        labels = labels.unionByName(alone).join(over, "label", "left").select("node", F.coalesce("top", "label").alias("label"))

    linked = written(labels.join(nodes.select("node", "id"), "node"), "linked")
    lowest = written(linked.groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("size")), "lowest")
    of_node = look_up(linked.drop("id"), lowest, "label", "size", linked.count()).select("node", "label", "component_id")
    # nodes of one document that nothing links are their own component and need no look-up
    several_rows = nodes.join(of_node, "node", "left").filter("copies > 1 or label is not null")
    known = written(several_rows.select("node", "copies", F.coalesce("component_id", F.when(F.col("label").isNull(), F.col("id"))).alias("component_id"), F.coalesce("label", "node").alias("component")), "known")
    full = signed.filter("n_shingles > 0").select("id", "n_shingles", "node", *carried)
    found = look_up(full, known, "node", "copies", n_rows, "left")
    component_id = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    out = found.select("id", "n_shingles", component_id, *carried, F.coalesce("component", "node").alias("component"))
    none = signed.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"), *carried, F.lit(None).cast("binary").alias("component"))
    kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    return out.unionByName(none).select(F.col("id").alias(id_col), "n_shingles", "component_id", kept, *carried, *(["component"] if with_digest else []))


def _signatures(source: DataFrame, shingle: int, rows: int, side: int, seed: int) -> DataFrame:
    kind = source.schema["id"].dataType.simpleString()
    carried = [c for c in source.columns if c == "text_sha256"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        muls = S.multipliers(2 * side * rows, seed)
        fold = S.multipliers(rows, seed + 1)
        for pdf in batches:
            for part in _slices(pdf):
                values, counts = S.shingle_sets(part["text"].tolist(), shingle)
                low = S.minhash(values, counts, muls).reshape(len(counts), 2 * side, rows)
                halves = S.mix64((low * fold).sum(axis=2, dtype=np.uint64)).view(np.int64)
                raw, ends = values.tobytes(), np.cumsum(counts) * 8
                nodes = [hashlib.blake2b(raw[e - 8 * c : e], digest_size=16).digest() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pd.DataFrame({"id": part["id"], "text_key": part["text_key"], "n_shingles": counts.astype(np.int64), "node": nodes, "halves": list(halves), **{c: part[c] for c in carried}})

    out = source.withColumn("id", held_id(source, "id")).mapInPandas(lean(run), f"id {kind}, text_key long, n_shingles long, node binary, halves array<long>" + "".join(f", {c} string" for c in carried))
    return out.withColumn("id", given_id(out))


def _slices(pdf: pd.DataFrame, most_chars: int = 500_000) -> Iterator[pd.DataFrame]:
    """Runs of rows of bounded total length, so that long texts do not pile up; no row is cut."""
    run = (pdf["text"].str.len().fillna(0).cumsum() // most_chars).to_numpy()
    for a in np.unique(run):
        yield pdf[run == a]


def _shared_halves(nodes: DataFrame, side: int, n_nodes: int) -> DataFrame:
    """(node, left, right): the half-bands (pos, key) that a node shares with others, where it shares some of either collection."""
    halves = nodes.select("node", F.posexplode("halves").alias("pos", "half")).select("node", "pos", F.xxhash64("pos", "half").alias("key"))
    shared = written(halves.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "shared")
    both = look_up(halves, shared, "key", "size", n_nodes * 2 * side)
    sides = both.groupBy("node").agg(
        F.collect_list(F.when(F.col("pos") < side, F.struct("pos", "key"))).alias("left"), F.collect_list(F.when(F.col("pos") >= side, F.struct("pos", "key"))).alias("right")
    )
    return sides.filter((F.size("left") > 0) & (F.size("right") > 0))


def _tables(sides: DataFrame) -> DataFrame:
    """(table, node, n, private, i, j): every product of a node's halves, as one hash each."""
    product = sides.select("node", "n", "private", F.explode("left").alias("l"), "right").select("node", "n", "private", "l", F.explode("right").alias("r"))
    return product.select(F.xxhash64("l.key", "r.key").alias("table"), "node", "n", "private", F.col("l.pos").cast("tinyint").alias("i"), F.col("r.pos").cast("tinyint").alias("j"))


def _bitmap(keys: DataFrame, most_bits: int = 27) -> np.ndarray:
    """A bit for each key modulo a power of two, set where ``keys`` (key) has it; at most 2 ** ``most_bits`` bits, whatever their number.

    The words are put together on the executors.
    """
    bits = max(10, min(most_bits, (16 * keys.count()).bit_length()))
    at = keys.select(F.col("key").bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(cast(1 as bigint), cast(at & 63 as int)))").alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    return out


def _candidate_sets(source: DataFrame, one: DataFrame, shingle: int) -> DataFrame:
    """(node, k, shingles) of the candidates, each from one of its texts, null ids too; k numbers them.

    ``one`` has the id and text_key of a row of each.  Rows are picked where they are read, by a bitmap of
    bounded size, so no text is shuffled; rows that it lets through without need do no harm.
    """
    bitmap = source.sparkSession.sparkContext.broadcast(_bitmap(one.select(F.xxhash64("id", "text_key").alias("key"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = bitmap.value
        last = np.uint64(64 * len(held) - 1)
        for pdf in batches:
            at = pdf["key"].to_numpy().view(np.uint64) & last
            picked = pdf[(held[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
            for part in _slices(picked):
                values, counts = S.shingle_sets(part["text"].tolist(), shingle)
                ends = np.cumsum(counts).tolist()
                sets = [values[e - c : e] for e, c in zip(ends, counts.tolist(), strict=True)]
                nodes = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in sets]
                yield pd.DataFrame({"node": nodes, "shingles": [v.view(np.int64) for v in sets]})

    found = source.select(F.xxhash64("id", "text_key").alias("key"), "text").mapInPandas(lean(run), "node binary, shingles array<long>")
    # rows that share an id and a text are one node still
    return found.filter(F.size("shingles") > 0).groupBy("node").agg(F.first("shingles").alias("shingles")).withColumn("k", F.monotonically_increasing_id())


def _private_counts(sets: DataFrame) -> DataFrame:
    """(node, n, private): sizes, and how many shingles no other candidate has."""
    alone = sets.select("k", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("k").alias("k")).filter("c = 1")
    private = alone.groupBy("k").agg(F.count("*").alias("private"))
    return sets.select("node", "k", F.size("shingles").cast("long").alias("n")).join(private, "k", "left").fillna(0, ["private"]).drop("k")


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs that sizes and private counts do not rule out."""
    inter = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    union = F.greatest(F.col("na") + F.col("pb"), F.col("nb") + F.col("pa"))
    return pairs.filter((F.col("a") != F.col("b")) & (100 * inter >= percent * union)).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, crowded: str = "a") -> DataFrame:
    """The pairs whose full sets reach the threshold.

    An end named in ``crowded`` may have many pairs, like the centre of a large bucket; then it is
    dealt into parts that each get its set.
    """
    joined = pairs = written(pairs, "pairs")
    for end in "ab":
        held = sets.select(F.col("node").alias(end), F.col("shingles").alias(f"s{end}"))
        on = [end]
        if end in crowded:
            parts = written(pairs.groupBy(end).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).filter("parts > 1"), "parts")
            if not parts.isEmpty():
                on = [end, "part"]
                dealt = F.coalesce("parts", F.lit(1))
                held = held.join(parts, end, "left").withColumn("part", F.explode(F.sequence(F.lit(0), dealt - 1))).drop("parts")
                joined = joined.join(parts, end, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), dealt).cast("int")).drop("parts")
        joined = joined.join(held, on).drop("part")
    return joined.withColumn("i", F.size(F.array_intersect("sa", "sb"))).filter(linked(F.col("i"), F.size("sa"), F.size("sb"), percent)).select("a", "b")


def linked(inter: Column, na: Column, nb: Column, percent: int) -> Column:
    return 100 * inter >= percent * (na + nb - inter)


def _across(open_: DataFrame, nodes: DataFrame, sets: DataFrame, side: int, percent: int) -> DataFrame:
    """Pairs of a bucket in different components, one end outside its largest component; each in its first bucket.

    ``open_`` has the members (table, node, n, i, j, label) of buckets with several components.
    """
    who = open_.select("node", "label").distinct()
    # linked across, a node has percent of its own shingles in other components
    able = _own_counts(sets.join(who, "node")).filter(100 * (F.col("n") - F.col("private")) >= percent * F.col("n")).select("node", "private")
    able = written(able.join(nodes.select("node", "halves"), "node"), "able")
    members = written(open_.join(able, "node"), "members")
    parts = members.groupBy("table", "label").agg(F.count("*").alias("size"))
    main = parts.groupBy("table").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.sum("size").alias("members"), F.count("*").alias("labels")).filter("labels > 1")
    main = written(main.select("table", "main", F.ceil(F.col("members") / PART).cast("int").alias("parts")), "main")
    # sizes of a linked pair differ by percent at most: by one band
    width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    held = members.join(main, "table").withColumn("band", F.floor(F.log("n") / F.lit(width)))
    columns = {"id": "node", "n": "n", "p": "private", "l": "label", "h": "halves"}
    minor = held.filter("label <> main").select("table", "i", "j", *[F.col(c).alias(f"{k}a") for k, c in columns.items()], F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"), "parts").withColumnRenamed("ida", "a")
    minor = minor.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    any_ = held.select("table", "band", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), *[F.col(c).alias(f"{k}b") for k, c in columns.items()]).withColumnRenamed("idb", "b")
    first = F.lit(True)
    for k in range(2 * side):
        before = (F.col("i") > k) if k < side else (F.col("j") > k)
        first = first & ~(before & (F.col("ha")[k] == F.col("hb")[k]))
    return minor.join(any_, ["table", "band", "part"]).filter((F.col("la") != F.col("lb")) & first)


def _own_counts(labelled_sets: DataFrame) -> DataFrame:
    """(node, n, private): sizes, and how many shingles no node of another label has."""
    spread = written(labelled_sets.select("k", F.col("label").alias("l"), F.explode("shingles").alias("s")), "spread")
    own = written(spread.groupBy("s").agg(F.min("l").alias("low"), F.max("l").alias("high"), F.count("*").alias("times")).filter("low = high").select("s", "times"), "own")
    private = look_up(spread.select("k", "s"), own, "s", "times", spread.count()).groupBy("k").agg(F.count("*").alias("private"))
    return labelled_sets.select("node", "k", F.size("shingles").cast("long").alias("n")).join(private, "k", "left").fillna(0, ["private"]).drop("k")
