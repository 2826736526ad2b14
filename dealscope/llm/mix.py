"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each document is to be taken q times, q = target / size of its source.  The whole
part of q is certain; the fraction is rounded so that the words a source gives
stay what they are: two open documents pass words between each other, in a
random direction whose chances keep every expectation, until one of them is
wholly in or wholly out.  A fold over a block of documents leaves one open
document; those are folded again, level by level, until a source has one, which
is drawn.  So a source's words end within one document of its target.

Equal rows (same id, source and text) are first counted: of m such rows with
fraction f, floor(m * f) are taken once more for certain and one is open for the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealscope.llm.shared import look_up, no_clash, words, written


def _key(source: Column) -> Column:
    """A key of a source that is there for null too; null sorts last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target, rows) of the sources in ``sized`` (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes; no target is above ``most`` times its source's size,
    and what is over goes to the others by weight.  Places in the order come from a
    range partitioning and its partitions' counts.  The level, words a unit of weight,
    rises until no more sources are above their limit; each step is one aggregation.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")).withColumn("key", _key(F.col("source")).cast("binary"))
    parted = written(sums.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "sources")
    # a row a partition
    before = parted.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = written(parted.join(F.broadcast(before), "part").select("source", "source_size", "rows", weight.alias("weight"), (most * F.col("source_size")).cast("double").alias("limit")), "weighted")
    total = share * float(s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, full = 0.0, -1
    while True:
        over = F.col("limit") < level * F.col("weight")
        n, gone, open_ = s.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if not open_:
            level = float("inf")
            break
        if n == full:
            break
        level, full = (total - gone) / open_, n
    return s.select("source", "source_size", F.least(F.col("limit"), F.lit(level) * F.col("weight")).alias("target"), "rows")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 128,
    seed: int = 7,
) -> DataFrame:
    """One row a document: id, size, source_size, target, copies, taken.

    Size is the number of words; taken = size * copies, repeats counted, at most
    ``most`` (a whole number) times the size.  Documents without words are taken
    once.  Null texts have no words; null sources are a source of their own, the
    last.  Repeated rows are documents of their own; which of them is taken once more
    cannot be told.  Draws depend on ids, texts and ``seed`` alone, so reruns agree.
    Other columns are ignored.  An empty table gives no rows.
    """
    groups = _copies(docs, id_col, text_col, source_col, weights, share, most, block, seed)
    # equal rows are dealt out in two steps, so that no array grows with their number
    step = 1 << 16
    dealt = groups.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / step))))
    rows = dealt.withColumn("k", F.explode(F.sequence(F.col("b") * step + 1, F.least(F.col("rows"), (F.col("b") + 1) * step))))
    copies = (F.col("whole") + (F.col("k") <= F.col("extra")).cast("long")).alias("copies")
    return rows.select(F.col("id").alias(id_col), F.col("size").cast("long").alias("size"), "source_size", "target", copies).withColumn("taken", F.col("size") * F.col("copies"))


def _copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, most: float, block: int, seed: int) -> DataFrame:
    """(id, source, text_key, size, rows, source_size, target, whole, extra): of the rows of a group, ``extra`` are taken whole + 1 times, the others ``whole`` times."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("text_key"), words(F.col(text_col)).alias("size"))
    sized = written(sized.groupBy("id", "source", "text_key", "size").agg(F.count("*").alias("rows")), "sized")
    targets = written(source_targets(sized.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, share, most).withColumn("key", _key(F.col("source"))).withColumnRenamed("rows", "groups").drop("source"), "targets")
    joined = look_up(sized.withColumn("key", _key(F.col("source"))), targets, "key", "groups", sized.count())
    q = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    whole = F.floor(q + 1e-12)
    more = F.greatest(F.lit(0.0), (q - whole) * F.col("rows"))
    d = joined.withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(1)).withColumn("sure", F.when(F.col("size") > 0, F.floor(more + 1e-12)).otherwise(0))
    d = d.withColumn("open", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), more - F.col("sure")) * F.col("size")).otherwise(0.0))
    unit = F.struct("id", "source", "text_key", "size", "rows", "source_size", "target", "whole", "sure", F.col("open").alias("mass"))
    d = written(d.select("key", unit.alias("unit")), "units")
    level = d.filter("unit.mass > 0").select("key", F.xxhash64(F.lit(seed), "unit.id", "unit.size", "unit.text_key").alias("r"), "unit")
    done: list[DataFrame] = []
    depth = 0
    while True:
        counts = written(level.groupBy("key").agg(F.count("*").alias("units_here")), "counts")
        largest, total = counts.agg(F.max("units_here"), F.sum("units_here")).first()
        folded = written(_fold(look_up(level, counts, "key", "units_here", total or 0), block, seed + depth), "folded")
        done.append(folded.select(F.explode("closed").alias("u")).select("u.*", (F.col("u.mass") > 0).alias("in")))
        if (largest or 0) <= block:
            done.append(folded.select("open.*").withColumn("in", _uniform(F.lit(seed), F.lit("last"), "id", "size", "text_key") * F.col("size") < F.col("mass")))
            break
        level = folded.select("key", F.xxhash64(F.lit(seed + depth + 1), "open.id", "open.size", "open.text_key").alias("r"), F.col("open").alias("unit"))
        depth += 1
    out = d.filter("unit.mass <= 0").select("unit.*", F.lit(False).alias("in"))
    for part in done:
        out = out.unionByName(part)
    return out.select("id", "source", "text_key", "size", "rows", "source_size", "target", F.col("whole").cast("long").alias("whole"), (F.col("sure") + F.col("in").cast("long")).alias("extra"))


def _uniform(*cols: Column | str) -> Column:
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).cast("double")


def _fold(level: DataFrame, block: int, seed: int) -> DataFrame:
    """Per block of units: the units now in (mass = size) or out (mass = 0), and the open one.

    ``level`` has the units of each key and their number, units_here.  Small documents come
    last in a block, so that the open one is small.
    """
    parts = F.ceil(F.col("units_here") / block)
    blocks = level.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "r"), parts)).groupBy("key", "part")
    units = blocks.agg(F.array_sort(F.collect_list(F.struct((-F.col("unit.size")).alias("smaller"), "r", "unit"))).alias("units"))

    def step(acc: Column, item: Column) -> Column:
        a, b = acc["open"], item["unit"]
        # words that can pass b -> a, and a -> b
        up = F.least(a["size"] - a["mass"], b["mass"])
        down = F.least(a["mass"], b["size"] - b["mass"])
        raise_a = _uniform(F.lit(seed), a["id"], a["size"], b["id"], b["size"], item["r"]) * (up + down) < down
        moved = F.when(raise_a, up).otherwise(-down)
        pair = F.struct(a.alias("a"), b.alias("b"), moved.alias("moved"), raise_a.alias("raised"))
        # one pass through an array names the pair, so that nothing is worked out twice
        return F.transform(F.array(pair), lambda p: _settle(acc, p))[0]

    def _settle(acc: Column, p: Column) -> Column:
        a, b = p["a"], p["b"]
        am, bm = a["mass"] + p["moved"], b["mass"] - p["moved"]
        # which of the two is closed: the one whose limit stopped the passing
        a_closed = F.when(p["raised"], a["size"] - a["mass"] <= b["mass"]).otherwise(a["mass"] <= b["size"] - b["mass"])
        a_new = F.when(p["raised"], a["size"].cast("double")).otherwise(F.lit(0.0))
        b_new = F.when(p["raised"], F.lit(0.0)).otherwise(b["size"].cast("double"))
        closed = F.when(a_closed, a.withField("mass", a_new)).otherwise(b.withField("mass", b_new))
        open_ = F.when(a_closed, b.withField("mass", F.greatest(F.lit(0.0), F.least(bm, b["size"].cast("double"))))).otherwise(a.withField("mass", F.greatest(F.lit(0.0), F.least(am, a["size"].cast("double")))))
        return F.struct(F.concat(acc["closed"], F.array(closed)).alias("closed"), open_.alias("open"))

    start = F.struct(F.filter(F.transform(F.slice("units", 1, 1), lambda u: u["unit"]), lambda u: F.lit(False)).alias("closed"), F.col("units")[0]["unit"].alias("open"))
    folded = units.select("key", F.aggregate(F.slice("units", F.lit(2), F.greatest(F.size("units") - 1, F.lit(0))), start, step).alias("f"))
    return folded.select("key", "f.closed", "f.open")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, block: int = 128, seed: int = 7) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as :func:`mix` takes it, same columns.

    A row is known by id, source and text, null and shared ids included.
    """
    key, own, due = no_clash(docs, "mixed_key"), no_clash(docs, "mixed_own"), no_clash(docs, "mixed_due")

    def of(i: Column, source: Column, text: Column) -> Column:
        return F.concat_ws("/", F.hex(text), _key(i.cast("string")), _key(source))

    chosen = _copies(docs, id_col, text_col, source_col, weights, share, most, block, seed)
    chosen = chosen.select(of(F.col("id"), F.col("source"), F.col("text_key")).alias(own), "whole", "extra")
    picked = chosen.select(own, F.struct("whole", "extra").alias(due))
    joined = docs.withColumn(key, of(F.col(id_col), F.col(source_col), F.xxhash64(F.col(text_col)))).join(picked, F.col(key) == F.col(own))
    place = F.row_number().over(Window.partitionBy(key).orderBy(key))
    copies = F.col(due)["whole"] + (place <= F.col(due)["extra"]).cast("long")
    taken = joined.withColumn(own, copies).filter(F.col(own) > 0)
    return taken.withColumn(own, F.explode(F.array_repeat(F.lit(1), F.col(own).cast("int")))).select(*docs.columns)
