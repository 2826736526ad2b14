"""A Merkle manifest of a table: a tree of digests a group, and one over the groups.

Leaves are numbered from a written range partitioning and the counts of its parts, so that no
group is ever in one task.  The trees are built bottom-up: every ``fan`` consecutive nodes
are one run, and each level's runs are a written table.  Proofs go top-down: a level's runs are joined to
their parents, and each child puts its siblings before the proof that its parent passes on.

Digests are SHA-256 and are concatenated as lowercase hex; the tables hold them as 32 bytes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealscope.llm.shared import written

#: Up to so many (part, group) counts are broadcast when leaves are numbered; beyond it the rows are shuffled to them.
BROADCAST_COUNTS = 100_000
#: An inner row number takes the low bits of monotonically_increasing_id, the partition the others.
_ROW_BITS = 33


def _empty() -> Column:
    return F.lit(bytearray(b""))


def leaf_digest(*values: Column) -> Column:
    """32 bytes: the digest of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value; whole numbers are decimal."""
    texts = (v.cast("string") for v in values)
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def node_digest(digests: Column) -> Column:
    """32 bytes: the digest of concatenated digests, taken as hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def folded(leaf: Column, steps: Column) -> Column:
    """The root, 32 bytes, that a leaf and the steps of a proof lead to."""
    return F.aggregate(steps, leaf, lambda digest, s: node_digest(F.concat(s["left"], digest, s["right"])))


def proof_digest(steps: Column) -> Column:
    """32 bytes: the digest of all siblings of a proof, level by level and from left to right."""
    return node_digest(F.aggregate(steps, _empty(), lambda held, s: F.concat(held, s["left"], s["right"])))


@dataclass
class Tree:
    """``nodes`` (group, pos, size, digest, items) and, level by level, their runs: group, pos of the parent, size of the level, digests, items."""

    nodes: DataFrame
    levels: list[DataFrame]
    fan: int

    def roots(self, level: int) -> DataFrame:
        """(group, digest) of the groups that one node of this level holds whole."""
        if level == 0:
            return self.nodes.filter("size = 1").select("group", "digest")
        return self.levels[level - 1].filter(F.col("size") <= self.fan).select("group", node_digest(F.col("digests")).alias("digest"))

    def all_roots(self) -> DataFrame:
        out = self.roots(0)
        for k in range(1, len(self.levels) + 1):
            out = out.unionByName(self.roots(k))
        return out

    def pushed(self, given: DataFrame) -> DataFrame:
        """(group, digest, item, steps, *columns of given): every node with its way up; ``given`` has (group, steps, ...) for the root of each group."""
        more = [c for c in given.columns if c not in ("group", "steps")]
        columns = ["group", "pos", "digest", "item", "steps", *more]
        nothing = self.nodes.select("item").schema["item"].dataType

        def start(level: int) -> DataFrame:
            rows = self.nodes.filter("size = 1").select("group", "digest", "item") if level == 0 else self.roots(level).withColumn("item", F.lit(None).cast(nothing))
            return rows.withColumn("pos", F.lit(0).cast("long")).join(given, "group").select(columns)

        state = start(len(self.levels))
        for level in range(len(self.levels), 0, -1):
            runs = self.levels[level - 1].join(state.select("group", "pos", "steps", *more), ["group", "pos"])
            inside = F.posexplode("items") if level == 1 else F.posexplode(F.array_repeat(F.lit(None).cast(nothing), (F.octet_length("digests") / 32).cast("int")))
            runs = runs.select("*", inside.alias("__at", "item"))
            own = F.struct(F.expr("substring(digests, 1, 32 * __at)").alias("left"), F.expr("substring(digests, 32 * __at + 33)").alias("right"))
            child = runs.withColumns({"steps": F.concat(F.array(own), F.col("steps")), "digest": F.expr("substring(digests, 32 * __at + 1, 32)"), "pos": F.col("pos") * self.fan + F.col("__at")})
            state = child.select(columns).unionByName(start(level - 1))
        return state


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, in their ``group``, by ``order``) and ``size`` of the group.

    Rows are range-partitioned by group and order and written; a row's place is its place in
    its part plus the group's rows in the parts before.
    """
    by = ["group", *order]
    held = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__seq", F.monotonically_increasing_id()), "sorted")
    held = held.withColumns({"__part": F.shiftright("__seq", _ROW_BITS), "__at": F.col("__seq").bitwiseAND((1 << _ROW_BITS) - 1)})
    counts = held.groupBy("__part", "group").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy("group")  # a group has a row a part here
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.select("__part", "group", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("size")), "counts")
    small = counts.limit(BROADCAST_COUNTS + 1).count() <= BROADCAST_COUNTS
    joined = held.join(F.broadcast(counts) if small else counts.hint("merge"), ["__part", "group"])
    return joined.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__seq", "__shift")


def grown(nodes: DataFrame, fan: int) -> Tree:
    """The tree over numbered ``nodes`` (group, pos, size, digest, item), level by level, each level written."""
    nodes = written(nodes, "nodes")
    most = nodes.agg(F.max("size")).first()[0] or 0
    levels: list[DataFrame] = []
    below, keep = nodes, ["item"]
    while most > 1:
        run = F.array_sort(F.collect_list(F.struct("pos", "digest", *keep)))
        runs = below.filter("size > 1").groupBy("group", F.expr(f"pos div {fan}").alias("pos")).agg(F.first("size").alias("size"), run.alias("__run"))
        items = [F.transform("__run", lambda x: x["item"]).alias("items")] if keep else []
        digests = F.aggregate("__run", _empty(), lambda held, x: F.concat(held, x["digest"]))
        levels.append(written(runs.select("group", "pos", "size", digests.alias("digests"), *items), "level"))
        below, keep = levels[-1].select("group", "pos", F.expr(f"(size + {fan - 1}) div {fan}").alias("size"), node_digest(F.col("digests")).alias("digest")), []
        most = -(-most // fan)
    return Tree(nodes, levels, fan)


@dataclass
class Manifest:
    """The groups' trees and the tree over their roots."""

    inner: Tree
    outer: Tree

    def root(self) -> bytes | None:
        """None for an empty table."""
        found = self.outer.all_roots().select("digest").first()
        return bytes(found[0]) if found else None

    def proofs(self) -> DataFrame:
        """(item, leaf, subroot, root, steps) for each row; digests have 32 bytes.

        ``item`` holds the row's id, group and carried columns; ``steps``, from the leaf to the root, the concatenated
        digests of its siblings to the left and to the right.
        """
        none = F.array().cast("array<struct<left: binary, right: binary>>")
        top = self.outer.all_roots().select("group", none.alias("steps"), F.col("digest").alias("root"))
        groups = self.outer.pushed(top).select(F.col("item").alias("group"), "steps", F.col("digest").alias("subroot"), "root")
        return self.inner.pushed(groups).select("item", F.col("digest").alias("leaf"), "subroot", "root", "steps")


def manifest(docs: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "lang", *, carry: dict[str, Column] | None = None, fan: int = 8) -> Manifest:
    """The manifest of ``docs`` with ``leaf`` (32 bytes) as each row's digest.

    In a group leaves ascend by id, null ids first, equal ids by their leaves; groups ascend
    as bytes of UTF-8, null first and apart from the empty text.  Repeated rows are leaves of their own.  ``carry``
    are further columns for ``proofs()``.  Whole texts are read once, for the leaves; other columns, whatever
    their names, are ignored.  An empty table has no root and gives no proofs.
    """
    if fan < 2:
        raise ValueError("a run has two nodes at least")
    item = F.struct(F.col(id_col).alias("id"), F.col(group_col).alias("group"), *[v.alias(k) for k, v in (carry or {}).items()])
    # a first letter keeps null apart and first
    group = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    # the number tells fully equal rows apart, so that they can lie in several parts
    leaves = written(docs.select(group.alias("group"), F.col(id_col).alias("__id"), leaf.alias("digest"), item.alias("item"), F.monotonically_increasing_id().alias("__row")), "leaves")
    inner = grown(numbered(leaves, ["__id", "digest", "__row"]).select("group", "pos", "size", "digest", "item"), fan)
    subroots = inner.all_roots().select(F.lit("").alias("group"), F.col("group").alias("item"), "digest")
    outer = grown(numbered(subroots, ["item"]).select("group", "pos", "size", "digest", "item"), fan)
    return Manifest(inner, outer)


def lowered(text: Column) -> Column:
    """``text`` with A-Z as a-z, and nothing else changed."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def tamper_report(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), every: int = 3, *, fan: int = 8) -> DataFrame:
    """Each row's proof checked against tampered texts: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows whose id's crc32 (of its decimal digits, unsigned) is a multiple of ``every`` have their text lower-cased
    (A-Z) before the check; the proof is folded from that leaf.  Rows without an id or text are never changed.
    All digests are lowercase hex.
    """
    own = {c: F.col(c) for c in fields}
    chosen = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    changed = F.when(chosen, leaf_digest(*(own | {text_col: lowered(F.col(text_col))}).values()))
    proofs = manifest(docs, leaf_digest(*own.values()), id_col, group_col, carry={"tampered": changed}, fan=fan).proofs()
    out = proofs.withColumns({"folded": folded(F.coalesce("item.tampered", "leaf"), F.col("steps")), "proof": proof_digest(F.col("steps"))})
    digests = {"leaf": "leaf", "subroot": "subroot", "root": "root", "proof": "proof_sha256", "folded": "folded_root"}
    return out.select(F.col("item.id").alias(id_col), *[F.lower(F.hex(k)).alias(v) for k, v in digests.items()], (F.col("folded") == F.col("root")).alias("verified"))
