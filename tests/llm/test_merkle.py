import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from dealscope.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values))


def tree(digests, fan):
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H("".join(below[k : k + fan])) for k in range(0, len(below), fan)])
    return levels


def way(levels, i, fan):
    out = []
    for level in levels[:-1]:
        first = i // fan * fan
        run = level[first : first + fan]
        out.append(("".join(run[: i - first]), "".join(run[i - first + 1 :])))
        i //= fan
    return out


def brute(rows, fan):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for v in sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, leaf(v))):
        groups.setdefault(v[2], []).append(v)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([leaf(v) for v in groups[x]], fan) for x in langs}
    top = tree([trees[x][-1][0] for x in langs], fan)
    out = []
    for k, x in enumerate(langs):
        for i, v in enumerate(groups[x]):
            steps = way(trees[x], i, fan) + way(top, k, fan)
            changed = v[0] is not None and v[4] is not None and zlib.crc32(str(v[0]).encode()) % 3 == 0
            digest = leaf((*v[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in v[4]))) if changed else leaf(v)
            for a, b in steps:
                digest = H(a + digest + b)
            out.append((v[0], leaf(v), trees[x][-1][0], top[-1][0], H("".join(a + b for a, b in steps)), digest, digest == top[-1][0]))
    return sorted(out, key=str)


def report(docs, **options):
    return sorted(map(tuple, merkle.tamper_report(docs, **options).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    langs = ["en"] * 6 + ["fr", "de", "", None, "é", "日本"]
    rows = [(rng.choice([k, k, k, 7, None]), f"Text {k} ÄÉ" if k % 5 else rng.choice([None, "", "same"]), rng.choice(langs), rng.choice(["a", None]), rng.choice([k, None])) for k in range(150)]
    return rows + [rows[3]] * 5 + [(1000, "Alone", "xx", "a", 1)] + [(2000 + k, "x", f"l{k:02}", None, None) for k in range(20)]


@pytest.mark.parametrize("fan", [8, 2])
def test_proofs_equal_brute_force(spark, rows, fan):
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "doc_id as pos", "lang as group", "text as item", "n_chars as size").repartition(3)
    plain = [(i, source, lang, n, text) for i, text, lang, source, n in rows]
    want = brute(plain, fan)
    got = report(docs, fan=fan)
    assert got == want and 0 < sum(r[-1] for r in got) < len(got)


def test_counts_beyond_the_broadcast(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, DOCS)
    want = report(docs)
    monkeypatch.setattr(merkle, "BROADCAST_COUNTS", 1)
    assert report(docs) == want


def test_empty_table_single_row_and_long_texts(spark, no_docs, edge_docs):
    assert report(no_docs) == []
    assert merkle.manifest(no_docs, merkle.leaf_digest(F.col("doc_id"))).root() is None
    one = spark.createDataFrame([(4, "T", None, None, None)], DOCS)
    assert report(one) == brute([(4, None, None, None, "T")], 8)
    plain = [tuple(r) for r in edge_docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert report(edge_docs) == brute(plain, 8)


def test_a_changed_row_changes_the_root(spark, rows):
    def root(data):
        return merkle.manifest(spark.createDataFrame(data, DOCS), merkle.leaf_digest(F.col("doc_id"), F.col("text"))).root()

    first = root(rows)
    assert first == root(rows[::-1]) and first != root(rows[1:]) and len(first) == 32
