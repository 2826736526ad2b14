import collections
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from dealscope.llm import shared, toxicity
from dealscope.llm.bpe import read_ranks
from test_dedup import brute_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS)


def corpus(rng):
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(220):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 60))]
        if k % 9 == 4:
            words[:2] = ["vile", "curse"]
        rows.append((k, " ".join(words), rng.choice([None, "a", "b", "c"])))
    for k in range(220, 300):
        i, t, s = rows[rng.randrange(200)]
        words = t.split(" ")
        if k % 2 and len(words) > 30:
            words[-1] = "changed"
        rows.append((k, " ".join(words), rng.choice([s, "b"])))
    return rows + [(300, None, "a"), (301, "", None), (None, rows[5][1], "a"), (None, "only here and without an id " * 3, "a"), (7, rows[7][1], rows[7][2])]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's rows, as run() writes them, and the folder."""
    rows = corpus(random.Random(17))
    at = str(tmp_path_factory.mktemp("corpus"))
    table(spark, rows).repartition(4).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int("vile" in (t or ""))) for i, t, _ in rows if i is not None and i % 3]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    found = [sorted(map(tuple, docs.collect()), key=str)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = shared.written(stage(spark, docs, at), "stage")
        found.append(sorted(map(tuple, docs.collect()), key=str))
    return at, found


def test_toxic_rows_go_by_their_own_text(spark, stages):
    at, found = stages
    machine = toxicity.train(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    score = machine.scorer()
    assert found[1] == [r for r in found[0] if score(r[1]) < 0.5]
    left = [r for r in found[1] if "vile" in (r[1] or "")]
    assert len(left) <= 1 and len(found[0]) - len(found[1]) <= sum("vile" in (r[1] or "") for r in found[0])


def test_one_row_of_each_text_stays(stages):
    _, found = stages
    best = {}
    for r in found[1]:
        t = r[1] or ""
        if t not in best or (r[0] is not None and (best[t] is None or r[0] > best[t])):
            best[t] = r[0]
    assert collections.Counter((r[0], r[1] or "") for r in found[2]) == collections.Counter((i, t) for t, i in best.items())


def test_one_document_of_each_near_group_stays(stages):
    _, found = stages
    own = [(k if r[0] is None else r[0], r[1]) for k, r in enumerate(found[2], 10_000)]
    label = brute_components(own, 80)
    assert collections.Counter(r[0] for r in found[3]) == collections.Counter(r[0] for (i, _), r in zip(own, found[2], strict=True) if label[i][1] == i)


def test_the_mix_takes_what_each_source_is_due(stages):
    from test_text import plain_targets

    _, found = stages
    size = lambda r: len((r[1] or "").split())
    sizes = collections.Counter()
    for r in found[3]:
        sizes[r[3]] += size(r)
    due, taken = plain_targets(dict(sizes)), collections.Counter()
    times = collections.Counter(found[4])
    assert set(times) <= set(found[3]) and max(times.values()) <= 2
    for r, n in times.items():
        taken[r[3]] += n * size(r)
    assert all(abs(taken[s] - due[s]) <= 60 for s in due)
    assert all(times[r] == 1 for r in found[3] if not size(r))


def test_ids_are_those_of_plain_merging(stages):
    _, found = stages
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path(corpus_pipeline.VOCABULARY)), special_tokens={})
    expected = []
    for r in found[4]:
        ids = np.array(plain.encode_ordinary(r[1] or ""), "<u4").tobytes()
        expected.append((r[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), ids))
    assert collections.Counter((*r[:4], bytes(r[4])) for r in found[5]) == collections.Counter(expected)


def test_run_is_its_stages_and_leaves_one_table(spark, stages):
    at, found = stages
    shared.release(spark)
    got = corpus_pipeline.run(spark, at)
    assert sorted(map(tuple, got.collect()), key=str) == found[5]
    assert shared.release(spark) == 1


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_rows_of_null_and_shared_ids_are_decided_by_their_texts(spark, tmp_path):
    w = [f"w{k}" for k in range(80)]
    other = " ".join(f"v{k}" for k in range(80))
    text, near = " ".join(w), " ".join([*w[:-1], "end"])

    def rows(*pairs):
        return table(spark, [(i, t, "a") for i, t in pairs])

    exact = corpus_pipeline.exact_stage(spark, rows((None, text), (3, text), (3, other), (None, other), (3, other), (None, None), (4, "")), "")
    assert left(exact) == sorted([(3, text), (3, other), (4, "")], key=str)
    kept = corpus_pipeline.near_stage(spark, rows((None, text), (None, near), (3, other), (3, other + " more"), (None, "alone"), (5, None), (6, " ")), "")
    got = left(kept)
    assert len(got) == 5 and (None, "alone") in got and (5, None) in got and (6, " ") in got
    assert sum(t in (text, near) for _, t in got) == 1 and sum((t or "").startswith(other) for _, t in got) == 1
    mixed = corpus_pipeline.mix_stage(spark, rows((None, text), (None, "x"), (3, other), (3, "y"), (3, "y"), (3, None)), "")
    assert {(r["doc_id"], r["text"]) for r in mixed.collect()} <= {(None, text), (None, "x"), (3, other), (3, "y"), (3, None)}
    assert mixed.filter("doc_id = 3 and text is null").count() == 1


def test_every_stage_takes_edge_rows_and_empty_tables(spark, edge_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge_docs, str(tmp_path))
        assert out.count() > 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, no_docs, str(tmp_path)).count() == 0, name

