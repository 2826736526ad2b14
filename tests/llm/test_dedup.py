import collections
import hashlib
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealscope.llm import shingles as S
from dealscope.llm.chunks import cut_texts, repeated_passages, without_repeats
from dealscope.llm.components import components
from dealscope.llm.exact import DigestIndex, deduplicate
from dealscope.llm.minhash import near_duplicates


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingle_set(text, k=5):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_shingles_equal_plain_sets():
    texts = ["A b c d e f", "a B c d E f", "x y", "", None, "\x0b \n", "q " * 40, "É é a b c d", "word with no break"]
    values, counts = S.shingle_sets(texts)
    assert counts.tolist() == [len(shingle_set(t)) for t in texts]
    ends = np.cumsum(counts)
    sets = [set(values[e - c : e].tolist()) for e, c in zip(ends, counts, strict=True)]
    assert sets[0] == sets[1] and not sets[3] and len(sets[6]) == 1


def brute_components(rows, percent):
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    rows, base = [], [rng.choice(vocab) for _ in range(120)]
    for k in range(90):  # one group with chains, edits shared by some, and some too far away
        w = list(rows[-1][1].split()) if k % 7 == 3 and rows else list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((k, " ".join(w)))
    for k in range(90, 200):
        rows.append((k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 80)))))
    rows += [(k, rows[k - 200][1].upper()) for k in range(200, 230)]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, percent):
    rows = near_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, percent=percent).collect()}
    assert got == brute_components(rows, percent)


def test_near_duplicates_on_edge_rows(edge_docs, no_docs):
    got = collections.defaultdict(list)
    for r in near_duplicates(edge_docs).collect():
        got[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[1] == [(4, 1, True)] and got[2] == [(4, 1, False)] * 2
    assert got[3] == [(0, 3, True)] and got[4] == [(0, 4, True)] and got[7] == [(0, 7, True)]
    assert got[None] == [(4, None, True)]
    assert got[9007199254740993][0][1:] == (9007199254740993, True) and got[9007199254740994][0][1] == 9007199254740993
    assert near_duplicates(no_docs).count() == 0


def test_rows_without_an_id_link_their_neighbours(spark):
    w = [f"w{k}" for k in range(120)]
    chain = [" ".join(w), " ".join([*w[:-3], "a1", "a2", "a3"]), " ".join(["b1", "b2", *w[2:-3], "a1", "a2", "a3"])]
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(5, chain[0]), (None, chain[1]), (9, chain[2]), (None, other), (None, other + " more"), (None, " "), (3, None)]
    sets = [shingle_set(t) for t in chain]
    assert 100 * len(sets[0] & sets[2]) < 93 * len(sets[0] | sets[2])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df, percent=93).collect())
    assert got == {(5, 5, True): 1, (9, 5, False): 1, (None, 5, False): 1, (None, None, True): 3, (3, 3, True): 1}
    # without ids the components still tell rows apart
    parts = collections.Counter(r["component"] and bytes(r["component"]) for r in near_duplicates(df, percent=93, with_digest=True).collect())
    assert sorted(parts.values()) == [2, 2, 3]


@pytest.mark.parametrize("part", [1, 3])
def test_large_buckets_in_parts_lose_no_link(spark, monkeypatch, part):
    from dealscope.llm import minhash

    monkeypatch.setattr(minhash, "PART", part)
    rows = near_corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, percent=80).collect()}
    assert got == brute_components(rows, 80)


def test_a_family_of_one_template_is_told_apart(spark):
    rng = random.Random(12)
    template = [f"t{k}" for k in range(100)]
    rows = [(k, " ".join([*template, *(f"u{k}x{j}" for j in range(rng.choice([9, 10, 11, 12, 13])))])) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, percent=80).collect()}
    assert got == brute_components(rows, 80)


def test_release_drops_what_was_written(spark):
    import os

    from dealscope.llm import shared

    shared.release(spark)
    df = shared.written(spark.range(5).toDF("x"), "some")
    path = shared._WRITTEN[-1].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    assert shared.release(spark) == 1 and not os.path.exists(path) and shared.release(spark) == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (1, 0)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def index(spark):
    return DigestIndex(spark, f"d_{uuid.uuid4().hex}", 4)


def test_exact_dedup_on_edge_rows(spark, edge_docs, no_docs):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in deduplicate(edge_docs, index(spark)).collect()}
    same, none = hashlib.sha256(b"the same text of a few words here").hexdigest(), hashlib.sha256(b"").hexdigest()
    assert (1, 2, 3, False, same) in got and (2, 2, 3, True, same) in got
    assert (3, 4, 2, False, none) in got and (4, 4, 2, True, none) in got
    assert any(r[0] is None and r[1] is None and r[3] for r in got)
    assert deduplicate(no_docs, index(spark)).count() == 0


def test_digest_index_keeps_what_came_first(spark):
    held = index(spark)
    first = spark.createDataFrame([(1, "a"), (5, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(9, "a"), (10, "c"), (11, "c")], "doc_id long, text string")
    assert {(r[0], r[1]) for r in deduplicate(first, held).collect()} == {(1, 5), (5, 5), (2, 2)}
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in deduplicate(second, held).collect()}
    assert got == {(9, 5, False), (10, 11, False), (11, 11, True)}
    assert held.read().count() == 3
    assert spark.sql(f"DESCRIBE EXTENDED {held.table}").filter("col_name = 'Num Buckets'").first()[1] == "4"


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_batches_go_through_the_anti_join_and_append(spark, monkeypatch, batches):
    rng = random.Random(batches)
    rows = [(rng.choice([None, rng.randrange(-50, 50)]), rng.choice([None, "", *"abcdefgh"])) for _ in range(300)]
    plans, added = [], []
    plain = DigestIndex.not_held

    def seen(self, digests):
        out = plain(self, digests)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        added.append(out.count())
        return out

    monkeypatch.setattr(DigestIndex, "not_held", seen)
    held = index(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter(map(tuple, deduplicate(df, held, batches=batches).collect()))
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in own if i is not None), default=None) for t, own in groups.items()}
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in groups}
    assert got == collections.Counter((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], digest[t or ""]) for i, t in rows)
    # the first batch founds the index; each later one is anti-joined by sort-merge, without a shuffle of the index
    assert len(plans) == batches and sum(added) == len(groups) == held.read().count()
    for p in plans[1:]:
        assert "SortMergeJoin" in p and "LeftAnti" in p and p.count("Exchange") == p.split("LeftAnti")[1].count("Exchange") <= 2
    held.drop()
    assert not held.exists()


def plain_cuts(text, bits=4, shortest=16, seed=3):
    """Byte offsets of cuts by the rolling form of the gear hash."""
    from dealscope.llm.chunks import _gear

    gear, data = _gear(seed).tolist(), text.encode()
    h, marks = 0, []
    for k, b in enumerate(b"\0" * 16 + data + b"\0" * 16):
        h = ((h << 1) + gear[b]) & 0xFFFF
        if h >> (16 - bits) == 0:
            marks.append(k + 1 - 16)
    out, last = [], None
    for m in marks:
        while 0 < m < len(data) and data[m] & 0xC0 == 0x80:
            m += 1
        if last is None or m - last >= shortest:
            if 0 < m < len(data):
                out.append(m)
        if m != last:
            last = m
    return out


def test_cuts_equal_the_rolling_hash():
    rng = random.Random(1)
    for _ in range(20):
        text = " ".join("".join(rng.choice("abcdefgé中") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 200)))
        c = cut_texts([text])
        starts = [len(text[:s].encode()) for s in c["start"].tolist()]
        assert starts == [0, *plain_cuts(text)]
        assert c["end"].tolist() == [*c["start"].tolist()[1:], len(text)] and c["n_words"].sum() == len(text.split())


def test_a_text_is_cut_alike_after_any_other():
    rng = random.Random(8)
    for _ in range(300):
        before, text = ("".join(rng.choice("abcdefgé中 ") for _ in range(n)) for n in (30, 120))
        alone, after = cut_texts([text]), cut_texts([before, text])
        own = after["doc"] == 1
        assert all(after[c][own].tolist() == alone[c].tolist() for c in ("start", "end", "n_words", "digest"))


def test_chunks_resist_insertions():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400))
    a, b = (set(c["digest"].tolist()) for c in (cut_texts([text]), cut_texts(["new words put before " + text[:900] + " inserted " + text[900:]])))
    assert len(a & b) >= len(a) - 4


def test_repeated_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(4)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))

    passage = prose(60)
    data = [(k, f"{prose(100)} {passage} {prose(50)}" if k % 4 == 0 else prose(200)) for k in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = repeated_passages(df).collect()
    assert {r["doc_id"] for r in got} == {k for k in range(40) if k % 4 == 0}
    texts = dict(data)
    for r in got:
        assert texts[r["doc_id"]][r["span_start"] : r["span_end"]] in passage or passage[20:-20] in texts[r["doc_id"]][r["span_start"] - 100 : r["span_end"] + 100]
        assert r["keeper_id"] == 0 and r["removed"] == (r["doc_id"] != 0)
    left = dict(without_repeats(df).collect())
    for k, t in data:
        spans = [(r["span_start"], r["span_end"]) for r in got if r["doc_id"] == k and r["removed"]]
        expected = t if not spans else t[: spans[0][0]] + t[spans[0][1] :]
        assert left[k] == expected


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_copies_that_hold_an_earlier_passage_stay_once(spark):
    rng = random.Random(6)
    passage, body, more = prose(rng, 60), prose(rng, 150), prose(rng, 60)
    copy = f"{body} {passage} {more}"
    data = [(0, f"{prose(rng, 80)} {passage} {prose(rng, 80)}"), (5, copy), (6, copy)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = repeated_passages(df).orderBy("doc_id", "span_start").collect()
    by_doc = {k: [r for r in got if r["doc_id"] == k] for k in (0, 5, 6)}
    assert [(r["keeper_id"], r["removed"]) for r in by_doc[0]] == [(0, False)]
    assert [(r["keeper_id"], r["removed"]) for r in by_doc[5]] == [(5, False), (0, True), (5, False)]
    assert [(r["keeper_id"], r["removed"]) for r in by_doc[6]] == [(5, True), (0, True), (5, True)]
    assert [r["span_end"] for r in by_doc[6]] == [*[r["span_start"] for r in by_doc[6][1:]], len(copy)]
    left = dict(without_repeats(df).collect())
    assert left[0] == data[0][1] and left[6] == ""
    assert left[5].startswith(body[:-60]) and left[5].endswith(more[60:]) and passage[60:-60] not in left[5]


def test_rows_that_share_an_id_have_passages_of_their_own(spark):
    rng = random.Random(7)
    passage, first, second, third = prose(rng, 60), prose(rng, 40), prose(rng, 90), prose(rng, 60)
    data = [(1, passage), (1, passage), (2, f"{first} {third}"), (2, third), (None, f"{second} {passage}"), (None, f"{passage} {first}"), (None, prose(rng, 70))]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = collections.defaultdict(list)
    for r in repeated_passages(df).collect():
        got[r["doc_id"]].append((r["keeper_id"], r["removed"]))
    assert sorted(got[1]) == [(1, False), (1, True)]
    assert sorted(x[1] for x in got[2] if x[0] == 2)[-2:] == [False, True]
    assert got[None].count((1, True)) == 2
    left = collections.defaultdict(list)
    for i, t in without_repeats(df).collect():
        left[i].append(t)
    assert sorted(left[1]) == ["", passage]
    assert sum(third[60:-60] in t for t in left[2]) == 1
    assert len(left[None]) == 3 and data[-1][1] in left[None] and not any(passage[60:-60] in t for t in left[None])
    assert any(t.startswith(second[:-60]) for t in left[None])


def plain_passages(rows, least=20):
    """Spans by plain dictionaries over the chunks of each distinct (id, text), in the order of ids and row hashes."""
    cut = {}
    for i, t, h in rows:
        c = cut_texts([t])
        cut[i is None, i, h] = list(zip(c["start"].tolist(), c["end"].tolist(), c["n_words"].tolist(), c["digest"].tolist(), strict=True))
    order = sorted(cut, key=lambda k: (k[0], k[1] if k[1] is not None else 0, k[2]))
    first, times = {}, collections.Counter()
    copies = collections.Counter((i is None, i, h) for i, _, h in rows)
    for k in order:
        for seq, (_, _, _, d) in enumerate(cut[k]):
            first.setdefault(d, (k, seq))
            times[d] += copies[k]
    found = collections.Counter()
    for k in order:
        for copy in range(copies[k]):
            runs, run = [], []
            for seq, c in enumerate(cut[k]):
                if times[c[3]] > 1:
                    run.append((seq, c, first[c[3]][0][1], copy > 0 or first[c[3]] != (k, seq)))
                elif run:
                    runs.append(run)
                    run = []
            for run in [*runs, run]:
                if sum(c[2] for _, c, _, _ in run) < least:
                    continue
                parts = []
                for x in run:
                    if not parts or x[2:] != parts[-1][-1][2:]:
                        parts.append([])
                    parts[-1].append(x)
                parts = settled([[p[0][1][0], p[-1][1][1], sum(c[2] for _, c, _, _ in p), p[0][2], p[0][3]] for p in parts], k[1], least)
                for p in parts:
                    found[(k[1], *p)] += 1
    return found


def settled(parts, own, least):
    """parts: [start, end, words, keeper, removed]; short ones go with what is beside them."""
    words = collections.Counter()
    for _, _, n, keeper, removed in parts:
        words[keeper, removed] += n
    firm = [not p[4] or words[p[3], p[4]] >= least for p in parts]
    states = []
    for i, p in enumerate(parts):
        if firm[i]:
            states.append((p[3], p[4]))
            continue
        a, b = i, i
        while a > 0 and not firm[a - 1]:
            a -= 1
        while b + 1 < len(parts) and not firm[b + 1]:
            b += 1
        sides = [(parts[j][3], parts[j][4]) for j in (a - 1, b + 1) if 0 <= j < len(parts)]
        goes = sides and all(s[1] for s in sides) and sum(x[2] for x in parts[a : b + 1]) < least
        states.append(sides[0] if goes else (own, False))
    joined = []
    for p, s in zip(parts, states, strict=True):
        if joined and joined[-1][3:] == list(s):
            joined[-1][1:3] = [p[1], joined[-1][2] + p[2]]
        else:
            joined.append([p[0], p[1], p[2], *s])
    return [[*p[:3], own, False] if p[4] and p[2] < least else p for p in joined]


def test_short_phrases_make_no_holes(spark):
    rng = random.Random(21)
    words = prose(rng, 94).split(" ")
    phrase = " ".join(words[40:54])
    text = " ".join(words)
    data = [(1, f"{prose(rng, 50)} {phrase} {prose(rng, 50)}"), (2, text), (3, text), (4, prose(rng, 80))]
    left = dict(without_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert left[1] == data[0][1] and left[2] == text and left[3] == "" and left[4] == data[3][1]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_equal_plain_search(spark, seed):
    rng = random.Random(seed)
    pieces = [prose(rng, rng.choice([25, 60, 120])) for _ in range(6)]
    texts = [" ".join(rng.choice(pieces) if rng.random() < 0.6 else prose(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 5))) for _ in range(30)]
    rows = [(rng.choice([None, 1, 2, *range(3, 40)]), t) for t in texts]
    rows += [rows[3], rows[3], (50, rows[4][1]), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashed = [tuple(r) for r in df.selectExpr("doc_id", "text", "xxhash64(text)").collect()]
    got = collections.Counter(map(tuple, repeated_passages(df).collect()))
    assert got == plain_passages(hashed) and len(got) > 20


def test_no_word_of_overlapping_quotes_is_lost(spark):
    rng = random.Random(14)
    words = prose(rng, 260).split(" ")
    data = [(1, " ".join(words[:120])), (2, " ".join(words[:200])), (3, " ".join(words[80:200])), (4, " ".join(words[100:]))]
    left = dict(without_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert sum(w in " ".join(left.values()) for w in words) == len(words)
    assert len(" ".join(left.values())) < 1.2 * len(" ".join(words))


def test_repeated_passages_on_edge_rows(edge_docs, no_docs):
    got = repeated_passages(edge_docs).collect()
    assert {r["doc_id"] for r in got} == {9007199254740993, 9007199254740994}
    cleaned = without_repeats(edge_docs)
    assert cleaned.columns == edge_docs.columns and cleaned.count() == edge_docs.count()
    assert repeated_passages(no_docs).count() == 0
