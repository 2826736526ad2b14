import hashlib
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from dealscope.llm import chat, gif
from dealscope.llm.boilerplate import spread_lines, without_boilerplate
from dealscope.llm.bpe import Bpe, encode_decode, read_ranks, with_token_counts
from dealscope.llm.html_main import decode, extract_main, main_text, trained
from dealscope.llm.html_tree import features, parse, text_of
from dealscope.llm.mix import mix, mixed_rows, source_targets
from dealscope.llm.toxicity import Machine, fit, terms, toxicity, train, without_toxic

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return Bpe(read_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_bpe_equals_plain_merging_on_awkward_pieces(bpe, plain):
    rng = random.Random(0)
    texts = ["", " ", "a" * 5000, "́" * 300, "\U0001f600" * 50, "\x00\x01�", "Donaudampfschifffahrt" * 20]
    texts += ["".join(rng.choice("abéß中 \n1.") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x400, 0x600), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(100)) for _ in range(50)]
    for t in texts:
        ids = bpe.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()
        for piece in bpe.split(t):
            assert bpe.encode_piece(piece.encode()) == bpe.merged(piece.encode()) or piece.encode() in bpe.ranks or len(piece) > 400


def test_bpe_documents(spark, sf, plain, edge_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r[0]: r[1] or "" for r in docs.select("doc_id", "text").collect()}
    for r in encode_decode(docs, PATH, P.PATTERN).collect():
        ids = np.array(plain.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert bytes(r["ids"]) == ids and r["n_tokens"] == len(ids) // 4 and r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert bytes(r["decoded"]) == texts[r["doc_id"]].encode()
    got = [(r["doc_id"], r["n_tokens"]) for r in encode_decode(edge_docs, PATH, P.PATTERN, digests_only=True).collect()]
    assert len(got) == 10 and dict(got)[4] == 0 and dict(got)[9007199254740993] > 30_000 and None in dict(got)
    assert encode_decode(no_docs, PATH, P.PATTERN).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def turns_of(n):
    rng = random.Random(n)
    roles = ["system", *(["user", "assistant"] * n)][:n]
    return [(1, k, r, " ".join(rng.choice(["a", "b<c>", "\\", "</turn>", "# x", "\\l", "\n"]) for _ in range(rng.randint(0, 60)))) for k, r in enumerate(roles)]


@pytest.mark.parametrize("budget", [60, 200, 5000])
def test_chat_windows_read_back(spark, budget):
    rows = turns_of(41) + [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (2, 0, None, None), (2, None, "assistant", ""), (None, 0, "assistant", "x")]
    history = budget // 4
    formatted = chat.windows(spark.createDataFrame(rows, TURNS), budget=budget, history=history, segment=8).persist()
    got = {r["conv_id"]: r for r in chat.read_digests(formatted).collect()}
    assert set(got) == {1, -7, 2, None}
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (-1 if x[1] is None else x[1], x[2] or ""))
        text = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(w["text"]) for w in formatted.collect() if w["conv_id"] == conv)
    cost = [len(t[3].split()) + chat.MARKS for t in rows[:41]]
    at = 0
    for w in sorted(formatted.filter("conv_id = 1").collect(), key=lambda w: w["window_no"]):
        back = chat.read_back(w["text"])
        assert [(rows[t["pos"]][2], rows[t["pos"]][3]) for t in w["turns"]] == back
        own, shown = [t["pos"] for t in w["turns"] if not t["repeated"]], [t["pos"] for t in w["turns"] if t["repeated"]]
        assert own == list(range(at, at + len(own))) and w["window_no"] == at and w["tokens"] == sum(cost[t["pos"]] for t in w["turns"])
        assert w["tokens"] <= budget or (len(own) == 1 and len(shown) <= 1)
        if at:
            assert shown[0] == 0  # the system turn is retained
            near = shown[1:]
            assert near == list(range(at - len(near), at)) and sum(cost[p] for p in near) <= history
            assert shown == list(range(at)) or len(shown) == 1 or sum(cost[p] for p in [near[0] - 1, *near]) > history or near[0] == 1 or w["tokens"] + cost[near[0] - 1] > budget
        at += len(own)
        if at < 41 and at % max(8, history // chat.MARKS + 1):
            assert cost[0] + history + sum(cost[p] for p in [*own, at]) > budget  # one more would not have fitted
    assert at == 41


def test_windows_do_not_depend_on_turn_numbers(spark):
    """Turns numbered from 0, by time stamps, all alike, or not at all; and a null conversation of many rows."""
    text = [f"turn number {k:02}" for k in range(20)]
    for number in (lambda k: k, lambda k: 1_700_000_000 + 997 * k, lambda k: 5, lambda k: None):
        rows = [(1, number(k), "user", t) for k, t in enumerate(text)]
        got = chat.windows(spark.createDataFrame(rows, TURNS).repartition(3)).collect()
        assert len(got) == 1 and [t for _, t in chat.read_back(got[0]["text"])] == text
    n = 5000
    rows = spark.range(n).selectExpr("cast(null as long) as conv_id", "cast(null as long) as turn", "'user' as role", "'same words' as text")
    many = chat.windows(rows, budget=100, history=20)
    assert many.selectExpr("count_if(tokens > 100)", "sum(size(filter(turns, t -> not t.repeated)))").first()[:] == (0, n)
    r = chat.read_digests(many).first()
    assert r["conv_id"] is None and r["n_turns"] == n and r["turns_sha256"] == hashlib.sha256(("user\nsame words\n" * n).encode()).hexdigest()


def test_a_long_system_turn_is_charged_to_the_budget(spark):
    rows = [(1, 0, "system", "s " * 3000), *((1, k, ["user", "assistant"][k % 2], "w " * 300) for k in range(1, 20))]
    for w in chat.windows(spark.createDataFrame(rows, TURNS)).collect():
        assert w["tokens"] <= 3004 + 304 and sum(not t["repeated"] for t in w["turns"]) == 1
    rows[0] = (1, 0, "system", "s " * 1000)
    for w in chat.windows(spark.createDataFrame(rows, TURNS)).collect():
        assert w["tokens"] <= 2048


def test_windows_take_given_token_counts(spark):
    rows = [(1, k, "user", "word " * 50) for k in range(10)]
    df = with_token_counts(spark.createDataFrame(rows, TURNS), PATH, P.PATTERN, "text", "n")
    counts = {r["n"] for r in df.collect()}
    assert len(counts) == 1 and df.columns == ["conv_id", "turn", "role", "text", "n"]
    each = counts.pop() + chat.MARKS
    got = chat.windows(df, budget=3 * each, history=0, tokens_col="n").collect()
    assert sorted(len(w["turns"]) for w in got) == [1, 3, 3, 3] and max(w["tokens"] for w in got) == 3 * each


def test_chat_edges(spark):
    assert chat.windows(spark.createDataFrame([], TURNS)).count() == 0
    assert chat.read_digests(chat.windows(spark.createDataFrame([], TURNS))).count() == 0
    long = "word <b> " * 60_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long)]
    df = spark.createDataFrame(rows, TURNS)
    for c in ("conv", "seg", "turns", "first", "tail", "tokens", "n"):
        df = df.selectExpr("*", f"turn as {c}")
    r = chat.read_digests(chat.windows(df)).first()
    assert r["n_turns"] == 3 and r["loss_chars"] == 2 * len(long) and r["loss_sha256"] == hashlib.sha256((2 * long).encode()).hexdigest()


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, full, open_ = share * sum(sizes.values()), {}, set(names)
    while True:
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if t[s] > most * sizes[s]]
        if not over:
            return full | t
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]
            open_.discard(s)
        if not open_:
            return full


def test_mix_targets_equal_resharing(spark):
    rng = random.Random(6)
    for n in (1, 2, 7, 30):
        sizes = {f"s{k}é"[: rng.randint(2, 4)]: rng.choice([0, 1, 10, 500, 20000]) for k in range(n)} | {None: 40}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in source_targets(df, (5.0, 2.0, 1.0), 1.5, 2.0).collect()}
        expected = plain_targets(sizes)
        assert set(got) == set(expected) and all(got[s] == pytest.approx(expected[s]) for s in got)


def test_mix_takes_what_is_due(spark):
    rng = random.Random(8)
    data = [(k, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "b", "c", "c", "c", None])) for k in range(2500)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(6)
    rows = mix(df, block=16).collect()
    again = mix(df.repartition(3), block=16).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {k: s for k, _, s in data}
    for s in {x[2] for x in data}:
        own = [r for r in rows if source[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 60
        assert all(r["taken"] <= 2 * r["size"] for r in own)


def test_mix_draws_are_fair(spark):
    df = spark.createDataFrame([(k, "w " * (1 + k % 9), "ab"[k % 2]) for k in range(6000)], "doc_id long, text string, source string")
    rows = mix(df, weights=(1.0, 3.0), share=1.2, block=32).collect()
    for source in (0, 1):
        for size in range(1, 10):
            own = [r for r in rows if r["doc_id"] % 2 == source and r["size"] == size]
            assert np.mean([r["copies"] for r in own]) == pytest.approx(own[0]["target"] / own[0]["source_size"], abs=0.12)


def test_mix_edges(edge_docs, no_docs):
    got = mix(edge_docs).collect()
    assert len(got) == 10 and {r["taken"] for r in got if r["size"] == 0} == {0}
    assert mix(no_docs).count() == 0
    out = mixed_rows(edge_docs)
    assert out.columns == edge_docs.columns and out.count() >= 10


def test_main_text_of_pages(spark, sf):
    import html as entities
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    page = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract_main(pages).collect():
        body = re.search(r"<article>(.*)</article>", page[r["page_id"]], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_main_text_leaves_other_parts_out():
    text = "This is the main text of the page, with a number of words in each of its paragraphs, and commas."
    page = f"""<html><body><header><h1>Site name</h1><nav><a href=/>Home</a><a href=/a>About</a></nav></header>
    <div class="cookie-notice"><p>We use cookies.</p></div><main><article><h2>Title &amp; more</h2><p>{text}</p><p>{text} Second&nbsp;  one.</p>
    <div class="advert">Buy now</div><p>{text}</p></article></main><aside class="sidebar"><ul><li><a href=/x>Related</a></li></ul></aside>
    <section id="comments"><h3>Comments</h3><div class="comment"><b>Joe</b><p>Nice text, I like it.</p></div></section>
    <form><label>Mail</label><input name=m></form><footer>&copy; 2026 Site</footer><script>var a = "<p>no</p>";</script></body></html>"""
    assert main_text(page, trained()) == f"Title & more\n\n{text}\n\n{text} Second one.\n\n{text}"


LONG = "This is the main text of the page, with a number of words in each of its paragraphs, and commas."
#: Pages written by hand, none like the made ones that the model learns on: (page, blocks of main text).
HAND = [
    (f"<html><body><table><tr><td><a href=/>Home</a><br><a href=/a>About us</a><br><a href=/b>Contact</a></td><td><h1>A title here</h1><p>{LONG}</p><p>{LONG} {LONG}</p></td></tr></table></body></html>", ["A title here", LONG, f"{LONG} {LONG}"]),
    (f"<div><div><h1>A title here</h1><p>{LONG}</p><p>{LONG} {LONG}</p></div><div><h3>More</h3><ul><li><a href=/x>One more story</a></li><li><a href=/y>Another story</a></li></ul></div></div>", ["A title here", LONG, f"{LONG} {LONG}"]),
    (f"<article><h1>Title</h1><p data-a=it's>{LONG}</p><p title='a > b'>{LONG} two</p></article>", ["Title", LONG, f"{LONG} two"]),
    (f"<article><h1>AT&<b>amp;</b>T</h1><p>{LONG} where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>", ["AT&amp;T", f"{LONG} where x=1 holds."]),
    (f"<body><div id=nav><a href=/>A</a> | <a href=/b>B</a></div><div id=content><h1>Story</h1><p>{LONG}<p>{LONG} Again.<h2>Part two</h2><p>{LONG} Third.</div><div id=footer>Copyright 2020 Somebody. All rights reserved.</div>", ["Story", LONG, f"{LONG} Again.", "Part two", f"{LONG} Third."]),
    (f"<div class=topbar><a href=/l>Log in</a></div><main><h1>Recipe</h1><p>{LONG}</p><ul><li>Two eggs and a cup of flour</li><li>One spoon of salt</li></ul><p>{LONG} Serve.</p></main><div class='related-posts'><h4>Related</h4><a href=/1>Pancakes</a><a href=/2>Waffles</a></div><div id='disqus_thread'><p>Great recipe, thanks a lot.</p></div>", ["Recipe", LONG, "Two eggs and a cup of flour", "One spoon of salt", f"{LONG} Serve."]),
    (f"<div class=cookie-banner>We use cookies. <button>OK</button></div><header><div class=logo>Daily</div><nav><ul><li><a href=/>News</a><li><a href=/s>Sport</a></ul></nav></header><div class=post-body><p>{LONG}</p><blockquote>{LONG} Said one.</blockquote><div class=ad-slot>Buy this now</div><p>{LONG} End.</p></div><footer><p>Contact us</p></footer>", [LONG, f"{LONG} Said one.", f"{LONG} End."]),
    (f"<body><center><font size=5><b>My page</b></font></center><hr><p>{LONG}<p>{LONG} More.<hr><a href=/>home</a> | <a href=/m>mail</a>", [LONG, f"{LONG} More."]),
    (f"<section class='sidebar'><h3>Tags</h3><a href=/t>one</a> <a href=/u>two</a></section><section class='story-text'><h1>Long read</h1><p>{LONG}</p><p>{LONG} Two.</p><p>{LONG} Three.</p></section><section class=newsletter><form><p>Subscribe to our letter</p><input name=e></form></section>", ["Long read", LONG, f"{LONG} Two.", f"{LONG} Three."]),
]


def test_hand_written_pages():
    right = given = wanted = 0
    for page, blocks in HAND:
        got = main_text(page, trained()).split("\n\n")
        right += len(set(got) & set(blocks))
        given += len(got)
        wanted += len(blocks)
    assert right / given >= 0.95 and right / wanted >= 0.95, (right, given, wanted)
    for page, blocks in HAND[:4]:
        assert main_text(page, trained()) == "\n\n".join(blocks)


def test_tags_and_text_by_the_standard():
    def text(page):
        nodes = parse(page)
        features(nodes)
        return text_of(nodes, [True] * len(nodes))

    assert text("<p a=it's>one</p><p b='>'>two</p><p c=\"x'>y\">three</p>") == "one\n\ntwo\n\nthree"
    assert text("<p>a<!-->b<!-- x > y -->c<wbr>d<br>e<script>x</script >f</p>") == "abcd ef"
    assert text("<p>1 &lt; 2 &amp;lt; 3 &#x41;&nbsp;B <my-tag>in</my-tag>line <unknown x=y>too</unknown></p>") == "1 < 2 &lt; 3 A B inline too"
    assert text("<p x==\"a>b\">c</p>") == 'b">c' and text("<p x=a\"b>c</p>") == "c"
    assert text("<p>" + "x=" * 200_000 + "</p><p " + "a='" * 100_001) == "x=" * 200_000


def test_decoding_is_the_best_consistent_labelling():
    nodes = parse("<div><p>a</p><ul><li>b</li><li>c</li></ul></div><div><p>d</p></div>")
    features(nodes)
    rng = random.Random(3)
    for _ in range(30):
        odds = [rng.uniform(-2, 2) for _ in nodes]
        keep = decode(nodes, odds)
        best = max(
            (sum(o for k, o in enumerate(odds) if mask >> k & 1) for mask in range(1 << len(nodes)) if all(not mask >> v.at & 1 or v.parent is None or mask >> v.parent.at & 1 for v in nodes)),
        )
        assert sum(o for o, k in zip(odds, keep, strict=True) if k) == pytest.approx(best)
        assert all(not keep[v.at] or v.parent is None or keep[v.parent.at] for v in nodes)


def test_main_text_edges(spark):
    item = "".join(f"<p>{LONG} {k}</p>" for k in range(3000))
    rows = [(None, "u", None), (1, None, ""), (2, "v", "<p"), (3, "w", "plain < text"), (4, "x", "<div>" * 3000 + "deep"), (5, "y", f"<article>{item}</article>"), (5, "y", f"<article>{item}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("id", "k0", "text", "n_chars"):
        df = df.selectExpr("*", f"page_id as {c}")
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in extract_main(df).collect()]
    by_id = {r[0]: r[2] for r in got}
    assert len(got) == 7 and set(by_id) == {None, 1, 2, 3, 4, 5} and by_id[None] == by_id[1] == "" and all(r[3] == len(r[2]) for r in got)
    assert by_id[5].split("\n\n") == [f"{LONG} {k}" for k in range(3000)]
    assert extract_main(df.limit(0)).count() == 0


def test_machine_learns_a_pair_that_weights_alone_miss():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
    rows = [np.array(sorted({10} | ({20} if x else set()) | ({30} if y else set()) | {int(100 + rng.integers(0, 300))}), np.int32) for x, y in zip(a, b, strict=True)]
    y = (a & b).astype(int)
    m = fit(rows, y, bits=10)
    got = np.array([m.score([t for t in r.tolist() if t in m.weight]) > 0.5 for r in rows])
    assert (got == y).mean() > 0.99
    pair = float(m.vector[20] @ m.vector[30])
    assert pair > 0


def test_toxicity_held_out(spark, sf):
    big = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, labels).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    caught, toxic = sum(p for t, p in held if t), sum(t for t, _ in held)
    flagged, clean = sum(p for t, p in held if not t), sum(not t for t, _ in held)
    assert toxic > 60 and caught / toxic >= 0.8 and flagged / clean <= 0.01, (caught, toxic, flagged, clean)


def test_tables_fit_the_machine_that_rows_in_memory_fit(spark):
    rng = random.Random(3)
    texts = [" ".join([rng.choice(["good", "bad", "old", "new"]), *(f"w{rng.randrange(60)}" for _ in range(8)), *(["vile"] if k % 4 == 0 else [])]) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    got = train(docs, labels, bits=12)
    learnt = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5]
    rows = sorted(((terms(texts[k], 12, {}).astype(np.int32).tobytes(), int(k % 4 == 0)) for k in learnt))
    plain = fit([np.frombuffer(t, np.int32) for t, _ in rows], np.array([y for _, y in rows]), bits=12)
    assert set(got.weight) == set(plain.weight) and got.weight
    assert [got.scorer()(t) > 0.5 for t in texts] == [plain.scorer()(t) > 0.5 for t in texts] == [k % 4 == 0 for k in range(400)]
    few = train(docs, labels, bits=12, sample=40)
    assert isinstance(few, Machine)
    none = train(docs, labels.limit(0), bits=12)
    assert none.scorer()("vile words") < 0.01
    assert {r["doc_id"] for r in without_toxic(docs, labels, machine=got).collect()} == {k for k in range(400) if k % 4}


def test_the_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    from dealscope.llm import toxicity as module

    fitted = []
    monkeypatch.setattr(module, "descend", lambda rows, *a, **b: fitted.append(len(rows)))
    docs = spark.createDataFrame([(k % 2, f"text number {k // 4}") for k in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    learnt = sum(zlib.crc32(str(k).encode()) % 5 > 0 for k in range(2))
    for sample in (30, 5000):
        train(docs, labels, bits=12, sample=sample)
    assert learnt and fitted == [30, 500 * learnt]


def test_toxicity_edges(edge_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    got = toxicity(edge_docs, labels).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity(no_docs, labels).count() == 0
    assert toxicity(edge_docs, labels.limit(0), machine=Machine(10, 0.0, {}, {})).first()["predicted"] == 1


def lzw(samples, least):
    """A plain LZW encoder with growing codes and a full table, as test data."""
    clear = 1 << least
    table, width, bits = {(k,): k for k in range(clear)}, least + 1, []

    def put(c):
        bits.extend(c >> k & 1 for k in range(width))

    put(clear)
    n, run = clear + 2, ()
    for s in samples:
        if (*run, s) in table:
            run = (*run, s)
            continue
        put(table[run])
        if n < 4096:
            table[*run, s] = n
            n += 1
            if n > 1 << width and width < 12:
                width += 1
        run = (s,)
    if run:
        put(table[run])
    put(clear + 1)
    return np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()


@pytest.mark.parametrize("least", [1, 2, 4, 8])
def test_reader_takes_any_lzw_stream(least):
    rng = random.Random(least)
    for n in (0, 1, 300, 9000):
        samples = [rng.randrange(1 << least) if rng.random() < 0.6 else 0 for _ in range(n)]
        assert gif.unpacked(lzw(samples, least), least, n).tolist() == samples


def test_writer_is_plain_lzw_with_a_clear_when_the_table_is_full():
    rng = random.Random(2)
    for n in (0, 1, 2, 100, 3000):
        samples = bytes(rng.choice([0, 7, 65, 66, 255]) for _ in range(n))
        assert gif.compressed(samples) == lzw(samples, 8)
    for n, kinds in ((9000, 256), (70_000, 40), (30_000, 1)):
        samples = bytes(rng.randrange(kinds) for _ in range(n))
        packed = gif.compressed(samples)
        assert gif.unpacked(packed, 8, n).tobytes() == samples
        assert kinds == 256 or len(packed) < n


def small_gif():
    rng = random.Random(5)
    red = gif.grey().copy()
    red[:, 1:] = 0
    frames = [gif.Frame(k, k, np.array([[rng.randrange(256) for _ in range(9)] for _ in range(7)], np.uint8), red if k % 2 else gif.grey(), k, k % 4, 3) for k in range(4)]
    return gif.write(frames, 11, 9)


def test_every_beginning_of_a_file_gives_its_whole_frames():
    whole = small_gif()
    frames = gif.read(whole).frames
    assert len(frames) == 4
    seen = set()
    for n in range(6, len(whole)):
        cut = gif.read(whole[:n])
        got = list(gif.shown(cut.width, cut.height, cut.frames))
        assert len(got) == len(cut.frames) and all(np.array_equal(a.samples, b.samples) for a, b in zip(cut.frames, frames, strict=False))
        seen.add(len(got))
    assert seen == {0, 1, 2, 3, 4}
    with pytest.raises(ValueError):
        gif.read(whole[:5])


def test_damaged_files_do_not_crash_and_take_bounded_memory():
    whole, rng = small_gif(), random.Random(6)
    for _ in range(1500):
        bad = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(6, len(bad))] = rng.randrange(256)
        g = gif.read(bytes(bad), 1 << 16)
        for f, _, canvas in gif.shown(g.width, g.height, g.frames):
            assert canvas.size <= 4 << 16 and f.samples.size <= 1 << 16
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0)
    assert gif.read(huge + whole[13:]).frames == []


def test_frames_compose_with_transparency_and_disposal():
    base, red = gif.grey(), gif.grey().copy()
    red[1] = (255, 0, 0)
    frames = [
        gif.Frame(0, 0, np.full((4, 4), 9, np.uint8), base, 5),
        gif.Frame(1, 1, np.array([[1, 7], [7, 1]], np.uint8), red, 7, disposal=2, transparent=7),
        gif.Frame(0, 0, np.full((1, 1), 1, np.uint8), red, 2, disposal=3),
        gif.Frame(3, 3, np.full((1, 1), 200, np.uint8), base, 1),
        gif.Frame(9, 9, np.full((2, 2), 5, np.uint8), base, 1),
    ]
    got = [(s, f.delay, canvas) for f, s, canvas in gif.shown(*gif.opened(gif.write(frames, 4, 4)))]
    assert [(s, d) for s, d, _ in got] == [(0, 5), (5, 7), (12, 2), (14, 1), (15, 1)]
    second, third, fourth = got[1][2], got[2][2], got[3][2]
    assert second[1, 1].tolist() == [255, 0, 0, 255] and second[1, 2].tolist() == [9, 9, 9, 255]
    assert third[1, 1].tolist() == [0, 0, 0, 0] and third[0, 0].tolist() == [255, 0, 0, 255]
    assert fourth[0, 0].tolist() == [9, 9, 9, 255] and fourth[3, 3].tolist() == [200, 200, 200, 255]
    assert gif.histogram(second).sum() == 16 and gif.histogram(fourth).sum() == 12 and np.array_equal(got[4][2], fourth)


def plain_file(payload):
    """The file of a payload of less than 3,000 bytes, put together by hand."""
    data = lzw(payload, 8)
    blocks = b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255))
    palette = b"".join(bytes([k]) * 3 for k in range(256))
    rows = len(payload) // 64
    return b"GIF89a" + struct.pack("<HHBBB", 64, rows, 0xF7, 0, 0) + palette + b"\x21\xf9\x04\x00\x04\x00\x00\x00" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 64, rows, 0) + b"\x08" + blocks + b"\x00\x3b"


def test_media_round_trip(spark, edge_docs, no_docs):
    media = gif.texts_as_media(edge_docs)
    got = {r["doc_id"]: r for r in gif.media_features(media).collect()}
    for r in edge_docs.select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        levels = np.bincount(np.frombuffer(payload, np.uint8) // 64, minlength=4)
        assert g["feature"] == f"frames={math.ceil(len(payload) / 65536)};hist=" + ",".join(f"{21 * k}:{n}" for k, n in enumerate(levels) if n)
        if len(payload) < 3000:
            file = plain_file(payload)
            assert (g["media_bytes"], g["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        elif len(raw) > 100_000:
            assert g["media_bytes"] < len(raw)
    frames = gif.decode_frames(media, "doc_id", "media")
    assert frames.filter("doc_id = 9007199254740993").count() == -(-got[9007199254740993]["payload_bytes"] // 65536)
    assert gif.media_features(gif.texts_as_media(no_docs)).count() == 0


def test_null_and_broken_media(spark):
    whole = small_gif()
    rows = [(1, None), (2, b""), (3, b"no gif"), (4, whole[:-200]), (5, whole[:8]), (None, whole), (6, whole), (6, whole)]
    df = spark.createDataFrame(rows, "i long, b binary")
    got = [r["i"] for r in gif.decode_frames(df, "i", "b").collect()]
    assert set(got) == {4, None, 6} and got.count(None) == 4 and got.count(6) == 8 and 1 <= got.count(4) < 4
    found = {r["doc_id"]: r for r in gif.media_features(df.selectExpr("i as doc_id", "b as media", "cast(null as long) as n_bytes", "1 as id", "2 as feature")).collect()}
    assert found[1]["media_bytes"] is None and found[1]["media_sha256"] is None and found[1]["feature"] == "frames=0;hist="
    assert found[3]["media_bytes"] == 6 and found[3]["payload_bytes"] == 0 and found[5]["feature"].startswith("frames=0") and found[6]["feature"].startswith("frames=4")


def test_large_pictures_are_decoded_and_larger_ones_named(spark):
    """A canvas of 4,200 x 4,200 with a small picture, and the same with a bound below it."""
    data = gif.write([gif.Frame(5, 6, np.full((2, 3), 7, np.uint8), gif.grey())], 4200, 4200)
    df = spark.createDataFrame([(1, data), (None, small_gif())], "i long, b binary")
    got = gif.decode_frames(df, "i", "b").selectExpr("i", "frame", "width", "left_out", "length(rgba) as n", "aggregate(histogram, 0L, (a, x) -> a + x) as seen").collect()
    assert [tuple(r) for r in got if r["i"] == 1] == [(1, 0, 4200, False, 4 * 4200 * 4200, 6)] and len(got) == 5
    small = gif.decode_frames(df, "i", "b", most_pixels=1 << 20).select("i", "frame", "width", "left_out", "rgba").collect()
    assert [tuple(r) for r in small if r["i"] == 1] == [(1, 0, 4200, True, None)] and len(small) == 5


def plain_boilerplate(rows, least):
    sites = {}
    for _, t, s in rows:
        for x in (t or "").split("\n") if t is not None else []:
            sites.setdefault(x, set()).add(s or "")
    return {i: (None if t is None else "\n".join(x for x in t.split("\n") if not x.strip(" ") or len(sites[x]) < least)) for i, t, s in rows}


def test_boilerplate_equals_plain_counting(spark):
    rng = random.Random(5)
    lines = [f"line {k}" for k in range(30)] + ["", "  "]
    rows = [(k, "\n".join(rng.choice(lines[: rng.choice([4, 32])]) for _ in range(rng.randint(0, 8))), rng.choice([None, *"abcdefghij"])) for k in range(60)]
    df = spark.createDataFrame(rows + [(100, None, "a")], "doc_id long, text string, source string")
    for least in (1, 2, 5, 9):
        got = {r["doc_id"]: r for r in without_boilerplate(df, least_sites=least).collect()}
        expected = plain_boilerplate([*rows, (100, None, "a")], least)
        assert {k: r["text"] for k, r in got.items()} == expected
        assert all(r["n_lines"] - r["n_removed"] == (0 if r["text"] is None else len(r["text"].split("\n")) if r["n_lines"] > r["n_removed"] else 0) for r in got.values())


def test_boilerplate_of_null_and_shared_ids(spark):
    rows = [(None, "own 1\ncommon", "a"), (None, "common\nown 2", "b"), (1, "common\nown 3", "c"), (1, "own 4\ncommon\nown 5", "a"), (1, "own 4\ncommon\nown 5", "a"), (1, "keep me", "a"), (None, None, "a"), (2, "common", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    expected = sorted((str(i), *((0, 0, "None") if t is None else (len(t.split("\n")), t.count("common"), "\n".join(x for x in t.split("\n") if x != "common")))) for i, t, _ in rows)
    got = without_boilerplate(df, least_sites=3).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_removed"], str(r["text"])) for r in got) == expected


def test_spread_is_sketched_and_exact_near_the_threshold(spark):
    rows = [(k * 1000 + j, f"line {k}", f"site {j % (k + 1)}") for k in range(0, 60, 3) for j in range(2 * k + 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r["sites"], r["times"]) for r in spread_lines(df, least_sites=5).collect())
    expected = sorted((k + 1, 2 * k + 3) for k in range(0, 60, 3) if k + 1 >= 5)
    assert [t for _, t in got] == [t for _, t in expected] and all(a == b if b < 10 else abs(a - b) <= 1 for (a, _), (b, _) in zip(got, expected, strict=True))


def test_boilerplate_edges(edge_docs, no_docs):
    got = without_boilerplate(edge_docs, least_sites=2).collect()
    assert len(got) == 10 and sum(r["n_removed"] for r in got) == 3
    assert without_boilerplate(no_docs).count() == 0
