import random
import re

import pytest

from dealscope.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {k: chr(k + 32) for k in range(65, 91)}


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for label, phrase in L.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def one(text):
    return {d.rule.label for d in L.resolved(L._scanner().detections(L.as_words(text)))}


def test_base_places_equal_brute_force(spark, edge_docs):
    rng = random.Random(2)
    parts = ["under", "the", "MIT", "License", "license", "apache", "version", "2", "cc", "by", "nc", "cc-by-nc", "Under The mit-LICENSE", "mité", " ", " ", "é", "\x00", ",", "İ"]
    texts = [rng.choice([" ", "\n", "--"]).join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", " - ", "under the mit license " * 30_000]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as n_words", "text as labels").repartition(4)
    got = L.labels_of(L.scan(df)).collect()
    want = sorted([(i, *base(t)) for i, t in rows], key=str)
    assert sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got], key=str) == want
    for r in got:
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(","))))
    assert L.scan(edge_docs).count() == 10 and L.scan(edge_docs.limit(0)).count() == 0


def test_there_are_hundreds_of_rules_and_each_runs_behind_its_keywords():
    rules = L.rules()
    assert len(rules) > 300 and [r.rank for r in rules] == sorted(r.rank for r in rules) and len({r.name for r in rules}) == len(rules)
    behind = L.Scanner(rules)
    texts = [f"{w} {name} license" for label, reading, _ in L.NAMES for name in (reading.split("|")[0].replace("(?:", "").replace(")?", "").replace(")", ""),) for w in ("licensed under the", "spdx license identifier", "see the")]
    texts += [s[3].replace("(?:www )?", "www ") for s in L.SENTENCES]
    for text in texts:
        words = L.as_words(text)
        every = {(r.name, m.start()) for r, p in behind.compiled for m in p.finditer(words)}
        assert {(d.rule.name, d.start) for d in behind.detections(words)} == every, text


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2"}),
        ("This file is licensed under the GNU Lesser General Public License v2.1.", {"lgpl-2.1"}),
        ("released under the terms of the GNU Affero General Public License version 3", {"agpl-3"}),
        ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance", {"apache-2"}),
        ("see https://creativecommons.org/licenses/by-nc-sa/4.0/", {"cc-by-nc-sa"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", {"mit"}),
        ("BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted", {"bsd-3", "bsd"}),
        ("available under CC BY-NC and the MIT License", {"cc-by-nc", "mit"}),
        ("Ich fahre mit dem Zug und spiele mit dem Hund", set()),
        ("a driving license for the general public", set()),
    ],
)
def test_labels(text, labels):
    assert one(text) == labels


def test_resolution_equals_a_plain_one():
    rng = random.Random(4)
    ranks = [L.Rule(f"r{k}", f"l{k}", k // 2 + 1, 0.5, "x", ("x",)) for k in range(8)] + [L.Rule("b", "b", 0, 1.0, "x", ("x",), True)]
    for _ in range(300):
        found = list({(d.start, d.end, d.rule.rank): d for d in (L.Detection(rng.choice(ranks), s, s + rng.randint(1, 9)) for s in (rng.randint(0, 25) for _ in range(rng.randint(0, 25))))}.values())
        kept = []
        for d in sorted(found, key=lambda d: (d.rule.rank, d.start, -d.end)):
            if d.rule.base or not any(k.start <= d.start and d.end <= k.end for k in kept):
                kept.append(d)
        assert sorted(L.resolved(found), key=str) == sorted(kept, key=str)
