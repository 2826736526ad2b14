"""License scans by ordered signature rules.

A rule is a regular expression over a text's words, with a label, a rank and a keyword.  The
keywords present in a text, found in one Aho-Corasick pass, say which rules run on it.  What
they detect is resolved by rank: a detection inside another one of the same or a
better rank goes, unless its rule is a base rule.

Texts are taken as words: A-Z are lower-cased, everything in ASCII that is no letter or digit
parts words, and one space stands between words.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from dealscope.llm.shared import lean

#: Phrases whose every place counts.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Fixed values, plain names: label, how the name reads in words, and a word that each reading holds.
NAMES = (
    ("0bsd", "(?:0bsd|zero clause bsd)", ("0bsd", "zero")),
    ("aal", "attribution assurance", ("assurance",)),
    ("afl-3", "academic free(?: license)?(?: version)? 3(?: 0)?|afl 3 0", ("academic", "afl")),
    ("agpl-3", "(?:gnu )?affero general public(?: license)?(?: version)?(?: v?3(?: 0)?)?|(?:gnu )?agpl(?: ?v?3(?: 0)?)?|agplv3", ("affero", "agpl", "agplv3")),
    ("apache-1.1", "apache(?: software)?(?: license)?(?: version)? 1 1", ("apache",)),
    ("apache-2", "apache(?: software)?(?: license)?(?: version)? v?2(?: 0)?|apache2", ("apache", "apache2")),
    ("apsl-2", "apple public source(?: license)?(?: version)?(?: 2(?: 0)?)?|apsl 2 0", ("apple", "apsl")),
    ("artistic-2", "artistic(?: license)?(?: version)? 2(?: 0)?|perl artistic", ("artistic",)),
    ("beerware", "beer ?ware", ("beerware", "beer")),
    ("bsd-2", "(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd", ("bsd", "freebsd")),
    ("bsd-3", "(?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|modified|revised) bsd", ("bsd",)),
    ("bsd-4", "(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd", ("bsd",)),
    ("bsl-1", "boost(?: software)?(?: license)?(?: version)?(?: 1 0)?|bsl 1 0", ("boost", "bsl")),
    ("busl-1.1", "business source(?: license)?(?: version)?(?: 1 1)?|busl 1 1", ("business", "busl")),
    ("cc0-1", "cc0(?: 1 0)?(?: universal)?|creative commons zero(?: 1 0)?", ("cc0", "zero")),
    ("cc-by", "(?:cc|creative commons) by(?: [1-4] [05])?|creative commons attribution(?: [1-4] [05])?", ("cc", "creative")),
    ("cc-by-sa", "(?:cc|creative commons) by sa(?: [1-4] [05])?|creative commons attribution share ?alike(?: [1-4] [05])?", ("cc", "creative")),
    ("cc-by-nd", "(?:cc|creative commons) by nd(?: [1-4] [05])?|creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?", ("cc", "creative")),
    ("cc-by-nc", "(?:cc|creative commons) by nc(?: [1-4] [05])?|creative commons attribution non ?commercial(?: [1-4] [05])?", ("cc", "creative")),
    ("cc-by-nc-sa", "(?:cc|creative commons) by nc sa(?: [1-4] [05])?|creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", ("cc", "creative")),
    ("cc-by-nc-nd", "(?:cc|creative commons) by nc nd(?: [1-4] [05])?|creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?", ("cc", "creative")),
    ("cddl-1", "common development and distribution(?: license)?(?: version)?(?: 1 [01])?|cddl(?: 1 [01])?", ("development", "cddl")),
    ("cecill-2.1", "cecill(?: 2 1)?", ("cecill",)),
    ("cpl-1", "common public(?: license)?(?: version)? 1 0|cpl 1 0", ("common", "cpl")),
    ("ecl-2", "educational community(?: license)?(?: version)?(?: 2 0)?", ("educational",)),
    ("elastic-2", "elastic(?: license)?(?: version)? 2(?: 0)?", ("elastic",)),
    ("epl-1", "eclipse public(?: license)?(?: version)?(?: v)? ?1 0|epl 1 0", ("eclipse", "epl")),
    ("epl-2", "eclipse public(?: license)?(?: version)?(?: v)? ?2 0|epl 2 0", ("eclipse", "epl")),
    ("eupl-1.2", "european union public(?: licen[cs]e)?(?: version)?(?: v)?(?: ?1 2)?|eupl(?: 1 2)?", ("european", "eupl")),
    ("gfdl-1.3", "(?:gnu )?free documentation(?: license)?(?: version)?(?: 1 [123])?|gfdl(?: 1 [123])?", ("documentation", "gfdl")),
    ("gpl", "gnu general public|gnu gpl", ("gnu",)),
    ("gpl-2", "(?:gnu )?general public(?: license)?(?: version)? v?2(?: 0)?|(?:gnu )?gpl ?v?2(?: 0)?|gplv2", ("general", "gpl", "gpl2", "gplv2")),
    ("gpl-3", "(?:gnu )?general public(?: license)?(?: version)? v?3(?: 0)?|(?:gnu )?gpl ?v?3(?: 0)?|gplv3", ("general", "gpl", "gpl3", "gplv3")),
    ("isc", "isc", ("isc",)),
    ("lgpl-2.1", "(?:gnu )?(?:lesser|library) general public(?: license)?(?: version)? v?2(?: [01])?|(?:gnu )?lgpl ?v?2(?: [01])?|lgplv2(?: 1)?", ("lesser", "library", "lgpl", "lgpl2", "lgplv2")),
    ("lgpl-3", "(?:gnu )?lesser general public(?: license)?(?: version)? v?3(?: 0)?|(?:gnu )?lgpl ?v?3(?: 0)?|lgplv3", ("lesser", "lgpl", "lgpl3", "lgplv3")),
    ("lppl-1.3", "latex project public(?: license)?(?: version)?(?: 1 3[ac]?)?|lppl(?: 1 3[ac]?)?", ("latex", "lppl")),
    ("mit", "(?:mit|expat)(?: x11)?", ("mit", "expat")),
    ("mit-0", "mit no attribution|mit 0", ("mit",)),
    ("mpl-1.1", "mozilla public(?: license)?(?: version)?(?: v)? ?1 1|mpl 1 1", ("mozilla", "mpl")),
    ("mpl-2", "mozilla public(?: license)?(?: version)?(?: v)? ?2(?: 0)?|mpl 2 0", ("mozilla", "mpl")),
    ("ms-pl", "microsoft public|ms pl", ("microsoft", "ms")),
    ("ms-rl", "microsoft reciprocal|ms rl", ("microsoft", "ms")),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", ("ncsa",)),
    ("odbl-1", "open (?:data commons open )?database|odbl(?: 1 0)?", ("database", "odbl")),
    ("odc-by-1", "open data commons attribution|odc by", ("commons", "odc")),
    ("ofl-1.1", "sil open font(?: license)?(?: version)?(?: 1 1)?|ofl 1 1", ("sil", "ofl")),
    ("openrail", "(?:creativeml )?open ?rail(?: m)?", ("openrail", "rail")),
    ("openssl", "openssl(?: ssleay)?", ("openssl",)),
    ("osl-3", "open software(?: license)?(?: version)?(?: v)? ?3 0|osl 3 0", ("software", "osl")),
    ("php-3", "php(?: license)?(?: version)? 3 01?", ("php",)),
    ("postgresql", "postgresql", ("postgresql",)),
    ("psf-2", "python software foundation|psf(?: 2 0)?", ("python", "psf")),
    ("qpl-1", "q public(?: license)?(?: version)?(?: 1 0)?", ("q",)),
    ("ruby", "ruby", ("ruby",)),
    ("sspl-1", "server side public(?: license)?(?: version)?(?: v)?(?: ?1)?|sspl(?: 1 0)?", ("server", "sspl")),
    ("unlicense", "unlicense", ("unlicense",)),
    ("upl-1", "universal permissive(?: license)?(?: version)?(?: 1 0)?", ("universal",)),
    ("vim", "vim", ("vim",)),
    ("w3c", "w3c(?: software(?: notice)?)?", ("w3c",)),
    ("wtfpl", "wtfpl|do what the fuck you want to public", ("wtfpl", "fuck")),
    ("x11", "x11|x consortium", ("x11", "consortium")),
    ("zlib", "zlib(?: libpng)?", ("zlib",)),
    ("zpl-2.1", "zope public(?: license)?(?: version)?(?: 2 [01])?|zpl 2 [01]", ("zope", "zpl")),
)

#: Wordings in which a name makes a license, best first: rank, score and pattern.
WORDINGS = (
    ("tag", 1, 1.0, "spdx license identifier (?:{name})(?: only| or later)?"),
    ("grant", 3, 0.95, "(?:licensed|released|distributed|available|published|provided|covered|made available|redistributed) under (?:the )?(?:terms (?:of|and conditions of) )?(?:the |an? )?(?:{name})(?: public)?(?: licen[cs]e)?(?: only| or (?:any )?later(?: version)?)?"),
    ("field", 4, 0.9, "licen[cs]e (?:is |type |name )?(?:the )?(?:{name})"),
    ("terms", 5, 0.85, "(?:under|terms of|subject to|conditions of|governed by|see|with) (?:the )?(?:{name}) licen[cs]e"),
    ("title", 6, 0.7, "(?:the )?(?:{name}) (?:public )?licen[cs]e(?:d)?"),
)

#: Sentences of license texts and addresses, best first; a word that each holds.
SENTENCES = (
    ("mit", 2, 0.98, "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby"),
    ("isc", 2, 0.98, "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", "hereby"),
    ("bsd-3", 2, 0.98, "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse", "endorse"),
    ("bsd", 2, 0.96, "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("apache-2", 2, 0.98, "licensed under the apache license version 2 0 the license you may not use this file except in compliance", "compliance"),
    ("apache-2", 2, 0.96, "(?:www )?apache org licenses license 2 0(?: html| txt)?", "apache"),
    ("gpl", 2, 0.96, "you can redistribute it and or modify it under the terms of the gnu general public license", "gnu"),
    ("lgpl", 2, 0.96, "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "gnu"),
    ("agpl", 2, 0.96, "you can redistribute it and or modify it under the terms of the gnu affero general public license", "gnu"),
    ("gpl", 2, 0.9, "(?:www )?gnu org licenses(?: old licenses)? gpl(?: [23] 0)?(?: html| txt)?", "gnu"),
    ("mpl-2", 2, 0.98, "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("mpl-2", 2, 0.96, "mozilla org mpl 2 0", "mozilla"),
    ("zlib", 2, 0.98, "altered source versions must be plainly marked as such and must not be misrepresented", "misrepresented"),
    ("unlicense", 2, 0.98, "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("bsl-1", 2, 0.98, "boost software license version 1 0 17th august 2003", "boost"),
    ("ofl-1.1", 2, 0.96, "this font software is licensed under the sil open font license", "sil"),
    ("beerware", 2, 0.96, "you can buy me a beer in return", "beer"),
    ("postgresql", 2, 0.96, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", "permission"),
    ("cc0-1", 2, 0.96, "creativecommons org publicdomain zero 1 0", "creativecommons"),
    ("cc-by", 2, 0.96, "creativecommons org licenses by [1-4] [05]", "creativecommons"),
    ("cc-by-sa", 2, 0.96, "creativecommons org licenses by sa [1-4] [05]", "creativecommons"),
    ("cc-by-nd", 2, 0.96, "creativecommons org licenses by nd [1-4] [05]", "creativecommons"),
    ("cc-by-nc", 2, 0.96, "creativecommons org licenses by nc [1-4] [05]", "creativecommons"),
    ("cc-by-nc-sa", 2, 0.96, "creativecommons org licenses by nc sa [1-4] [05]", "creativecommons"),
    ("cc-by-nc-nd", 2, 0.96, "creativecommons org licenses by nc nd [1-4] [05]", "creativecommons"),
    ("cc-by-sa", 3, 0.9, "text is available under the creative commons attribution share ?alike license", "creative"),
    ("public-domain", 5, 0.8, "(?:released|dedicated|placed|is) (?:in|into|to) the public domain", "domain"),
    ("all-rights-reserved", 7, 0.5, "all rights reserved", "reserved"),
    ("proprietary", 6, 0.7, "(?:confidential and proprietary|proprietary and confidential|unauthorized copying of this (?:file|software))", "proprietary|unauthorized"),
)


@dataclass(frozen=True)
class Rule:
    """``rank`` orders rules, 0 first; base rules' detections always stay."""

    name: str
    label: str
    rank: int
    score: float
    pattern: str
    keywords: tuple[str, ...]
    base: bool = False


def rules() -> list[Rule]:
    """All rules, best first: base phrases, then sentences and each name in each wording."""
    out = [Rule(f"base:{label}", label, 0, 1.0, phrase, (phrase.split(" ")[-2],), True) for label, phrase in BASE]
    out += [Rule(f"sentence:{label}:{k}", label, rank, score, pattern, tuple(words.split("|"))) for k, (label, rank, score, pattern, words) in enumerate(SENTENCES)]
    out += [Rule(f"{kind}:{label}", label, rank, score, wording.format(name=name), words) for kind, rank, score, wording in WORDINGS for label, name, words in NAMES]
    return sorted(out, key=lambda r: r.rank)


#: ASCII as words take it.
_AS_WORDS = {k: (chr(k).lower() if chr(k).isalnum() else " ") for k in range(128)}
_SPACES = re.compile("  +")


def as_words(text: str | None) -> str:
    """The words of a text with one space between them."""
    return _SPACES.sub(" ", (text or "").translate(_AS_WORDS)).strip(" ")


@dataclass(frozen=True)
class Detection:
    """``start`` and ``end`` are places in the words, the end not included."""

    rule: Rule
    start: int
    end: int


def resolved(found: Sequence[Detection]) -> list[Detection]:
    """The detections that stay, by start.

    By rank, one goes if it lies within another of a better rank, or within a longer or earlier-ruled one of its own
    rank.  Detections that only overlap stay both.  Base ones always stay.
    """
    kept: list[Detection] = []
    starts: list[int] = []
    ends: list[int] = []  # the furthest end of those that start no later
    for rank in sorted({d.rule.rank for d in found}):
        own: list[Detection] = []
        furthest = -1
        for d in sorted((d for d in found if d.rule.rank == rank), key=lambda d: (d.start, -d.end)):
            k = bisect_right(starts, d.start)
            covered = d.end <= furthest or (k > 0 and ends[k - 1] >= d.end)
            if d.rule.base or not covered:
                own.append(d)
            furthest = max(furthest, d.end)
        kept = sorted([*kept, *own], key=lambda d: (d.start, -d.end))
        starts, ends, top = [d.start for d in kept], [], -1
        for d in kept:
            top = max(top, d.end)
            ends.append(top)
    return kept


class Scanner:
    """Compiled rules behind their keywords."""

    def __init__(self, given: Sequence[Rule]):
        self.compiled = [(r, re.compile(f"(?<![^ ])(?:{r.pattern})(?![^ ])")) for r in given]
        of_word: dict[str, list[int]] = {}
        for k, r in enumerate(given):
            for w in r.keywords:
                of_word.setdefault(w, []).append(k)
        self.keywords = ahocorasick.Automaton()
        for w, k in of_word.items():
            self.keywords.add_word(f" {w} ", k)
        self.keywords.make_automaton()

    def detections(self, words: str) -> list[Detection]:
        """All detections in words with one space between them, unresolved."""
        wanted: set[int] = set()
        for _, k in self.keywords.iter(f" {words} "):
            wanted.update(k)
        return [Detection(rule, m.start(), m.end()) for rule, pattern in (self.compiled[k] for k in sorted(wanted)) for m in pattern.finditer(words)]


@cache
def _scanner() -> Scanner:
    return Scanner(rules())


def _word_numbers(words: str, places: Sequence[int]) -> dict[int, int]:
    """The number of the word that starts at each place."""
    out, at, n = {}, 0, 0
    for p in sorted(set(places)):
        n += words.count(" ", at, p)
        out[p], at = n, p
    return out


FOUND = "n_words long, n_base long, detections array<struct<label: string, rule: string, first_word: long, end_word: long, score: double, base: boolean>>"


def scan(docs: DataFrame, text_col: str = "text", columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row, its number of words and base places, and the detections that stay, by their first word.

    Whole texts are scanned, one by one, each row by its own text; null counts as empty, and a text without
    words has no detections.  Repeated rows give repeated results; ids may be null; other columns are ignored.
    """
    kept = StructType([docs.schema[c] for c in columns])
    clash = {"n_words", "n_base", "detections"} & {c.lower() for c in columns}
    if clash:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    found = StructType([StructField(f.name, f.dataType) for f in _parse_datatype_string(FOUND).fields])
    source = docs.select(*columns, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    detection = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        for batch in batches:
            n_words, n_base, detections = [], [], []
            for value in batch.column(len(columns)):
                words = as_words(value.as_py())
                every = scanner.detections(words)
                stay = resolved(every)
                number = _word_numbers(words, [p for d in stay for p in (d.start, d.end)])
                n_words.append(words.count(" ") + 1 if words else 0)
                n_base.append(sum(d.rule.base for d in every))
                detections.append([(d.rule.label, d.rule.name, number[d.start], number[d.end] + 1, d.rule.score, d.rule.base) for d in stay])
            rows = [[dict(zip(("label", "rule", "first_word", "end_word", "score", "base"), d, strict=True)) for d in row] for row in detections]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(n_words, pa.int64()), pa.array(n_base, pa.int64()), pa.array(rows, detection)], [*columns, "n_words", "n_base", "detections"])

    return source.mapInArrow(lean(run), StructType([*kept.fields, *found.fields]))


def labels_of(found: DataFrame) -> DataFrame:
    """Rows of :func:`scan` with base places and labels in plain columns instead of detections.

    ``score`` is that of the surest detection, 0 without any; labels are distinct, sorted and joined by commas.
    """
    base = F.filter("detections", lambda d: d["base"])

    def joined(rows: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda d: d["label"]))), ",")

    starts = F.transform(base, lambda d: d["first_word"])
    return found.withColumns({
        "first_word": F.array_min(starts),
        "last_word": F.array_max(starts),
        "base_labels": joined(base),
        "labels": joined(F.col("detections")),
        "score": F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)),
    }).drop("detections")
