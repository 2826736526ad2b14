"""Byte-level BPE by longest matches with backtracking, linear in the text.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton over
the vocabulary finds the longest token at every position.  The encoder takes the
longest token, and keeps it if it may stand after the token before it; else it
tries that token's next shorter prefix, and steps back when none is left.  Two
tokens may be adjacent when merging their joined bytes gives just those two;
this is worked out once a pair and remembered.  A sequence of pairwise
compatible tokens is the one that the merges themselves reach, so ids are
identical to those of plain merging by rank.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dealscope.llm.shared import given_id, held_id

_MAX_REMEMBERED = 1 << 18
_LONGEST_REMEMBERED = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 token, space, rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """Encoder and decoder of one vocabulary; ``pattern`` splits a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.token[i] = t
        self.size = [len(t) for t in self.token]
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.adjacent: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = _Pieces(self)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        held = array("I")
        held.frombytes(ids)
        return b"".join(map(self.token.__getitem__, held))

    def encode_piece(self, piece: bytes) -> list[int]:
        if (known := self.ranks.get(piece)) is not None:
            return [known]
        n = len(piece)
        # matches come by their ends, so the last one of a start is its longest
        longest: list[int] = [-1] * n
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = token
        size, adjacent, whole = self.size, self.adjacent, self.whole
        dead = bytearray(n + 1)
        out: list[int] = []
        pos, token, before = 0, longest[0], -1
        while pos < n:
            while token >= 0:
                end = pos + size[token]
                if not dead[end]:
                    fits = whole.get(token) if before < 0 else adjacent.get((before, token))
                    if fits is None:
                        fits = self._stands(token) if before < 0 else self._stands(token) and self._may_follow(before, token)
                    if fits:
                        break
                token = self._next_shorter(token)
            if token >= 0:
                out.append(token)
                pos, before = end, token
                token = longest[pos] if pos < n else -1
            else:
                dead[pos] = 1
                token = out.pop()
                pos -= size[token]
                before = out[-1] if out else -1
        return out

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if (found := self.shorter.get(token)) is None:
            t = self.token[token]
            found = next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ranks), -1)
            self.shorter[token] = found
        return found

    def _stands(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if (found := self.whole.get(token)) is None:
            found = self.whole[token] = self.merged(self.token[token]) == [token]
        return found

    def _may_follow(self, a: int, b: int) -> bool:
        if (found := self.adjacent.get((a, b))) is None:
            if len(self.adjacent) >= 4 * _MAX_REMEMBERED:
                self.adjacent.clear()
            found = self.adjacent[a, b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return found

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging by rank; used on pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]


class _Pieces(dict):
    """Encoded pieces, in two generations: when the young one is full it replaces the old. Long ones are never held."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = array("I", self.bpe.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= _LONGEST_REMEMBERED:
            if len(self) >= _MAX_REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


@lru_cache(maxsize=2)
def loaded(vocabulary: str, pattern: str) -> Bpe:
    """The encoder of a rank file, kept by a worker from task to task."""
    return Bpe(read_ranks(vocabulary), pattern)


def with_token_counts(df: DataFrame, vocabulary: str, pattern: str, text_col: str, name: str) -> DataFrame:
    """``df`` with the number of tokens of a text column in ``name``; null and empty texts have none. All columns stay as they are."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary, pattern)
        for batch in batches:
            counts = pa.array([len(bpe.encode(t or "")) // 4 for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, LongType())]))


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """One row a document: id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded unless ``digests_only``.

    The ids are those of merging each match of ``pattern`` by the ranks of the file
    ``vocabulary`` (a path that every worker has), without special tokens; decoded
    is what the ids stand for, as bytes.  Null and empty texts have no tokens.
    Whole texts are encoded, of any length.  Repeated rows give repeated results;
    null ids stay null; other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(held_id(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    more = "" if digests_only else ", ids binary, decoded binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(vocabulary, pattern)
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = bpe.encode(text or "")
                back = bpe.decode(ids)
                rows.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()) + (() if digests_only else (ids, back)))
            yield pd.DataFrame(rows, columns=["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ([] if digests_only else ["ids", "decoded"]))

    out = source.mapInPandas(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumn("id", given_id(out)).withColumnRenamed("id", id_col)
