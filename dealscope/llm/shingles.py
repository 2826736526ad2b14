"""Vectorised word and shingle hashing over whole Arrow batches.

A batch of texts is laid end to end as UTF-8 bytes and hashed with numpy: one
pass finds the words, one sums each word's bytes against powers of an odd
multiplier, and one combines runs of words into shingles.  Nothing is cut: a
text of any length is hashed whole.  Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_MAX_WORD_POWERS = 1 << 12


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BYTE_BASE, _MAX_WORD_POWERS)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and each text's word count.

    A-Z are lower-cased; words are runs of bytes other than space and 0x09-0x0D.
    """
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n" + b"\n".join(encoded) + b"\n", dtype=np.uint8)
    upper = (buf >= 65) & (buf <= 90)
    buf = buf + (upper.view(np.uint8) << 5)
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.cumsum([1] + [len(e) + 1 for e in encoded])
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    longest = int((ends - starts).max())
    powers = _POW if longest <= _MAX_WORD_POWERS else _powers(_BYTE_BASE, longest)
    # keep only word bytes, packed; position inside the word from a repeat of starts
    at = np.flatnonzero(inside)
    lengths = ends - starts
    packed_starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    offset = np.arange(len(at), dtype=np.int64) - np.repeat(packed_starts, lengths)
    value = (buf[at].astype(np.uint64) + np.uint64(1)) * powers[offset]
    sums = np.add.reduceat(value, packed_starts)
    return mix64(sums + lengths.astype(np.uint64) * _MIX_2), counts


def shingle_sets(texts: Sequence[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, end to end, and their counts.

    A text with fewer than ``size`` words but at least one is a single shingle
    of its whole word sequence; a text without words has none.
    """
    words, counts = word_hashes(texts)
    powers = _powers(_WORD_BASE, size + 1)
    doc_of = np.repeat(np.arange(len(counts)), np.maximum(counts - size + 1, (counts > 0).astype(counts.dtype)))
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    n_out = np.maximum(counts - size + 1, (counts > 0).astype(counts.dtype))
    if not len(doc_of):
        return np.empty(0, np.uint64), n_out
    base = np.concatenate(([0], np.cumsum(n_out)[:-1]))
    pos = np.arange(len(doc_of)) - np.repeat(base, n_out) + np.repeat(first, n_out)
    span = np.minimum(counts, size)[doc_of]
    acc = np.zeros(len(doc_of), np.uint64)
    short = bool((span < size).any())
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    for j in range(size):
        term = padded[pos + j] * powers[j]
        acc += np.where(span > j, term, np.uint64(0)) if short else term
    acc = mix64(acc + span.astype(np.uint64) * powers[size])
    return distinct_by_group(acc, doc_of, len(counts))


def distinct_by_group(values: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each group (groups are ascending in ``group``)."""
    ends = np.searchsorted(group, np.arange(n_groups + 1))
    values = values.copy()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
    return values[keep], np.bincount(group[keep], minlength=n_groups)


def minhash(values: np.ndarray, counts: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """(texts, hashes) matrix of minima; rows of empty sets are all ones."""
    out = np.full((len(counts), len(multipliers)), np.iinfo(np.uint64).max, np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))[full]
    for k, m in enumerate(multipliers):
        out[full, k] = np.minimum.reduceat(mixed(values, m), starts)
    return out


def mixed(values: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    """One hash function of the family: multiply, fold the high half down, multiply."""
    x = values * multiplier
    x ^= x >> np.uint64(32)
    return x * multiplier


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers made from a seed."""
    at = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * _BYTE_BASE + np.uint64(seed)
    return mix64(at) | np.uint64(1)
