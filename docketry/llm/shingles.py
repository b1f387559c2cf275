"""Vectorised word shingles: sets of 64-bit hashes of k consecutive words per text.

Words are the maximal runs of ``a-z0-9`` of the lower-cased text. All texts of an Arrow
batch are laid end to end as bytes and every step below is one numpy pass over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WORD = np.zeros(256, np.bool_)
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("0") : ord("9") + 1] = True
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    powers = np.empty(n, np.uint64)
    if n:
        powers[0] = 1
        powers[1:] = _MULTIPLY
        np.multiply.accumulate(powers, out=powers)
    return powers


#: Most texts in one call; their places take 16 bits.
MOST_TEXTS = 1 << 16


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts that one call takes."""
    for at in range(0, len(batch), MOST_TEXTS):
        yield batch.slice(at, MOST_TEXTS)


def shingle_sets(texts: pa.Array, k: int, least_words: int, distinct: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, offsets, hashes): the distinct shingle hashes of each text with at least
    ``least_words`` words (and at least k), in one order for all texts; ``documents`` holds
    their places in ``texts``. With ``distinct`` false, hashes repeat as shingles do.

    Null texts have no words.
    """
    if len(texts) > MOST_TEXTS:
        raise ValueError(f"at most {MOST_TEXTS} texts at a time")
    lowered = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts.to_pylist()]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    data = np.frombuffer(b"\x00".join(lowered) + b"\x00", np.uint8)
    word = np.zeros(len(data) + 2, np.bool_)
    word[1:-1] = _WORD[data]
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, stops = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint64)
    # Polynomial hash of each word: position weights restart at each word's first byte.
    length = stops - starts
    inside = np.flatnonzero(word[1:-1])
    place = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    weights = _powers(int(length.max()))
    values = (data[inside].astype(np.uint64) + np.uint64(1)) * weights[place]
    words = mix(np.add.reduceat(values, np.cumsum(length) - length) + length.astype(np.uint64))
    document = np.searchsorted(ends, starts, side="right")
    count = np.bincount(document, minlength=len(lowered))
    keep = count >= max(least_words, k)
    first = np.cumsum(count) - count
    # k consecutive words of one document, for all documents at once.
    n = len(words) - k + 1
    if n <= 0 or not keep.any():
        return np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint64)
    combined = np.zeros(n, np.uint64)
    for i in range(k):
        combined = combined * np.uint64(0xD1342543DE82EF95) + words[i : i + n]
    combined = mix(combined)
    whole = (np.arange(n) + k <= (first + count)[document[:n]]) & keep[document[:n]]
    hashes, owner = combined[whole], document[:n][whole]
    # 48 bits of hash under 16 bits of place in the batch: one plain sort orders all sets.
    rows = (owner.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16))
    if distinct:
        rows.sort()
        new = np.ones(len(rows), np.bool_)
        new[1:] = rows[1:] != rows[:-1]
        rows = rows[new]
    owner = (rows >> np.uint64(48)).astype(np.int64)
    hashes = mix(rows & np.uint64((1 << 48) - 1))
    documents = np.flatnonzero(keep)
    offsets = np.zeros(len(documents) + 1, np.int64)
    offsets[1:] = np.cumsum(np.bincount(owner, minlength=len(lowered))[documents])
    return documents, offsets, hashes


def set_prints(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One 64-bit print of each set."""
    if len(offsets) < 2:
        return np.empty(0, np.uint64)
    return mix(np.add.reduceat(mix(hashes), offsets[:-1]) + np.diff(offsets).astype(np.uint64))
