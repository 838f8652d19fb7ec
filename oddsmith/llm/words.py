"""Words, shingles and hashes of many texts at once.

Texts lie behind one another as UTF-8 bytes, as Arrow keeps them. A word is
``[^\\x20\\x09-\\x0D]+``; A-Z count as a-z. All hashes have 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits; no two values meet."""
    h = h ^ (h >> np.uint64(30))
    h *= _K1
    h ^= h >> np.uint64(27)
    h *= _K2
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    up, down = np.full(n, base), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    return _powers(max(1 << 20, 1 << max(n - 1, 0).bit_length()))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWERED = _VALUES.copy()
_LOWERED[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Texts:
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than there are texts

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array) -> Texts:
    """The bytes of a string or binary column; null is empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    if data is None or at[-1] == at[0]:
        return Texts(np.zeros(0, np.uint8), at - at[0])
    return Texts(np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]), at - at[0])


def prefix_sums(texts: Texts, lower: bool = False) -> np.ndarray:
    """Sums from which ``substring_hash`` tells the hash of any substring."""
    n = len(texts.data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWERED if lower else _VALUES)[texts.data] * powers(n)[0][:n], out=sums[1:])
    return sums


def substring_hash(sums: np.ndarray, starts, ends) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # of each word
    first: np.ndarray  # number of each text's first word, and of the end
    hashes: np.ndarray


#: Bytes of plain words: letters, digits, and all of other scripts.
PLAIN = np.ones(256, bool)
PLAIN[:128] = [chr(b).isalnum() for b in range(128)]


def words_of(texts: Texts, plain: bool = False) -> Words:
    """The words; or with ``plain`` runs of letters and digits, without punctuation."""
    n = len(texts.data)
    inside = (PLAIN if plain else ~_SPACE)[texts.data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = texts.offsets[(texts.offsets > 0) & (texts.offsets < n)]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(starts, texts.offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(starts, ends, doc, first, substring_hash(prefix_sums(texts, True), starts, ends))


def shingles(words: Words, size: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and hash of each run of ``size`` words. With ``whole``, a text
    of fewer words is one run."""
    h, doc = words.hashes, words.doc
    n = max(len(h) - size + 1, 0)
    run = h[:n].copy()
    for j in range(1, size):
        run = run * _NEXT + h[j : n + j]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :][:n])
    docs, places, hashes = [doc[at]], [at], [run[at]]
    counts = np.diff(words.first)
    for length in range(1, size) if whole else ():
        short = np.flatnonzero(counts == length)
        begin = words.first[short]
        run = np.full(len(short), length, np.uint64)
        for j in range(length):
            run = run * _NEXT + h[begin + j]
        docs.append(short)
        places.append(begin)
        hashes.append(run)
    docs, places, hashes = map(np.concatenate, (docs, places, hashes))
    return docs, places, mix(hashes)


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct shingle, ordered by text, then by signed hash."""
    doc, _, h = shingles(words_of(texts), size)
    h = h.view(np.int64)
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of ranges of ``n`` from ``begin``, one range behind another."""
    n = np.asarray(n).astype(np.int64)
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
