"""Vectorised word splitting and hashing over Arrow string columns.

Texts are handled as the UTF-8 bytes of an Arrow batch, in blocks of whole
documents; nothing is decoded.  Both word classes of this package can be
told apart byte by byte: every byte of a non-ASCII character is 0x80 or
more, and belongs to a word in either class.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20

# Multipliers of the 64-bit hashes (odd numbers).
_STEP = 0x9E3779B97F4A7C15
_GRAM = 0xD1342543DE82EF95
_MIX1 = 0xFF51AFD7ED558CCD
_MIX2 = 0xC4CEB9FE1A85EC53


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def _alnum() -> np.ndarray:
    """Digits, letters and all non-ASCII bytes: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, after lower-casing."""
    t = np.zeros(256, bool)
    t[48:58] = t[97:123] = t[128:] = True
    return t


def _nonspace() -> np.ndarray:
    """Everything but ``[\\x20\\x09-\\x0D]``."""
    t = np.ones(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = False
    return t


LOWER = _lower_table()
ALNUM = _alnum()
NONSPACE = _nonspace()


def worker_cache() -> dict:
    """A dictionary of this Python process, kept from task to task."""
    name = "_doeffect_llm_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


def text_key(text_col: str = "text") -> Column:
    """A 64-bit hash of the text; NULL is like an empty text."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of an Arrow string column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)
    off = off[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """Ranges (i, j) of whole documents of at most ``most`` bytes (or one document)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spans(codes: np.ndarray, bounds: np.ndarray, word: np.ndarray):
    """Start, end (bytes) and document of every word; no word crosses ``bounds``."""
    m = word[codes]
    if not m.any():
        z = np.zeros(0, np.int64)
        return z, z, z
    before, after = np.empty_like(m), np.empty_like(m)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = m[:-1], m[1:]
    first = bounds[:-1]
    before[first[first < len(m)]] = False
    last = bounds[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(bounds[1:], starts, "right")


def _powers(n: int):
    cache = worker_cache()
    if len(cache.get("pow", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("pow", _STEP), ("inv", pow(_STEP, -1, 1 << 64))):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                cache[name] = np.cumprod(p, dtype=np.uint64)
            cache["byte"] = mix(np.arange(1, 257, dtype=np.uint64))
    return cache["pow"], cache["inv"], cache["byte"]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(_MIX1)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(_MIX2)
        return h ^ (h >> np.uint64(33))


def word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, mixed with its length."""
    power, inverse, byte = _powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(byte[codes] * power[: len(codes)], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(_GRAM))


def grams(hashes: np.ndarray, docs: np.ndarray, k: int):
    """Hashes of the k consecutive words from each word on, and the words where
    such a run starts (it ends in the same document)."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = hashes[:m].copy()
        for j in range(1, k):
            g *= np.uint64(_GRAM)
            g += hashes[j : j + m]
        at = np.flatnonzero(docs[:m] == docs[k - 1 :])
        return mix(g[at] + np.uint64(k)), at


def words_of(column, word: np.ndarray, lower: bool = True, most: int = BLOCK_BYTES):
    """Blocks of a column: (first document, one past the last, word hashes,
    document of each word from 0, bytes, starts, ends)."""
    data, off = utf8(column)
    for i, j in blocks(off, most):
        codes = data[off[i] : off[j]]
        codes = LOWER[codes] if lower else codes
        starts, ends, docs = spans(codes, off[i : j + 1] - off[i], word)
        yield i, j, word_hashes(codes, starts, ends), docs, codes, starts, ends


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that ``words_of`` gives to these words (lower case already)."""
    raw = [w.encode() for w in words]
    codes = np.frombuffer(b" ".join(raw), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in raw]) - 1
    starts = ends - np.array([len(w) for w in raw])
    return word_hashes(codes, starts, ends)
