"""Packing by power-of-two decomposition.

A document's token ids (its end id included) are cut into pieces whose
lengths are powers of two: as many whole sequences as it fills, then the
binary digits of the rest.  Every piece is a sequence of its own, so no
sequence crosses documents and none needs padding; pieces of equal length
form a bucket that a trainer reads as one batch shape.

Rows: NULL text counts as empty (the end id alone), repeated rows and NULL
ids are packed like any other; other columns are ignored.  Nothing is
shuffled; a task holds one Arrow batch of texts.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import worker_cache

SEQUENCE_TOKENS = 2048
END_ID = 1
LONG_RUN = 400  # bytes without (or of nothing but) white space

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def piece_lengths(n: int, most: int = SEQUENCE_TOKENS) -> list[int]:
    """Powers of two that add up to ``n``, none above ``most`` (itself a power of two)."""
    out = [most] * (n // most)
    rest = n % most
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Encoder:
    """Token ids as the ``tokenizers`` library gives them for ``json_path``.

    The same vocabulary in rank form (``ranks_path``) is encoded several
    times faster by tiktoken; it serves texts whose characters are below
    U+0240 (where both libraries agree on letters and digits) and that have
    no very long run.  All other texts go to ``tokenizers``.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        self.json_path, self._full = json_path, None
        self._fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            with open(json_path) as f:
                self._special = [t["content"] for t in json.load(f).get("added_tokens", [])]

    def full(self, text: str) -> list[int]:
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self.json_path)
        return self._full.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if self._fast is None or any(s in text for s in self._special) or not _plain(text):
            return self.full(text)
        return self._fast.encode_ordinary(text)


def _plain(text: str) -> bool:
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return True
    if raw.max() >= 0xC9:
        return False
    gaps = np.concatenate(([-1], np.flatnonzero(raw <= 32), [len(raw)]))
    if np.diff(gaps).max() > LONG_RUN:
        return False
    return len(gaps) <= LONG_RUN or bool((gaps[LONG_RUN:] - gaps[:-LONG_RUN]).min() > LONG_RUN)


def vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    """Paths of the installed vocabulary in both forms, and its pattern."""
    import public_tokenizers as P

    return P.path(f"{name}.json"), P.path(f"{name}.tiktoken"), P.PATTERN


def pack(
    docs: DataFrame,
    encoder_files: tuple[str, str | None, str | None],
    most: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, ids`` (little-endian
    unsigned 32-bit ids), with ``bucket`` (its length), ``sequence_id`` and ``offset``."""
    if most & (most - 1):
        raise ValueError("most must be a power of two")

    def encode(batches):
        cache = worker_cache()
        key = ("encoder", encoder_files)
        if key not in cache:
            cache[key] = Encoder(*encoder_files)
        encoder = cache[key]
        cuts: dict[int, list[int]] = {}
        for batch in batches:
            doc, start, length, tokens, ids = [], [], [], [], []
            held = 0
            for d, t in zip(batch.column(0), batch.column(1)):
                got = encoder.ids(t.as_py() or "")
                got.append(end_id)
                raw, n, at = np.array(got, "<u4").tobytes(), len(got), 0
                if n not in cuts:
                    cuts[n] = piece_lengths(n, most)
                for size in cuts[n]:
                    doc.append(d.as_py())
                    start.append(at)
                    length.append(size)
                    tokens.append(n)
                    ids.append(raw[4 * at : 4 * (at + size)])
                    at += size
                held += len(raw)
                if held > 1 << 22:
                    yield _batch(doc, start, length, tokens, ids)
                    doc, start, length, tokens, ids, held = [], [], [], [], [], 0
            if doc:
                yield _batch(doc, start, length, tokens, ids)

    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pieces.mapInArrow(encode, PIECES).select(
        "*",
        F.col("length").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def _batch(doc, start, length, tokens, ids) -> pa.RecordBatch:
    long = pa.int64()
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, long), pa.array(start, long), pa.array(length, long), pa.array(tokens, long), pa.array(ids, pa.binary())],
        ["doc_id", "start", "length", "doc_tokens", "ids"],
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the pieces as one folder per length, for batches of equal shape."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )
