"""Importance resampling towards a target: hashed n-gram weights, exact ranks.

A document's features are its runs of one to three words, in buckets of their
checksum.  The buckets' shares in the target texts and in all documents give
each bucket a gain; a document's weight is the sum over its features.  Noise
that depends on the document alone (Gumbel) is added, so that the documents
of highest score are a draw without replacement by weight.

Ranks come from parallel sorting by regular sampling:

1. every task sorts its run and names every w-th row of it (``SAMPLES`` rows
   in all at most, beside one a run);
2. the sorted sample gives splitters that cut all rows into ranges of about
   equal size, equal scores told apart by id and place;
3. segments are exchanged; each range is merged (sorted) on its own and its
   rows are numbered;
4. the numbers of rows before each range (one row a range) make the ranks.

So no task sorts more than a range, whatever the ties, and the result does not
depend on partitions, but for which of several equal rows gets which rank.

NULL and empty texts have no features and weight 0; they and others of less
than the least number of words are never drawn.  A NULL id hashes as an empty
one and comes last among equal scores.  Repeated rows count each.  An empty
table has no rows; without target texts all target shares are the smoothing.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .text import ALNUM, words_of

BUCKETS = 10_000
LONGEST = 3  # words of a feature
LEAST_WORDS = 20
DRAW_PERCENT = 5
SEED = 42
SAMPLES = 1 << 20
SHORT = 32  # bytes; longer words have their checksum one by one

SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


# --- checksums of word runs ---------------------------------------------------


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _byte_table()
SPACE = np.uint32(zlib.crc32(b" "))


def _zeros_table(most: int = 256) -> np.ndarray:
    """What ``n`` following zero bytes make of each byte of a checksum: [n, place, byte]."""
    c = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    out = np.empty((most, 1024), np.uint32)
    for n in range(most):
        out[n] = c
        c = CRC[c & 255] ^ (c >> 8)
    return out.ravel()


ZEROS = _zeros_table()


def followed(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The checksums after ``n`` more bytes, but for those bytes' own part."""
    out = crc
    n = np.asarray(n)
    while True:
        base = np.minimum(n, 255) * 1024
        out = (
            ZEROS[base + (out & 255)]
            ^ ZEROS[base + 256 + ((out >> 8) & 255)]
            ^ ZEROS[base + 512 + ((out >> 16) & 255)]
            ^ ZEROS[base + 768 + (out >> 24)]
        )
        n = np.maximum(n - 255, 0)
        if not n.any():
            return out


def word_checksums(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each word: all first bytes at once, then all second ones, and so on."""
    size = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    by_size = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    count = np.bincount(np.minimum(size, SHORT + 1), minlength=SHORT + 2)
    longer = len(starts) - np.cumsum(count)  # words of more than that many bytes
    run, first = crc[by_size], starts[by_size]
    n_long = int(count[SHORT + 1])
    for k in range(SHORT):
        m = int(longer[k])
        if m <= n_long:
            break
        part = run[n_long:m]
        run[n_long:m] = CRC[(part ^ codes[first[n_long:m] + k]) & 255] ^ (part >> 8)
    crc[by_size] = run ^ np.uint32(0xFFFFFFFF)
    for w in by_size[:n_long].tolist():
        crc[w] = zlib.crc32(codes[starts[w] : ends[w]].tobytes())
    return crc


def features(column, buckets: int, longest: int):
    """Blocks of a text column: (first document, documents, words of each, and by
    feature length the buckets and documents of the features)."""
    for i, j, _, docs, codes, starts, ends in words_of(column, ALNUM):
        word = word_checksums(codes, starts, ends)
        size = ends - starts
        one = np.ones(1, np.int64)
        runs, crc = [], word
        for k in range(1, longest + 1):
            if k > 1:
                # One word more: what is there, a space, the next word.
                m = max(len(word) - k + 1, 0)
                crc = followed(followed(crc[:m], one) ^ SPACE, size[k - 1 : k - 1 + m]) ^ word[k - 1 : k - 1 + m]
            same = np.flatnonzero(docs[: len(crc)] == docs[k - 1 : k - 1 + len(crc)])
            runs.append(((crc[same] % np.uint32(buckets)).astype(np.int64), docs[same]))
        yield i, j - i, np.bincount(docs, minlength=j - i), runs


def bucket_counts(texts: DataFrame, buckets: int, longest: int, text_col: str = "text") -> list[int]:
    """Features of all texts by bucket (one row a bucket to the driver)."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, runs in features(batch.column(0), buckets, longest):
                for bucket, _ in runs:
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    out = [0] * buckets
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """Of each bucket, the log of its smoothed target share over its source share, in thousandths."""
    b, s, t = len(source), sum(source), sum(target)
    return np.array(
        [math.floor(1000 * math.log(((y + 1) * (s + b)) / ((x + 1) * (t + b)))) for x, y in zip(source, target)], np.int64
    )


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of a document in thousandths, from a hash of its id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(
    docs: DataFrame,
    gain: np.ndarray,
    longest: int = LONGEST,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, m, words, runs in features(batch.column(1), buckets, longest):
                weight, n = np.zeros(m, np.int64), np.zeros(m, np.int64)
                for bucket, doc in runs:
                    n += np.bincount(doc, minlength=m)
                    upto = np.append(0, np.cumsum(gain[bucket]))
                    edge = np.searchsorted(doc, np.arange(m + 1))
                    weight += upto[edge[1:]] - upto[edge[:-1]]
                extra = np.array([noise(x, seed) for x in ids[i : i + m]], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, m), *[pa.array(c) for c in (words.astype(np.int64), n, weight, weight + extra)]],
                    ["doc_id", "n_words", "n_features", "weight", "score"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCORED)


# --- ranks ---------------------------------------------------------------------


def ranked(rows: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, ...) by falling ``score``, then by ``doc_id``
    (NULL last), by parallel sorting by regular sampling."""
    order = [F.col("worse"), F.col("none"), F.col("__id"), F.col("at")]
    names = ["worse", "none", "__id", "at"]
    # Sorted runs, kept: three passes read them.  ``at`` tells equal rows apart.
    runs = (
        rows.select(
            "*",
            (-F.col("score")).alias("worse"),
            F.col("doc_id").isNull().cast("long").alias("none"),
            F.coalesce("doc_id", F.lit(0)).alias("__id"),
            F.monotonically_increasing_id().alias("at"),
        )
        .sortWithinPartitions(*order)
        .checkpoint()
    )
    sizes = runs.groupBy(F.spark_partition_id().alias("run")).agg(F.count(F.lit(1)).alias("n"))
    n_runs, n = sizes.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = max(1, n // max(1, min(ranges * n_runs, samples)))

    def every(batches):
        seen = 0
        for batch in batches:
            at = np.arange(-seen % step, batch.num_rows, step)
            seen += batch.num_rows
            yield batch.take(pa.array(at))

    sample = runs.select(*names).mapInArrow(every, "worse long, none long, __id long, at long").collect()
    sample = np.array(sorted(tuple(r) for r in sample), np.int64).reshape(-1, 4)
    cuts = np.unique(np.arange(1, ranges) * len(sample) // ranges)
    splitters = sample[cuts] if len(sample) else sample

    def numbers(batches):
        for batch in batches:
            keys = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names])
            both = np.concatenate((splitters, keys))
            # A splitter comes before the row that it was taken from.
            rank = np.lexsort((np.arange(len(both)), *both.T[::-1]))
            passed = np.cumsum(rank < len(splitters))
            segment = np.empty(len(both), np.int64)
            segment[rank] = passed
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(segment[len(splitters) :], pa.int32())], [*batch.schema.names, "segment"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    cut = runs.mapInArrow(numbers, f"{kinds}, segment int")
    # One row a range: how many rows lie before it.
    sizes = cut.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("segment").orderBy(*order))
    merged = cut.withColumn("place", within.cast("long")).join(F.broadcast(offsets), "segment")
    return merged.withColumn("rank", F.col("before") + F.col("place")).select(*rows.columns, "rank")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = DRAW_PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` is
    NULL for those not drawn."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, buckets, longest, text_col), bucket_counts(target, buckets, longest, text_col))
    folder = scratch_dir(spark, "resampling")
    score(docs, gain, longest, seed, id_col, text_col).write.parquet(folder)
    scored = spark.read.parquet(folder)
    long_enough = scored.where(F.col("n_words") >= least_words)
    drawn = long_enough.count() * percent // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    columns = ["doc_id", "n_features", "weight", "score"]
    few = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(long_enough).select(*columns, rank.alias("rank")).unionByName(few)
