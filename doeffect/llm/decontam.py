"""Benchmark decontamination by winnowing.

Of every ``WINNOW`` consecutive word k-grams a text keeps the one of least
hash.  A run of ``SPAN`` = k + WINNOW - 1 words holds exactly one such
window, so any run that a document shares with a benchmark item leaves at
least one common fingerprint.  The item fingerprints are marked in a bitmap
of fixed size, and the documents' fingerprints are looked up there; around
each hit the runs of ``SPAN`` words that hold it are hashed and joined with
the runs of the items.  The bitmap only sheds what cannot match, so the
result is the same whatever the benchmark's size.

Items of fewer than ``SPAN`` words are one run of their own length, looked
up at every word.  NULL texts have no words, items without words are never
found, and items with a NULL id are left out.  An id that several items
share counts once.  Repeated documents each get their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .text import _GRAM, ALNUM, grams, mix, text_key, words_of

SPAN = 10
GRAM = 5
BITS = 24  # the bitmap has 2 ** BITS bits


def winnow(g: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    """Places of the k-grams that are the least of some ``width`` consecutive ones."""
    m = len(g) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    least = g[:m].copy()
    for j in range(1, width):
        np.minimum(least, g[j : j + m], out=least)
    whole = docs[:m] == docs[width - 1 :]
    kept = np.zeros(len(g), bool)
    for j in range(width):
        kept[j : j + m] |= whole & (g[j : j + m] == least)
    return np.flatnonzero(kept)


def runs_at(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` words from each start on."""
    h = hashes[starts].copy()
    with np.errstate(over="ignore"):
        for j in range(1, length):
            h = h * np.uint64(_GRAM) + hashes[starts + j]
        return mix(h + np.uint64(length))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def item_runs(items: DataFrame, span: int = SPAN, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``run, length, item``: every run of words to look for (item ids as text)."""

    def run(batches):
        for batch in batches:
            for i, j, hashes, docs, *_ in words_of(batch.column(1), ALNUM):
                count = np.bincount(docs, minlength=j - i)
                for length in sorted(set(np.minimum(count, span).tolist()) - {0}):
                    g, at = grams(hashes, docs, length)
                    mine = np.minimum(count[docs[at]], span) == length
                    ids = batch.column(0).slice(i, j - i).take(pa.array(docs[at][mine]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g[mine].view(np.int64)), pa.array(np.full(mine.sum(), length), pa.int32()), ids],
                        ["run", "length", "item"],
                    )

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.where(F.col("item").isNotNull()).mapInArrow(run, "run long, length int, item string").distinct()


def item_slots(items: DataFrame, span: int = SPAN, k: int = GRAM, text_col: str = "text") -> DataFrame:
    """``length, slot``: bitmap places of the fingerprints (length 0) and of runs shorter than ``span``."""

    def run(batches):
        for batch in batches:
            for i, j, hashes, docs, *_ in words_of(batch.column(0), ALNUM):
                g, at = grams(hashes, docs, k)
                found = [(0, g[winnow(g, docs[at], span - k + 1)])]
                count = np.bincount(docs, minlength=j - i)
                for length in sorted(set(count[(count > 0) & (count < span)].tolist())):
                    g, at = grams(hashes, docs, length)
                    found.append((length, g[count[docs[at]] == length]))
                for length, h in found:
                    slot = np.unique(_slot(h))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(slot), length), pa.int32()), pa.array(slot)], ["length", "slot"]
                    )

    return items.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "length int, slot long").distinct()


def candidates(docs: DataFrame, bitmaps: dict[int, np.ndarray], span: int = SPAN, k: int = GRAM) -> DataFrame:
    """``doc_id, key, n_words`` of every row (columns id, text, key), and the runs
    (hash, start, length) around its marked fingerprints."""
    width = span - k + 1
    kind = pa.list_(pa.struct([("run", pa.int64()), ("start", pa.int64()), ("length", pa.int32())]))
    shipped = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches):
        maps = shipped.value
        for batch in batches:
            for i, j, hashes, docs_of, *_ in words_of(batch.column(1), ALNUM):
                n = j - i
                bounds = np.searchsorted(docs_of, np.arange(n + 1))
                starts, lengths = [], []
                if 0 in maps:
                    g, at = grams(hashes, docs_of, k)
                    kept = winnow(g, docs_of[at], width)
                    kept = kept[maps[0][_slot(g[kept])]]
                    # The runs that hold the k-gram, within its document.
                    s = (at[kept][:, None] - np.arange(width)).ravel()
                    doc = np.repeat(docs_of[at[kept]], width)
                    s = np.unique(s[(s >= bounds[doc]) & (s + span <= bounds[doc + 1])])
                    starts.append(s)
                    lengths.append(np.full(len(s), span))
                for length in sorted(set(maps) - {0}):
                    g, at = grams(hashes, docs_of, length)
                    s = at[maps[length][_slot(g)]]
                    starts.append(s)
                    lengths.append(np.full(len(s), length))
                runs = [runs_at(hashes, s, int(w[0])) if len(s) else np.zeros(0, np.uint64) for s, w in zip(starts, lengths)]
                s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
                w = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
                h = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
                doc = docs_of[s]
                order = np.argsort(doc, kind="stable")
                s, w, h, doc = s[order], w[order], h[order], doc[order]
                offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(s - bounds[doc]), pa.array(w, pa.int32())], fields=list(kind.value_type)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n),
                        batch.column(2).slice(i, n),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), values).cast(kind),
                    ],
                    ["doc_id", "key", "n_words", "runs"],
                )

    return docs.mapInArrow(run, "doc_id long, key long, n_words long, runs array<struct<run:long,start:long,length:int>>")


def find(
    docs: DataFrame,
    items: DataFrame,
    span: int = SPAN,
    k: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: ``doc_id, key`` (a hash of the text), ``n_words``, the covered ``places`` (start, length) and the ``items`` found."""
    ensure_checkpoint_dir(docs.sparkSession)
    bitmaps: dict[int, np.ndarray] = {}
    part = 1 << 16
    packed = (
        item_slots(items, span, k)
        .groupBy("length", F.floor(F.col("slot") / part).alias("part"))
        .agg(F.collect_set((F.col("slot") % part).cast("int")).alias("places"))
    )
    # At most 2 ** BITS places a length, and as many lengths as words in a run.
    for length, at, places in zip(*packed.toArrow().columns):
        bitmap = bitmaps.setdefault(length.as_py(), np.zeros(1 << BITS, bool))
        bitmap[at.as_py() * part + places.values.to_numpy()] = True
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), text_key(text_col).alias("key"))
    rows = candidates(rows, bitmaps, span, k).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    found = (
        rows.select("row", F.inline("runs"))
        .join(item_runs(items, span).groupBy("run", "length").agg(F.collect_set("item").alias("items")), ["run", "length"])
        .groupBy("row")
        .agg(
            F.sort_array(F.collect_set(F.struct("start", "length"))).alias("places"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    return rows.drop("runs").join(found, "row", "left").drop("row")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` in whose text no run of an item occurs."""
    found = find(docs, items, id_col=id_col, text_col=text_col, **settings)
    bad = found.where(F.col("places").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (text_key(text_col) == F.col("__key"))
    return docs.join(bad, same, "left_anti")


def digest(found: DataFrame) -> DataFrame:
    """Words covered, items found and their checksum."""
    covered = F.aggregate(
        F.coalesce("places", F.array().cast("array<struct<start:long,length:int>>")),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, p: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), p["start"] + p["length"] - F.greatest(acc["upto"], p["start"]))).alias("n"),
            F.greatest(acc["upto"], p["start"] + p["length"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("places").isNotNull().alias("contaminated"),
    )


def oracle_sql(span: int = SPAN) -> str:
    """The digest in DuckDB, over the tables ``documents`` and ``benchmark``."""
    words = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {words} AS words FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS words FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT *, least({span}, len(words)) AS n FROM items WHERE len(words) > 0),
runs AS (
  SELECT DISTINCT item, n, array_to_string(words[i:i + n - 1], ' ') AS run
  FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM sized)),
places AS (
  SELECT row, n, i, array_to_string(words[i:i + n - 1], ' ') AS run
  FROM (SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM runs))),
hits AS (SELECT row, i, n, item FROM places JOIN runs USING (n, run)),
covered AS (
  SELECT row, count(DISTINCT w) AS n_hit
  FROM (SELECT row, unnest(range(i, i + n)) AS w FROM (SELECT DISTINCT row, i, n FROM hits)) GROUP BY row),
found AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (row) LEFT JOIN found USING (row)
"""
