"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots.  Two vectors that
are near each other see the pivots in nearly the same order, so candidates are
ranked by the footrule distance of their orders, and the best of them are
reranked by the true measure, the inner product in double precision.

1. Equal vectors become one (a task drops its own copies first), with the
   least ids of its copies: as many as an answer can hold.  So a vector that
   holds a third of all rows is one entry of the index and one query.
2. Pivots are distinct vectors of the table, those of least hash: a bounded
   sample (``PIVOTS``, or as many as there are list heads).  Every distinct
   vector is indexed.  Inner products are turned into distances by one more
   coordinate, which gives all vectors the length of the longest.
3. The first pivots head the inverted lists.  A vector is posted in the list
   of its nearest head; a query asks the lists of its nearest ``PROBES``
   heads.  Heads grow with the root of the table, so lists do too, while a
   vector moves once and a query at most ``PROBES`` times.  Small lists share
   a block, a long list is split over several.
4. A task holds one block: its vectors and, per pivot, the places at which
   its vectors' orders have that pivot.  Queries stream past.  The lists of a
   query's pivots add up the footrule distance to every vector of the block;
   all whose distance is at most that of the ``KEEP``-th (or ``SHARE`` of the
   block) are reranked.  Answers of blocks are merged by query.

The cut by footrule distance is what makes the search approximate; with
``share=1`` and ``probes`` at least the number of heads the answer is exact.

Rows with a NULL id, and vectors that are NULL, zero, hold a NULL or
non-finite entry, or are not of the table's commonest length, take no part.
Repeated rows (same id and vector) count once; a query's own id is never its
neighbour.  Of equal products the smaller id comes first.  An empty table, or
one without queries, gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from .vectors import dimension, element, finite_rows, vector_column

EVERY = 20  # ids divisible by this are queries
NEAREST = 20
PIVOTS = 1024  # at least (if there are as many distinct vectors)
MOST_HEADS = 4096  # list heads, whatever the table's size
PREFIX = 64  # nearest pivots that represent a vector
PROBES = 32  # lists that a query asks
BLOCKS = 8  # at least (of lists, as far as there are rows)
BLOCK_ROWS = 1 << 18  # at most
SHARE = 0.1  # of a block's vectors that are reranked
KEEP = 320  # at least so many are reranked
CELLS = 1 << 22  # footrule distances that a task holds at a time

DISTINCT = "vec binary, ids array<long>, asks boolean"
ROUTED = "block int, asks boolean, vec binary, ids binary"
FOUND = "vec binary, found array<struct<worse:double,id:long>>"


def entries(table: DataFrame, d: int, id_col: str, vec_col: str, copies: int, every: int) -> DataFrame:
    """``vec, ids, asks``: every distinct vector that takes part (its bytes), the
    least ``copies`` ids that have it, and whether one of its ids is a query."""

    def fold(batches):
        full: dict[bytes, int] = {}  # vectors with enough ids already, and the largest of those
        for batch in batches:
            at, matrix = finite_rows(batch.column(1), d)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
            some = (matrix != 0).any(axis=1)
            matrix, ids = matrix[some] + 0, ids[some].astype(np.int64)  # -0 becomes 0
            if not len(ids):
                continue
            rows = np.ascontiguousarray(matrix).view(f"V{matrix.itemsize * d}").ravel()
            _, same = np.unique(rows, return_inverse=True)
            order = np.lexsort((ids, same))
            rows, ids, same = rows[order], ids[order], same[order]
            starts = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
            vecs, lists, asks = [], [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
                vec, mine = rows[a].tobytes(), ids[a:b]
                ask = bool((mine % every == 0).any())
                if b - a > 1:
                    mine = np.unique(mine)[:copies]
                    if vec in full:
                        mine = mine[mine < full[vec]]
                    elif len(mine) == copies:
                        full[vec] = int(mine[-1])
                if len(mine) or ask:
                    vecs.append(vec)
                    lists.append(mine)
                    asks.append(ask)
            offsets = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([pa.array(vecs, pa.binary()), held, pa.array(asks)], ["vec", "ids", "asks"])

    rows = table.select(F.col(id_col).cast("long").alias("id"), vector_column(table, vec_col).alias("v"))
    rows = rows.where(F.col("id").isNotNull()).mapInArrow(fold, DISTINCT)
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, copies)
    return rows.groupBy("vec").agg(least.alias("ids"), F.max("asks").alias("asks"))


class Pivots:
    """Orders of the nearest pivots, by inner product."""

    def __init__(self, pivots: np.ndarray, heads: int, longest: float, scale: float):
        self.heads, self.longest, self.scale = heads, longest, scale
        self.axes = self.lengthened(pivots).T

    def lengthened(self, vectors: np.ndarray) -> np.ndarray:
        """The vectors with one more coordinate, all as long as the longest."""
        v = vectors.astype(np.float64) / self.scale
        rest = np.sqrt(np.maximum(self.longest**2 - (v * v).sum(axis=1), 0))
        return np.column_stack((v, rest))

    def near(self, vectors: np.ndarray, asking: bool) -> np.ndarray:
        """Nearness of each pivot (columns) to each vector; a query has no length to make up."""
        if not asking:
            return self.lengthened(vectors) @ self.axes
        return (vectors.astype(np.float64) / self.scale) @ self.axes[:-1]

    def order(self, near: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` nearest pivots in order, of equally near ones the first."""
        return np.argsort(-near, axis=1, kind="stable")[:, :most]


def deal(counts: dict[int, int], heads: int, least_blocks: int, block_rows: int) -> list[list[int]]:
    """The blocks of each list: short lists share one, long ones have several."""
    room = max(1, min(block_rows, -(-sum(counts.values()) // least_blocks)))
    blocks: list[list[int]] = []
    last, left = -1, 0
    for head in range(heads):
        n = counts.get(head, 0)
        if n > room:
            parts = -(-n // room)
            blocks.append([last + 1 + p for p in range(parts)])
            last, left = last + parts, 0
            continue
        if n > left or last < 0:
            last, left = last + 1, room
        left -= n
        blocks.append([last])
    return blocks


def route(index: DataFrame, pivots: Pivots, blocks: list[list[int]], dtype, probes: int) -> DataFrame:
    """Every vector at its block, and every query at the blocks of its lists."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs, lists = batch.column(0), batch.column(1)
            matrix = np.frombuffer(b"".join(vecs.to_pylist()), dtype).reshape(batch.num_rows, -1)
            ids = [np.asarray(x, np.int64).tobytes() for x in lists.to_pylist()]
            raw = vecs.to_pylist()
            home = pivots.near(matrix, False)[:, : pivots.heads].argmax(axis=1)
            block, asks, row = [], [], []
            for k, head in enumerate(home.tolist()):
                own = blocks[head]
                block.append(own[0] if len(own) == 1 else own[zlib.crc32(raw[k]) % len(own)])
                asks.append(False)
                row.append(k)
            asking = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            if len(asking):
                nearest = pivots.order(pivots.near(matrix[asking], True)[:, : pivots.heads], probes)
                for k, listed in zip(asking.tolist(), nearest.tolist()):
                    for b in sorted({b for head in listed for b in blocks[head]}):
                        block.append(b)
                        asks.append(True)
                        row.append(k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block, pa.int32()),
                    pa.array(asks),
                    pa.array([raw[k] for k in row], pa.binary()),
                    pa.array([b"" if a else ids[k] for k, a in zip(row, asks)], pa.binary()),
                ],
                ["block", "asks", "vec", "ids"],
            )

    return index.mapInArrow(run, ROUTED)


class Block:
    """The inverted files of one block: per pivot, the vectors that have it among
    their nearest, and its place there."""

    def __init__(self, matrix: np.ndarray, ids: list[np.ndarray], pivots: Pivots, prefix: int):
        self.matrix, self.ids, self.pivots, self.prefix = matrix, ids, pivots, prefix
        order = np.concatenate([pivots.order(pivots.near(m, False), prefix) for m in self._parts(matrix)])
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.rows = (by_pivot // prefix).astype(np.int32)
        self.places = (by_pivot % prefix).astype(np.int16)
        self.bounds = np.searchsorted(order.ravel()[by_pivot], np.arange(pivots.axes.shape[1] + 1))

    @staticmethod
    def _parts(matrix: np.ndarray, rows: int = 2048):
        return [matrix[i : i + rows] for i in range(0, len(matrix), rows)]

    def likeness(self, queries: np.ndarray) -> np.ndarray:
        """For each query and vector how far the footrule distance stays below its
        largest value: a pivot in both orders takes off the prefix length less
        the distance of its places."""
        order = self.pivots.order(self.pivots.near(queries, True), self.prefix)
        alike = np.zeros((len(queries), len(self.matrix)), np.int32)
        flat = alike.reshape(-1)
        asked = order.ravel()
        by_pivot = np.argsort(asked, kind="stable")
        found, first, n = np.unique(asked[by_pivot], return_index=True, return_counts=True)
        for pivot, a, k in zip(found.tolist(), first.tolist(), n.tolist()):
            lo, hi = self.bounds[pivot], self.bounds[pivot + 1]
            if lo == hi:
                continue
            who, place = np.divmod(by_pivot[a : a + k], self.prefix)
            apart = np.abs(place[:, None] - self.places[lo:hi][None, :])
            # A vector has a pivot once, so no cell occurs twice here.
            flat[who[:, None] * len(self.matrix) + self.rows[lo:hi][None, :]] += (self.prefix - apart).astype(np.int32)
        return alike

    def search(self, queries: np.ndarray, nearest: int, share: float, keep: int):
        """Ids and products of the nearest of each query in this block."""
        n = len(self.matrix)
        most = min(n, max(keep, math.ceil(share * n)))
        step = max(1, CELLS // n)
        for i in range(0, len(queries), step):
            part = queries[i : i + step]
            if most < n:
                alike = self.likeness(part)
                # Equally distant vectors are all reranked.
                least = np.partition(alike, n - most, axis=1)[:, n - most]
            for k, q in enumerate(part.astype(np.float64)):
                rows = np.flatnonzero(alike[k] >= least[k]) if most < n else np.arange(n)
                with np.errstate(over="ignore", invalid="ignore"):
                    score = self.matrix[rows].astype(np.float64) @ q
                score[np.isnan(score)] = -np.inf  # products that overflow both ways
                if len(rows) > nearest:
                    best = score >= np.partition(score, len(score) - nearest)[len(score) - nearest]
                    rows, score = rows[best], score[best]
                held = [self.ids[r] for r in rows.tolist()]
                ids = np.concatenate(held)
                score = np.repeat(score, [len(x) for x in held])
                order = np.lexsort((ids, -score))[:nearest]
                yield ids[order], score[order]


def look_up(
    routed: DataFrame, n_blocks: int, pivots: Pivots, dtype, nearest: int, prefix: int, share: float, keep: int
) -> DataFrame:
    """Answers of each block to each query sent to it."""

    def run(batches):
        current, held, ids, block = None, [], [], None
        for batch in batches:
            at = batch.column(0).to_numpy()
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1 if len(at) else []
            for a, b in zip([0, *cut], [*cut, len(at)]):
                if a == b:
                    continue
                if at[a] != current:
                    current, held, ids, block = at[a], [], [], None
                raw = batch.column(2).slice(a, b - a).to_pylist()
                matrix = np.frombuffer(b"".join(raw), dtype).reshape(b - a, -1)
                if not asks[a]:
                    held.append(matrix)
                    ids += [np.frombuffer(x, np.int64) for x in batch.column(3).slice(a, b - a).to_pylist()]
                    continue
                if not held:
                    continue  # no vector at this block
                if block is None:
                    block = Block(np.concatenate(held), ids, pivots, prefix)
                answers = list(block.search(matrix, nearest, share, keep))
                offsets = np.append(0, np.cumsum([len(x) for x, _ in answers])).astype(np.int32)
                cells = pa.StructArray.from_arrays(
                    [pa.array(-np.concatenate([s for _, s in answers])), pa.array(np.concatenate([x for x, _ in answers]))],
                    ["worse", "id"],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(raw, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), cells)], ["vec", "found"]
                )

    # As many tasks as blocks at least: a block is few bytes and much work, so
    # it is not merged with others by its bytes.
    tasks = max(n_blocks, int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return routed.repartition(tasks, "block").sortWithinPartitions("block", "asks").mapInArrow(run, FOUND)


def search(
    table: DataFrame,
    nearest: int = NEAREST,
    every: int = EVERY,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    prefix: int = PREFIX,
    probes: int = PROBES,
    share: float = SHARE,
    keep: int = KEEP,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: of every row whose id is divisible by
    ``every`` the ``nearest`` other rows found."""
    spark = table.sparkSession
    d = dimension(table, vec_col)
    dtype = element(table, vec_col)
    folder = scratch_dir(spark, "permutation-index")
    # One more than the answer holds: the query itself is among them.
    entries(table, d, id_col, vec_col, nearest + 1, every).write.parquet(folder)
    index = spark.read.parquet(folder)

    def extent(batches):
        for batch in batches:
            if batch.num_rows:
                m = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype).reshape(batch.num_rows, -1).astype(np.float64)
                top = float(np.abs(m).max())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(m)]), pa.array([top]), pa.array([top * float(np.sqrt(((m / top) ** 2).sum(axis=1)).max())])],
                    ["n", "top", "longest"],
                )

    sizes = index.select("vec").mapInArrow(extent, "n long, top double, longest double")
    size = sizes.agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.max("longest").alias("longest")).first()
    n = size["n"] or 0
    heads = max(1, min(n, MOST_HEADS, math.ceil(math.sqrt(n) / 4)))
    scale = size["top"] or 1.0
    sample = index.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(max(PIVOTS, heads)).collect()
    matrix = np.frombuffer(b"".join(bytes(r.vec) for r in sample), dtype).reshape(len(sample), -1) if sample else np.zeros((1, max(d, 1)), dtype)
    pivots = Pivots(matrix, heads, (size["longest"] or 0.0) / scale, scale)

    def homes(batches):
        for batch in batches:
            if batch.num_rows:
                m = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype).reshape(batch.num_rows, -1)
                head, n_rows = np.unique(pivots.near(m, False)[:, : pivots.heads].argmax(axis=1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(head, pa.int32()), pa.array(n_rows)], ["head", "n"])

    # A row a list head.
    counts = index.select("vec").mapInArrow(homes, "head int, n long").groupBy("head").agg(F.sum("n").alias("n")).collect()
    blocks = deal({r["head"]: r["n"] for r in counts}, heads, BLOCKS, BLOCK_ROWS)
    prefix = min(prefix, len(matrix))
    n_blocks = 1 + max(b for own in blocks for b in own)
    routed = route(index, pivots, blocks, dtype, probes)
    answers = look_up(routed, n_blocks, pivots, dtype, nearest + 1, prefix, share, keep)
    merged = answers.groupBy("vec").agg(F.flatten(F.collect_list("found")).alias("found"))
    merged = merged.select(F.md5("vec").alias("same"), F.slice(F.array_sort("found"), 1, nearest + 1).alias("found"))

    def asking(batches):
        for batch in batches:
            at, m = finite_rows(batch.column(1), d)
            some = (m != 0).any(axis=1)
            at, m = at[some], m[some] + 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in m], pa.binary())], ["query_id", "vec"]
            )

    rows = table.select(F.col(id_col).cast("long").alias("id"), vector_column(table, vec_col).alias("v"))
    queries = rows.where(F.col("id") % every == 0).mapInArrow(asking, "query_id long, vec binary")
    queries = queries.select("query_id", F.md5("vec").alias("same")).distinct()
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, nearest)
    ranked = queries.join(merged, "same").select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.worse")).alias("score")
    )
