"""Scoring by logistic context mixing.

A text is predicted bit by bit.  For contexts of the last 0 to ``ORDER``
bytes it is known how often each bit was 0 or 1 in the training texts; these
counts are exact, and they grow with the corpus.  A mixer adds the
predictors' log-odds with weights gated by the bit's place and by the longest
context that was seen; an adaptive map then refines the mixed probability.
The sum of the bits' costs is the text's code length, so ``bits_per_byte``
and its log10 probability.

Tasks cut the texts into chunks and count each chunk's distinct byte windows
(a context and the byte after it).  Windows whose contexts end in the same
``NEAR`` bytes meet in one block, so a block has all that contexts of
``NEAR`` bytes and more need; the counts of shorter contexts follow from the
distinct runs of ``NEAR`` bytes (at most 2^24), which all tasks hold.  The
mixer learns online, window after window, in every task that reads the
blocks, with each window's own occurrence left out of the counts that predict
it; the tasks' weights are averaged by the text they saw.  A block works out
the log-odds of the bits of its distinct windows once (in sixteenths) and
returns to every chunk those it asked for.

There each text is read once more from its begin.  A match predictor looks up
where the last ``ORDER`` bytes occurred before in the same text and predicts
the byte that followed.  A second mixer adds its log-odds to the corpus
model's, with weights gated by the length of the match, and learns online,
byte after byte: its weights start anew every ``STRIDE`` bytes, and matches
are looked for within ``REACH`` bytes.  So a byte's cost depends on the
finished model and on the text before it, not on the order or placement of
texts.

Beside it stands a unigram word model with additive smoothing.  The counts
of the ``HEAD`` most frequent words are sent to all tasks; rarer words are
joined, so every word has its exact count.

NULL text is empty: its end alone is scored.  A NULL id is trained on.
Repeated rows count as often as they occur.  With nothing to train on, every
bit costs one bit and a token's base probability is one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from .text import LOWER, NONSPACE, blocks, mix, spans, utf8, word_hashes, worker_cache

ORDER = 5
END = 0xFF  # the byte that ends a text; UTF-8 has no such byte
NEAR = 3  # contexts that end in the same bytes are counted together
HEAD = 1 << 17  # words whose counts all tasks hold
PRIOR = 0.1  # added to the counts of a bit
MOST = 8.0  # bound of log-odds
CELLS = 24  # of the adaptive map, along the mixed log-odds
RATE = 2.0
BATCH = 4096
HELD = 1 << 21  # distinct windows or words that a task holds before it sends them
CHUNK = 1 << 25  # bytes of the texts that ask for costs together
STRETCH = 10_000  # windows over which the learning rate falls
LEVEL = 6  # of the texts' compression
PLACE_BITS = 22
GRAIN = 16  # steps of the log-odds that blocks return
STRIDE = 2048  # bytes along which the second mixer learns
REACH = 1 << 20  # bytes within which a match is looked for; with a context it fits into 64 bits
WIDTH = 1 << 21  # bytes of the texts that are mixed side by side
NEIGHBOURS = 1 << 16  # bytes of the texts whose matches are looked for together
# Weights of the corpus model and of the match, by the length of the match: none, ORDER bytes, 2 * ORDER, 4 * ORDER.
START = ((1.0, 0.0), (1.0, 0.5), (0.8, 1.5), (0.6, 3.0))
RATES = (0.004, 0.03)
ADD = 0.1
PARTS = "block long, chunk long, v binary, n binary, ids array<long>, held array<boolean>"
SCORED = "doc_id long, held_out boolean, n_tokens long, base double, known long, rare array<long>, bits double, plain double, n_bytes long"


def held_out(id_col: str = "doc_id", folds: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def windows(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A number for every byte and (last) every end of a text: the ``ORDER``
    bytes before it, zeros before a text's begin, and itself."""
    w = np.zeros(len(data), np.uint64)
    for k in range(ORDER, -1, -1):
        w <<= np.uint64(8)
        w[k:] |= data[: max(len(data) - k, 0)]
    for k in range(ORDER):
        at = off[:-1] + k
        at = at[at < off[1:]]
        w[at] &= np.uint64((1 << (8 * (k + 1))) - 1)
    end = np.zeros(len(off) - 1, np.uint64)
    some = off[1:] > off[:-1]
    end[some] = w[off[1:][some] - 1] << np.uint64(8)
    end &= np.uint64((1 << (8 * (ORDER + 1))) - 1)
    return np.concatenate((w, end | np.uint64(END)))


def counted(values: list[np.ndarray], weights: list[np.ndarray]):
    """Distinct values, in order, and the sums of their weights."""
    v, n = np.concatenate(values), np.concatenate(weights)
    order = np.argsort(v)
    v, n = v[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    return v[first], np.add.reduceat(n, first) if len(v) else n


def distinct(v: np.ndarray):
    v = np.sort(v)
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    return v[first], np.diff(np.append(first, len(v)))


def rotated(w: np.ndarray) -> np.ndarray:
    """Windows with the last ``NEAR`` bytes of the context first, then the byte after it."""
    low, far = 8 * (NEAR + 1), 8 * (ORDER - NEAR)
    return ((w & np.uint64((1 << low) - 1)) << np.uint64(far)) | (w >> np.uint64(low))


def restored(r: np.ndarray) -> np.ndarray:
    low, far = 8 * (NEAR + 1), 8 * (ORDER - NEAR)
    return (r >> np.uint64(far)) | ((r & np.uint64((1 << far) - 1)) << np.uint64(low))


def squeezed(a: np.ndarray) -> bytes:
    """Compressed bytes of numbers, byte place by byte place."""
    import zstandard as zstd

    return zstd.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def expanded(raw: bytes, kind=np.uint64) -> np.ndarray:
    import zstandard as zstd

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstd.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()


def packets(r: np.ndarray, n: np.ndarray, n_blocks: int):
    """Blocks of rotated windows (in order), and the windows and counts of each."""
    spread = mix(r >> np.uint64(8 * (ORDER - NEAR + 1)))
    block = ((spread >> np.uint64(32)) * np.uint64(n_blocks) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, r, n = block[order], r[order], n[order].astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    for a, b in zip(first, np.append(first[1:], len(block))):
        yield int(block[a]), squeezed(r[a:b]), squeezed(n[a:b])


def part_rows(block, chunk: int, v, n, ids=None, held=None) -> pa.RecordBatch:
    none = pa.nulls(len(v))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block, pa.int64()),
            pa.array([chunk] * len(v), pa.int64()),
            pa.array(v, pa.binary()),
            pa.array(n, pa.binary()),
            none.cast(pa.list_(pa.int64())) if ids is None else pa.array(ids, pa.list_(pa.int64())),
            none.cast(pa.list_(pa.bool_())) if held is None else pa.array(held, pa.list_(pa.bool_())),
        ],
        ["block", "chunk", "v", "n", "ids", "held"],
    )


def cut_corpus(docs: DataFrame, n_blocks: int, folder: str) -> None:
    """Write, of ``doc_id, held_out, text``, the texts in chunks (rows without a block), and
    the distinct byte windows of each chunk by blocks, with their counts in training texts."""

    def cut(batches):
        import zstandard as zstd
        from pyspark import TaskContext

        chunk, n_bytes, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def send(r, n):
            rows = list(packets(r, n, n_blocks))
            return part_rows([b for b, _, _ in rows], chunk, [v for _, v, _ in rows], [c for _, _, c in rows])

        for batch in batches:
            data, off = utf8(batch.column(2))
            out = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in blocks(off):
                codes, rel = data[off[i] : off[j]], off[i : j + 1] - off[i]
                # The lowest bit tells the windows of training texts.
                train = ~out[i:j]
                train = np.concatenate((np.repeat(train, np.diff(rel)), train))
                both, n = distinct((rotated(windows(codes, rel)) << np.uint64(1)) | train.astype(np.uint64))
                held.append((both >> np.uint64(1), np.where(both & np.uint64(1), n, 0)))
                size += len(both)
                yield part_rows(
                    [None],
                    chunk,
                    [zstd.compress(codes.tobytes(), LEVEL)],
                    [zstd.compress(rel.astype(np.int64).tobytes(), LEVEL)],
                    [batch.column(0).slice(i, j - i).to_pylist()],
                    [out[i:j].tolist()],
                )
                n_bytes += len(codes) + j - i
                if size > HELD:
                    held = [counted([r for r, _ in held], [c for _, c in held])]
                    size = len(held[0][0])
                if size > HELD // 2 or n_bytes > CHUNK:
                    yield send(*counted([r for r, _ in held], [c for _, c in held]))
                    chunk, n_bytes, held, size = chunk + 1, 0, [], 0
        if held:
            yield send(*counted([r for r, _ in held], [c for _, c in held]))

    docs.mapInArrow(cut, PARTS).write.parquet(folder)


def count_words(docs: DataFrame, n_blocks: int, folder: str) -> None:
    """Write ``word, n``: the hashes of the words of all texts, and their counts."""

    def count(batches):
        held, size = [], 0

        def pack(values, n):
            block = ((mix(values) >> np.uint64(32)) * np.uint64(n_blocks) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            block, values, n = block[order], values[order], n[order].astype(np.uint32)
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            last = np.append(first[1:], len(block))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(block[first]),
                    pa.array([values[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
                    pa.array([n[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
                ],
                ["block", "v", "n"],
            )

        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in blocks(off):
                lower = LOWER[data[off[i] : off[j]]]
                starts, ends, _ = spans(lower, off[i : j + 1] - off[i], NONSPACE)
                held.append(distinct(word_hashes(lower, starts, ends)))
                size += len(held[-1][0])
                if size > HELD:
                    held = [counted([v for v, _ in held], [c for _, c in held])]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield pack(*held[0])
                        held, size = [], 0
        if size:
            yield pack(*counted([v for v, _ in held], [c for _, c in held]))

    def merge(key, table):
        values, n = counted(
            [np.frombuffer(v.as_py(), np.uint64) for v in table.column("v")],
            [np.frombuffer(c.as_py(), np.uint32).astype(np.int64) for c in table.column("n")],
        )
        return pa.table({"word": pa.array(values.view(np.int64)), "n": pa.array(n, pa.int64())})

    docs.mapInArrow(count, "block long, v binary, n binary").groupBy("block").applyInArrow(merge, "word long, n long").write.parquet(folder)


def block_windows(table):
    """Distinct rotated windows of a block's rows and their counts."""
    return counted([expanded(v.as_py()) for v in table.column("v")], [expanded(c.as_py(), np.int64) for c in table.column("n")])


def merge_windows(parts: DataFrame, folder: str) -> None:
    """Write ``block, v, n``: a row of all windows of a block that training texts have."""

    def merge(key, table):
        r, n = block_windows(table)
        r, n = r[n > 0], n[n > 0]
        return pa.table(
            {"block": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([squeezed(r)], pa.binary()), "n": pa.array([squeezed(n)], pa.binary())}
        )

    requests(parts).groupBy("block").applyInArrow(merge, "block long, v binary, n binary").write.parquet(folder)


def requests(parts: DataFrame) -> DataFrame:
    return parts.where("block is not null").select("block", "chunk", "v", "n")


def short_runs(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of ``NEAR`` bytes that end in a window's last byte, and their counts."""
    shift, mask = np.uint64(8 * (ORDER - NEAR)), np.uint64((1 << (8 * NEAR)) - 1)

    def runs(batches):
        for batch in batches:
            for v, c in zip(batch.column(0), batch.column(1)):
                run, n = counted([(expanded(v.as_py()) >> shift) & mask], [expanded(c.as_py(), np.int64)])
                part = (mix(run) >> np.uint64(56)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, run, n = part[order], run[order], n[order]
                first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
                ends = list(zip(first, np.append(first[1:], len(part))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[first], pa.int64()),
                        pa.array([squeezed(run[a:b]) for a, b in ends], pa.binary()),
                        pa.array([squeezed(n[a:b]) for a, b in ends], pa.binary()),
                    ],
                    ["part", "v", "n"],
                )

    def add(key, table):
        run, n = block_windows(table)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([squeezed(run)], pa.binary()), "n": pa.array([squeezed(n)], pa.binary())})

    # At most 256 rows and 2^24 runs, whatever the corpus.
    rows = seen.select("v", "n").mapInArrow(runs, "part long, v binary, n binary").groupBy("part").applyInArrow(add, "part long, v binary, n binary").collect()
    rows.sort(key=lambda row: row["part"])
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(none + [expanded(row["v"]) for row in rows]), np.concatenate(none + [expanded(row["n"]) for row in rows]).astype(np.int64)


class Counts:
    """Exact counts of the bits after all contexts of a block's windows.

    ``w`` are distinct windows, all those of training texts whose contexts
    end like theirs among them, and ``n`` their counts; ``runs`` and
    ``run_n`` are the short runs of the whole corpus."""

    def __init__(self, w: np.ndarray, n: np.ndarray, runs: np.ndarray, run_n: np.ndarray):
        self.symbol = (w & np.uint64(0xFF)).astype(np.int64)
        self.grams = []
        for order in range(ORDER + 1):
            mask = np.uint64((1 << (8 * (order + 1))) - 1)
            if order < NEAR:
                g, back = np.unique(np.concatenate((runs & mask, w & mask)), return_inverse=True)
                total = np.bincount(back[: len(runs)], run_n, len(g))
                back = back[len(runs) :]
            else:
                g, back = np.unique(w & mask, return_inverse=True)
                total = np.bincount(back, n, len(g))
            self.grams.append((g, back, total))

    def bits(self):
        """For the bits of the windows' last bytes, first to last: place, node, bit, and
        for each order the zeros and ones of every gram, and the windows' grams."""
        for b in range(8):
            found = []
            for g, back, total in self.grams:
                node = g >> np.uint64(8 - b)
                new = np.concatenate(([True], node[1:] != node[:-1]))
                first, run = np.flatnonzero(new), np.cumsum(new) - 1
                ones = np.add.reduceat(total * ((g >> np.uint64(7 - b)) & np.uint64(1)), first)
                zeros = np.add.reduceat(total, first) - ones
                found.append((zeros[run], ones[run], back))
            yield b, (1 << b) | (self.symbol >> (8 - b)), (self.symbol >> (7 - b)) & 1, found


def log_odds(zeros, ones):
    return np.clip(np.log((ones + PRIOR) / (zeros + PRIOR)), -MOST, MOST)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Mixer:
    def __init__(self, weights: np.ndarray, cells: np.ndarray | None = None):
        self.weights = weights  # (bit place * (ORDER + 2) + gate) x (ORDER + 1)
        self.cells = cells  # per node and cell, the refined probability of a 1

    def mixed(self, b: int, inputs: np.ndarray, seen: np.ndarray):
        gate = b * (ORDER + 2) + seen
        return np.clip((self.weights[gate] * inputs).sum(axis=1), -MOST, MOST), gate

    def refine(self, counts: Counts):
        """Bit place, part of the windows, and the probability of the bit that their last bytes have."""
        for b, node, bit, found in counts.bits():
            odds = [(np.where(z + o > 0, log_odds(z, o), np.nan), back) for z, o, back in found]
            for i in range(0, len(bit), 1 << 16):
                part = slice(i, i + (1 << 16))
                inputs = np.stack([x[back[part]] for x, back in odds], axis=1)
                known = ~np.isnan(inputs)
                t, _ = self.mixed(b, np.where(known, inputs, 0), gate_of(known))
                p = (_sigmoid(t) + refined(self.cells, node[part], t)) / 2
                yield b, part, np.where(bit[part] == 1, p, 1 - p)

    def cost(self, counts: Counts) -> np.ndarray:
        """Bits that the last byte of each window takes after the others."""
        total = np.zeros(len(counts.symbol), np.float32)
        for _, part, p in self.refine(counts):
            total[part] -= np.log2(p)
        return total

    def odds(self, counts: Counts) -> np.ndarray:
        """For the eight bits of each window's last byte: log-odds of the bit that it has, in steps, eight to a number."""
        out = np.zeros((len(counts.symbol), 8), np.int8)
        for b, part, p in self.refine(counts):
            out[part, b] = np.clip(np.rint(np.log(p / (1 - p)) * GRAIN), -127, 127)
        return out.view(np.uint64).ravel()


def predicted(symbol: np.ndarray, context: np.ndarray, off: np.ndarray):
    """Of every byte, its exclusive or with the byte that followed the context
    before (256: none did), and the class of the match's length."""
    agrees, gates = np.empty(len(symbol), np.int16), np.empty(len(symbol), np.int8)
    for i, j in blocks(off, NEIGHBOURS):
        a, b = off[i], off[j]
        mine = symbol[a:b]
        last, gates[a:b] = matches(context[a:b], off[i : j + 1] - a)
        agrees[a:b] = np.where(last >= 0, mine ^ mine[last], np.int16(256))
    return agrees, gates


def matches(context: np.ndarray, off: np.ndarray):
    """Of every place, the last place before it with the same context in the same text
    (-1: none), and the class of the match's length."""
    n, k = len(context), ORDER
    # Sorted by the context, then by the place: a context's neighbour is its last place before.
    bits = np.uint64(max(n - 1, 0).bit_length())
    both = np.sort((context << bits) | np.arange(n, dtype=np.uint64))
    at = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    both >>= bits
    same = np.flatnonzero(both[1:] == both[:-1])
    begin = np.repeat(off[:-1], np.diff(off))
    here, before = at[same + 1], at[same]
    mine = before >= begin[here]
    last = np.full(n, -1, np.int64)
    last[here[mine]] = before[mine]
    gate = (last >= 0).astype(np.int8)
    long = np.flatnonzero(gate)
    for level, backs in ((2, (k,)), (3, (2 * k, 3 * k))):
        for back in backs:
            long = long[last[long] - back >= begin[long]]
            long = long[context[long - back] == context[last[long] - back]]
        gate[long] = level
    return last, gate


# By the exclusive or of a byte and its prediction (256: none), eight to a number, for each bit:
# 1 while they agree, -1 where they first do not, then 0.
AGREES = np.array([[(x >> (8 - b) == 0) * (1 - 2 * (x >> (7 - b) & 1)) for b in range(8)] for x in range(256)] + [[0] * 8], np.int8).view(np.uint64).ravel()


def by_bit(packed: np.ndarray) -> np.ndarray:
    """A row for each of the eight places of packed numbers."""
    return np.ascontiguousarray(packed.view(np.int8).reshape(-1, 8).T)


def stretches(off: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut every ``most`` bytes: where the cuts begin, and the text of each."""
    cuts = -(-np.diff(off) // most)
    text = np.repeat(np.arange(len(cuts)), cuts)
    return off[text] + (np.arange(len(text)) - (np.cumsum(cuts) - cuts)[text]) * most, text


def adapted(symbol: np.ndarray, context: np.ndarray, odds: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits that each byte takes (texts end at ``off``, their end bytes included), when the corpus model's
    packed ``odds`` and the match's are mixed by weights that learn along the text; and by the odds alone."""
    n = len(symbol)
    agrees, gate = predicted(symbol, context, off)
    begins, text = stretches(off, STRIDE)
    ends = np.minimum(begins + STRIDE, off[text + 1])
    order = np.argsort(begins - ends, kind="stable")  # the longest first
    begins, length = begins[order].astype(np.int32), (ends - begins)[order]
    # All stretches advance together, a byte a step: places in the order of steps.
    some = len(length) - np.searchsorted(length[::-1], np.arange(length.max(initial=0)), "right")
    step = np.repeat(np.arange(len(some), dtype=np.int32), some)
    bounds = np.concatenate(([0], np.cumsum(some)))
    which = np.arange(n, dtype=np.int32) - bounds.astype(np.int32)[step]
    place = begins[which] + step
    mine = gate[place] * np.int32(len(begins)) + which
    del step, which, gate
    first = by_bit(odds[place])
    second = by_bit(AGREES[agrees[place]])
    del agrees
    # The weights are negative, so that they give the log-odds of the other bit.
    w0, w1 = np.repeat(np.array(START, np.float32).T / [[-GRAIN], [-1]], len(begins), axis=1).astype(np.float32)
    out = np.empty(n, np.float32)
    rates, bound = (np.float32(RATES[0] / GRAIN**2), np.float32(RATES[1])), np.float32(10)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        at = mine[a:b].astype(np.intp)
        x, y = first[:, a:b].astype(np.float32), second[:, a:b].astype(np.float32)
        u, v = w0[at], w1[at]
        miss = u * x
        miss += v * y
        miss.clip(-bound, bound, out=miss)
        np.exp(miss, out=miss)
        cost = miss + 1
        miss /= cost  # probability of the other bit
        np.multiply.reduce(cost, axis=0, out=out[a:b])
        x *= miss
        y *= miss
        u -= rates[0] * np.add.reduce(x, axis=0)
        v -= rates[1] * np.add.reduce(y, axis=0)
        w0[at], w1[at] = u, v
    bits = np.empty(n, np.float32)
    bits[place] = np.log2(out)
    return bits, PLAIN[odds.view(np.uint16)].reshape(-1, 4) @ np.ones(4, np.float32)


# Bits of two neighbouring bits by their log-odds in steps (a byte each).
PLAIN = np.log2(1 + np.exp(-np.arange(1 << 16, dtype=np.uint16).view(np.int8).reshape(-1, 2) / GRAIN)).sum(axis=1).astype(np.float32)


def text_bits(codes: np.ndarray, rel: np.ndarray, w: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of every text of a piece, from its windows (bytes, then ends) and their packed odds:
    with the mixing along the text, and by the corpus model alone."""
    n = len(rel) - 1
    # Bytes and ends in the order of the texts.
    order = np.empty(len(w), np.int32)
    order[np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(rel))] = np.arange(len(codes))
    order[rel[1:] + np.arange(n)] = len(codes) + np.arange(n)
    off = rel + np.arange(n + 1)
    bits, plain = np.zeros(n), np.zeros(n)
    # Parts of long texts are taken like texts.
    begins, text = stretches(off, REACH)
    cuts = np.append(begins, off[-1])
    for i, j in blocks(cuts, WIDTH):
        part, bounds = order[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i]
        found = adapted((w[part] & np.uint64(0xFF)).astype(np.uint8), w[part] >> np.uint64(8), odds[part], bounds)
        for total, each in zip((bits, plain), found):
            np.add.at(total, text[i:j], np.add.reduceat(each, bounds[:-1], dtype=np.float64))
    return bits, plain


@dataclass
class Model:
    parts: DataFrame  # what ``cut_corpus`` wrote
    n_blocks: int
    runs: np.ndarray  # the short runs of the corpus
    run_n: np.ndarray
    weights: np.ndarray
    cells: np.ndarray

    def costs(self, asked: DataFrame, each=Mixer.odds) -> DataFrame:
        """``chunk, v, n``: the windows that each chunk asked for in ``asked``, and what ``each`` says of them."""
        shipped = ship(asked, self.runs, self.run_n, self.weights, self.cells)

        def cost(key, table):
            runs, run_n, weights, cells = received(shipped)
            r, n = block_windows(table)
            said = each(Mixer(weights, cells), Counts(restored(r), n, runs, run_n))
            found = [squeezed(said[np.searchsorted(r, expanded(v.as_py()))]) for v in table.column("v")]
            return pa.table({"chunk": table.column("chunk"), "v": table.column("v"), "n": pa.array(found, pa.binary())})

        return asked.groupBy("block").applyInArrow(cost, "chunk long, v binary, n binary")

    def cost(self, w: np.ndarray) -> np.ndarray:
        """Bits that the last byte of each window takes after the others, by the corpus model alone."""
        r, back = np.unique(rotated(w), return_inverse=True)
        rows = [(b, -1, v, c) for b, v, c in packets(r, np.zeros(len(r)), self.n_blocks)]
        mine = self.parts.sparkSession.createDataFrame(rows, "block long, chunk long, v binary, n binary")
        seen = requests(self.parts).join(mine.select("block"), "block", "left_semi")
        got = self.costs(seen.unionByName(mine), Mixer.cost).where("chunk = -1").collect()
        keys = np.concatenate([expanded(bytes(row["v"])) for row in got])
        cost = np.concatenate([expanded(bytes(row["n"]), np.float32).astype(np.float64) for row in got])
        order = np.argsort(keys)
        return cost[order][back]


def gate_of(known: np.ndarray) -> np.ndarray:
    """0 if no context was seen, else one more than the longest that was."""
    order = np.arange(1, known.shape[1] + 1)
    return (known * order).max(axis=1)


def cell_of(t: np.ndarray):
    """The two cells around mixed log-odds, and the share of the upper one."""
    x = (t + MOST) * (CELLS - 1) / (2 * MOST)
    low = np.minimum(x.astype(np.int64), CELLS - 2)
    return low, x - low


def refined(cells: np.ndarray, node: np.ndarray, t: np.ndarray) -> np.ndarray:
    low, share = cell_of(t)
    at = node * CELLS + low
    return cells[at] * (1 - share) + cells[at + 1] * share


def ship(df: DataFrame, *arrays):
    """Broadcast arrays in compressed form (tables of a small corpus are mostly zeros)."""
    import zstandard as zstd

    packed = [(zstd.compress(a.tobytes(), 1), a.dtype.str, a.shape) for a in arrays]
    return df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, packed))


def received(shipped) -> list[np.ndarray]:
    """The arrays of a broadcast, unpacked once in a Python worker."""
    import zstandard as zstd

    key, packed = shipped.value
    cache = worker_cache()
    if cache.get("shipped", (None,))[0] != key:
        cache["shipped"] = (key, [np.frombuffer(zstd.decompress(b), kind).reshape(shape) for b, kind, shape in packed])
    return cache["shipped"][1]


def _initial_cells() -> np.ndarray:
    return np.tile(_sigmoid(np.linspace(-MOST, MOST, CELLS)), 256)


def _left_out(found, bit, part):
    """Inputs and seen contexts when one occurrence of the bit is left out of the counts."""
    z = np.stack([zeros[back[part]] for zeros, _, back in found], axis=1) - (bit == 0)[:, None]
    o = np.stack([ones[back[part]] for _, ones, back in found], axis=1) - (bit == 1)[:, None]
    known = z + o > 0.5
    return np.where(known, log_odds(np.maximum(z, 0), np.maximum(o, 0)), 0), known


def training_blocks(batches, shipped):
    """The windows of each block, their counts and those of their contexts' bits."""
    runs, run_n = received(shipped)
    for batch in batches:
        for v, c in zip(batch.column(0), batch.column(1)):
            w, n = restored(expanded(v.as_py())), expanded(c.as_py(), np.int64).astype(np.float64)
            if len(w):
                # In no order, so that neighbours share no context.
                order = np.argsort(mix(w))
                yield n[order], Counts(w[order], n[order], runs, run_n)


def train_mixer(seen: DataFrame, shipped) -> np.ndarray:
    """Weights learned online in each task, averaged by the bytes behind them."""
    n_gates = 8 * (ORDER + 2)

    def learn(batches):
        model = Mixer(np.full((n_gates, ORDER + 1), 1.5 / (ORDER + 1)))
        mass = np.zeros(n_gates)
        for n, counts in training_blocks(batches, shipped):
            for b, _, bit, found in counts.bits():
                for i in range(0, len(n), BATCH):
                    at = slice(i, i + BATCH)
                    part = n[at]
                    inputs, known = _left_out(found, bit[at], at)
                    t, gate = model.mixed(b, inputs, gate_of(known))
                    wrong = (bit[at] - _sigmoid(t)) * part
                    total = np.bincount(gate, part, n_gates)
                    rate = RATE / np.sqrt(1 + i % STRETCH // BATCH) / np.maximum(total, 1)
                    for k in range(ORDER + 1):
                        model.weights[:, k] += rate * np.bincount(gate, wrong * inputs[:, k], n_gates)
                    mass += total
        if mass.any():
            at = np.arange(n_gates * (ORDER + 1))
            share = np.repeat(mass, ORDER + 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(model.weights.ravel() * share), pa.array(share)], ["at", "w", "mass"])

    rows = seen.select("v", "n").mapInArrow(learn, "at long, w double, mass double").groupBy("at").agg(F.sum("w").alias("w"), F.sum("mass").alias("mass"))
    weights = np.full(n_gates * (ORDER + 1), 1.5 / (ORDER + 1))
    for row in rows.where("mass > 0").collect():
        weights[row["at"]] = row["w"] / row["mass"]
    return weights.reshape(n_gates, ORDER + 1)


def train_cells(seen: DataFrame, shipped, weights: np.ndarray) -> np.ndarray:
    """The adaptive map: how often the bit was 1 around each mixed probability."""

    def learn(batches):
        model = Mixer(weights)
        total, ones = np.zeros(256 * CELLS), np.zeros(256 * CELLS)
        for n, counts in training_blocks(batches, shipped):
            for b, node, bit, found in counts.bits():
                for i in range(0, len(n), 1 << 16):
                    at = slice(i, i + (1 << 16))
                    inputs, known = _left_out(found, bit[at], at)
                    t, _ = model.mixed(b, inputs, gate_of(known))
                    low, share = cell_of(t)
                    for cell, weight in ((node[at] * CELLS + low, n[at] * (1 - share)), (node[at] * CELLS + low + 1, n[at] * share)):
                        total += np.bincount(cell, weight, 256 * CELLS)
                        ones += np.bincount(cell, weight * bit[at], 256 * CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ones[at]), pa.array(total[at])], ["at", "ones", "total"])

    rows = seen.select("v", "n").mapInArrow(learn, "at long, ones double, total double").groupBy("at").agg(F.sum("ones").alias("ones"), F.sum("total").alias("total"))
    cells = _initial_cells()
    for row in rows.collect():
        # The starting value counts as some occurrences.
        cells[row["at"]] = (row["ones"] + 32 * cells[row["at"]]) / (row["total"] + 32)
    return np.clip(cells, 1e-4, 1 - 1e-4)


def train(docs: DataFrame, folder: str) -> tuple[Model, DataFrame]:
    """The model of the texts that are not held out (columns ``doc_id``, ``held_out``
    and ``text``, or ``text`` alone), and the counts of their words."""
    spark = docs.sparkSession
    if "held_out" not in docs.columns:
        docs = docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text")
    # Several blocks a partition, so that a packed block is a small row.
    n_blocks = max(32, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut_corpus(docs.select("doc_id", "held_out", "text"), n_blocks, f"{folder}/parts")
    count_words(docs.where(~F.col("held_out")).select("text"), n_blocks, f"{folder}/words")
    parts = spark.read.schema(PARTS).parquet(f"{folder}/parts")
    merge_windows(parts, f"{folder}/windows")
    seen = spark.read.schema("block long, v binary, n binary").parquet(f"{folder}/windows")
    runs, run_n = short_runs(seen)
    shipped = ship(docs, runs, run_n)
    weights = train_mixer(seen, shipped)
    cells = train_cells(seen, shipped, weights)
    shipped.unpersist()
    return Model(parts, n_blocks, runs, run_n, weights, cells), spark.read.schema("word long, n long").parquet(f"{folder}/words")


def most_frequent(words: DataFrame, most: int):
    """The words of the highest counts, ``most`` at the utmost: those above the
    least bound, eight to an octave, that no more words reach."""
    steps = words.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("words"))
    bound, held = None, 0
    # A few hundred rows, whatever the corpus.
    for row in steps.orderBy(F.desc("step")).collect():
        held += row["words"]
        if held > most:
            break
        bound = row["step"]
    above = F.lit(False) if bound is None else F.floor(F.log2("n") * 8) >= bound
    top = words.where(above).toPandas()
    # The most frequent get their places first.
    return top.sort_values(["n", "word"], ascending=[False, True])


class Head:
    """Counts of the most frequent words, by their hash; a word that finds both
    its places taken by more frequent ones is looked up like a rare word."""

    def __init__(self, words: np.ndarray, n: np.ndarray):
        words = words.view(np.uint64)
        self.tables = []
        for shift in (44, 24):
            keys, values = np.zeros(1 << 20, np.uint64), np.full(1 << 20, -1, np.int64)
            place = self.place(words, shift)
            _, first = np.unique(place, return_index=True)
            keys[place[first]], values[place[first]] = words[first], n[first]
            self.tables.append((shift, keys, values))
            rest = np.ones(len(words), bool)
            rest[first] = False
            words, n = words[rest], n[rest]

    @staticmethod
    def place(words, shift):
        return ((words >> np.uint64(shift)) & np.uint64((1 << 20) - 1)).astype(np.int64)

    def counts(self, words: np.ndarray) -> np.ndarray:
        """Count of each word, -1 if it is not here."""
        out = np.full(len(words), -1, np.int64)
        todo = np.arange(len(words))
        for shift, keys, values in self.tables:
            place = self.place(words[todo], shift)
            hit = (keys[place] == words[todo]) & (values[place] >= 0)
            out[todo[hit]] = values[place[hit]]
            todo = todo[~hit]
        return out


def score(docs: DataFrame, train_folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows that are not held out, score all: ``doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` (of the corpus model
    alone), ``adapted_bits_per_byte`` (with the mixing along the text, like ``score``)."""
    spark = docs.sparkSession
    folder = scratch_dir(spark, "mixing")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, train_folds).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    model, words = train(rows, f"{folder}/counts")
    # Every training text has one end.
    texts = rows.where(~F.col("held_out")).count()
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).collect()[0]
    n_train, kinds = totals["n"] + texts, totals["v"] + (texts > 0)
    below = np.log10(n_train + ADD * (kinds + 1))
    top = most_frequent(words, HEAD)
    shipped = ship(rows, top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64))
    end_cost = float(np.log10(texts + ADD) - below)

    def run(key, table):
        import zstandard as zstd

        head = Head(*received(shipped))
        text = table.column("ids").is_valid().to_numpy()
        v, c = table.column("v"), table.column("n")
        keys = np.concatenate([restored(expanded(v[int(i)].as_py())) for i in np.flatnonzero(~text)])
        odds = np.concatenate([expanded(c[int(i)].as_py()) for i in np.flatnonzero(~text)])
        order = np.argsort(keys)
        keys, odds = keys[order], odds[order]
        # Most windows are found at their hash; one that shares it is searched for.
        place = np.zeros(1 << PLACE_BITS, np.int32)
        place[mix(keys) >> np.uint64(64 - PLACE_BITS)] = np.arange(len(keys))
        out = []

        def beside(rows):
            """The rows of texts, a few at a time (or one large row)."""
            sizes = np.array([zstd.frame_content_size(v[row].as_py()) for row in rows], np.int64)
            return [rows[i:j] for i, j in blocks(np.concatenate(([0], np.cumsum(sizes))), WIDTH)]

        for group in beside(np.flatnonzero(text).tolist()):
            pieces = [np.frombuffer(zstd.decompress(v[row].as_py()), np.uint8) for row in group]
            rels = [np.frombuffer(zstd.decompress(c[row].as_py()), np.int64) for row in group]
            codes, sizes = np.concatenate(pieces), np.concatenate([np.diff(rel) for rel in rels])
            rel = np.concatenate(([0], np.cumsum(sizes)))
            n = len(sizes)
            lower = LOWER[codes]
            starts, ends, docs_of = spans(lower, rel, NONSPACE)
            h = word_hashes(lower, starts, ends)
            count = head.counts(h)
            common = count >= 0
            base = np.bincount(docs_of[common], np.log10(count[common] + ADD) - below, n) + end_cost
            known = np.bincount(docs_of[common], minlength=n) + (texts > 0)
            rare = h[~common].view(np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(docs_of[~common], minlength=n)))).astype(np.int32)
            w = windows(codes, rel)
            at = place[mix(w) >> np.uint64(64 - PLACE_BITS)]
            miss = np.flatnonzero(keys[at] != w)
            at[miss] = np.searchsorted(keys, w[miss])
            said = odds[at]
            n_tokens = np.bincount(docs_of, minlength=n) + 1
            del pieces, lower, starts, ends, docs_of, h, count, common, at, miss
            bits, plain = text_bits(codes, rel, w, said)
            del codes, w, said
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array([i for row in group for i in table.column("ids")[row].as_py()], pa.int64()),
                        "held_out": pa.array([h for row in group for h in table.column("held")[row].as_py()], pa.bool_()),
                        "n_tokens": pa.array(n_tokens),
                        "base": pa.array(base),
                        "known": pa.array(known),
                        "rare": pa.ListArray.from_arrays(pa.array(offsets), pa.array(rare)),
                        "bits": pa.array(bits),
                        "plain": pa.array(plain),
                        "n_bytes": pa.array(np.diff(rel)),
                    }
                )
            )
        return pa.concat_tables(out)

    pieces = model.parts.where("block is null").drop("block")
    costs = model.costs(requests(model.parts))
    (
        pieces.unionByName(costs, allowMissingColumns=True)
        .groupBy("chunk")
        .applyInArrow(run, SCORED)
        .withColumn("row", F.monotonically_increasing_id())
        .write.parquet(f"{folder}/scored")
    )
    scored = spark.read.parquet(f"{folder}/scored")
    rare = (
        scored.select("row", F.explode("rare").alias("word"))
        .join(words, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.log10(F.coalesce("n", F.lit(0)) + ADD) - F.lit(float(below))).alias("rare_base"), F.count("n").alias("rare_known")
        )
    )
    none = F.lit(0)
    return scored.drop("rare").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", none)).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", none)).alias("base_score"),
        (-F.col("bits") * float(np.log10(2))).alias("score"),
        (F.col("plain") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
        (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("adapted_bits_per_byte"),
    )


def digest(scored: DataFrame) -> DataFrame:
    return scored.drop("bits_per_byte", "adapted_bits_per_byte")
