"""N-gram Jaccard join as a blocked sparse matrix product.

The incidence matrix has a row per distinct text and a column per word
n-gram.  It is cut into blocks of rows (chunks, of about ``FLUSH`` entries) and
blocks of columns, and only packed blocks move:

1. Chunks to column blocks: each chunk sends each of its n-grams once, with the
   number of its texts that have it (or the one text).  A column block adds up
   in how many texts each n-gram occurs.  So an n-gram of a third of all texts
   is one entry a chunk, and no task meets all its texts.
2. Column blocks to chunks: the counts above one go back, and each chunk puts
   the n-grams of its texts in order of rarity; those of one text only, which
   no overlap can hold, come first of all.  A text that several chunks have
   stays in the first of them.
3. The product over the rare columns: for two texts to reach the bound, the
   rarest n-grams of one (as many as the bound lets it miss, plus one) must
   hold one of the other's.  Pairs of texts meet in such a column if its place
   in both orders leaves enough behind it.  For each pair the common rare
   columns are counted up; the count, the place of the last one and what is
   left behind the rare columns bound the whole overlap, and pairs whose sizes
   ask for more are dropped there, before whole sets are sent.
4. The other columns are added for the pairs that remain: whole overlap counts
   decide, exactly.

No group of texts is paired with itself.  Within a column each text is first
paired with the column's most central text alone; texts found to be linked
share a class, and only texts of different classes are paired after that.
So a group of near copies takes pairs in proportion to its size.

Copies of a text meet early: a chunk has each text once, and one chunk keeps
it.  Nothing is capped, and every count is over all rows.

Empty texts, NULL and texts without words have no n-grams and are linked
with nothing.  NULL ids take part, but are never a component's id.  Texts
are told apart by 64-bit hashes, and so are n-grams: among 10^9 texts, two
different ones share a hash with a chance of about 3 %, and would then count
as copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from .graph import components
from .text import _GRAM, NONSPACE, grams, mix, text_key, words_of

SHINGLE = 4
PERCENT = 85
FLUSH = 1 << 20  # n-grams of a chunk

# What a message is, and to whom.
COLUMNS, KEYS, OWN = 0, 1, 2


def sets_of(column, k: int):
    """Blocks of a column: (first document, sizes, sorted n-gram hashes of each document in turn)."""
    for i, j, hashes, docs, *_ in words_of(column, NONSPACE):
        n = j - i
        g, at = grams(hashes, docs, k)
        of = docs[at]
        count = np.bincount(docs, minlength=n)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            first = np.searchsorted(docs, short)
            h = hashes[first].copy()
            for m in range(1, k):
                more = count[short] > m
                with np.errstate(over="ignore"):
                    h[more] = h[more] * np.uint64(_GRAM) + hashes[first[more] + m]
            with np.errstate(over="ignore"):
                g = np.concatenate((g, mix(h + count[short].astype(np.uint64))))
            of = np.concatenate((of, short))
        order = np.lexsort((g, of))
        g, of = g[order], of[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
        yield i, np.bincount(of[new], minlength=n), g[new]


def block_of(h: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n_blocks) >> np.uint64(32)).astype(np.int64)


def _pack(*arrays) -> bytes:
    """Arrays one after the other, their lengths first."""
    head = np.array([len(x) for x in arrays], np.uint64)
    return b"".join(x.tobytes() for x in (head, *arrays))


def _unpack(payload: bytes, *kinds) -> list[np.ndarray]:
    lengths = np.frombuffer(payload, np.uint64, len(kinds)).tolist()
    out, at = [], 8 * len(kinds)
    for kind, length in zip(kinds, lengths):
        out.append(np.frombuffer(payload, kind, length, at))
        at += length * np.dtype(kind).itemsize
    return out


GRAM, INDEX, COUNT = np.uint64, np.uint32, np.uint16
ENTRIES = (GRAM, INDEX, GRAM, INDEX)  # n-grams of one text and that text; of more, and how many
# The same with the count over all texts: it only orders them, so 65,535 stands for more.
COUNTED = (GRAM, INDEX, COUNT, GRAM, COUNT)
TEXTS = (GRAM, INDEX)  # hash and size
INCIDENCE = (*TEXTS, GRAM, INDEX, INDEX)  # texts; n-grams of more, how many texts, which


def _runs(values: np.ndarray):
    """Starts and lengths of the runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return starts, np.diff(np.append(starts, len(values)))


def _expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all members of the runs, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def chunk_messages(chunk: int, keys: np.ndarray, sizes: np.ndarray, h: np.ndarray, n_columns: int, n_rows: int):
    """(kind, block, payload) of one chunk: its n-grams by column block, its texts
    by hash, and what it keeps for itself."""
    doc = np.repeat(np.arange(len(keys), dtype=INDEX), sizes)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    starts, n = _runs(h)
    gram, single = h[starts], n == 1
    # Column blocks follow the order of the hashes.
    edge = np.searchsorted(block_of(gram, n_columns), np.arange(n_columns + 1))
    for c in range(n_columns):
        part = slice(edge[c], edge[c + 1])
        one, more = single[part], ~single[part]
        if one.size:
            g, s = gram[part], starts[part]
            yield COLUMNS, c, _pack(g[one], doc[s[one]], g[more], n[part][more].astype(INDEX))
    row = block_of(keys, n_rows)
    order = np.argsort(row, kind="stable")
    first, length = _runs(row[order])
    for a, m in zip(first.tolist(), length.tolist()):
        who = order[a : a + m]
        yield KEYS, int(row[who[0]]), _pack(keys[who], sizes[who].astype(INDEX))
    many = ~single
    docs = doc[_expand(starts[many], n[many])]
    yield OWN, chunk, _pack(keys, sizes.astype(INDEX), gram[many], n[many].astype(INDEX), docs)


def to_blocks(docs: DataFrame, k: int, n_columns: int, n_rows: int) -> DataFrame:
    """The messages of all chunks of ``docs`` (``key, text``)."""

    def pack(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        made, total, seen = 0, 0, set()
        keys, sizes, held = [], [], []

        def flush():
            # The number of the task and of its chunk: the same if the task is run again.
            chunk = task << 32 | made
            messages = list(chunk_messages(chunk, np.concatenate(keys), np.concatenate(sizes), np.concatenate(held), n_columns, n_rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([m[0] for m in messages], pa.int32()),
                    pa.array([m[1] for m in messages], pa.int64()),
                    pa.array([chunk] * len(messages), pa.int64()),
                    pa.array([m[2] for m in messages], pa.binary()),
                ],
                ["kind", "block", "chunk", "payload"],
            )

        for batch in batches:
            ids = batch.column(0).to_numpy().view(np.uint64)
            for i, size, h in sets_of(batch.column(1), k):
                key = ids[i : i + len(size)]
                fresh = np.zeros(len(size), bool)
                for d, x in enumerate(key.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[d] = True
                keys.append(key[fresh])
                sizes.append(size[fresh])
                held.append(h[np.repeat(fresh, size)])
                total += len(held[-1]) + len(keys[-1])
                if total > FLUSH:
                    yield from flush()
                    made += 1
                    keys, sizes, held, total = [], [], [], 0
                    seen.clear()
        if total:
            yield from flush()

    return docs.select("key", "text").mapInArrow(pack, "kind int, block long, chunk long, payload binary")


def _answers(kind: int, chunks, payloads) -> pa.Table:
    return pa.table(
        {
            "chunk": pa.array(chunks, pa.int64()),
            "kind": pa.array([kind] * len(payloads), pa.int32()),
            "payload": pa.array(payloads, pa.binary()),
        }
    )


def count_columns(key, table):
    """Answers of one block to the chunks: counts of n-grams, or the texts that stay with a chunk."""
    kind = key[0].as_py()
    chunks = table.column("chunk").to_numpy()
    payloads = table.column("payload").to_pylist()
    if kind == OWN:
        return _answers(OWN, chunks, payloads)
    out = []
    if kind == KEYS:
        parts = [_unpack(p, *TEXTS)[0] for p in payloads]
        keys = np.concatenate(parts)
        chunk = np.repeat(chunks, [len(p) for p in parts])
        order = np.lexsort((chunk, keys))
        first = _runs(keys[order])[0]
        keys, chunk = keys[order][first], chunk[order][first]
        order = np.argsort(chunk, kind="stable")
        starts, n = _runs(chunk[order])
        homes = chunk[order][starts]
        out = [_pack(keys[order[a : a + m]]) for a, m in zip(starts.tolist(), n.tolist())]
        return _answers(KEYS, homes, out)
    parts = [_unpack(p, *ENTRIES) for p in payloads]
    del payloads
    grams = np.concatenate([x for p in parts for x in (p[0], p[2])])
    times = np.concatenate([x for p in parts for x in (np.ones(len(p[0]), INDEX), p[3])])
    order = np.argsort(grams, kind="stable")
    starts, n = _runs(grams[order])
    total = np.add.reduceat(times[order].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    held_by = np.empty(len(grams), COUNT)
    held_by[order] = np.repeat(np.minimum(total, np.iinfo(COUNT).max), n)
    at = 0
    for one, doc, more, _ in parts:
        first, second = held_by[at : at + len(one)], held_by[at + len(one) : at + len(one) + len(more)]
        at += len(one) + len(more)
        shared = first > 1
        out.append(_pack(one[shared], doc[shared], first[shared], more, second))
    return _answers(COLUMNS, chunks, out)


def order_rows(percent: int):
    """The sets of a chunk's texts, from the answers to it."""

    def ordered(key, table):
        kinds = table.column("kind").to_numpy()
        payloads = table.column("payload").to_pylist()
        (own,) = [_unpack(p, *INCIDENCE) for k, p in zip(kinds, payloads) if k == OWN]
        texts, size, gram, n, docs = own
        homes = np.concatenate([_unpack(p, GRAM)[0] for k, p in zip(kinds, payloads) if k == KEYS] or [np.zeros(0, GRAM)])
        stays = np.isin(texts, homes)
        counted = [_unpack(p, *COUNTED) for k, p in zip(kinds, payloads) if k == COLUMNS]
        del payloads
        who, h, held_by = [], [], []
        starts = np.cumsum(n) - n
        for one, doc, first, more, second in counted:
            place = np.searchsorted(gram, more)
            members = n[place].astype(np.int64)
            who += [doc, docs[_expand(starts[place].astype(np.int64), members)]]
            h += [one, np.repeat(more, members)]
            held_by += [first, np.repeat(second, members)]
        who = np.concatenate([*who, np.zeros(0, INDEX)]).astype(np.int64)
        h, held_by = np.concatenate([*h, np.zeros(0, GRAM)]), np.concatenate([*held_by, np.zeros(0, COUNT)])
        here = stays[who]
        # Number the texts that stay.
        number = np.cumsum(stays) - 1
        who, h, held_by = number[who[here]], h[here], held_by[here]
        texts, size = texts[stays], size[stays].astype(np.int64)
        shared = np.bincount(who, minlength=len(texts))
        # n-grams of one text come first in its order, so they take up its prefix.
        prefix = size - -(-percent * size // 100) + 1
        prefix = np.clip(prefix - (size - shared), 0, shared)
        prefix[size == 0] = 0
        # Of equally rare ones the order is that of signed numbers, as in the table.
        by_rarity = np.lexsort((h.view(np.int64), held_by, who))
        rank = np.arange(len(h)) - np.repeat(np.cumsum(shared) - shared, shared)
        is_rare = rank < prefix[who[by_rarity]]
        rare = h[by_rarity][is_rare]
        rarity = np.append(held_by[by_rarity][is_rare], 0).astype(np.int64)
        end_by = np.where(prefix > 0, rarity[np.cumsum(prefix) - 1], 0)
        full = np.lexsort((h, who))
        full = full[prefix[who[full]] > 0]
        kept = np.where(prefix > 0, shared, 0)

        def lists(counts, values):
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))

        return pa.table(
            {
                "key": pa.array(texts.view(np.int64)),
                "n": pa.array(size, pa.int64()),
                "shared": pa.array(shared, pa.int64()),
                "end_by": pa.array(end_by, pa.int64()),
                "rare": lists(prefix, rare),
                "grams": lists(kept, h[full]),
            }
        )

    return ordered


def _need(a: Column, b: Column, percent: int) -> Column:
    """Least overlap of sets of these sizes that links them."""
    return F.ceil((a + b) * percent / F.lit(100 + percent))


def _may_link(common: Column, last_a: Column, last_b: Column, percent: int) -> Column:
    """Whether texts a and b with so many common rare columns, the last at these
    places of their orders, can reach the bound.

    What follows the last common column is in both or not at all.  And the text
    whose rare columns end first in the order has no other of them in common
    with the other text: ``rest`` columns are left to it.
    """
    n_a, n_b = F.col("n_a"), F.col("n_b")
    behind = F.least(n_a - last_a, n_b - last_b) - 1
    rest = F.when(F.col("end_a") < F.col("end_b"), F.col("rest_a")).when(F.col("end_b") < F.col("end_a"), F.col("rest_b"))
    left = F.least(behind, F.coalesce(rest, F.least("rest_a", "rest_b")))
    return common + left >= _need(n_a, n_b, percent)


def _ends() -> list[Column]:
    """Where a text's rare columns end in the order, and how many shared ones follow."""
    end = F.struct("end_by", F.try_element_at("rare", F.lit(-1)).alias("gram"))
    return [end.alias("end"), (F.col("shared") - F.size("rare")).alias("rest")]


def _rarely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose common rare columns let them reach the bound."""
    one, two = (
        sets.select(
            F.col("key").alias(x),
            F.col("n").alias(f"n_{x}"),
            (F.col("n") - F.col("shared")).alias(f"alone_{x}"),
            F.col("rare").alias(f"rare_{x}"),
            *[e.alias(f"{name}_{x}") for e, name in zip(_ends(), ("end", "rest"))],
        )
        for x in "ab"
    )
    common = F.array_intersect("rare_a", "rare_b")
    last = F.try_element_at("common", F.lit(-1))
    # Places from 0: n-grams of one text only come first.
    places = [F.array_position(f"rare_{x}", last) - 1 + F.col(f"alone_{x}") for x in "ab"]
    bound = _may_link(F.size("common"), *places, percent)
    return pairs.join(two, "b").join(one, "a").withColumn("common", common).where((F.size("common") > 0) & bound).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole overlap reaches the bound.

    The central texts (b) are joined first: there a pair is two keys, so a
    centre of very many texts draws few bytes to its task; the sets of both
    then meet by the other text (a).
    """
    one, two = (
        sets.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("grams").alias(f"grams_{x}")) for x in "ab"
    )
    overlap = F.size(F.array_intersect("grams_a", "grams_b"))
    return (
        pairs.join(two, "b").join(one, "a").where((100 + percent) * overlap >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")
    )


def multiplied(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked: overlaps over the rare columns first,
    then, for the few that they leave, over all."""
    return _linked(_rarely(pairs, sets, percent), sets, percent)


def incidence(docs: DataFrame, k: int, percent: int, text_col: str = "text") -> DataFrame:
    """``key, n, shared, end_by, rare, grams`` of every distinct text: its hash, the size
    of its set, how many n-grams it shares with any text, the rarest of those
    that the bound looks at (and how many texts have the last of them), and, if
    there are any, all of them."""
    spark = docs.sparkSession
    folder = scratch_dir(spark, "ngram-join")
    # Two blocks a partition; with more, each chunk sends more and smaller messages.
    n_blocks = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    (
        to_blocks(texts, k, n_blocks, n_blocks)
        .groupBy("kind", "block")
        .applyInArrow(count_columns, "chunk long, kind int, payload binary")
        .groupBy("chunk")
        .applyInArrow(order_rows(percent), "key long, n long, shared long, end_by long, rare array<long>, grams array<long>")
        .write.parquet(folder)
    )
    return spark.read.parquet(folder)


def cells_of(sets: DataFrame) -> DataFrame:
    """A row for each text and rare column: ``key, n, gram`` and its ``place`` in the
    text's order of rarity."""
    cells = sets.where(F.size("rare") > 0).select("key", "n", "shared", F.posexplode("rare").alias("at", "gram"))
    return cells.select("key", "n", "gram", (F.col("n") - F.col("shared") + F.col("at")).alias("place"))


def candidates_across(cells: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of texts of different classes that meet in a rare column early
    enough in both orders for what follows to reach the bound."""
    classed = cells.drop("hub").join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))
    mixed = (
        classed.groupBy("gram")
        .agg(F.min("class").alias("first"), F.max("class").alias("last"))
        .where("first < last")
        .select("gram")
    )
    classed = classed.join(mixed, "gram")
    left, right = (
        classed.select("gram", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "place", "class")]) for x in "ab"
    )
    na, nb = F.col("n_a"), F.col("n_b")
    return (
        left.join(right, "gram")
        .where(
            (F.col("class_a") != F.col("class_b"))
            & (F.col("key_a") < F.col("key_b"))
            & (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)
            & (F.least(na - F.col("place_a"), nb - F.col("place_b")) >= _need(na, nb, percent))
        )
        .select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
        .distinct()
    )


def links(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, text_col: str = "text"):
    """(sets, edges): ``key, n`` of every distinct text, and links ``a, b`` between
    texts that connect all texts whose n-gram sets reach ``percent`` Jaccard
    similarity, directly or by other such links."""
    sets = incidence(docs, k, percent, text_col)
    cells = cells_of(sets)
    central = (
        cells.groupBy("gram")
        .agg(F.min(F.struct("place", "n", "key")).alias("hub"), F.min("n").alias("least"), F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
        .drop("rows")
    )
    n, hub_n = F.col("n"), F.col("hub.n")
    # A text can reach the bound only with partners of at least this size.
    floor = F.greatest("least", F.ceil(n * percent / F.lit(100)))
    cells = (
        cells.join(central, "gram")
        .where(n - F.col("place") >= _need(n, floor, percent))
        .select("gram", "key", "n", "place", "hub")
        .checkpoint()
    )
    fits = F.least(n - F.col("place"), hub_n - F.col("hub.place")) >= _need(n, hub_n, percent)
    sized = F.least(n, hub_n) * 100 >= F.greatest(n, hub_n) * percent
    starred = cells.where((F.col("key") != F.col("hub.key")) & fits & sized).select(
        F.col("key").alias("a"), F.col("hub.key").alias("b")
    )
    stars = multiplied(starred.distinct(), sets, percent).checkpoint()
    # Class of a text: the least centre it is linked with, or that centre's own.
    direct = stars.groupBy("a").agg(F.min("b").alias("b"))
    second = direct.select(F.col("a").alias("b"), F.col("b").alias("c"))
    classes = direct.join(second, "b", "left").select(F.col("a").alias("key"), F.coalesce("c", "b").alias("class"))
    across = candidates_across(cells, classes, percent)
    return sets.select("key", "n"), stars.unionByName(multiplied(across, sets, percent))


def members(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, key, n, component`` of every row; components are named by a text's key."""
    sets, edges = links(docs, k, percent, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"))
    rows = rows.join(sets, "key", "left").join(components(edges).withColumnRenamed("node", "key"), "key", "left")
    return rows.withColumn("component", F.coalesce("component", "key"))


def join(
    docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the size of its n-gram
    set and the least id reachable by links (its own included)."""
    rows = members(docs, k, percent, id_col, text_col)
    # One row a component, from per-task minima.
    least = (
        rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    )
    return rows.join(least, "component", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_each(
    docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of least
    id stays (NULL ids last), once; rows without words all stay."""
    rows = members(docs, k, percent, id_col, text_col).where("n > 0")
    # Ids and keys only; one row a component, from per-task minima.
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("row"))
    stay = first.select(F.col("row.doc_id").alias("__id"), F.col("row.key").alias("__key"))
    keyed = docs.withColumn("__text_key", text_key(text_col))
    empty = F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike("^[ \\t\\n\\x0B\\f\\r]*$")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))
    once = keyed.where(~empty).join(stay, same, "left_semi").dropDuplicates([id_col, "__text_key"])
    return once.unionByName(keyed.where(empty)).drop("__text_key")


def oracle_sql(k: int = SHINGLE, percent: int = PERCENT) -> str:
    """The join in DuckDB, over the table ``documents`` (ids there are unique)."""
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + {k - 1}], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - {k - 1}) + 1)) AS i FROM docs WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_shared
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * n_shared >= {percent} * (x.n + y.n - n_shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM sizes
  UNION
  SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id
FROM docs d LEFT JOIN sizes s USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS least FROM reached GROUP BY doc_id) c USING (doc_id)
"""
