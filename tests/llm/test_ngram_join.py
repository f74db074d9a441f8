import pytest

from doeffect.llm import ngram_join as J
from doeffect.llm.graph import components

from . import cases


def brute(rows, percent=85, k=4):
    sets = []
    for _, text, *_ in rows:
        w = cases.NONSPACE.findall(cases.low(text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[top(i)] = top(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r[0])
    least = {t: min((d for d in g if d is not None), default=None) for t, g in groups.items()}
    return [(r[0], len(s), least[top(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def bag(rows):
    return sorted(map(tuple, rows), key=lambda t: tuple((x is None, x) for x in t))


def test_edge_rows(spark):
    rows = cases.documents()
    assert bag(J.join(cases.frame(spark, rows)).collect()) == bag(brute(rows))


@pytest.mark.parametrize("seed,percent,k", [(5, 85, 4), (6, 85, 4), (7, 60, 2), (8, 80, 5)])
def test_random_copies(spark, seed, percent, k):
    rows = cases.many(spark, 300, seed)
    got = J.join(cases.frame(spark, rows), k, percent).collect()
    assert bag(got) == bag(brute(rows, percent, k))
    assert len({r.component_id for r in got}) < len(rows) - 20


def test_group_around_no_centre(spark):
    """A chain in which only neighbours are near, and a text near to two groups."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 100]), *[None] * 6) for i in range(60)]
    got = J.join(cases.frame(spark, rows)).collect()
    assert bag(got) == bag(brute(rows)) and {r.component_id for r in got} == {0}


def test_one_each(spark):
    rows = cases.documents()
    kept = J.one_each(cases.frame(spark, rows))
    assert kept.columns == cases.SCHEMA.names
    want = {d for d, n, c in brute(rows) if n == 0 or d == c}
    got = [r.doc_id for r in kept.collect()]
    assert set(got) == want and len([d for d in got if d is not None]) == len(want - {None})


def test_empty_table(spark):
    assert J.join(cases.frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (200, 201), (300, 300), (None, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98, 200: 200, 201: 200, 300: 300}


def test_many_chunks_and_copies_across_them(spark, monkeypatch):
    """Chunks of a few texts, copies in many of them: one keeps each text."""
    monkeypatch.setattr(J, "FLUSH", 60)
    rows = cases.many(spark, 250, 9) + cases.documents()[:12]
    rows += [(2000 + i, rows[40][1], *[None] * 6) for i in range(30)]
    docs = cases.frame(spark, [(i, *r[1:]) for i, r in enumerate(rows)]).repartition(5)
    got = J.join(docs).collect()
    assert bag(got) == bag(brute([(i, *r[1:]) for i, r in enumerate(rows)]))
    sets = J.incidence(docs, 4, 85)
    assert sets.count() == sets.select("key").distinct().count() == len({r[1] or "" for r in rows})


def test_a_hot_ngram_is_one_entry_a_chunk(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(J, "FLUSH", 400)
    passage = " ".join(f"boiler{i}" for i in range(12))
    texts = [(i, f"a{i} b{i} c{i} {passage} d{i} e{i}") for i in range(200)]
    docs = spark.createDataFrame(texts, "key long, text string").repartition(6)
    messages = J.to_blocks(docs, 4, 4, 4).collect()
    chunks = {m.chunk for m in messages}
    assert len(chunks) > 4
    entries, held = {}, {}
    for m in messages:
        if m.kind == J.COLUMNS:
            one, _, more, n = J._unpack(bytes(m.payload), *J.ENTRIES)
            for g, times in zip([*one.tolist(), *more.tolist()], [*np.ones(len(one), int).tolist(), *n.tolist()]):
                entries[g] = entries.get(g, 0) + 1
                held[g] = held.get(g, 0) + times
    assert max(held.values()) == 200 and sum(x == 200 for x in held.values()) == 9
    assert max(entries.values()) <= len(chunks)


def test_texts_that_share_boilerplate_alone(spark):
    """Texts of 40 columns out of 400, no near copies: the counted-up rare columns
    drop nearly all pairs before any whole set is sent."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = [(i, " ".join(r.sample([f"p{w}" for w in range(400)], 40)), *[None] * 6) for i in range(400)]
    near = rows[7][1].split()
    rows.append((1000, " ".join([*near[:-1], "other"]), *[None] * 6))
    docs = cases.frame(spark, rows)
    sets = J.incidence(docs, 1, 85).checkpoint()
    cells = J.cells_of(sets).withColumn("hub", F.lit(0))
    none = spark.createDataFrame([], "key long, class long")
    met = J.candidates_across(cells, none, 85).checkpoint()
    left = J._rarely(met, sets, 85).count()
    sharing = cells.join(cells.select("gram", F.col("key").alias("other")), "gram").where("key < other").select("key", "other").distinct().count()
    assert 1 <= left < 60 and sharing > 1000 * left
    got = J.join(docs, 1, 85).collect()
    assert bag(got) == bag(brute(rows, 85, 1)) and {x.component_id for x in got if x.doc_id == 1000} == {7}
