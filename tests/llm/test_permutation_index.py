import numpy as np
import pytest
from pyspark.sql import types as T

from doeffect.llm import permutation_index as P

from . import vector_cases


def brute(data, every=20, nearest=20):
    """All neighbours by sorting all products."""
    seen, kept = set(), []
    d = max((len(r[1]) for r in data if r[1]), key=lambda k: sum(len(r[1] or ()) == k for r in data), default=0)
    for i, v, *_ in data:
        if i is None or v is None or len(v) != d or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        if (i, tuple(v)) not in seen:
            seen.add((i, tuple(v)))
            kept.append((i, np.array(v, float)))
    out = {}
    for q, v in kept:
        if q % every == 0:
            near = sorted((-float(v @ w), i) for i, w in kept if i != q)[:nearest]
            out[q] = [(i, -s) for s, i in near]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        # Whole sums of products may differ in the last bits.
        assert [round(s, 9) for _, s in got[q]] == [round(s, 9) for _, s in want[q]]
        assert len({i for i, _ in got[q]}) == len(got[q])


def recall(got, want):
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want if want[q]]
    return sum(hits) / len(hits)


@pytest.mark.parametrize("element", [T.FloatType(), T.DoubleType()])
def test_exact_when_all_are_reranked(spark, element):
    data = vector_cases.rows() + vector_cases.odd_rows()
    data += [(5000 + i, data[7][1], None, None, None, None, None) for i in range(60)]  # copies
    data += [(2000, [0.0] * 6, None, None, None, None, None), (None, data[3][1], None, None, None, None, None), data[40]]
    got = found(P.search(vector_cases.frame(spark, data, element), share=1.0, probes=1000))
    want = brute(data)
    same(got, want)
    # Copies: equal products, the least ids first.
    assert [i for i, _ in got[5000]] == [i for i, _ in want[5000]]
    copies = [i for i, _ in got[5000] if i == 7 or i > 5000]
    assert copies[:2] == [7, 5001] and copies == sorted(copies)


def test_few_rows_and_none(spark):
    data = vector_cases.rows(3)
    got = found(P.search(vector_cases.frame(spark, data)))
    same(got, brute(data))
    assert len(got[0]) == 2
    for nothing in ([], vector_cases.odd_rows()):
        assert P.search(vector_cases.frame(spark, nothing)).collect() == []
    alone = P.search(vector_cases.frame(spark, data[:1])).collect()
    assert alone == []
    assert P.search(vector_cases.frame(spark, data[1:])).collect() == []


def test_long_and_short_vectors(spark):
    """Inner product, not angle: the long vectors are near everything."""
    data = vector_cases.rows(200, seed=8)
    data = [(i, [x * (50 if i % 17 == 0 else 1) for x in v], *rest) for i, v, *rest in data]
    got, want = found(P.search(vector_cases.frame(spark, data), keep=60)), brute(data)
    assert recall(got, want) > 0.9


def test_lists_share_blocks_and_split():
    blocks = P.deal({0: 5, 1: 900, 2: 5, 3: 5}, 5, 8, 100)
    assert len(blocks[1]) == 9 and len(blocks[0]) == 1 and blocks[2] == blocks[3] == blocks[4]
    assert len({b for x in blocks for b in x}) == 11
    assert P.deal({}, 1, 8, 100) == [[0]]


def test_footrule_is_what_the_lists_add_up():
    r = np.random.default_rng(1)
    x, q = r.normal(size=(80, 5)), r.normal(size=(3, 5))
    length = float(np.linalg.norm(x, axis=1).max())
    pivots = P.Pivots(x[:30], 4, length, 1.0)
    block = P.Block(x, [np.array([i]) for i in range(80)], pivots, 12)
    got = block.likeness(q)
    a, b = pivots.order(pivots.near(q, True), 12), pivots.order(pivots.near(x, False), 12)
    for i in range(3):
        for j in range(80):
            want = sum(12 - abs(list(a[i]).index(p) - list(b[j]).index(p)) for p in set(a[i]) & set(b[j]))
            assert got[i, j] == want


def test_recall_on_the_tables(spark, sf_small):
    table = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    data = [(r.vec_id, r.embedding) for r in table.collect()]
    got, want = found(P.search(table, keep=60)), brute(data)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    true = {(q, i): s for q, near in brute(data, nearest=len(data)).items() for i, s in near}
    assert all(abs(true[q, i] - s) < 1e-12 for q, near in got.items() for i, s in near)
