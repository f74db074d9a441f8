import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from doeffect.llm import decontam

from . import cases

ITEMS = "item_id long, text string, key int, run string"


def brute(docs, items, span=10):
    runs = defaultdict(set)
    for item, text, *_ in items:
        w = cases.ALNUM.findall(cases.low(text or ""))
        if w and item is not None:
            n = min(span, len(w))
            for i in range(len(w) - n + 1):
                runs[tuple(w[i : i + n])].add(str(item))
    out = []
    for doc_id, text, *_ in docs:
        w = cases.ALNUM.findall(cases.low(text or ""))
        hit, found = set(), set()
        for n in {len(r) for r in runs}:
            for i in range(len(w) - n + 1):
                if (r := tuple(w[i : i + n])) in runs:
                    hit |= set(range(i, i + n))
                    found |= runs[r]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, bool(hit)))
    return out


def bag(rows):
    return sorted(map(tuple, rows), key=lambda t: tuple((x is None, str(x)) for x in t))


def test_matches_brute_force(spark):
    docs = cases.documents()
    long = cases.prose(2, 3000).split(" ")
    items = [
        (1, " ".join(long[100:130]), 1, "x"),
        (2, " ".join(long[100:110]).upper(), 1, "x"),
        (3, "two WORDS", 1, "x"),
        (10, cases.prose(9, 12), 1, "x"),
        (11, " ".join(long[200:209]), 1, "x"),
        (12, "not to be found anywhere at all in these few texts", 1, "x"),
        (12, cases.prose(1, 20), 1, "x"),
        (13, None, 1, "x"),
        (14, " ,.; ", 1, "x"),
        (None, cases.prose(1, 15), 1, "x"),
        (15, "a b a b a b a b a b a b", 1, "x"),
    ]
    got = decontam.digest(decontam.find(cases.frame(spark, docs), spark.createDataFrame(items, ITEMS))).collect()
    assert bag(got) == bag(brute(docs, items))
    assert sum(r.contaminated for r in got) >= 6


def test_clean_keeps_the_rest(spark):
    docs = cases.documents()
    items = [(1, cases.prose(1, 15), 1, "x")]
    kept = decontam.clean(cases.frame(spark, docs), spark.createDataFrame(items, ITEMS))
    want = [d for d, b in zip(docs, brute(docs, items)) if not b[-1]]
    assert bag(kept.collect()) == bag(want) and kept.columns == cases.SCHEMA.names and len(want) < len(docs)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    found = decontam.digest(decontam.find(cases.frame(spark), none))
    assert found.where("contaminated").count() == 0 and found.count() == len(cases.documents())
    assert decontam.find(cases.frame(spark, []), none).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=6, max_size=60), st.lists(st.integers(0, 5), max_size=30), st.data())
def test_winnowing_guarantee(a, b, data):
    """Any window that two sequences share leaves a common fingerprint."""
    at = data.draw(st.integers(0, len(a) - 6))
    b = b + a[at : at + 6] + b
    one, two = (np.array([hash(("x", v)) & (2**63 - 1) for v in s], np.uint64) for s in (a, b))
    keep = lambda s: {int(s[i]) for i in decontam.winnow(s, np.zeros(len(s), np.int64), 6)}
    assert keep(one) & keep(two)
