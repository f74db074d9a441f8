import random
import zlib

import numpy as np

from doeffect.llm import langid as L

from . import cases

SYLLABLES = {"aa": "tha ing con ver per", "bb": "ou eau ais ent que", "cc": "sch ung ein ich ver", "dd": "ción ado llá que ez",
             "ee": "kko inen llä ssa uu", "ff": "ov sk cz ny čí", "gg": "あ い う え お"}


def rows(n=300, langs=tuple(SYLLABLES)):
    r = random.Random(3)
    out = []
    for i in range(n):
        lang = langs[i % len(langs)]
        words = ["".join(r.choices(SYLLABLES[lang].split(), k=r.randint(1, 3))) for _ in range(r.randint(8, 60))]
        out.append((i, " ".join(words), lang, "s", 0, "k", "b", 1))
    return out


def test_held_out_accuracy_and_folds(spark):
    for langs in (tuple(SYLLABLES), ("aa", "bb", "cc"), ("aa", "bb")):
        given = rows(langs=langs)
        got = {r.doc_id: r for r in L.identify(cases.frame(spark, given)).collect()}
        assert {i: g.held_out for i, g in got.items()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in got}
        right = [got[i].lang_pred == lang for i, _, lang, *_ in given if got[i].held_out]
        assert len(right) > 30 and np.mean(right) > 0.97
        assert all(0 <= g.score <= 1 for g in got.values())


def brute(given):
    """Fit and decoding restated one document and one trigram at a time."""
    import math
    from collections import Counter, defaultdict

    def letter(b):
        return b >= 128 or 97 <= b <= 122

    def slots(text):
        b = [x + 32 if 65 <= x <= 90 else x for x in (text or "").encode()]
        b = [x if letter(x) else 32 for x in b]
        out = Counter()
        for k in range(len(b) - 2):
            if any(letter(x) for x in b[k : k + 3]):
                gram = b[k] * 65536 + b[k + 1] * 256 + b[k + 2]
                out[(gram * 2654435761 % 2**32) >> 19] += 1
        return out

    tables = defaultdict(Counter)
    for i, text, lang, *_ in given:
        if text is None or lang is None or (i is not None and zlib.crc32(str(i).encode()) % 5 == 0):
            continue
        found = slots(text)
        tables[lang].update()
        for slot, n in found.items():
            tables[lang][slot] += round(n / math.sqrt(found.total()) * 1024) / 1024
    langs = sorted(x for x in tables if tables[x])
    code = L.codewords(len(langs))
    p = {x: [(tables[x][s] + 0.5) / (tables[x].total() + 0.5 * 8192) for s in range(8192)] for x in langs}
    weights, trust = [], []
    for b in range(code.shape[1]):
        one = [x for x, c in zip(langs, code[:, b]) if c > 0]
        other = [x for x, c in zip(langs, code[:, b]) if c < 0]
        w = [math.log((sum(p[x][s] for x in one) / len(one)) / (sum(p[x][s] for x in other) / len(other))) for s in range(8192)]
        weights.append(w)
        trust.append(max(min(sum(a * v for a, v in zip(p[x], w)) * c for x, c in zip(langs, code[:, b].tolist())), 1e-3))
    out = {}
    for i, text, *_ in given:
        if not any(c.isalpha() for c in text or ""):
            out[i] = ("und", 0.0)
            continue
        found = slots(text)
        total = max(found.total(), 1)
        margin = [sum(n * w[s] for s, n in found.items()) / total for w in weights]
        loss = [sum(t / sum(trust) * math.log1p(math.exp(-12 * m * c)) for t, m, c in zip(trust, margin, row)) for row in code.tolist()]
        e = [math.exp(min(loss) - x) for x in loss]
        best = max(range(len(langs)), key=lambda k: e[k])
        out[i] = (langs[best], e[best] / sum(e))
    return out


def test_matches_a_plain_restatement(spark):
    for langs in (("aa", "bb", "cc"), tuple(SYLLABLES)):
        given = rows(40, langs) + [(1000 + i, *r[1:]) for i, r in enumerate(cases.documents())]
        want = brute(given)
        got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(cases.frame(spark, given)).collect()}
        assert got.keys() == want.keys()
        for i in want:
            # Scores as close as rounding lets them be; equal shares may go either way.
            assert abs(got[i][1] - want[i][1]) < 1e-6, i
            assert got[i][0] == want[i][0] or abs(want[i][1] * 2 - 1) < 1e-6, i


def test_many_labels(spark):
    """A dirty column of labels: no cap, one row a label at the driver."""
    given = rows(60) + [(1000 + i, f"label{i} text number{i * 7}", f"l{i:05d}", "s", 0, "k", "b", 1) for i in range(2600)]
    got = L.identify(cases.frame(spark, given)).collect()
    assert len(got) == len(given) and all(0 <= r.score <= 1 for r in got)


def test_many_short_texts_take_little_memory():
    """One batch of ten thousand titles is one block of bytes."""
    import tracemalloc

    import pyarrow as pa

    from doeffect.llm.text import utf8

    data, off = utf8(pa.array([f"title number {i}" for i in range(10_000)]))
    code = L.codewords(5)
    model = L.Model(list("abcde"), code, np.random.default_rng(1).normal(size=(L.SLOTS, code.shape[1])), np.ones(code.shape[1]))
    tracemalloc.start()
    n = 0
    for i, j in L.parts(off, model.most_docs):
        rel = off[i : j + 1] - off[i]
        n += len(model.shares(*L.trigram_counts(data[off[i] : off[j]], rel), j - i))
    assert n == 10_000 and tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_clashing_names_and_repeated_rows(spark):
    given = rows(60)
    docs = cases.frame(spark, given + given[:5]).selectExpr("*", "1 AS slot", "2 AS n", "3 AS score", "true AS ambiguous", "4 AS held_out")
    got = L.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "ambiguous"] and got.count() == 65
    assert L.accept(docs, L.fit(docs)).columns == docs.columns


def test_labels_are_no_inputs(spark):
    given = rows(200)
    held = [r for r in given if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    wrong = {r[0] for r in held}
    other = [(r[0], r[1], "zz" if r[0] in wrong else r[2], "other", *r[4:]) for r in given]
    one, two = ({r.doc_id: (r.lang_pred, r.score) for r in L.identify(cases.frame(spark, x)).collect()} for x in (given, other))
    assert one == two


def test_edge_texts(spark):
    given = rows(100) + [(1000 + i, *r[1:]) for i, r in enumerate(cases.documents())]
    got = {r.doc_id: r for r in L.identify(cases.frame(spark, given)).collect()}
    texts = {r[0]: r[1] for r in given}
    for i, g in got.items():
        letter = any(c.isalpha() for c in texts[i] or "")
        assert (g.lang_pred == "und") == (not letter) and (letter or g.score == 0)


def test_one_language_none_and_empty(spark):
    got = L.identify(cases.frame(spark, rows(20, ("aa",)))).collect()
    assert {r.lang_pred for r in got} == {"aa"}
    unlabelled = [(*r[:2], None, *r[3:]) for r in rows(20)]
    assert {r.lang_pred for r in L.identify(cases.frame(spark, unlabelled)).collect()} == {"und"}
    assert L.identify(cases.frame(spark, [])).count() == 0


def test_accept(spark):
    given = rows(100) + [(1000 + i, *r[1:]) for i, r in enumerate(cases.documents())]
    frame = cases.frame(spark, given)
    kept = L.accept(frame, L.fit(frame))
    assert kept.columns == frame.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i, *_ in rows(100)} <= ids and not ids & {1000, 1001, 1002, 1006}
    assert L.accept(frame, None).count() == sum(any(c.isalpha() for c in r[1] or "") for r in given)


def test_codewords():
    for n in (1, 2, 3, 4, 5, 6, 20, 150):
        code = L.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
        assert len({tuple(r) for r in code.tolist()}) == n
        if 1 < n:
            assert (np.abs(code.sum(axis=0)) < n).all()
