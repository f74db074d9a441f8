import duckdb
import numpy as np

from doeffect.llm import quality_js as Q

from . import cases


def brute(text):
    w = cases.NONSPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if cases.NONSPACE.search(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(8)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def rows():
    texts = [t for _, t, *_ in cases.documents()]
    one = cases.prose(3, 30).replace("\n", " ")
    texts += [one + " " + one, "x y z\n" * 3 + " \n \nx y z", one + " q " + " ".join(one.split()[:9]), "# | $ " * 40, "the " * 8, "a b c d e f g h a b c d e f g h"]
    return [(i, t, "en", "s", 0, "k", "b", 1) for i, t in enumerate(texts)]


def test_base_columns_match_brute_force(spark):
    given = rows()
    got = {r.doc_id: tuple(r)[1:7] for r in Q.judge(cases.frame(spark, given)).collect()}
    for i, t, *_ in given:
        assert got[i] == brute(t), (t or "")[:80]


def test_method_matches_sql_and_drops_junk(spark):
    given = rows()
    given += [(100 + i, cases.prose(100 + i, 150), "en", "s", 0, "k", "b", 1) for i in range(60)]
    given += [(200 + i, cases.prose(300 + i, 150, "der die und haus baum wolke nicht fluss"), "de" if i % 2 else None, "s", 0, "k", "b", 1) for i in range(80)]
    given += [(400, " ".join(w + "***$$$" for w in cases.prose(7, 200).split()), "en", "s", 0, "k", "b", 1)]
    given += [(401, cases.prose(8, 200).upper(), "en", "s", 0, "k", "b", 1)]
    got = Q.judge(cases.frame(spark, given)).collect()
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, lang varchar)")
    db.executemany("insert into documents values (?, ?, ?)", [(r[0], None if r[1] is None else r[1].replace("\0", "\1"), r[2]) for r in given])
    want = {r[0]: r for r in db.sql(Q.oracle_sql()).fetchall()}
    for r in got:
        w = want[r.doc_id]
        assert tuple(r)[:8] == w[:8]
        for a, b in zip(tuple(r)[8:], w[8:]):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-5)
    by = {r.doc_id: r for r in got}
    assert all(by[100 + i].kept for i in range(60)) and all(by[200 + i].kept for i in range(80))
    assert not by[400].kept and not by[400].base_failed and not by[401].kept
    assert by[200].char_distance is None  # no language


def test_no_language_is_not_the_empty_label(spark):
    given = [(i, cases.prose(i, 150), "", "s", 0, "k", "b", 1) for i in range(40)]
    given += [(100, cases.prose(100, 150), None, "s", 0, "k", "b", 1)]
    docs = cases.frame(spark, given + given[-1:]).selectExpr("*", "1 AS ref_lang", "2 AS chars", "3 AS n_words")
    got = Q.judge(docs).collect()
    assert len(got) == 42 and all((r.char_distance is None) == (r.doc_id == 100) for r in got)
    assert {r.kept for r in got} == {True}


def test_many_languages_are_joined(spark, monkeypatch):
    given = [(i, cases.prose(i, 100), f"l{i % 3}", "s", 0, "k", "b", 1) for i in range(120)]
    key = lambda r: r.doc_id
    want = sorted(Q.judge(cases.frame(spark, given)).collect(), key=key)
    monkeypatch.setattr(Q, "BROADCAST", 2)
    assert sorted(Q.judge(cases.frame(spark, given)).collect(), key=key) == want


def test_windows_of_random_texts(spark):
    r = np.random.default_rng(0)
    given = [(i, " ".join(r.choice(["a", "b"], r.integers(1, 60))), None, None, None, None, None, None) for i in range(150)]
    got = {x.doc_id: x.n_repeat_words for x in Q.judge(cases.frame(spark, given)).collect()}
    assert all(got[i] == brute(t)[4] for i, t, *_ in given)


def test_empty_table_and_no_python(spark):
    assert Q.judge(cases.frame(spark, [])).count() == 0
    plan = Q.features(cases.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
