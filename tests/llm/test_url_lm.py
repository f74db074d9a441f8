import duckdb

from doeffect.llm import url_lm

URLS = [
    None, "", "no scheme/x", "http://", "https://WWW.Example.com/en/1", "http://blog.example.com/en/2", "http://a.com",
    "http://a.com/", "http://x.net/es/3", "http://x.net/fr", "http://net/fr/1", "http://planet/fr/1", "http://b.org/p?q#f",
    "http://b.org?x=/y", "http://user@c.org:80/\u00fc/%20", "a://b://c.com/", "http://d.com/" + "z" * 20000,
]


def frame(spark, urls):
    rows = [(i, u, "h", "r", 1) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string, score int")


def test_parse_rules_and_score_match_sql(spark):
    urls = URLS + [f"http://h{i % 7}.{'com' if i % 2 else 'net'}/{'es' if i % 3 else 'xx'}/{i}" for i in range(60)] + URLS[4:7]
    got = {tuple(r) for r in url_lm.judge(frame(spark, urls)).collect()}
    db = duckdb.connect()
    db.execute("create table pages (page_id bigint, url varchar)")
    db.executemany("insert into pages values (?, ?)", [(i, u) for i, u in enumerate(urls)])
    want = set(db.sql(url_lm.oracle_sql()).fetchall())
    assert got == want and len(got) == len(urls)
    by = {r[0]: r for r in got}
    assert by[0][1:4] == ("", "", None) and by[2][1:4] == ("", "", None)
    assert by[4][1:5] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert by[5][3:5] == ("example.com/en/", "block") and by[6][3] is None and by[7][3:5] == ("com/", "allow")
    assert by[9][3] is None and by[10][3] == "net/fr/" and by[11][3] is None
    assert by[13][1:3] == ("b.org", "")


def test_frequent_and_rare_strings_give_the_same_scores(spark, monkeypatch):
    urls = URLS + [f"http://h{i % 7}.{'com' if i % 2 else 'net'}/{'es' if i % 3 else 'xx'}/{i}" for i in range(60)] + ["http://hot.com/a"] * 40
    pages = frame(spark, urls)
    want = {tuple(r) for r in url_lm.judge(pages).collect()}
    for head in (1, 30):  # nothing, then some strings are broadcast
        monkeypatch.setattr(url_lm, "HEAD", head)
        assert {tuple(r) for r in url_lm.judge(pages).collect()} == want


def test_longer_contexts_tell_more(spark):
    # Both kinds have the same strings of three symbols; only a longer context tells them apart.
    urls = [f"http://{i}.com/abxyabxyabzyab" for i in range(60)] + [f"http://{i}.net/es/abxyabzyabxyab" for i in range(60)]
    ask = ["http://q.org/abxyabxyabzyab", "http://q.org/abxyabzyabxyab"]

    def gap(order):
        score = {r.page_id: r.score for r in url_lm.judge(frame(spark, urls + ask), order=order).collect()}
        return score[120] - score[121]

    assert gap(5) > 0.05 > abs(gap(1))


def test_threshold_is_the_best_cut_of_the_held_out(spark):
    def least(rows):
        return url_lm.threshold(spark.createDataFrame(rows, "score long, verdict string")).collect()[0].least

    assert least([]) == 0 and least([(5, "allow"), (70_000, "allow")]) == 0
    # Buckets 3 and 9: halfway between the end of one and the begin of the other.
    assert least([(30_000, "block"), (99_999, "allow")]) == 65_000
    # A blocked url above an allowed one: (2/3 out, none lost) is less than (all out, 1/4 lost).
    scores = [(1, "block"), (2, "block"), (3, "allow"), (4, "block"), (5, "allow"), (6, "allow"), (7, "allow")]
    assert least([(s * 10_000, v) for s, v in scores]) == 50_000


def test_learns_from_the_rules(spark):
    good = [f"http://tulip{i}.com/garden" for i in range(30)]
    bad = [f"http://casino{i}.net/es/spin" for i in range(30)]
    rows = url_lm.judge(frame(spark, good + bad + ["http://tulip.org/garden", "http://casino.org/spin"])).collect()
    verdict = {r.page_id: r.verdict for r in rows}
    assert verdict[60] == "allow" and verdict[61] == "block"


def test_empty_table_and_no_python(spark):
    assert url_lm.judge(frame(spark, [])).count() == 0
    plan = url_lm.judge(frame(spark, URLS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
