import random

from hypothesis import given, settings
from hypothesis import strategies as st

from doeffect.llm import license_scan as L

from . import cases


def brute(text):
    w = cases.ALNUM.findall(cases.low(text or ""))
    at, labels = [], set()
    for label, phrase in L.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_columns_match_brute_force(spark):
    texts = [t for _, t, *_ in cases.documents()] + [
        "MIT License and the Apache  LICENSE, gnu General-Public License",
        "mit\nlicense " * 50,
        "License mit",
    ]
    rows = [(i, t, None, None, None, None, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in L.digest(L.scan(cases.frame(spark, rows))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_templates_are_found_whole_changed_and_in_part(spark):
    mit = L.TEMPLATES[0][1]
    words = L.words(mit)
    changed = words.copy()
    changed[20] = "zebra"
    changed.insert(45, "extra")
    rows = [
        (0, "some code\n" + mit + "\nmore"),
        (1, " ".join(changed)),
        (2, " ".join(words[: len(words) // 4])),
        (3, "nothing of the kind"),
        (4, " ".join(words[:40]) + " filler" * 500 + " " + " ".join(words[40:])),
        (5, "Licensed under CC BY-NC 4.0."),
    ]
    got = {r.doc_id: r for r in L.digest(L.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[0].labels == "mit" and got[0].score == 1.0 and got[0].base_labels == ""
    assert got[1].labels == "mit" and 0.8 < got[1].score < 1
    assert got[2].labels == "" and 0 < got[2].score < 0.3
    assert got[3].labels == "" and got[3].score == 0
    assert got[4].score < 0.7  # the gap is too long for one chain
    assert got[5].labels == "cc-by-nc"
    spans = {r.doc_id: r.matches for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(m.start, m.stop) for m in spans[0] if m.label == "mit"] == [(2, 2 + len(words))]


def test_empty_table(spark):
    assert L.digest(L.scan(cases.frame(spark, []))).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=10), min_size=1, max_size=3), st.lists(st.integers(1, 4), max_size=15))
def test_matching_statistics(templates, text):
    automaton = L.SuffixAutomaton(templates)
    subs = {tuple(t[i:j]): k for k, t in enumerate(templates) for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for i, (length, state) in enumerate(automaton.statistics(text)):
        want = max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in subs), default=0)
        assert length == want
        if length:
            piece = text[i + 1 - length : i + 1]
            holders = {k for k, t in enumerate(templates) if any(t[j : j + length] == piece for j in range(len(t)))}
            assert set(automaton.ends[state]) == holders
            for k, stop in automaton.ends[state].items():
                assert templates[k][stop - length : stop] == piece


def test_each_template_has_the_matches_it_has_alone(monkeypatch):
    monkeypatch.setattr(L, "LEAST", 3)
    r = random.Random(7)
    for _ in range(200):
        templates = [(str(k), " ".join(r.choices("abc", k=r.randint(2, 10)))) for k in range(3)]
        text = L.hash_words(r.choices("abcd", k=30))
        matches = lambda ts: L.Scanner(ts, {}).matches(L.Scanner(ts, {}).word_ids(text).tolist(), 5)
        alone = [(k, *m[1:]) for k, t in enumerate(templates) for m in matches([t])]
        assert sorted(matches(templates)) == sorted(alone)


def test_a_template_that_begins_another_is_found_whole():
    short = "licensed under the apache license version 2 0"
    scanner = L.Scanner([("short", short), ("long", short + " the license " + " ".join(f"w{i}" for i in range(30)))], {})
    ids = scanner.word_ids(L.hash_words((short + " the license").split())).tolist()
    assert {label: share for label, _, _, share in scanner.chains(scanner.matches(ids, 0))}["short"] == 1.0


def ends(template, piece):
    return [e for e in range(len(piece), len(template) + 1) if template[e - len(piece) : e] == piece]


def brute_matches(template, text, least):
    """(start, stop, template end) of the longest piece of the template that ends at each word, where it grows no further."""
    longest = [max((n for n in range(i + 1) if ends(template, text[i - n : i])), default=0) for i in range(len(text) + 1)] + [0]
    return [
        (i - n, i, ends(template, text[i - n : i])[0])
        for i, n in enumerate(longest[:-1])
        if n >= min(least, len(template)) and longest[i + 1] != n + 1
    ]


def brute_chains(matches):
    """(start, stop, covered words) of every chain of the matches."""
    matches = sorted(matches)
    out = []

    def grow(i, first, covered):
        start, stop, end = matches[i]
        out.append((first, stop, covered))
        for j in range(i + 1, len(matches)):
            a, b, to = matches[j]
            lap = max(0, stop - a, end - (to - (b - a)))
            if a - stop <= L.GAP and to > end and lap < b - a:
                grow(j, first, covered + b - a - lap)

    for i, (start, stop, _) in enumerate(matches):
        grow(i, start, stop - start)
    return out


def test_chains_match_brute_force(monkeypatch):
    monkeypatch.setattr(L, "LEAST", 2)
    monkeypatch.setattr(L, "GAP", 4)
    r = random.Random(11)
    chained = 0
    for _ in range(300):
        templates = ["".join(r.choices("abcd", k=r.randint(2, 12))) for _ in range(2)]
        # Pieces of the templates with other words between them.
        text = "".join(x[r.randrange(len(x)) :][: r.randint(2, 5)] + "x" * r.choice([0, 1, 3, 6]) for x in r.choices(templates, k=5))
        scanner = L.Scanner([(str(k), " ".join(x)) for k, x in enumerate(templates)], {})
        ids = scanner.word_ids(L.hash_words(list(text)))
        found = [m for a, b in scanner.runs(ids, L.np.zeros(len(ids), int)) for m in scanner.matches(ids[a:b].tolist(), a)]
        got = scanner.chained(found)
        for k, template in enumerate(templates):
            mine = brute_matches(template, text, 2)
            assert sorted(m[1:] for m in found if m[0] == k) == sorted(mine)
            every = brute_chains(mine)
            best = [c[1:] for c in got if c[0] == k]
            assert set(best) <= set(every)
            assert max((c[2] for c in best), default=0) == max((c[2] for c in every), default=0)
            # A place's chain is the best of those that end where it does.
            assert all(n == max(c[2] for c in every if c[1] == stop) for _, stop, n in best)
            chained += sum(n > max(b - a for a, b, _ in mine) for _, _, n in best)
    assert chained > 100


def test_runs_lose_no_match(monkeypatch):
    monkeypatch.setattr(L, "LEAST", 3)
    r = random.Random(5)
    for _ in range(200):
        scanner = L.Scanner([(str(k), " ".join(r.choices("abc", k=r.randint(0, 9)))) for k in range(3)], {})
        sizes = [r.randint(0, 8) for _ in range(4)]
        docs = L.np.repeat(L.np.arange(4), sizes)
        ids = scanner.word_ids(L.hash_words(r.choices("abcd", k=len(docs))))
        got = sorted((int(docs[a]), m) for a, b in scanner.runs(ids, docs) for m in scanner.matches(ids[a:b].tolist(), a))
        at = L.np.cumsum([0, *sizes])
        want = sorted((d, m) for d in range(4) for m in scanner.matches(ids[at[d] : at[d + 1]].tolist(), int(at[d])))
        assert got == want


def test_whole_texts_are_told_apart(spark):
    texts = L.whole_texts()
    assert len(texts) >= 19 and {"mit", "mit-0", "gpl", "lgpl", "apache", "mpl"} <= {label for label, _ in texts}
    rows = [(i, "int main() {}\n" * 30 + text + "\nthe end") for i, (_, text) in enumerate(texts)]
    # Two licenses in one file; one copy with other line breaks and another holder; a third of a text.
    by = dict(texts)
    rows += [
        (100, by["mit"] + "\n" * 3 + "x " * 100 + by["apache"]),
        (101, by["mit"].upper().replace("\n", " ").replace("AUTHORS", "FRIENDS")),
        (102, by["epl"][: len(by["epl"]) // 3]),
    ]
    got = {r.doc_id: r for r in L.digest(L.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, (label, _) in enumerate(texts):
        base = set(filter(None, got[i].base_labels.split(",")))
        assert set(got[i].labels.split(",")) == base | {label} and got[i].score == 1.0
    assert got[100].labels == "apache,mit" and got[101].labels == "mit"
    assert got[102].labels == "" and 0.2 < got[102].score < 0.4


def test_the_template_that_accounts_for_more_is_present():
    short, more = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    scanner = L.Scanner([("part", short), ("whole", short + " " + more), ("same", short + " " + more)], {})
    for text, labels in [(short, {"part"}), (short + " " + more, {"whole", "same"}), (short + " z" * 80 + " " + short + " " + more, {"part", "whole", "same"})]:
        ids = scanner.word_ids(L.hash_words(text.split()))
        found = [m for a, b in scanner.runs(ids, L.np.zeros(len(ids), int)) for m in scanner.matches(ids[a:b].tolist(), a)]
        assert {m["label"] for m in scanner.judged(found, L.COVERED) if m["present"]} == labels


def test_repeated_rows_and_other_columns(spark):
    rows = [(1, L.NOTICES[0][1], "x", "y")] * 3 + [(None, None, None, None), (2, "", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string, n_words string")
    got = sorted(map(tuple, L.digest(L.scan(docs)).collect()), key=str)
    assert len(got) == 5 and got[0] == got[1] == got[2] and got[0][6] == "mit"
    assert {row[6] for row in got[3:]} == {""}


def test_a_very_long_text_of_notices():
    import time

    scanner = L.Scanner()
    text = L.words((L.NOTICES[0][1] + " and so on " + L.NOTICES[7][1] + " ") * 1500)
    ids = scanner.word_ids(L.hash_words(text))
    begin = time.monotonic()
    found = [m for a, b in scanner.runs(ids, L.np.zeros(len(ids), int)) for m in scanner.matches(ids[a:b].tolist(), a)]
    present = [m["label"] for m in scanner.judged(found, L.COVERED) if m["present"]]
    assert time.monotonic() - begin < 60
    assert present.count("mit") >= 1500 and present.count("bsd") >= 1500
