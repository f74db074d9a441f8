import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from doeffect.llm.packing import piece_lengths, vocabulary

from . import cases
from .test_decontam import brute as contaminated
from .test_ngram_join import brute as components
from .test_secrets import ASSIGN


def masked(text):
    spans = [(m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{16,}|AKIA[A-Z0-9]{14,}", text)]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "<SECRET>"
        at = max(at, b)
    return out + text[at:]


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs = [r[:5] for r in cases.documents() if r[0] is not None]
    docs += [(100 + i, cases.prose(500 + i, 80), "en" if i % 4 else "de", "s", 0) for i in range(40)]
    docs += [(200, cases.prose(700, 80) + " token = 'abcdefghijklmnop'", "en", "s", 0), (201, cases.prose(777, 50) + " 0123456789abcdef0123", None, "s", 5)]
    docs += [(202, cases.prose(888, 50) + " " + cases.prose(999, 14), "en", "s", 0)]
    items = [(1, cases.prose(999, 14)), (2, cases.prose(505, 12))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(tuple(r)[:5] for r in P.run(spark, str(tmp_path)).collect())

    rows = [r for r in docs if any(c.isalpha() for c in r[1] or "")]
    keep = {d for d, n, c in components(rows, 80, 5) if n == 0 or d == c}
    rows = list({r[0]: r for r in rows if r[0] in keep}.values())
    rows = [r for r, c in zip(rows, contaminated(rows, items)) if not c[-1]]
    assert not {202, 105} & {r[0] for r in rows} and {200, 201} <= {r[0] for r in rows}
    tokenizer = Tokenizer.from_file(vocabulary()[0])
    want = []
    for r in rows:
        ids = np.array([*tokenizer.encode(masked(r[1]), add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for n in piece_lengths(len(ids)):
            want.append((r[0], at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
    assert got == sorted(want)


CLASHING = ["key", "blob", "row", "spans", "_found", "component", "least", "n", "lang_pred", "score", "n_words", "n_hit", "contaminated", "item", "digest", "block"]


def test_stages_keep_all_columns(spark, tmp_path):
    """Every column of the input, also of names that operators use, comes through with its row."""
    docs = cases.frame(spark)
    for name in CLASHING:
        if name not in docs.columns:
            docs = docs.selectExpr("*", f"concat('{name}', coalesce(doc_id, -1)) AS `{name}`")
    spark.createDataFrame([(1, "x"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    given = {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(given[0].__fields__), name
        for r in docs.collect():
            assert all(r[c] == given[r.doc_id][c] for c in docs.columns if c not in ("text", "n_chars")), name
    assert {r.doc_id for r in docs.where("doc_id is null").collect()} == {None}
    assert P.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_repeated_rows_with_other_columns(spark):
    """Of rows with one id and text one stays, whatever their other columns."""
    rows = [(1, cases.prose(1, 50), "en", "s", 1, "a", "b", 1), (1, cases.prose(1, 50), "de", "t", 2, "c", "d", 2), (2, cases.prose(1, 50), "en", "s", 1, "a", "b", 1)]
    kept = P.near_copies(spark, cases.frame(spark, rows), "").collect()
    assert len(kept) == 1 and kept[0].doc_id == 1


def test_ambiguous_long_texts_go(spark):
    """A long text whose two best languages are close goes; a short one stays."""
    one, two = "tha ing con ver per", "ou eau ais ent que"
    rows = [(i, cases.prose(i, 60, one if i % 2 else two), "aa" if i % 2 else "bb", "s", 0, "k", "b", 1) for i in range(80)]
    # Trigrams of neither language tell nothing; a short text gets the benefit of the doubt.
    unknown = "zzq xxj qqk vvw jjx"
    rows += [(1000, cases.prose(901, 300, unknown), None, "s", 0, "k", "b", 1), (1001, cases.prose(902, 300, one), None, "s", 0, "k", "b", 1)]
    rows += [(2000, "zzq xxj", None, "s", 0, "k", "b", 1), (2001, "ing eau", None, "s", 0, "k", "b", 1), (2002, "12 34", None, "s", 0, "k", "b", 1)]
    kept = {r.doc_id for r in P.known_language(spark, cases.frame(spark, rows), "").collect()}
    assert set(range(80)) | {1001, 2000, 2001} <= kept and not {1000, 2002} & kept
