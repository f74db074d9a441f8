import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from doeffect.llm.packing import END_ID, Encoder, digest, pack, piece_lengths, vocabulary, write_buckets

from . import cases


def test_piece_lengths():
    for n in (*range(1, 70), 2047, 2048, 2049, 10000):
        got = piece_lengths(n, 2048)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 2048 for x in got)
        assert sorted(got, reverse=True) == got and all(got.count(x) == 1 for x in got if x < 2048)


@pytest.mark.parametrize(
    "text",
    ["plain words, isn't it 42", "caf\u00e9 \u00f1and\u00fa\n\n  x", "\u4e2d\u6587 \u0915\u094d", "x" * 5000, " " * 3000 + "a", "<|endoftext|> a", "a\x00b", "\u00a0 \u2003x"],
)
def test_ids_are_those_of_tokenizers(text):
    files = vocabulary()
    want = Tokenizer.from_file(files[0]).encode(text, add_special_tokens=False).ids
    assert Encoder(*files).ids(text) == want


def test_pieces_hold_every_id_once(spark):
    files = vocabulary()
    tokenizer = Tokenizer.from_file(files[0])
    rows = cases.documents()
    pieces = pack(cases.frame(spark, rows), files)
    got = digest(pieces).collect()
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    want = []
    for doc_id, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID], "<u4")
        at = 0
        for n in piece_lengths(len(ids)):
            want.append((doc_id, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got], key=key) == sorted(want, key=key)


def test_buckets_and_empty_table(spark, tmp_path):
    files = vocabulary()
    pieces = pack(cases.frame(spark), files, most=64)
    write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("bucket != length or length > 64").count() == 0 and back.count() == pieces.count()
    assert digest(pack(cases.frame(spark, []), files)).count() == 0


@cache
def _encoder() -> Encoder:
    return Encoder(*vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x23F, exclude_categories=["Cs"]), max_size=80))
def test_both_encoders_agree_below_u0240(text):
    assert _encoder().ids(text) == _encoder().full(text)
