import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from doeffect.llm.text import ALNUM, NONSPACE, blocks, grams, hash_words, utf8, words_of

from . import cases


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8))
def test_words_are_those_of_the_patterns(texts):
    column = pa.array(texts, pa.string())
    for word, pattern in ((ALNUM, cases.ALNUM), (NONSPACE, cases.NONSPACE)):
        found = [[] for _ in texts]
        for i, _, _, docs, codes, starts, ends in words_of(column, word, most=16):
            raw = codes.tobytes()
            for d, a, b in zip(docs, starts, ends):
                found[i + d].append(raw[a:b].decode())
        assert found == [pattern.findall(cases.low(t or "")) for t in texts]


def test_hashes_do_not_depend_on_the_place():
    column = pa.array(["alpha beta", None, "gamma alpha beta"], pa.string())
    (_, _, hashes, docs, *_), *_ = words_of(column, ALNUM)
    assert hashes[0] == hashes[3] and hashes[1] == hashes[4] and len(set(hashes.tolist())) == 3
    assert hash_words(["alpha", "beta", "gamma"]).tolist() == [hashes[0], hashes[1], hashes[2]]
    g, at = grams(hashes, docs, 2)
    assert at.tolist() == [0, 2, 3] and g[0] == g[2] != g[1]


def test_slices_and_blocks():
    column = pa.array(["aa", "b", None, "cccc", ""], pa.string()).slice(1, 3)
    data, off = utf8(column)
    assert data.tobytes() == b"bcccc" and off.tolist() == [0, 1, 1, 5]
    assert list(blocks(off, 2)) == [(0, 2), (2, 3)]
    assert list(blocks(np.zeros(1, np.int64))) == []
