from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from notelake.llm import shingles, words
from notelake.llm.licenses import _SEPARATORS
from tests.llm import brute

TEXT = st.one_of(st.none(), st.text("aB c\n\té\x0b\x1c  😀0-", max_size=40))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=8), st.integers(1, 30))
def test_words_equal_the_pattern(texts, slice_bytes):
    old, words.SLICE_BYTES = words.SLICE_BYTES, slice_bytes
    try:
        got = []
        for s in words.slices(pa.array(texts, pa.string())):
            raw = s.data.tobytes()
            cut = [raw[a:b].decode() for a, b in zip(s.begin, s.end, strict=True)]
            got += [cut[a:b] for a, b in zip(s.row_words[:-1], s.row_words[1:], strict=True)]
        assert got == [brute.words(t) for t in texts]
    finally:
        words.SLICE_BYTES = old


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_letters_and_digits(texts):
    n = [c for s in words.slices(pa.array(texts, pa.string()), separators=_SEPARATORS) for c in s.counts()]
    assert n == [len(brute.ALNUM.findall((t or "").translate(brute.LOWER))) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab \n", max_size=60), max_size=6))
def test_shingles(texts):
    sets = [s.row(i) for s in shingles.of_column(pa.array(texts, pa.string())) for i in range(len(s))]
    want = [brute.shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(i):
            assert shingles.overlap(sets[i], sets[j]) == len(want[i] & want[j])


def test_word_hashes_tell_words_apart():
    texts = [f"w{i}" for i in range(20000)] + ["ab ba aab abb bba a aa aaa b"]
    h = np.concatenate([s.hashes() for s in words.slices(pa.array(texts))])
    assert len(np.unique(h)) == len(h)


def test_sliced_arrays():
    a = pa.array(["x y", None, "z", "p q r"]).slice(1)
    assert [list(s.counts()) for s in words.slices(a)] == [[0, 1, 3]]
