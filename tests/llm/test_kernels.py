import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import _text

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
texts = st.lists(st.text(alphabet="ab \n\t\x0b\xa0é\x1c", max_size=40), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts, st.sampled_from([1, 7, 1 << 20]))
def test_words_of_any_batch(batch, limit):
    got = []
    for a, b, data, offsets in _text.chunks(pa.array(batch, pa.string()), limit):
        starts, ends, first = _text.words(data, offsets)
        assert len(first) == b - a + 1
        for i in range(b - a):
            got.append([bytes(data[s:e]) for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)])
    assert got == [WORDS.findall(t.encode()) for t in batch]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "A", "c d", "é"]), max_size=30), st.lists(st.sampled_from(["a", "b", "A", "c d", "é"]), max_size=30))
def test_shingle_sets_are_equal_for_equal_shingles_only(x, y):
    def plain(t):
        w = [v.lower() for v in WORDS.findall(t.encode())]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = " ".join(x), "  ".join(y)
    sa, sb = _text.shingle_sets(pa.array([a, b]))
    assert len(sa) == len(plain(a)) and len(sb) == len(plain(b))
    assert len(np.intersect1d(sa, sb)) == len(plain(a) & plain(b))


def test_hashes_do_not_depend_on_the_place():
    w = ["w%d" % (i % 997) for i in range(5000)]
    old = _text.CHUNK
    try:
        data = np.frombuffer(" ".join(w).encode(), np.uint8)
        starts, ends, _ = _text.words(data, np.array([0, len(data)]))
        whole = _text.word_hashes(data, starts, ends)
        runs = _text.sequence_hashes(whole, 50)
        _text.CHUNK = 100
        assert (_text.word_hashes(data, starts, ends) == whole).all() and (_text.sequence_hashes(whole, 50) == runs).all()
    finally:
        _text.CHUNK = old
    assert (whole[:997] == whole[997:1994]).all() and len(set(whole.tolist())) == 997 and (runs[:900] == runs[997:1897]).all()
