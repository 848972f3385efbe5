import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from findloom.llm.arrays import Words, shingle_sets, slices

TEXT = st.text(alphabet="ab é\n\t", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=8))
def test_words_and_shingles(texts):
    data = [t.encode() if t is not None else None for t in texts]
    words = Words(data)
    expected = [(i, w) for i, t in enumerate(data) for w in (t or b"").split()]
    assert [(int(d), words.text(i)) for i, d in enumerate(words.doc)] == expected
    h = words.hashes()
    assert len({(w, int(x)) for (_, w), x in zip(expected, h, strict=True)}) == len({w for _, w in expected}) == len(set(h.tolist()))
    values, first = shingle_sets(data, 4)
    for i, t in enumerate(data):
        w = (t or b"").split()
        sets = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} or ({tuple(w)} if w else set())
        assert first[i + 1] - first[i] == len(sets)
    same = [i for i, t in enumerate(data) if (t or b"").split() == (data[0] or b"").split()]
    for i in same:
        assert np.array_equal(values[first[i] : first[i + 1]], values[first[0] : first[1]])


def test_slices_cover():
    texts = [b"x" * n for n in (5, 0, 90, 3, 3)] + [None]
    parts = list(slices(texts, 10))
    assert [i for a, b in parts for i in range(a, b)] == list(range(6))
