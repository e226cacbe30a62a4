import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from profspark.llm import words as W


@given(st.text(st.sampled_from("aB9 \n\t.,é漢"), max_size=60), st.integers(3, 9))
@settings(max_examples=150, deadline=None)
def test_words_do_not_depend_on_pieces(text, piece):
    data = text.encode()
    whole = W.words(data, W.SPACED)
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    assert list(zip(whole[1].tolist(), whole[2].tolist(), strict=True)) == spans
    before = W.PIECE
    try:
        W.PIECE = piece
        W._powers.cache_clear()
        again = W.words(data, W.SPACED)
    finally:
        W.PIECE = before
        W._powers.cache_clear()
    assert all((a == b).all() for a, b in zip(whole, again, strict=True))


def test_equal_words_have_equal_hashes():
    h, s, e = W.words("Ab aB ab é É abab".encode(), W.SPACED)
    assert len(set(h[:3].tolist())) == 1 and len(set(h.tolist())) == 4
    assert (W.shingles(h[:2], 3) == W.windows(h[:2], 2)).all() and len(W.shingles(h[:0], 3)) == 0


def test_windows_depend_on_order():
    h = np.array([1, 2, 1, 2, 1], dtype=np.uint64)
    w = W.windows(h, 2)
    assert w[0] == w[2] != w[1]
