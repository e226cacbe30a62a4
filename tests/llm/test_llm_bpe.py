import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from profspark.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@given(st.text(st.sampled_from("ab'sé9 \n\t　.!🙂"), max_size=80))
@settings(max_examples=200, deadline=None)
def test_cuts_change_no_id(text):
    whole = bpe.encoding(PATH, PATTERN).encode_ordinary(text)
    cut = [i for p in bpe.parts(text, 5) for i in bpe.encoding(PATH, PATTERN).encode_ordinary(p)]
    assert cut == whole


@pytest.mark.parametrize("text", ["ab" + " \n" * 3000 + "cd " * 40_000 + "\t" * 9000, "x" + " " * 5000, "\n" * 4096 + " 's", "a" * 70_000 + " b"])
def test_long_texts(text):
    assert bpe.ids(text, PATH, PATTERN).tolist() == bpe.encoding(PATH, PATTERN).encode_ordinary(text)


def test_white_space_beyond_the_engine():
    text = " \n" * 1_000_000 + "x"
    assert bpe.encoding(PATH, PATTERN).decode(bpe.ids(text, PATH, PATTERN).tolist()) == text


def test_round_trip(edges, empty):
    coded = bpe.encoded(edges, PATH, PATTERN)
    back = bpe.decoded(coded, PATH, PATTERN)
    assert back.columns == [*edges.columns, "n_tokens", "ids", "bytes"]
    for r in back.collect():
        assert bytes(r.bytes).decode() == (r.text or "")
        assert r.n_tokens == len(np.frombuffer(r.ids, "<u4"))
    assert bpe.decoded(bpe.encoded(empty, PATH, PATTERN), PATH, PATTERN).count() == 0
