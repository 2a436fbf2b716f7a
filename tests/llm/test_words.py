import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import words as W
from tests.llm.helpers import words

ALPHABET = st.text(alphabet="ab \n\t\r\x0b\x0cé\U0001f600A", max_size=40)


def hashed(texts, **options):
    """Words of each text, as hashes, through the block reader."""
    out = []
    for block in W.text_blocks(pa.array(texts, pa.string())):
        found = W.words_of(block, **options)
        out += [found.hashes[found.first[i]: found.first[i + 1]].tolist() for i in range(len(block))]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), ALPHABET), max_size=6))
def test_same_words_as_the_pattern(texts):
    known = {}
    for text, got in zip(texts, hashed(texts), strict=True):
        expected = words(text)
        assert len(got) == len(expected)
        for w, h in zip(expected, got, strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_long_words_and_texts_hash_as_short_ones():
    word = "a" * (W._PIECE_BYTES + 5)
    text = " ".join(["b", word, "c"] * 3)
    one = hashed([text])[0]
    assert one[:3] == one[3:6] == one[6:9] and one[1] == hashed([word])[0][0]
    assert hashed(["ABC É"], lower=True) != hashed(["abc é"], lower=True)
    assert hashed(["ABC"], lower=True) == hashed(["abc"])


def test_sliced_and_null_columns():
    column = pa.array(["x", None, "", "y z"], pa.string()).slice(1)
    blocks = list(W.text_blocks(column))
    assert [len(b) for b in blocks] == [3] and bytes(blocks[0].data) == b"y z"
    assert not list(W.text_blocks(pa.array([], pa.string())))


def test_whole_sequences_tell_order_and_length_apart():
    a, b = np.array([3, 5], np.uint64), np.array([5, 3], np.uint64)
    assert W.whole(a) != W.whole(b) and W.whole(a[:1]) != W.whole(a)
