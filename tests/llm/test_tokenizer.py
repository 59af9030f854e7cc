import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumensift.llm import tokenizer as Z

PATH = Z.vocabulary("byte_bpe_50k")
needs = pytest.mark.skipif(not os.path.exists(PATH), reason="vocabulary files are not here")


@pytest.fixture(scope="module")
def both():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = Z.load_ranks(PATH)
    return Z.Encoder(ranks, kept=500), tiktoken.Encoding("t", pat_str=Z.PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs
@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from("  \n\t'abcdeé中の🙂.,!-012"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_same_ids_and_round_trip(both, text):
    own, other = both
    ids = own(text)
    assert ids == other.encode_ordinary(text)
    assert Z.decode(ids, own.fst.text) == text


@needs
def test_long_runs(both):
    own, other = both
    for text in ["a" * 5000, " " * 3000, "ab" * 3000 + " ", "中" * 2000, "<|endoftext|>", "x  y   z \n\n w ", "don't we'll"]:
        assert own(text) == other.encode_ordinary(text)


@needs
@given(data=st.binary(max_size=40), cut=st.integers(0, 40))
def test_utf8_machine(data, cut):
    machine = Z.Utf8Machine()
    assert machine.feed(data[:cut]) + machine.feed(data[cut:]) + machine.end() == data.decode("utf-8", "replace")


@needs
def test_encode_rows(spark):
    df = spark.createDataFrame([(1, "Hello", 7, "x"), (2, "", 8, "x"), (3, None, 9, "x"), (3, None, 9, "x")], "doc_id long, text string, ids int, id string")
    rows = sorted((r.doc_id, r.ids) for r in Z.encode(df).collect())
    assert rows == [(1, [15496]), (2, []), (3, []), (3, [])]
    assert sorted((r.doc_id, r.text) for r in Z.decoded(Z.encode(df)).collect())[0] == (1, "Hello")
    assert Z.encode(df.limit(0)).count() == 0
