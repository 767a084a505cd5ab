"""Merge-dropout encoding: the vocabulary's own segmentation at dropout 0, exact round trips, keyed variety."""

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from underwrite.llm import pieces
from underwrite.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


PLAIN, DROPPING = (pieces.Encoder(pieces.vocabulary(), dropout=p) for p in (0, 0.2))
TEXT = st.lists(st.sampled_from(list("abcdethinoé ß日௵\n\t .,'1") + ["the ", "  ", "tion"]), max_size=120).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_without_dropout_it_is_the_vocabulary_s_segmentation(model, text):
    assert PLAIN.encode(text).tolist() == model.encode(text)


@settings(max_examples=400, deadline=None)
@given(st.one_of(TEXT, st.text(max_size=200)))
def test_every_text_comes_back_and_rows_are_cut_like_single_stretches(text):
    ids = DROPPING.encode(text, "7")
    assert pieces.decode_ids(ids, pieces.vocabulary()) == text
    for stretch in pieces.STRETCH.findall(" " + text):
        entry = DROPPING.plain.get(stretch)
        if entry is not None:
            parts, met = pieces._cut_short(stretch.replace(" ", pieces.SPACE), DROPPING.words.ranks, 0)
            start = DROPPING.ends[entry - 1] if entry else 0
            assert DROPPING.ids[start : DROPPING.ends[entry]].tobytes() == DROPPING._ids(stretch, parts)
            assert DROPPING.bits[entry] == (1 << met) - 1


def test_long_stretches_are_cut_like_short_ones(monkeypatch):
    words = pieces.vocabulary()
    text = "antidisestablishmentarianism" * 3
    for limit in (0, 6554, 40000):
        long = pieces._cut_long(text, words.ranks, 99, limit)
        with monkeypatch.context() as m:
            m.setattr(pieces, "SHORT", 10**9)
            assert pieces.cut(text, words.ranks, 99, limit) == long
    assert len(DROPPING.encode("x" * 100_000)) > 0


def test_dropout_varies_by_occurrence_and_repeats():
    words = pieces.vocabulary()
    text = "international " * 200
    one, two = (pieces.Encoder(words, dropout=0.3).encode(text, "5") for _ in range(2))
    assert np.array_equal(one, two)
    assert not np.array_equal(one, pieces.Encoder(words, dropout=0.3, seed=18).encode(text, "5"))
    assert len(one) > len(pieces.Encoder(words, dropout=0).encode(text))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x▁ y", "c"), (3, "x▁ y", "c"), (None, "z" * 100_000, None)], "doc_id long, text string, piece_ids2 string")
    out = pieces.decode(pieces.encode(df, df.columns)).collect()
    assert all(r.decoded == r.text for r in out) and len(out) == 5
    once = pieces.encode(df, df.columns, decoded="decoded")
    assert sorted(map(repr, once.collect())) == sorted(map(repr, out)) and pieces.encode(df.limit(0), ["doc_id"], decoded="back").count() == 0
    assert [r.piece_ids for r in out if r.text is None] == [None] and [r.piece_ids for r in out if r.text == ""] == [[]]
    assert pieces.decode(pieces.encode(df.limit(0), ["doc_id"])).count() == 0


def test_whole_table_round_trip(spark, sf):
    out = QUERIES["op6_sentencepiece"](spark, sf)
    assert out.where("not lossless").count() == 0
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
