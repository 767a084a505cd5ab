"""Repeated ids with different texts, and callers' columns that have the operators' own names."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from underwrite.llm import minhash, mixing, pieces, quality_model

WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n=60):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


A, B = prose(1), prose(2)
FOUR = [(5, A), (5, B), (6, A + " end"), (7, B + " end"), (8, prose(3)), (None, A), (9, ""), (9, None), (5, A)]


def test_an_id_with_several_texts_loses_no_link(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.link(spark.createDataFrame(FOUR, "doc_id long, text string")).collect()}
    assert {x[::2] for x in got} == {(5, 5), (6, 5), (7, 5), (8, 8), (None, None), (9, 9)}
    assert {d for d, _, _, kept in got if kept} == {5, 8, 9, None}
    assert minhash.link(spark.createDataFrame(FOUR, "doc_id long, text string")).count() == len(FOUR)


def test_the_stage_keeps_different_texts_of_an_id(spark):
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in FOUR], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(5, A), (5, B), (8, prose(3)), (0, A), (9, ""), (9, "")])


NAMES = ["target", "mix_copies", "_mix", "_mix_size", "_mix_text", "_copy", "_score", "_score_text", "row", "key", "size", "copy", "score", "source_size", "node", "print"]


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, prose(i, 30), "en", "ab"[i % 2], i) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES})
    model = quality_model.fit(quality_model.np.zeros((0, quality_model.N_MEASURES)), quality_model.np.zeros((0, quality_model.N_MEASURES)), 0.5)
    for out in (mixing.repeat(odd), quality_model.accepted(odd, model, threshold=0.0), corpus_pipeline.near_duplicates(spark, odd, ""), corpus_pipeline.personal_data(spark, odd, "")):
        assert out.columns == odd.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)


def test_encode_refuses_its_own_names(spark):
    docs = spark.createDataFrame([(1, "a b", [1])], "doc_id long, text string, piece_ids array<int>")
    with pytest.raises(ValueError):
        pieces.encode(docs, ["doc_id", "piece_ids"])
    assert pieces.encode(docs.withColumn("_key", F.lit(1)).withColumn("_text", F.lit("x")), ["doc_id", "_key", "_text"]).first()["_text"] == "x"
