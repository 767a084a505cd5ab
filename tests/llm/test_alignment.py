"""Alignment of two tokenizers against plain loops over whole texts."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
import tokenizers
from underwrite.llm import alignment
from underwrite.llm.queries import QUERIES

ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "  two  spaces\n and  \n\n lines "), (6, "tail\n"), (7, "▁ sign ▁x"),
    (8, "<|endoftext|> </s> <s> <unk> <0x41>"), (9, "été ça   b 　 c  d e\u0085 f"), (10, "漢字 かな 한국어 🙂 🙂🙂"), (11, "same same"), (11, "same same"),
    (None, "no key"), (12, "x" * 30000), (13, "word " * 9000), (14, "tab\t here\r\n and it's we'll"), (15, "nul \x00 \x1c q"), (16, "é ﬁ ½"),
]


def plain(rows):
    """Every token by its own span, groups by walking both sides, counts over the whole list."""
    a_coder = tokenizers.Tokenizer.from_file(alignment.A_FILE)
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
    spell = alignment.coder()
    out, counts = [], Counter()
    for key, text in rows:
        a = a_coder.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_coder.encode(text or "", num_threads=1)
        want = (" " + (text or "")).encode()
        if not text or b"".join(spell.a_bytes[i] for i in a) != want or b"".join(spell.b_bytes[i] for i in b) != want:
            out.append((key, 0, 0, [], ""))
            continue
        groups, links, at = [], [], [0, 0]
        group = ([], [])
        todo = [list(reversed(a)), list(reversed(b))]
        while todo[0] or todo[1]:
            side = 0 if at[0] <= at[1] else 1
            i = todo[side].pop()
            at[side] += len((spell.a_bytes, spell.b_bytes)[side][i])
            group[side].append(i)
            if at[0] == at[1]:
                groups.append("|".join(",".join(map(str, g)) for g in group))
                links.append((group[0][-1], group[1][-1]))
                group = ([], [])
        counts.update(links)
        out.append((key, len(a), len(b), links, sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (k, na, nb, len(ls), len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), digest)
        for k, na, nb, ls, digest in out
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_equals_plain_loops(spark, sf):
    got = [tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_alignment"](spark, sf).collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_odd_texts_equal_plain_loops(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in alignment.align(df, "text", ["doc_id"]).collect()]
    assert sorted(got, key=repr) == sorted(plain(ODD), key=repr)


def test_small_memory_and_slices_change_nothing(spark, sf, monkeypatch):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").take(60)]
    one = alignment.Aligner(alignment.coder())
    whole = alignment._aligned(one, [t for _, t in rows], True)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    few = alignment.Aligner(alignment.coder())
    parts = [alignment._aligned(few, [t], True) for _, t in rows]
    assert [g for p in parts for g in p["groups"].to_pylist()] == whole["groups"].to_pylist()
    assert [g for p in parts for g in p["links"].to_pylist()] == whole["links"].to_pylist()


def test_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, kept string").withColumn("links", df_lit())
    out = alignment.align(df, "text", ["doc_id", "kept", "links", "text"], whole=True)
    assert out.columns[:4] == ["doc_id", "kept", "links", "text"]
    row = out.first()
    assert row["kept"] == "x" and row["links"] == "mine" and row["groups"].count("|") == row["n_groups"] == 2
    with pytest.raises(ValueError):
        alignment.align(df.withColumnRenamed("kept", "n_a"), "text", ["n_a"])
    assert alignment.align(df.where("false"), "text", ["doc_id"]).count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("mine")


def test_coalescing_joins_overlaps_only():
    a, b = alignment.coalesce(np.array([0, 3, 5]), np.array([3, 5, 9]), np.array([0, 2, 5, 7]), np.array([2, 5, 7, 9]))
    assert a.tolist() == [0, 0, 1] and b.tolist() == [0, 0, 1, 1]
    x, y = alignment.overlaps(np.array([0, 3, 5]), np.array([3, 5, 9]), np.array([0, 2, 5, 7]), np.array([2, 5, 7, 9]))
    assert list(zip(x.tolist(), y.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3)]


def test_pair_bound_holds_on_data(spark, sf):
    rows = alignment.tokens(spark.read.parquet(f"{sf}/documents.parquet"), "text", ["doc_id"])
    assert 0 < alignment.link_counts(rows).count() <= alignment.coder().pair_bound()
