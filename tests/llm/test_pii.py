"""Anchor expansion against plain searches, and its added kinds."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from underwrite.llm import pii

PARTS = ["a@b.c", "x.y", "@", ".", "-", "+", "1", "256", "10.0.0.1", " ", "(", ")", "4111 1111 1111 1111", "+1 (436) 555-8670", "é", "\n", "00", "9.9", "q"]


def base(text):
    import hashlib

    got = [s for s in pii.spans(text) if s[0] in pii.BASE_KINDS]
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in got).encode()).hexdigest()


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans_equal_plain_searches(text):
    assert base(text) == pii.brute_base_sha256(text)


def test_long_and_degenerate_texts_are_linear():
    for text in ("", "1" * 200_000, "1." * 100_000, "@" * 100_000, "a@" * 100_000, "+1" * 100_000, "- " * 100_000):
        pii.spans(text)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("0123456789.+- ()@ab\n") for _ in range(rng.randrange(400)))
        assert base(text) == pii.brute_base_sha256(text)


def test_added_kinds_and_masking():
    text = 'see ftp://bob:pw1@host.net/x, IBAN: DE89 3704 0044 0532 0130 00 and password=9f9f9f9f9f; token = "0a1b2c3d4e"'
    kinds = [(k, text[s:e]) for k, s, e in pii.spans(text)]
    assert ("address", "ftp://bob:pw1@host.net/x,") in kinds or ("address", "ftp://bob:pw1@host.net/x") in kinds
    assert ("account", "DE89 3704 0044 0532 0130 00") in kinds
    assert ("secret", "9f9f9f9f9f") in kinds and ("secret", "0a1b2c3d4e") in kinds
    clean = pii.masked(text, pii.spans(text))
    assert "bob" not in clean and "3704" not in clean and "9f9f" not in clean
    assert pii.masked("no data here", []) == "no data here"


def test_find_and_redact_handle_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "mail a.b@c.org now", "x"), (3, "mail a.b@c.org now", "x"), (None, "1.2.3.4 5.6.7.8", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((r.doc_id or -1, r.n_email, r.n_ip, r.spans) for r in pii.digest(pii.find(df)).collect())
    assert got == [(-1, 0, 2, "ip:0:7,ip:8:15"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, "email:5:14"), (3, 1, 0, "email:5:14")]
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted(str(r.text) for r in out.collect()) == ["", "<IP> <IP>", "None", "mail <EMAIL> now", "mail <EMAIL> now"]
    assert pii.digest(pii.find(df.limit(0))).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_whole_table_against_plain_searches(spark, sf):
    from underwrite.llm.queries import QUERIES

    got = {r.doc_id: r.base_sha256 for r in QUERIES["op5_pii"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == {d.doc_id: pii.brute_base_sha256(d.text or "") for d in docs}
