"""The two learned operators against plain versions: gradients by differences, measures and matches by loops."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from underwrite.llm import common, quality_model, toxicity
from underwrite.llm.queries import QUERIES, _training

BLANK = "\x20\x09-\x0d"


def risk(z_p, z_u, prior):
    positive = prior * np.logaddexp(0, -z_p).mean()
    return positive, np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()


@pytest.mark.parametrize("shift", [0.0, -6.0])
def test_gradient_of_the_risk_by_differences(shift):
    """With unlabelled scores far down the second part is negative, and its gradient is turned round."""
    draw = np.random.default_rng(4)
    z_p, z_u, prior, h = draw.normal(1, 1, 7), draw.normal(shift, 1, 9), 0.6, 1e-6
    positive, negative = risk(z_p, z_u, prior)
    assert (negative < 0) == (shift < 0)
    part = (lambda a, b: -risk(a, b, prior)[1]) if negative < 0 else (lambda a, b: sum(risk(a, b, prior)))
    g_p, g_u = quality_model._risk_gradient(z_p, z_u, prior)
    for k in range(len(z_p)):
        up, down = z_p.copy(), z_p.copy()
        up[k], down[k] = up[k] + h, down[k] - h
        assert g_p[k] == pytest.approx((part(up, z_u) - part(down, z_u)) / (2 * h), abs=1e-8)
    for k in range(len(z_u)):
        up, down = z_u.copy(), z_u.copy()
        up[k], down[k] = up[k] + h, down[k] - h
        assert g_u[k] == pytest.approx((part(z_p, up) - part(z_p, down)) / (2 * h), abs=1e-8)


def plain_measures(text):
    words = re.findall(f"[^{BLANK}]+", text)
    n, raw = max(len(words), 1), text.encode()
    fives = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {f for f, c in Counter(fives).items() if c > 1}
    repeated = {i + k for i, f in enumerate(fives) if f in often for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(f"[^{BLANK}]", x)]
    lower, upper = (sum(lo <= b <= hi for b in raw) for lo, hi in ((97, 122), (65, 90)))
    symbols = b"#*$%&|<>"
    kinds = [b"0123456789", b"!?", b".,;:", None, symbols]
    counts = [sum(b >= 128 for b in raw) if k is None else sum(b in k for b in raw) for k in kinds]
    sizes = [len(w.encode()) for w in words]
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, sum(b in symbols for b in raw) / n, len(repeated) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1), upper / max(upper + lower, 1), *(c / n for c in counts), sum(s <= 3 for s in sizes) / n,
        sum(s >= 12 for s in sizes) / n, len(set(words)) / math.sqrt(n), len(lines) / n, max(len(raw), 1) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
    ]


def test_quality_query_equals_plain_measures(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    unlabelled = docs.select("doc_id", "text").where(common.fold("doc_id", 5) != 0)
    model = quality_model.train(unlabelled, _training(spark, sf, "quality", 5, 0))
    got = {r.doc_id: (r.score, r.predicted) for r in QUERIES["op8_quality_model"](spark, sf).collect()}
    for row in docs.collect():
        z = model.intercept + sum(model.weights[j][sum(e <= x for e in model.edges[j])] for j, x in enumerate(plain_measures(row.text or "")))
        want = 1 / (1 + math.exp(-min(max(z, -30), 30)))
        assert got[row.doc_id][0] == pytest.approx(want, abs=1e-9) and got[row.doc_id][1] == int(got[row.doc_id][0] >= 0.3)


def plain_density(text, lexicon):
    folded, total = toxicity.fold(text), 0.0
    for word, weight in lexicon.weights.items():
        start = folded.find(word)
        while start >= 0:
            end = start + len(word)
            whole = not folded[:start][-1:].isalpha() and not folded[end : end + 1].isalpha()
            left, right = re.findall(r"[^\W\d_]+", folded[max(0, start - 40) : start])[-1:], re.findall(r"[^\W\d_]+", folded[end : end + 40])[:1]
            phrases = [" ".join([*left, word]), " ".join([word, *right]), " ".join([*left, word, *right])]
            if whole and not any(p in lexicon.exceptions for p in phrases if " " in p):
                total += weight
            start = folded.find(word, start + 1)
    return total / math.log(3 + text.count(" ") + text.count("\n")) if total else 0.0


def test_toxicity_query_equals_plain_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lexicon = toxicity.learn(docs, _training(spark, sf, "toxic", 4, 2))
    assert lexicon.weights
    got = {r.doc_id: (r.score, r.predicted) for r in QUERIES["op10_toxicity"](spark, sf).collect()}
    for row in docs.collect():
        z = lexicon.intercept + lexicon.slope * plain_density(row.text or "", lexicon)
        assert got[row.doc_id][0] == pytest.approx(1 / (1 + math.exp(-min(max(z, -30), 30))), abs=1e-9)


def test_cover_takes_the_word_with_most_new_documents():
    rows = [["a", "b"], ["a"], ["a", "c"], ["c", "d"], ["c"], ["d", "c"], ["e"], ["b"]]
    odds = dict.fromkeys("abcde", 4.0)
    want, open_ = [], set(range(len(rows)))
    while True:
        gain = {w: sum(w in rows[k] for k in open_) for w in odds if w not in want}
        best = max(gain, key=lambda w: (gain[w], w))
        if gain[best] < toxicity.LEAST_NEW:
            break
        want.append(best)
        open_ -= {k for k in open_ if best in rows[k]}
    assert toxicity._cover(rows, odds) == want
