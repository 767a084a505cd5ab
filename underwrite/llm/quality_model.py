"""Quality classifier learned from positive and unlabelled documents.

Trusted positives are documents marked good in the training folds; unlabelled documents are drawn from the
corpus itself. The classifier minimises the non-negative unbiased risk

    prior * E_P[loss(z, +)] + max(0, E_U[loss(z, -)] - prior * E_P[loss(z, -)])

with logistic loss; where the second part would turn negative its gradient is reversed, which keeps the model
from fitting the positives inside the unlabelled set as negatives. The class prior is estimated from the
training folds' labels. Inputs are measures of the whole text only, each cut into bins at quantiles of the
sample (an additive model). The fit is bounded: at most ``SAMPLE_ROWS`` positives and about as many unlabelled
documents reach the driver, as one short numeric row each; scoring is one pass over all texts on the executors.

Defined results: NULL and empty texts have all-zero measures and get a score like any other text; without
positives in the training folds every score is the prior (0.5 without labels); repeated rows are scored one by
one; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwrite.llm import common
from underwrite.llm.quality_rules import SYMBOL, Texts

#: Bound of the labelled sample, and of the unlabelled one.
SAMPLE_ROWS = 20_000
BINS = 12
#: A document is predicted good from this score on.
THRESHOLD = 0.3

_class = np.zeros(256, dtype=np.uint8)
_class[48:58] = 1  # digits
_class[list(b"!?")] = 2
_class[list(b".,;:")] = 3
_class[128:] = 4
_class[SYMBOL] = 5


N_MEASURES = 17


def measures(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of measures per text."""
    t = Texts(data, bounds)
    size = np.maximum(np.diff(bounds), 1)
    n = np.maximum(t.n_words, 1)
    starts, ends, before = t.words
    kind = _class[data]
    count = [t.per_text(kind == k) for k in range(1, 6)]
    length = ends - starts
    lower, upper = t.letters
    lines, again = t.lines
    hashes = common.span_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(t)), t.n_words)
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    twin = np.zeros(len(hashes), dtype=bool)
    twin[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    types = np.bincount(doc[order][new], minlength=len(t))
    columns = [
        np.log1p(t.n_words), t.word_chars / n, t.n_symbols / n, t.n_repeat_words / n, again / np.maximum(lines, 1),
        upper / np.maximum(upper + lower, 1), *(c / n for c in count), t.per_text(length <= 3, before) / n,
        t.per_text(length >= 12, before) / n, types / np.sqrt(n), lines / n, size / n, t.per_text(twin, before) / n,
    ]
    return np.column_stack(columns).astype(np.float64)


@dataclass(frozen=True)
class Model:
    """Bin edges per measure, one weight per bin, the intercept and the class prior."""

    edges: np.ndarray
    weights: np.ndarray
    intercept: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, edges in enumerate(self.edges):
            z += self.weights[j][np.searchsorted(edges, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _risk_gradient(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the non-negative risk by the scores of positives and unlabelled documents."""
    up, uu = 1 / (1 + np.exp(-z_p)), 1 / (1 + np.exp(-z_u))
    negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    if negative < 0:
        return prior * up / len(z_p), -uu / len(z_u)
    return prior * (up - 1) / len(z_p) - prior * up / len(z_p), uu / len(z_u)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, ridge: float = 2e-5) -> Model:
    """Adam on the non-negative risk; the samples are sorted first, so the order of rows does not matter."""
    width = (unlabelled if len(unlabelled) else positive).shape[1]
    if not len(positive) or not len(unlabelled):
        odds = np.log(prior / (1 - prior)) if 0 < prior < 1 else 30.0 * np.sign(prior - 0.5)
        return Model(np.zeros((width, BINS - 1)), np.zeros((width, BINS)), float(odds), prior)
    positive, unlabelled = (a[np.lexsort(a.T[::-1])] for a in (positive, unlabelled))
    both = np.vstack((positive, unlabelled))
    edges = np.quantile(both, np.concatenate((np.linspace(0, 1, BINS - 3)[1:-1], [0.02, 0.97, 0.99])), axis=0)
    edges = np.sort(edges, axis=0).T
    cells = np.column_stack([np.searchsorted(edges[j], both[:, j], side="right") + j * BINS for j in range(width)])
    w, b, m, v = np.zeros(width * BINS), 0.0, np.zeros(width * BINS + 1), np.zeros(width * BINS + 1)
    n_p = len(positive)
    for step in range(1, steps + 1):
        z = w[cells].sum(axis=1) + b
        g_p, g_u = _risk_gradient(np.clip(z[:n_p], -30, 30), np.clip(z[n_p:], -30, 30), prior)
        g = np.concatenate((g_p, g_u))
        grad = np.append(np.bincount(cells.ravel(), np.repeat(g, width), minlength=width * BINS) + ridge * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(edges, w.reshape(width, BINS), float(b), prior)


def _measured(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def work(data: np.ndarray, bounds: np.ndarray) -> dict[str, object]:
        x = measures(data, bounds)
        return {"x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))}

    return common.per_slice(df, text, keep, "x array<double>", work)


def labelled_sample(labels: DataFrame, key: str, mark: str, rows: int) -> DataFrame:
    """At most ``rows`` keys with their label (the larger one of contradicting rows), chosen by hash."""
    known = labels.where(F.col(mark).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(mark).cast("int").alias("_mark"))
    return known.orderBy(F.xxhash64(F.lit(3), key), key).limit(rows)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Model from the labels given (pass training folds only) and a sample of ``docs``."""
    sample = labelled_sample(labels, key, mark, rows).persist()
    marks = {r["_mark"]: r["n"] for r in sample.groupBy("_mark").agg(F.count("*").alias("n")).collect()}
    prior = marks.get(1, 0) / sum(marks.values()) if marks else 0.5
    total = docs.count()
    share = min(1.0, rows / total) if total else 1.0
    # the sample has at most ``rows`` keys, so its broadcast is bounded
    joined = docs.select(key, text).join(F.broadcast(sample.where("_mark = 1")), key, "left")
    drawn = F.pmod(F.xxhash64(F.lit(5), key), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    chosen = joined.withColumn("_drawn", F.coalesce(drawn, F.lit(False))).where("_drawn or _mark = 1")
    facts = _measured(chosen, text, ["_drawn", "_mark"]).toPandas()
    sample.unpersist()
    x = np.array(facts["x"].tolist(), dtype=np.float64).reshape(len(facts), -1 if len(facts) else N_MEASURES)
    return fit(x[(facts["_mark"] == 1).to_numpy()], x[facts["_drawn"].to_numpy(dtype=bool)], prior)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``key`` (or the columns ``keep``) and the score of every row."""
    return common.per_slice(docs, text, keep or [key], "score double", lambda data, bounds: {"score": model.score(measures(data, bounds))})


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with the same columns, whatever their names."""
    packed = docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("text"))
    scored = common.per_slice(packed, "text", ["row"], "score double", lambda data, bounds: {"score": model.score(measures(data, bounds))})
    return scored.where(F.col("score") >= threshold).select("row.*")
