"""Each query of the forest stops at its own prefix length, and what meets is cut on both sides."""

import numpy as np
from pyspark.sql import functions as F
from underwrite.llm import ann


def test_dense_and_sparse_queries_stop_at_different_steps(monkeypatch, spark):
    rng = np.random.default_rng(3)
    dense = rng.standard_normal(24) + 0.02 * rng.standard_normal((600, 24))
    x = np.concatenate((dense, rng.standard_normal((600, 24))))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    sent, stops, tiles = ann._query_rows, [], []

    def spy(stopped, turns):
        stops.append({r["step"] for r in stopped.select("step").distinct().collect()})
        return sent(stopped, turns)

    cut = ann._tiles

    def watch(held, asked, *rest):
        tiles.append(asked.agg(F.max("turns")).first()[0])
        return cut(held, asked, *rest)

    monkeypatch.setattr(ann, "_query_rows", spy)
    monkeypatch.setattr(ann, "_tiles", watch)
    monkeypatch.setattr(ann, "BLOCK", 16)
    found = ann.search(df, F.col("id") % 20 == 0).toPandas()
    assert stops and len(stops[0]) > 1
    assert max(tiles) > 1  # more queries of a prefix than one block
    hits = 0
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(found[found["query_id"] == q]["id"]))
    assert len(found) == 60 * 20 and hits >= 0.93 * 60 * 20
