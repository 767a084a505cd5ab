"""Ordered scans against plain loops, with ties, hot keys and few or many ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from underwrite.operators import scan
from underwrite.operators.counts import average_rank
from underwrite.operators.loans import keep_first
from underwrite.operators.preprocessing import bounded_sample
from underwrite.operators.quantiles import exact_quantiles
from underwrite.operators.scan import RANGE, ntile, row_numbers, running_min, running_total, top_per_key, with_range


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows share one value, and one key holds most rows."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else f"k{i % 5}", 7.0 if rng.random() < 0.5 else rng.random() * 20, i, rng.random() - 0.5) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, v double, id bigint, x double")


@pytest.mark.parametrize("ranges", [2, 8, 200])
def test_row_numbers_match_a_sort(skewed, ranges):
    rows, df = skewed
    out = running_total(with_range(df, ["v", "id"], ranges), ["k"], ["v", "id"], {"n": F.lit(1), "s": F.col("x")}, {"n": "size"}).collect()
    got = {r["id"]: (r["n"], r["size"], r["s"]) for r in out}
    assert len(out) == len(rows)
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        total = 0.0
        for i, r in enumerate(mine, start=1):
            total += r[3]
            n, size, s = got[r[2]]
            assert (n, size) == (i, len(mine)) and s == pytest.approx(total, abs=1e-9)


def test_hot_tie_is_cut_by_the_second_column(skewed):
    _, df = skewed
    sizes = [r["count"] for r in with_range(df, ["v", "id"], 30).groupBy(RANGE).count().collect()]
    assert max(sizes) < 3 * 3000 / 30


def test_running_minimum(skewed):
    rows, df = skewed
    out = {r["id"]: r["m"] for r in running_min(with_range(df, ["v", "id"], 16), [], ["v", "id"], {"m": F.col("x")}).collect()}
    low = float("inf")
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        low = min(low, r[3])
        assert out[r[2]] == low


@pytest.mark.parametrize("tiles", [3, 7, 10])
def test_ntile_equals_array_split(spark, tiles):
    n = 103
    df = spark.range(n).withColumn("z", F.lit(0))
    got = {r["id"]: r["tile"] for r in ntile(df, [], ["z", "id"], tiles).collect()}
    want = {i: t for t, part in enumerate(np.array_split(np.arange(n), tiles), start=1) for i in part}
    assert got == want


def test_more_tiles_than_rows(spark):
    got = sorted(r["tile"] for r in ntile(spark.range(3), [], ["id"], 10).collect())
    assert got == [1, 2, 3]


def test_top_rows_and_samples_are_exact(skewed):
    rows, df = skewed
    top = top_per_key(df, ["k"], ["v", "id"], 5).collect()
    for key in {r[0] for r in rows}:
        want = [r[2] for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))[:5]]
        assert sorted(r["id"] for r in top if r["k"] == key) == sorted(want)
    a = sorted(r["id"] for r in bounded_sample(df, ["k"], "id", 20).collect())
    b = sorted(r["id"] for r in bounded_sample(df.repartition(5), ["k"], "id", 20).collect())
    assert a == b and len(a) == 20 * len({r[0] for r in rows})


def test_exact_quantiles_equal_numpy(skewed):
    rows, df = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for r in exact_quantiles(df, ["k"], "v", probs).collect():
        values = [row[1] for row in rows if row[0] == r["k"]]
        assert np.allclose(r["q"], np.quantile(values, probs)) and r["n"] == len(values)


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0, 3.0, None)], "v double")
    assert {r["v"]: r["avg_rank"] for r in average_rank(df, "v").collect()} == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


def test_keep_first_is_total(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (1, "a", 3), (2, None, 1)], "id int, t string, n int")
    got = sorted((r["id"], r["t"], r["n"]) for r in keep_first(df, "id", ["t"]).collect())
    assert got == [(1, "a", 3), (2, None, 1)]


def test_empty_input(spark):
    empty = spark.createDataFrame([], "k string, v double, id bigint")
    assert row_numbers(empty, ["k"], ["v", "id"]).count() == 0


def test_a_null_key_is_a_key(spark):
    rows = [(None if k % 2 else "a", float((k * 37) % 500)) for k in range(500)]
    df = spark.createDataFrame(rows, "k string, x double")
    numbered = scan.row_numbers(df, ["k"], ["x"]).collect()
    for key in (None, "a"):
        assert sorted(r.row_number for r in numbered if r.k == key) == list(range(1, 251))
        assert {r.row_count for r in numbered if r.k == key} == {250}
    top = scan.top_per_key(df, ["k"], ["x"], 5).collect()
    assert sorted((str(r.k) for r in top)) == ["None"] * 5 + ["a"] * 5


def test_next_value_crosses_ranges(spark):
    rows = [(k, float(v)) for k in ("a", "b", None) for v in range(0, 60, 3)]
    df = scan.with_range(spark.createDataFrame(rows, "k string, v double"), ["v"], ranges=5)
    got = {(r["k"], r["v"]): r["above"] for r in scan.next_value(df, ["k"], "v", "above").collect()}
    assert got == {(k, v): (v + 3 if v < 57 else None) for k, v in rows}


def test_running_xor_crosses_ranges(spark):
    draw = random.Random(8)
    rows = [(draw.choice([None, 1, 2]), i, draw.getrandbits(62) - 2**61) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    got = {r["i"]: r["x"] for r in scan.running_xor(scan.with_range(df, ["i"], 7), ["k"], ["i"], {"x": F.col("v")}).collect()}
    upto = {}
    for k, i, v in rows:
        upto[k] = upto.get(k, 0) ^ v
        assert got[i] == upto[k]
