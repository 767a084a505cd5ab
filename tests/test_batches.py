"""How micro-batches are dealt out: files, passes over a batch, ranges of a walk."""

import glob

import pytest
from pyspark.sql import functions as F

from underwrite.operators import detectors as DT
from underwrite.operators import scan
from underwrite.plans import q_streaming
from underwrite.session import scratch_path
from underwrite.streaming import detectors as SD
from underwrite.streaming import sinks as SK
from underwrite.streaming import windows as SW


def counted(spark, kind):
    """A function that returns its argument, and how often it was called."""
    calls = spark.sparkContext.accumulator(0)

    def same(x):
        calls.add(1)
        return x

    return F.udf(same, kind), calls


def stream_of(spark, df):
    path = scratch_path(spark, "batch-test")
    df.write.parquet(path)
    return SW.file_stream(spark, path, df.schema)


def test_a_batch_is_decided_once_for_both_sinks(spark):
    same, calls = counted(spark, "long")
    rows = stream_of(spark, spark.range(500)).withColumn("v", same("id")).withColumn("errors", F.when(F.col("v") % 5 == 0, F.array(F.lit("e"))).otherwise(F.array()))
    good, held = scratch_path(spark, "good"), scratch_path(spark, "held")
    SW.wait(SK.route(rows, good, held, scratch_path(spark, "route-state")))
    ids = [sorted(r["id"] for r in spark.read.parquet(f"{p}/batch=0").collect()) for p in (good, held)]
    assert ids == [[i for i in range(500) if i % 5], list(range(0, 500, 5))]
    assert calls.value == 500


def test_applications_arrive_in_several_files_a_batch(spark, sf, monkeypatch):
    paths = {}
    monkeypatch.setattr(q_streaming, "scratch_path", lambda s, name: paths.setdefault(name, scratch_path(s, name)))
    q_streaming.streaming_decisions(spark, sf)
    assert len(glob.glob(f"{paths['raw-parts']}/*.parquet")) > 3
    assert len(glob.glob(f"{paths['decided']}/batch=*")) == 3


def test_a_part_arrives_whole_from_several_writers(spark):
    rows = spark.range(0, 900, 1, 5).select("id", (F.col("id") % 3).alias("part"))
    log, state = scratch_path(spark, "arrival-log"), scratch_path(spark, "arrival-state")
    for stream in q_streaming.arrivals(rows, [F.col("part") == i for i in range(3)], "arrival-test"):
        SW.wait(SK.log_sink(stream, log, rows.schema, state))
    batches = [spark.read.parquet(f"{log}/batch={i}") for i in range(3)]
    assert [(b.count(), {r["part"] for r in b.collect()}) for b in batches] == [(300, {i}) for i in range(3)]
    assert not glob.glob(f"{log}/batch=3")
    assert all(len(b.inputFiles()) > 1 for b in batches)


@pytest.mark.parametrize("detector", ["ddm", "page_hinkley"])
def test_a_batch_is_walked_once_for_alerts_and_state(spark, detector, monkeypatch):
    same, walked = counted(spark, "long")
    rows = spark.range(400).select(F.lit("k").alias("key"), F.timestamp_seconds("id").alias("ts"), "id", (F.col("id") > 300).cast("double").alias("value"))
    name = f"{detector}_rows"
    plain = getattr(SD.DT, name)
    monkeypatch.setattr(SD.DT, name, lambda *args: plain(*args).withColumn("n", same("n")))
    alerts, state, checkpoint = (scratch_path(spark, f"{detector}-once-{part}") for part in ("alerts", "state", "checkpoint"))
    SW.wait(SD.detector_sink(stream_of(spark, rows), detector, alerts, state, checkpoint))
    kept = spark.read.parquet(f"{state}/batch=0").collect()
    assert [(r["key"], r["n"]) for r in kept] == [("k", 400)]
    assert walked.value == 400


def test_ranges_and_tasks_of_a_walk_follow_the_rows(spark, monkeypatch):
    rows = spark.range(6000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 6000).alias("t"), ((F.col("id") * 7919 % 6000 > 4000) & (F.col("id") % 2 == 0)).cast("double").alias("x"))

    def found(find):
        return sorted([round(v, 9) if isinstance(v, float) else v for v in r] for r in find(rows, "x", ["t"], ["k"]).collect())

    few = DT.ordered_rows(rows, "x", ["t"], ["k"])
    plain = [found(find) for find in (DT.ddm, DT.page_hinkley)]
    monkeypatch.setattr(scan, "RANGE_ROWS", 100, raising=False)
    many = DT.ordered_rows(rows, "x", ["t"], ["k"])
    assert (few.select("_cell._range").distinct().count() <= 16) and many.rdd.getNumPartitions() == 60
    assert max(r["count"] for r in many.groupBy("_cell._range").count().collect()) <= 200
    assert [found(find) for find in (DT.ddm, DT.page_hinkley)] == plain


@pytest.mark.parametrize("find", [DT.ddm, DT.page_hinkley])
def test_summaries_do_not_sort_the_rows(spark, capsys, find):
    find(spark.range(50).select(F.lit("k").alias("k"), "id", F.lit(1.0).alias("x")), "x", ["id"], ["k"]).explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan and "SortAggregate" not in plan
