"""Structured Streaming forms over the events table, compared with their batch results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from underwrite import config as C
from underwrite.operators.loans import parse_loans
from underwrite.plans import oracles as O
from underwrite.plans import views as V
from underwrite.plans.q_loans import SPEC, _error_sql, raw_loans
from underwrite.plans.q_risk import DDM_SQL, PH_SQL
from underwrite.plans.registry import register, rounded
from underwrite.session import parallelism, scratch_path
from underwrite.streaming import detectors as SD
from underwrite.streaming import sinks as SK
from underwrite.streaming import windows as SW


def event_stream(spark: SparkSession, sf: str, name: str = "events") -> DataFrame:
    schema = V.table(spark, sf, name).schema
    # A pattern, because a stream over a single path expects a folder.
    return SW.file_stream(spark, f"{sf}/{name}*.parquet", schema)


def arrivals(rows: DataFrame, parts: Sequence[Column], name: str) -> Iterator[DataFrame]:
    """The stream of a folder each time another part of ``rows`` has arrived there.

    A sink run on every one of them takes the new part, however many files and writers it has, as one micro-batch.
    """
    path = scratch_path(rows.sparkSession, name)
    for part in parts:
        rows.filter(part).write.mode("append").parquet(path)
        yield SW.file_stream(rows.sparkSession, path, rows.schema)


def event_arrivals(spark: SparkSession, sf: str, parts: int = 4) -> Iterator[DataFrame]:
    """The events in equal stretches of time, one per micro-batch."""
    rows = V.table(spark, sf, "events")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * i / parts for i in range(1, parts)]
    at, edges = F.col("ts"), [F.lit(cut).cast("timestamp_ntz") for cut in cuts]
    inner = [(at >= low) & (at < high) for low, high in zip(edges, edges[1:])]
    return arrivals(rows, [at < edges[0], *inner, at >= edges[-1]], "event-parts")


ERROR = "sum(case when event_type = 'error' then 1.0e0 else 0.0e0 end) / count(*)"


def metrics() -> list:
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean_value"),
        F.avg((F.col("event_type") == "error").cast("double")).alias("error_rate"),
    ]


@register(
    "t01_tumbling_windows",
    f"select cast(cast(date_trunc('day', ts) as date) as varchar) as day, event_type, count(*) as n, avg(value) as mean_value, {ERROR} as error_rate from events group by 1, 2",
)
def tumbling(spark, sf):
    out = SW.run_once(SW.windowed(event_stream(spark, sf), "ts", metrics(), "1 day", keys=["event_type"]), "tumbling", "complete")
    day = F.col("window_start").cast("date").cast("string").alias("day")
    return rounded(out.select(day, "event_type", "n", "mean_value", "error_rate"))


@register(
    "t02_sliding_windows",
    "select cast(cast(d as date) as varchar) as day, count(*) as n, avg(value) as mean_value from (select unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day, date_trunc('day', ts) - interval 2 day]) as d, value from events) group by 1",
)
def sliding(spark, sf):
    out = SW.run_once(SW.windowed(event_stream(spark, sf), "ts", metrics(), "3 days", "1 day"), "sliding", "complete")
    return rounded(out.select(F.col("window_start").cast("date").cast("string").alias("day"), "n", "mean_value"))


@register(
    "t03_delayed_label_join",
    f"select l.request_id, o.actual_default from ({V.oracle(V.INFERENCE_LOG)}) l join ({V.oracle(V.OUTCOMES)}) o on l.request_id = o.request_id where o.observed_ts >= l.event_ts and o.observed_ts <= l.event_ts + interval 7 day",
)
def delayed_label_join(spark, sf):
    requests = event_stream(spark, sf).select(F.col("event_id").alias("request_id"), F.col("ts").alias("event_ts"), "value")
    labels = event_stream(spark, sf).filter("event_type <> 'signup'").select(
        F.col("event_id").alias("request_id"),
        (F.col("event_type") == "error").cast("int").alias("actual_default"),
        (F.col("ts") + F.expr("INTERVAL 6 DAYS")).alias("observed_ts"),
    )
    joined = SW.labelled_stream(requests, labels, "event_ts", "observed_ts", "request_id", "7 DAYS", "8 days")
    return SW.run_once(joined, "labels").select("request_id", "actual_default")


def alerts_of(spark: SparkSession, streams: Iterator[DataFrame], values: dict[str, Column], key: str, ts: str, id_: str) -> DataFrame:
    """Run each detector on its value whenever rows have arrived, and read the alerts of all."""
    paths = {name: [scratch_path(spark, f"{name}-{part}") for part in ("alerts", "state", "checkpoint")] for name in values}
    for stream in streams:
        for name, value in values.items():
            SW.wait(SD.detector_sink(SD.detector_input(stream.withColumn("x", value), key, ts, id_, "x"), name, *paths[name]))
    found = [SD.read_alerts(stream, alerts) for alerts, _, _ in paths.values()]
    return reduce(DataFrame.unionByName, found)


@register(
    "t04_stateful_detectors",
    f"select * from (with src as (select event_type as k, ts, event_id as id, (value > 60)::int::double as x from events), {DDM_SQL} "
    "select d.k as key, 'ddm' as detector, 'drift' as state, di as at_index, best.level as statistic from d join m on m.k = d.k and m.n = di + 1 "
    "union all select d.k, 'ddm', 'warning', wi, best.level from d join m on m.k = d.k and m.n = wi + 1 where di is null or wi < di) "
    f"union all select * from (with src as (select event_type as k, ts, event_id as id, value / 50 as x from events), {PH_SQL} "
    "select k, 'page_hinkley', 'drift', index, statistic from ph where drift)",
)
def stateful_detectors(spark, sf):
    """First warning and drift of each event type, state carried across micro-batches."""
    values = {"ddm": (F.col("value") > 60).cast("double"), "page_hinkley": F.col("value") / 50}
    return rounded(alerts_of(spark, event_arrivals(spark, sf), values, "event_type", "ts", "event_id"))


@register(
    "t04_hot_key",
    f"with src as (select case when l_linenumber = 1 then 'rare' else 'hot' end as k, l_shipdate as ts, l_orderkey * 1000000 + l_partkey * 100 + l_suppkey as id, (l_returnflag = 'R')::int::double as x from lineitem), {DDM_SQL} "
    "select d.k as key, 'drift' as state, di as at_index, best.level as statistic from d join m on m.k = d.k and m.n = di + 1 "
    "union all select d.k, 'warning', wi, best.level from d join m on m.k = d.k and m.n = wi + 1 where di is null or wi < di",
)
def hot_key(spark, sf):
    """Most rows belong to one key; its micro-batches are still walked range by range."""
    rows = V.table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") == 1, "rare").otherwise("hot").alias("key"), F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("id"), (F.col("l_returnflag") == "R").cast("double").alias("value"),
    )
    parts = [F.expr(part) for part in ("ts < date'1996-07-01'", "ts >= date'1996-07-01' and ts < date'1998-01-01'", "ts >= date'1998-01-01'")]
    return rounded(alerts_of(spark, arrivals(rows, parts, "line-parts"), {"ddm": F.col("value")}, "key", "ts", "id").drop("detector"))


@register("t05_idempotent_requests", "select user_id, event_type, count(*) as copies from (select distinct user_id, event_type from events) group by all")
def idempotent_requests(spark, sf):
    unique = SW.idempotent(event_stream(spark, sf).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "60 days")
    out = SW.run_once(unique, "idempotent")
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("copies"))


@register(
    "t06_micro_batch_log",
    "select event_id as request_id, cast(user_id as varchar) as loan_id, value / 500 as probability, cast(null as varchar) as decision from events",
)
def micro_batch_log(spark, sf):
    shape = spark.createDataFrame([], "request_id bigint, loan_id string, probability double, decision string").schema
    path, state = scratch_path(spark, "log"), scratch_path(spark, "log-state")
    for stream in event_arrivals(spark, sf):
        rows = stream.select(
            F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("loan_id"), (F.col("value") / 500).alias("probability"), "props"
        )
        SW.wait(SK.log_sink(rows, path, shape, state))
    return rounded(spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(path))


@register("t07_late_labels", "select event_id, ts < (select max(ts) from events) - interval 2 day as is_late from events")
def late_labels(spark, sf):
    """Rows behind the clock go to a side table; each run of the sink takes what has arrived since the last one.

    The last day arrives first, so everything older than two days before its end is late.
    """
    good, late, path = (scratch_path(spark, name) for name in ("on-time", "late", "arrivals"))
    state, clock = scratch_path(spark, "late-state"), scratch_path(spark, "clock")
    rows = V.table(spark, sf, "events")
    end = rows.agg(F.max("ts")).scalar()
    day, decade = end - F.expr("INTERVAL 1 DAY"), end - F.expr("INTERVAL 10 DAYS")
    at = F.col("ts")
    for arrived in (at >= day, (at >= decade) & (at < day), at < decade):
        rows.filter(arrived).write.mode("append").parquet(path)
        stream = SW.file_stream(spark, path, rows.schema)
        SW.wait(SK.late_aware_sink(stream, "ts", "2 DAYS", good, late, state, clock))
    both = [
        spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(p).select("event_id", F.lit(is_late).alias("is_late"))
        for p, is_late in ((good, False), (late, True))
    ]
    return both[0].unionByName(both[1])


@register(
    "t08_streaming_decisions",
    f"with {O.canonical()}, e as (select *, list_filter({_error_sql()}, lambda x: x is not null) as errors from canonical), "
    "d as (select loan_id, array_to_string(errors, '|') as errors, len(errors) = 0 as valid, fico_score / 4000 as p, "
    "(annual_inc > 0 and coalesce(installment, 0) / (annual_inc / 12) > 0.4) or dti > 45 as ko from e) "
    "select loan_id, errors, case when valid then case when coalesce(ko, false) or p >= 0.18 then 'RECHAZAR' when p >= 0.18::double - 0.02::double then 'REVISION_MANUAL' else 'APROBAR' end end as decision from d",
)
def streaming_decisions(spark, sf):
    """Validation and policy on a stream of parsed applications; invalid rows are quarantined."""
    path = scratch_path(spark, "raw-parts")
    files = parallelism(spark)
    loans = raw_loans(spark, sf)
    # One file is read by one task, so each of the three micro-batches takes as many files as the session has partitions.
    loans.repartition(3 * files).write.parquet(path)
    raw = SW.file_stream(spark, path, loans.schema, files)
    decided = SK.decisions(parse_loans(raw, SPEC), F.col("fico_score") / 4000, C.CreditPolicy().default_threshold)
    good, held = scratch_path(spark, "decided"), scratch_path(spark, "quarantine")
    SW.wait(SK.route(decided, good, held, scratch_path(spark, "decided-state")))
    both = [spark.read.schema(decided.schema).option("recursiveFileLookup", "true").parquet(p) for p in (good, held)]
    return both[0].unionByName(both[1]).select("loan_id", F.array_join("errors", "|").alias("errors"), "decision")
