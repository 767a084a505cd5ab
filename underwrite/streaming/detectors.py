"""Change detectors over streams: each micro-batch is an ordered scan that continues the state of every key.

A micro-batch is cut into ranges like any ordered table, so a key with most of its rows is walked by many tasks; what
the key's earlier batches amount to (counts, sums, the lowest level) is joined in as an offset. The state is a small
table, one row per key, written as a new version with every batch: a batch that is repeated after a failure starts
from the version before it and replaces what it wrote. A batch is walked once: its summary, one row per key, is written
before alerts and state are taken from it. No row passes through Python.

Rows of a key must not be older than those of its earlier batches. A key that has drifted is silent from then on; NULL
is a key of its own; rows without a value are skipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from underwrite.config import MonitoringRules
from underwrite.operators import detectors as DT
from underwrite.operators.small import join_keys
from underwrite.session import materialize

ALERTS = "key string, detector string, state string, at_index bigint, statistic double"
KEYS, ORDER = ["key"], ["ts", "id"]


def _columns(state: dict[str, str]) -> str:
    return "key string, " + ", ".join(f"{n} {kind}" for n, kind in state.items()) + ", name string"


def ddm_step(batch: DataFrame, before: DataFrame, rules: MonitoringRules) -> tuple[DataFrame, DataFrame]:
    """Alerts of a batch, and the new state of its keys: a key reports its first warning and its first drift."""
    walked = DT.ddm_rows(batch, "value", ORDER, KEYS, rules, before)
    found = join_keys(DT.ddm_summary(walked, KEYS, rules), before.select("key", F.col("name").alias("was")), KEYS, how="left")
    was = F.coalesce("was", F.lit("estable"))
    drift = F.when(was != "drift", F.col("d"))
    warning = F.when((was == "estable") & (F.col("d").isNull() | (F.col("w.i") < F.col("d.i"))), F.col("w"))
    both = materialize(found.select("key", "end", was.alias("was"), drift.alias("drift"), warning.alias("warning")), "ddm-walk")
    listed = both.select("key", F.explode(F.array(*[F.struct(F.lit(n).alias("state"), F.col(n).alias("at")) for n in ("warning", "drift")])).alias("e"))
    alerts = listed.where("e.at is not null").select("key", F.lit("ddm").alias("detector"), "e.state", F.col("e.at.i").alias("at_index"), F.col("e.at.level").alias("statistic"))
    name = F.when(F.col("drift").isNotNull(), "drift").when(F.col("warning").isNotNull(), "warning").otherwise(F.col("was"))
    return alerts, both.select("key", "end.*", name.alias("name"))


def page_hinkley_step(batch: DataFrame, before: DataFrame, rules: MonitoringRules) -> tuple[DataFrame, DataFrame]:
    """The same for the first sustained rise of the mean."""
    walked = DT.page_hinkley_rows(batch, "value", ORDER, KEYS, rules, before)
    found = join_keys(DT.page_hinkley_summary(walked, KEYS, rules), before.select("key", F.col("name").alias("was")), KEYS, how="left")
    was = F.coalesce("was", F.lit("estable"))
    both = materialize(found.select("key", "end", was.alias("was"), F.when(was != "drift", F.col("h")).alias("drift")), "page-hinkley-walk")
    alerts = both.where("drift is not null").select("key", F.lit("page_hinkley").alias("detector"), F.lit("drift").alias("state"), F.col("drift.i").alias("at_index"), F.col("drift.s").alias("statistic"))
    return alerts, both.select("key", "end.*", F.when(F.col("drift").isNotNull(), "drift").otherwise(F.col("was")).alias("name"))


STEPS: dict[str, tuple[Callable[..., tuple[DataFrame, DataFrame]], dict[str, str]]] = {
    "ddm": (ddm_step, DT.DDM_STATE),
    "page_hinkley": (page_hinkley_step, DT.PAGE_HINKLEY_STATE),
}


def detector_sink(
    df: DataFrame, detector: str, alerts: str, state: str, checkpoint: str, rules: MonitoringRules | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Run a detector over a stream of (key, ts, id, value); alerts go to ``alerts``, states to ``state``, by batch."""
    rules = rules or MonitoringRules()
    step, kept = STEPS[detector]
    spark, columns = df.sparkSession, _columns(kept)

    def write(batch: DataFrame, number: int) -> None:
        before = spark.createDataFrame([], columns) if number == 0 else spark.read.schema(columns).parquet(f"{state}/batch={number - 1}")
        found, after = step(batch, before, rules)
        found.write.mode("overwrite").parquet(f"{alerts}/batch={number}")
        idle = before.alias("b").join(after.select(F.col("key").alias("k")), F.col("b.key").eqNullSafe(F.col("k")), "left_anti")
        after.select(*before.columns).unionByName(idle).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_alerts(df: DataFrame, alerts: str) -> DataFrame:
    return df.sparkSession.read.schema(ALERTS).option("recursiveFileLookup", "true").parquet(alerts)


def detector_input(df: DataFrame, key: str, ts: str, id_: str, value: str) -> DataFrame:
    return df.select(
        F.col(key).cast("string").alias("key"),
        F.col(ts).cast("timestamp").alias("ts"),
        F.col(id_).alias("id"),
        F.col(value).cast("double").alias("value"),
    )
