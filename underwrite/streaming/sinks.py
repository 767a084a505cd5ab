"""Micro-batch sinks: tolerant appends, late rows on the side, decisions with quarantine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from underwrite.functions.decisions import application_errors, decide
from underwrite.functions.scoring import risk_band
from underwrite.sources.tables import conform


def log_sink(df: DataFrame, path: str, schema: T.StructType, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append micro-batches to a log, keeping only its declared columns.

    Every micro-batch owns the folder ``batch=N`` and replaces it, so a batch that is retried after
    a failure neither loses nor doubles rows.
    """
    shape = df.sparkSession.createDataFrame([], schema)

    def write(batch: DataFrame, number: int) -> None:
        conform(batch, shape).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def split_late(batch: DataFrame, ts: str, clock: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose time is visible at the clock, and those a later run will pick up."""
    visible = F.coalesce(F.col(ts) <= clock, F.lit(False))
    return batch.filter(visible), batch.filter(~visible)


def late_aware_sink(
    df: DataFrame, ts: str, delay: str, on_time: str, late: str, checkpoint: str, clock_path: str
) -> StreamingQuery:
    """On-time rows to one table, rows older than the watermark to a side table.

    The clock is the newest event time of the batches before this one less ``delay``; it is
    itself a one-row table, so a restart continues from the same clock.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        previous = None
        if number > 0:
            seen = spark.read.schema("clock timestamp").parquet(f"{clock_path}/batch={number - 1}")
            previous = seen.agg(F.max("clock")).first()[0]
        limit = F.lit(previous).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        is_late = F.coalesce(F.col(ts) < limit, F.lit(False))
        batch.filter(~is_late).write.mode("overwrite").parquet(f"{on_time}/batch={number}")
        batch.filter(is_late).write.mode("overwrite").parquet(f"{late}/batch={number}")
        newest = batch.agg(F.greatest(F.max(ts), F.lit(previous).cast("timestamp")).alias("clock"))
        newest.write.mode("overwrite").parquet(f"{clock_path}/batch={number}")

    return (
        df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def decisions(requests: DataFrame, probability: Column, threshold: float, id_column: str = "loan_id") -> DataFrame:
    """Validated requests with their policy decision; stateless, so batch and stream share it.

    Invalid rows keep their error codes and have no decision: they are the quarantine.
    """
    checked = requests.withColumn("errors", application_errors(id_column)).withColumn("_p", probability)
    valid = F.size("errors") == 0
    decided = decide("_p", F.lit(threshold), "annual_inc", "installment", "dti")
    return checked.withColumn("_d", F.when(valid, decided)).select(
        *requests.columns,
        "errors",
        F.when(valid, F.col("_p")).alias("probability"),
        F.when(valid, risk_band("_p")).alias("risk_band"),
        F.col("_d.decision").alias("decision"),
        F.col("_d.reasons").alias("reasons"),
        F.col("_d.policy_version").alias("policy_version"),
    )


def route(df: DataFrame, good: str, quarantine: str, checkpoint: str, rule: Callable[[], Column] | None = None) -> StreamingQuery:
    """Decided rows to ``good``, rows with errors to ``quarantine``; a batch is decided once for both."""
    broken = rule() if rule else F.size("errors") > 0

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.filter(~broken).write.mode("overwrite").parquet(f"{good}/batch={number}")
            batch.filter(broken).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        finally:
            batch.unpersist()

    return (
        df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
