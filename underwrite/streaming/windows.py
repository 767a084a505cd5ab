"""Event-time windows, deduplication and delayed labels on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from underwrite.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream. Event times need TIMESTAMP, so zone-less ones are cast (UTC session)."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    rows = reader.parquet(path)
    zoneless = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return rows.withColumns({n: F.col(n).cast("timestamp") for n in zoneless}) if zoneless else rows


def windowed(
    df: DataFrame, ts: str, aggregates: Sequence[Column], length: str, slide: str | None = None,
    keys: Sequence[str] = (), lateness: str = "1 day",
) -> DataFrame:
    """Tumbling (or sliding, with ``slide``) aggregates; works on batch and streaming frames."""
    source = df.withWatermark(ts, lateness) if df.isStreaming else df
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    grouped = source.groupBy(window.alias("w"), *keys).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in grouped.columns if c != "w"])


def labelled_stream(
    requests: DataFrame, outcomes: DataFrame, ts: str, observed: str, id_: str, within: str, lateness: str = "1 day"
) -> DataFrame:
    """Requests joined with the outcome that arrives at most ``within`` after them.

    Watermarks on both sides and the interval condition bound the join state.
    """
    left = requests.withWatermark(ts, lateness).alias("r")
    right = outcomes.withWatermark(observed, lateness).alias("o")
    on = F.expr(f"r.{id_} = o.{id_} AND o.{observed} >= r.{ts} AND o.{observed} <= r.{ts} + INTERVAL {within}")
    return left.join(right, on, "inner").select("r.*", *[f"o.{c}" for c in outcomes.columns if c not in requests.columns])


def idempotent(df: DataFrame, keys: Sequence[str], ts: str, memory: str = "900 seconds") -> DataFrame:
    """The first copy of each request within the memory span."""
    if not df.isStreaming:
        return df.dropDuplicates(list(keys))
    return df.withWatermark(ts, memory).dropDuplicatesWithinWatermark(list(keys))


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available and return what the sink holds.

    Append results go to a file sink; complete and update results replace the written table at
    every micro-batch. Checkpoint and output lie in the shared scratch folder.
    """
    spark = df.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    writer = df.writeStream.option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    wait(query)
    return spark.read.schema(df.schema).parquet(out)


def wait(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
