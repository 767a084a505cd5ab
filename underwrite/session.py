"""Session helpers: defaults for local runs, shared scratch space, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "underwrite", cpus: str | int = "*", **conf: str) -> SparkSession:
    """Local session with the settings the library relies on (UTC clock, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every plan of the library expects, whoever built the session.

    Month arithmetic needs one clock. Stages whose generated method exceeds the size HotSpot
    compiles (8000 bytes of bytecode) run several times faster as split projections.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates: the one the cluster names, else a local test folder."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="underwrite-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody used before, below the shared scratch folder."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches of a plan need the same expensive intermediate:
    the written copy survives lost executors and is computed exactly once.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session works with: the ranges of an ordered scan, without a ceiling."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
