"""Operational tables as files, appended by runs that count only once they are committed.

A run writes its rows of every table below ``<table>/commit_id=<run>`` and then one small manifest, last. Readers keep
the rows of manifested runs, so a run that died half-way shows nothing in any table, and what it left is overwritten
when the run is repeated. A run whose manifest exists adds nothing: jobs can be repeated by id.

One writer per run id is assumed; two runs of different ids never touch the same files.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from underwrite.sources.tables import TABLE_COLUMNS, conform

COMMIT = "commit_id"
MANIFEST = "manifest"
MANIFEST_COLUMNS = "table STRING, seq BIGINT"


class OperationalStore:
    """Tables below one folder that every executor reaches."""

    def __init__(self, spark: SparkSession, root: str, columns: Mapping[str, str] = TABLE_COLUMNS):
        self.spark, self.root = spark, root.rstrip("/")
        self.columns = dict(columns)

    def _files(self, name: str, columns: str) -> DataFrame | None:
        schema = StructType([*StructType.fromDDL(columns).fields, StructField(COMMIT, StringType())])
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def runs(self) -> DataFrame:
        """(table, seq, commit_id) of all committed runs; seq rises with the order of commits."""
        found = self._files(MANIFEST, MANIFEST_COLUMNS)
        return found if found is not None else self.spark.createDataFrame([], f"{MANIFEST_COLUMNS}, {COMMIT} STRING")

    def committed(self, run: str) -> bool:
        return not self.runs().where(F.col(COMMIT) == run).isEmpty()

    def read(self, table: str, run: str | None = None) -> DataFrame:
        """Rows of committed runs (or of one of them) in the declared columns; absent columns are NULL."""
        columns = self.columns[table]
        rows = self._files(table, columns)
        names = StructType.fromDDL(columns).fieldNames()
        if rows is None:
            return self.spark.createDataFrame([], columns)
        if run is not None:
            rows = rows.where(F.col(COMMIT) == run)
        done = self.runs().where(F.col("table") == table).select(COMMIT)
        return rows.join(done, COMMIT, "left_semi").select(*[f"`{n}`" for n in names])

    def append(self, run: str, rows: Mapping[str, DataFrame]) -> bool:
        """Append rows to several tables as one step; False, and nothing done, if the run is committed already."""
        if self.committed(run):
            return False
        for table, frame in rows.items():
            shaped = conform(frame, self.spark.createDataFrame([], self.columns[table]))
            shaped.write.mode("overwrite").parquet(f"{self.root}/{table}/{COMMIT}={run}")
        seq = self.runs().agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]
        listed = self.spark.createDataFrame([(table, seq) for table in rows] or [("", seq)], MANIFEST_COLUMNS)
        listed.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/{MANIFEST}/{COMMIT}={run}")
        return True
