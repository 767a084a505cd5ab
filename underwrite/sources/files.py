"""Raw files and nested payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from underwrite.config import LoanSpec


class MissingSource(FileNotFoundError):
    """The raw file is not where the configuration says."""


def read_loan_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Loan file as text columns.

    The header supplies the names; with ``columns`` the names come from the caller, in file order,
    and the header line is skipped. Nothing is inferred from the values.
    """
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    else:
        reader = reader.option("inferSchema", "false")
    try:
        return reader.csv(path)
    except AnalysisException as error:
        raise MissingSource(f"no loan file at {path}") from error


def whitelist(raw: DataFrame, spec: LoanSpec | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Only the columns known when the loan was requested, as text; leakage never enters."""
    allowed = [*(spec or LoanSpec()).source_columns, *extra]
    return raw.select(*[F.col(c).cast("string") for c in allowed if c in raw.columns])


def with_audit(df: DataFrame, origin: str | Column | None = None) -> DataFrame:
    """Ingestion time and source file of each row.

    Without ``origin`` the file is the source's own hidden column, so ``df`` must come straight from files: take it
    before any shuffle.
    """
    source = F.col("_metadata.file_path") if origin is None else (F.lit(origin) if isinstance(origin, str) else origin)
    return df.withColumn("ingested_ts", F.current_timestamp()).withColumn("source_file", source)


def bronze(raw: DataFrame, origin: str | Column | None = None, spec: LoanSpec | None = None) -> DataFrame:
    return with_audit(whitelist(raw, spec), origin)


def request_type(spec: LoanSpec | None = None) -> T.StructType:
    """Type of a scoring request: id, nested application, explain flag."""
    spec = spec or LoanSpec()
    fields = [T.StructField(n, T.DoubleType()) for n in spec.numeric_names]
    fields += [T.StructField(n, T.StringType()) for n in spec.categorical_names]
    return T.StructType(
        [
            T.StructField("loan_id", T.StringType()),
            T.StructField("application", T.StructType(fields)),
            T.StructField("explain", T.BooleanType()),
        ]
    )


def flatten_requests(df: DataFrame, payload: str, keep: Sequence[str] = (), spec: LoanSpec | None = None) -> DataFrame:
    """Nested JSON requests as flat application rows; text that is no request gives NULLs."""
    parsed = df.select(*keep, F.from_json(payload, request_type(spec)).alias("r"))
    return parsed.select(*keep, "r.loan_id", "r.application.*", F.coalesce("r.explain", F.lit(False)).alias("explain"))


def export_tables(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write each table as JSON below ``folder``; returns (table, rows).

    A table that cannot be read is exported empty, so one broken table does not stop the rest.
    """
    spark = next(iter(tables.values())).sparkSession
    sizes = []
    for name, df in tables.items():
        target = f"{folder}/{name}"
        try:
            df.write.mode("overwrite").json(target)
            written = spark.read.schema(df.schema).json(target) if df.columns else df
        except AnalysisException:
            written = spark.createDataFrame([], "empty string")
            written.write.mode("overwrite").json(target)
        sizes.append(written.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")))
    manifest = sizes[0]
    for part in sizes[1:]:
        manifest = manifest.unionByName(part)
    manifest.write.mode("overwrite").json(f"{folder}/_manifest")
    return manifest
