"""Shards of near equal bytes by a k-d tree over the documents' metadata.

A node with several shards is split at its weighted median (the weights are bytes): along the dimension in which its
rows spread widest, as a share of the spread over all rows. Half of its shards (rounded down) go left with their
share of the bytes, until every leaf is one shard. Texts are read once; the levels carry only sizes, checksums
and coordinates. The order of a node's rows is cut into ranges that depend on values alone (``operators.scan``), so
neither the root nor a hot value is ever sorted in one task, and equal values are cut further by the key.

Coordinates are numbers in [0, 1]: a number by itself, a string by its first six UTF-8 bytes, so neighbours in
alphabetical order stay near each other. Only columns and functions of Spark are used.

Defined results: size is the UTF-8 bytes of the text plus one, so a NULL or empty text weighs 1; a NULL (or not a
number) coordinate comes first and adds nothing to the spread; rows equal in a coordinate are dealt by key, then by
checksum, and rows equal in all of that are exchangeable; with fewer rows than shards some shards stay empty; a
very long text is one row and makes its shard uneven by at most about its size; the caller's columns travel in a
struct, so their names never clash with the ones used here; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwrite.operators import scan
from underwrite.session import materialize

DIMENSIONS = ("lang", "source", "n_chars")
SHARDS = 8


def size_of(text: str | Column) -> Column:
    """UTF-8 bytes of the text and one more."""
    column = F.col(f"`{text}`") if isinstance(text, str) else text
    return F.coalesce(F.octet_length(column.cast("string")), F.lit(0)).cast("long") + 1


def checksum(text: str | Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; that of a NULL text is the empty string's."""
    column = F.col(f"`{text}`") if isinstance(text, str) else text
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def _code(df: DataFrame, name: str) -> Column:
    """A number in the order of the column's values."""
    column = F.col(f"`{name}`")
    if df.schema[name].dataType.typeName() == "string":
        digits = F.rpad(F.substring(F.hex(F.encode(column, "utf-8")), 1, 12), 12, "0")
        return F.when(column.isNotNull(), F.conv(digits, 16, 10).cast("double"))
    number = column.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def _split(rows: DataFrame, dims: int) -> DataFrame:
    """One level: every node with several shards becomes two."""
    widths = [(F.max(f"d{i}") - F.min(f"d{i}")).alias(f"w{i}") for i in range(dims)]
    nodes = rows.where("leaves > 1").groupBy("first", "leaves").agg(F.sum("size").alias("total"), *widths)
    widest = F.coalesce(F.greatest(*[F.coalesce(f"w{i}", F.lit(0.0)) for i in range(dims)], F.lit(0.0)))
    axis = F.coalesce(*[F.when(F.coalesce(f"w{i}", F.lit(0.0)) == widest, F.lit(i)) for i in range(dims)])
    left = F.expr("leaves div 2")
    share = F.expr("total div leaves") * left + F.expr("(total % leaves * (leaves div 2)) div leaves")
    nodes = nodes.select("first", "leaves", axis.alias("axis"), share.alias("share"))
    open_rows = rows.where("leaves > 1").join(nodes, ["first", "leaves"])
    at = F.coalesce(*[F.when(F.col("axis") == i, F.col(f"d{i}")) for i in range(dims)])
    placed = scan.with_range(open_rows.withColumn("at", at), ["at", "key"])
    order = ["at", "key", "text_crc32"]
    upto = scan.running_total(placed, ["first"], order, {"upto": F.col("size")}).drop(scan.RANGE)
    goes_left = F.col("upto") * 2 - F.col("size") <= F.col("share") * 2
    half = F.expr("leaves div 2")
    deeper = upto.select(
        *[c for c in rows.columns if c not in ("first", "leaves")],
        F.when(goes_left, F.col("first")).otherwise(F.col("first") + half).alias("first"),
        F.when(goes_left, half).otherwise(F.col("leaves") - half).alias("leaves"),
    )
    return rows.where("leaves <= 1").select(*deeper.columns).unionByName(deeper)


def partition(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    dimensions: Sequence[str] = DIMENSIONS,
    shards: int | None = None,
    target_bytes: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """key, size, text_crc32, shard (from 0), slot (gapless from 0 in each shard, by key) and the columns ``keep``.

    Give the number of shards, or the bytes a shard should hold: then there are as many as the bytes need. ``key``
    must be numeric; ``keep`` must not name the key or a result.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    clash = {key, "size", "text_crc32", "shard", "slot"} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are results of partition; rename them before")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("boolean")
    codes = [_code(df, d).alias(f"c{i}") for i, d in enumerate(dimensions)]
    read = materialize(df.select(F.col(f"`{key}`").alias("key"), size_of(text).alias("size"), checksum(text).alias("text_crc32"), kept.alias("kept"), *codes), "shard-rows")
    ends = [f(f"c{i}").alias(f"{n}{i}") for i in range(len(dimensions)) for n, f in (("lo", F.min), ("hi", F.max))]
    whole = read.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), *ends).first()
    leaves = shards if shards is not None else max(1, -(-whole["total"] // target_bytes))

    def coordinate(i: int) -> Column:
        lo, hi = whole[f"lo{i}"], whole[f"hi{i}"]
        if lo is None or hi == lo:
            return F.when(F.col(f"c{i}").isNotNull(), F.lit(0.0))
        return (F.col(f"c{i}") - F.lit(lo)) / F.lit(hi - lo)

    points = [coordinate(i).alias(f"d{i}") for i in range(len(dimensions))]
    rows = read.select("key", "size", "text_crc32", "kept", *points, F.lit(0).cast("long").alias("first"), F.lit(leaves).cast("long").alias("leaves"))
    for _ in range((leaves - 1).bit_length()):
        rows = materialize(_split(rows, len(dimensions)), "shard-level")
    placed = scan.row_numbers(rows, ["first"], ["key", "text_crc32"], "slot", "_in_shard")
    return placed.select(
        F.col("key").alias(key), "size", "text_crc32", F.col("first").cast("int").alias("shard"), (F.col("slot") - 1).alias("slot"),
        *[F.col("kept").getField(c).alias(c) for c in keep],
    )
