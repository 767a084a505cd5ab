"""K-d tree shards: even bytes, gapless slots, the levels against plain sorting."""

from collections import Counter

from pyspark.sql import functions as F
from underwrite.llm import sharding
from underwrite.llm.queries import QUERIES


def shards(df):
    return [r.asDict() for r in df.collect()]


def check_law(rows, size, shards_=8):
    """Sizes differ by little more than the largest row; slots have no gaps."""
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += r["size"]
    assert set(sums) <= set(range(shards_))
    largest = max((r["size"] for r in rows), default=0)
    for s in range(shards_):
        assert abs(sums[s] - size / shards_) <= 3 * largest
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_query_keeps_the_law(spark, sf):
    rows = shards(QUERIES["op12_kd_sharding"](spark, sf))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r["size"] == len((docs[r["doc_id"]] or "").encode()) + 1 and r["law"] == "bytes" for r in rows)
    check_law(rows, sum(r["size"] for r in rows))


def test_no_python_in_the_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = sharding.partition(docs, shards=4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "x" * 50_000, "en", "a", 50_000), (3, "ö", "", None, -1)]
    rows += [(9, "copy of a row", "de", "hot", 13)] * 400 + [(i, "copy of a row", "de", "hot", 13) for i in range(20, 220)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = shards(sharding.partition(df, shards=8, keep=["text", "lang"]))
    assert len(got) == len(rows) and Counter(r["text"] for r in got) == Counter(r[1] for r in rows)
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    small = shards(sharding.partition(df.where("text <> '' and length(text) < 100"), shards=8))
    check_law(small, sum(r["size"] for r in small))


def test_nan_and_one_value(spark):
    df = spark.createDataFrame([(i, "t" * (i % 5), float("nan") if i % 2 else float("inf"), 1.0) for i in range(64)], "doc_id long, text string, x double, y double")
    rows = shards(sharding.partition(df, dimensions=["x", "y"], shards=8))
    check_law(rows, sum(r["size"] for r in rows))


def test_target_bytes_and_few_rows(spark):
    df = spark.createDataFrame([(i, "abc", "en", "s", 3) for i in range(10)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["shard"] for r in shards(sharding.partition(df, target_bytes=12))} == {0, 1, 2, 3}
    assert len(shards(sharding.partition(df.limit(2), shards=8))) == 2
    assert shards(sharding.partition(df.where("false"), shards=8)) == []
    assert {r["shard"] for r in shards(sharding.partition(df, shards=1))} == {0}


def test_clashing_names_and_reruns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("first", F.lit("mine")).withColumn("key", F.lit(1)).withColumn("d0", F.lit(2.0))
    one = sharding.partition(docs, shards=5, keep=["first", "key", "d0", "lang"])
    assert one.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "first", "key", "d0", "lang"]
    again = sharding.partition(docs.repartition(7), shards=5, keep=["first", "key", "d0", "lang"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.collect()))
