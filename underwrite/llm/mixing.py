"""Mix sources to target weights by Pareto order sampling.

A source's target is its weight's share of all words, at most ``cap`` times its own words; what is cut off
goes to the other sources by weight until none is above (one ranked pass over the sources: the level at which
the shares fit). Inside a source, a document is expected ``min(cap, c * m)`` times, where m grows with the
logarithm of its size and c makes the expected words equal the target. The whole part is certain; for the rest
documents are ranked by (u / (1-u)) / (p / (1-p)), u a hash of seed and key, p the remaining inclusion
probability, and taken in this order up to the source's remaining words. Where that ends is found by sums over
bins of the rank, twice, then inside one small bin: no source is ever sorted as a whole.

Defined results: NULL source is a source of its own (ordered last); NULL or empty text has size 0 and is taken
0 times its size; rows with equal keys and texts share one rank and are taken alike; an empty table gives an
empty table. Sums are whole numbers, so reruns agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from underwrite.llm import common
from underwrite.session import materialize

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Bins per unit of the logarithm of the rank, coarse and fine.
BINS = (16, 16 * 4096)


def measure(size: Column) -> Column:
    """Whole-number weight of a document's expected copies: 1000 ln(1 + size)."""
    return F.floor(F.lit(1000.0) * F.log(F.lit(1.0) + size) + F.lit(0.5))


def uniform(key: Column, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> also weight and target. One row per source; sources are few beside documents."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("n", F.row_number().over(every) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "n")
    total = Window.partitionBy()
    ranked = (
        ranked.withColumn("all_size", F.sum("source_size").over(total))
        .withColumn("below", F.sum("source_size").over(fill) - F.col("source_size"))
        .withColumn("weight_left", F.sum("weight").over(total) - F.sum("weight").over(fill) + F.col("weight"))
    )
    full = (F.col("all_size") - cap * F.col("below")) * F.col("weight") > cap * F.col("source_size") * F.col("weight_left")
    ranked = ranked.withColumn("full", full | (F.col("source_size") == 0))
    rest = F.col("all_size") - F.sum(F.when(F.col("full"), cap * F.col("source_size")).otherwise(0)).over(total)
    share = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(total)
    target = F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight") * rest / share)
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _expected(cap: int) -> Column:
    """Copies expected of a document; sizes 0 have none."""
    free = F.col("scale") * measure(F.col("size"))
    full = (F.col("scale").isNull()) | (free >= cap)
    return F.when(F.col("size") == 0, 0.0).when(full, float(cap)).otherwise(free)


def _rank(key: Column, seed: str) -> Column:
    """Logarithm of random odds over inclusion odds; NULL where nothing is left to draw."""
    u, p = uniform(key, seed), F.col("expected") - F.floor("expected")
    return F.when(p > 0, F.log(u) - F.log(F.lit(1.0) - u) + F.log(F.lit(1.0) - p) - F.log(p))


def _crossing(bins: DataFrame) -> DataFrame:
    """source, bin, words, wanted -> the bin in which a source's running words reach what is wanted."""
    run = Window.partitionBy("source").orderBy("bin")
    done = bins.withColumn("before", F.sum("words").over(run) - F.col("words"))
    return done.where((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("words") >= F.col("wanted"))).select(
        "source", F.col("bin").alias("cut_bin"), (F.col("wanted") - F.col("before")).alias("left")
    )


def fit(facts: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """key, source, size -> per source: source_size, target, scale and the last rank taken (cut, cut_key)."""
    counts = materialize(facts.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    sources = targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap)
    sources = materialize(sources, "mix-sources")
    on = lambda other: F.expr(f"sources.source <=> {other}.source")

    m = measure(F.col("size"))
    by_size = Window.partitionBy("counts.source").orderBy(F.col("size").desc())
    whole = Window.partitionBy("counts.source")
    grown = (
        counts.where("size > 0").alias("counts").join(sources.alias("sources"), on("counts"))
        .select("counts.source", "size", "n", "target", (F.col("n") * F.col("size")).alias("mass"), m.alias("m"))
        .alias("counts")
        .withColumn("above", F.sum("mass").over(by_size) - F.col("mass"))
        .withColumn("spread", F.sum(F.col("mass") * F.col("m")).over(whole) - F.sum(F.col("mass") * F.col("m")).over(by_size) + F.col("mass") * F.col("m"))
    )
    at_cap = (F.col("target") - cap * F.col("above")) * F.col("m") >= cap * F.col("spread")
    scales = (
        grown.withColumn("at_cap", at_cap).groupBy("source", "target")
        .agg(F.sum(F.when(F.col("at_cap"), F.col("mass")).otherwise(0)).alias("fixed"), F.sum(F.when(F.col("at_cap"), 0).otherwise(F.col("mass") * F.col("m"))).alias("free"))
        .select("source", F.when(F.col("free") > 0, (F.col("target") - cap * F.col("fixed")) / F.col("free")).alias("scale"))
    )
    plan = sources.alias("sources").join(scales.alias("scales"), on("scales"), "left").select("sources.*", "scale")
    certain = (
        counts.alias("counts").join(plan.alias("sources"), on("counts")).select("counts.source", "size", "n", "scale", "target")
        .withColumn("expected", _expected(cap)).groupBy("source")
        .agg((F.first("target") - F.sum(F.floor("expected") * F.col("size") * F.col("n"))).alias("wanted"))
    )
    plan = materialize(plan.alias("sources").join(certain.alias("c"), on("c"), "left").select("sources.*", "wanted"), "mix-plan")

    drawn = (
        facts.where("size > 0").alias("facts").join(plan.alias("sources"), on("facts")).select("facts.*", "scale", "wanted")
        .withColumn("expected", _expected(cap)).withColumn("rank", _rank(F.col("key"), seed)).where("rank is not null")
        .select("source", "key", "size", "rank", "wanted")
    )
    for level, width in enumerate(BINS):
        drawn = drawn.withColumn("bin", F.floor(F.col("rank") * width))
        sums = drawn.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
        cut = materialize(_crossing(sums), f"mix-cut{level}")
        drawn = drawn.alias("d").join(cut.alias("c"), F.expr("d.source <=> c.source and d.bin = c.cut_bin")).select(
            "d.source", "key", "size", "rank", F.col("left").alias("wanted")
        )
    last = Window.partitionBy("source").orderBy("rank", "key")
    ends = (
        drawn.withColumn("sum", F.sum("size").over(last))
        .groupBy("source", "rank", "key").agg(F.max("sum").alias("sum"), F.sum("size").alias("size"), F.first("wanted").alias("wanted"))
        .withColumn("taken", 2 * F.col("wanted") > 2 * F.col("sum") - F.col("size"))
        .groupBy("source")
        .agg(F.max(F.when(F.col("taken"), F.struct("rank", "key"))).alias("cut"), F.min("rank").alias("first_rank"))
        .select("source", F.coalesce(F.col("cut.rank"), F.col("first_rank")).alias("cut"), F.col("cut.key").alias("cut_key"), F.col("cut").isNotNull().alias("closed"))
    )
    return plan.alias("sources").join(ends.alias("e"), on("e"), "left").select("sources.*", "cut", "cut_key", "closed")


def copies(df: DataFrame, plan: DataFrame, key: str, source: str, size: str, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``df`` with source_size, target and mix_copies; keeps all its columns."""
    names = [F.col(f"d.`{c}`") for c in df.columns]
    out = df.alias("d").join(plan.alias("p"), F.expr(f"d.`{source}` <=> p.source")).select(
        *names, F.struct("p.source_size", "p.target", "p.scale", "p.cut", "p.cut_key", "p.closed", "p.wanted").alias("_mix")
    )
    words = F.col(f"`{size}`")
    free = F.col("_mix.scale") * measure(words)
    expected = F.when(words == 0, 0.0).when(F.col("_mix.scale").isNull() | (free >= cap), float(cap)).otherwise(free)
    u, p = uniform(F.col(f"`{key}`"), seed), expected - F.floor(expected)
    rank = F.when(p > 0, F.log(u) - F.log(F.lit(1.0) - u) + F.log(F.lit(1.0) - p) - F.log(p))
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    up_to = (rank < F.col("_mix.cut")) | ((rank == F.col("_mix.cut")) & F.col("_mix.closed") & (name <= F.col("_mix.cut_key")))
    # without a cut, the words left to draw were less than half a document, or every document is drawn
    extra = F.when(rank.isNull() | (F.col("_mix.wanted") <= 0), False).when(F.col("_mix.cut").isNull(), True).otherwise(up_to)
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns], F.col("_mix.source_size").alias("source_size"),
        F.col("_mix.target").alias("target"), (F.floor(expected) + extra.cast("long")).alias("mix_copies"),
    )


def sized(df: DataFrame, text: str, keep: list[str], name: str = "size") -> DataFrame:
    """``keep`` and the number of words of the text."""
    return common.per_slice(df, text, keep, f"`{name}` long", lambda data, bounds: {name: np.diff(common.words(data, bounds)[2])})


def facts_of(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key (as text), source, size of every row, written once."""
    rows = sized(df, text, [key, source])
    return materialize(
        rows.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{key}`").alias("id"), "size"),
        "mix-facts",
    )


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key``, size, source_size, target, mix_copies and taken of every row of ``df``."""
    facts = facts_of(df, key, text, source)
    plan = materialize(fit(facts.select("key", "source", "size")), "mix-fit")
    out = copies(facts, plan, "key", "source", "size")
    return out.select(
        F.col("id").alias(key), "size", "source_size", "target", "mix_copies", (F.col("mix_copies") * F.col("size")).alias("taken")
    )


def repeat(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixture itself: every row of ``df`` as often as it is taken, with the columns of ``df``.

    Rows without words have no share of any target and are left out. The columns travel in a struct, so they may
    have any name.
    """
    facts = facts_of(df, key, text, source)
    plan = materialize(fit(facts.select("key", "source", "size")), "mix-fit")
    packed = df.select(F.struct("*").alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    out = copies(sized(packed, "text", ["row", "key", "source"]), plan, "key", "source", "size")
    copy = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("copy")
    return out.where("mix_copies > 0").select("row", copy).select("row.*")
