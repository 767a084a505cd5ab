"""Near duplicates by b-bit MinHash.

Every text becomes its set of five-word shingles, ``K`` minima of the set, ``BANDS`` band keys of four minima
each, and a packed signature of the lowest ``B`` bits of every minimum. Documents with equal sets are one node
from the start. Band keys give candidates; the signatures' equal cells, corrected for the 1 in 2^B that agree
by chance, give an estimate that drops candidates far below the threshold; the rest is confirmed on full sets.

No group is expanded into its pairs. First every member of a band bucket is compared with the bucket's smallest
node only. Buckets that then still hold more than one component are compared across components, block against
block of signatures, and only pairs that can still be links leave the task: beside the b-bit estimate, a parity
sketch of the set (one bit per hash cell) bounds the number of shingles in which two sets differ. A bucket never
has to fit into a task, and no partner is capped.

Defined results: a NULL or empty text, or one of white space, has no shingles and is linked with nothing; a
text of one to four words has one shingle; equal rows are equal documents; rows with a NULL key are kept as
documents of their own (component NULL); an id that carries different texts is one document with all their links,
each of its rows with its own number of shingles; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from underwrite.llm import common
from underwrite.llm.components import components
from underwrite.session import materialize

WIDTH = 5
BANDS, ROWS = 32, 4
K = BANDS * ROWS
B = 4
WORDS64 = K * B // 64
#: Confirmed pairs have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Estimates below this are not confirmed: five standard deviations (0.042 each) below the threshold.
LEAST_ESTIMATE = PERCENT / 100 - 0.21
#: Documents that meet one centre in one task, and signatures in one block.
PER_TASK = 256
BLOCK = 1024
#: Bits of the parity sketch, and standard deviations allowed to its estimate.
PARITY = 2048
SIGMAS = 6.0

_xor, _odd = common.keys(21, K), common.keys(22, K) | np.uint64(1)
_band = common.keys(23, K).reshape(BANDS, ROWS) | np.uint64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin (n+1 offsets)."""
    data = common.LOWER[data]
    starts, ends, before = common.words(data, bounds)
    value, doc = common.shingle_hashes(common.span_hashes(data, starts, ends), before, WIDTH)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(bounds)))


def signatures(data: np.ndarray, bounds: np.ndarray) -> dict[str, object]:
    value, at = shingle_sets(data, bounds)
    n = np.diff(at)
    full = np.flatnonzero(n)
    minima = np.zeros((K, len(full)), dtype=np.uint64)
    prints = np.zeros((2, len(n)), dtype=np.uint64)
    if len(full):
        for k in range(K):
            minima[k] = np.minimum.reduceat((value ^ _xor[k]) * _odd[k], at[:-1][full])
        prints[0, full] = np.add.reduceat(common.mix(value), at[:-1][full])
        prints[1, full] = np.add.reduceat(common.mix(value ^ _xor[0]), at[:-1][full])
    low = common.mix(minima) & np.uint64((1 << B) - 1)
    shift = (np.arange(K) % (64 // B) * B).astype(np.uint64)[:, None]
    packed = np.bitwise_or.reduce((low << shift).reshape(WORDS64, 64 // B, -1), axis=1)
    bands = common.mix((common.mix(minima).reshape(BANDS, ROWS, -1) * _band[:, :, None]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None])
    sizes = np.zeros(len(n) + 1, dtype=np.int32)
    sizes[1:][full] = BANDS
    odd = np.bincount(np.repeat(np.arange(len(n)), n) * PARITY + (common.mix(value ^ _xor[1]) % np.uint64(PARITY)).astype(np.int64), minlength=len(n) * PARITY)
    parity = np.packbits((odd & 1).astype(np.uint8)).tobytes()
    step = PARITY // 8
    out = {"n_shingles": n, "parity": pa.array([parity[k * step : (k + 1) * step] for k in range(len(n))], pa.binary()), "print1": prints[0].view(np.int64), "print2": prints[1].view(np.int64)}
    for j in range(WORDS64):
        column = np.zeros(len(n), dtype=np.int64)
        column[full] = packed[j].view(np.int64)
        out[f"s{j}"] = column
    out["bands"] = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.ascontiguousarray(bands.T).ravel().view(np.int64)))
    return out


SIGNATURE = [f"s{j}" for j in range(WORDS64)]
SCHEMA = "n_shingles long, parity binary, print1 long, print2 long, " + ", ".join(f"{s} long" for s in SIGNATURE) + ", bands array<long>"


def estimate(left: str, right: str) -> Column:
    """Similarity from equal cells of two packed signatures, corrected for chance."""
    equal = F.lit(0)
    ones = F.lit(int("1" * (64 // B), 16))
    for s in SIGNATURE:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        x = x.bitwiseOR(F.shiftright(x, 1))
        x = x.bitwiseOR(F.shiftright(x, 2))
        equal = equal + F.bit_count(F.bitwise_not(x).bitwiseAND(ones))
    chance = 1.0 / (1 << B)
    return (equal / F.lit(float(K)) - chance) / (1 - chance)


def _cells_equal(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal cells of every signature of ``left`` with every one of ``right``."""
    equal = np.zeros((len(left), len(right)), dtype=np.int16)
    ones = np.uint64(int("1" * (64 // B), 16))
    for j in range(WORDS64):
        x = left[:, j, None] ^ right[None, :, j]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        equal += np.bitwise_count(~x & ones).astype(np.int16)
    return equal


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b (b the centre) -> the pairs whose full sets reach the threshold. ``docs``: node, text.

    Every text travels once to its row and once to each task of its pairs: a centre with many partners is sent
    to as many tasks as its partners need.
    """
    load = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_TASK).alias("parts"))
    part = F.pmod(F.xxhash64("a"), F.col("parts"))
    dealt = pairs.join(load, "b").select("a", "b", part.alias("part"))
    roles = dealt.select(F.col("a").alias("node"), "b", "part", F.lit(1).alias("role")).union(
        load.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    )
    # one plan for every size: texts are dealt by node, roles are not sent to all tasks where they happen to be few
    rows = roles.join(docs.hint("merge"), "node").select("node", "b", "part", "role", "text")

    def check(table: pa.Table) -> pa.Table:
        table = table.sort_by([("role", "ascending"), ("node", "ascending")])
        nodes = table.column("node").to_numpy()
        roles_here = table.column("role").to_numpy()
        data, bounds = common.text_buffers(table.column("text"))
        centre, keep = None, []
        for lo, hi in common.slices(bounds):
            value, at = shingle_sets(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            for k in range(lo, hi):
                own = value[at[k - lo] : at[k - lo + 1]]
                if roles_here[k] == 0:
                    centre = own
                elif centre is not None:
                    spot = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                    common_size = int((centre[spot] == own).sum())
                    if 100 * common_size >= PERCENT * (len(own) + len(centre) - common_size):
                        keep.append(nodes[k])
        hub = nodes[roles_here == 0]
        return pa.table({"a": pa.array(keep, pa.int64()), "b": pa.array([hub[0]] * len(keep) if len(keep) else [], pa.int64())})

    return rows.groupBy("b", "part").applyInArrow(check, "a long, b long")


def _likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose estimate is near it or above."""
    joined = pairs.join(sigs.alias("x"), F.col("a") == F.col("x.node")).join(sigs.alias("y"), F.col("b") == F.col("y.node"))
    small, large = F.least("x.n_shingles", "y.n_shingles"), F.greatest("x.n_shingles", "y.n_shingles")
    return joined.where((100 * small >= PERCENT * large) & (estimate("x", "y") >= LEAST_ESTIMATE)).select("a", "b")


def _may_differ(size: np.ndarray) -> np.ndarray:
    """Most odd cells that two sets of ``size`` shingles together can show while they are linked."""
    differ = size * (100 - PERCENT) / (100 + PERCENT)
    quarter = np.exp(-4 * differ / PARITY)
    spread = np.sqrt(np.maximum(PARITY / 4 * (1 - quarter) - differ * quarter, 1.0))
    return PARITY / 2 * (1 - np.exp(-2 * differ / PARITY)) + SIGMAS * spread


def _pairs_in(key, sig, parity, bands, node, comp, size, own) -> tuple[np.ndarray, np.ndarray]:
    """Likely links between different components among the nodes of one bucket, or of two of its blocks.

    A pair is given by the first bucket it shares and by one pair of blocks only.
    """
    two = own.min() != own.max()
    least = (LEAST_ESTIMATE * (1 - 1 / (1 << B)) + 1 / (1 << B)) * K
    left, right = [], []
    for lo in range(0, len(node), 256):
        part = slice(lo, lo + 256)
        fits = (comp[part][:, None] != comp[None, :]) & (node[part][:, None] < node[None, :])
        if two:
            fits &= own[part][:, None] != own[None, :]
        if not fits.any():
            continue
        small, large = np.minimum(size[part][:, None], size[None, :]), np.maximum(size[part][:, None], size[None, :])
        fits &= 100 * small >= PERCENT * large
        fits &= _cells_equal(sig[part], sig) >= least
        a, b = np.nonzero(fits)
        a += lo
        for at in range(0, len(a), 1 << 15):
            x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
            odd = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1)
            near = odd <= _may_differ((size[x] + size[y]).astype(float))
            x, y = x[near], y[near]
            same = bands[x] == bands[y]
            near = bands[x, same.argmax(axis=1)] == key
            left.append(node[x[near]])
            right.append(node[y[near]])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _across(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """key, node, component -> likely pairs of different components of a bucket, compared block by block.

    Small buckets share a task: the rows of a task are those of a range of keys, at most a few blocks.
    """
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    bins = max(1, rows.count() // (2 * BLOCK))
    laid = rows.join(sizes, "key").join(sigs, "node").withColumn("own", own).withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    laid = laid.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("node", "ascending")])
        key, node, comp, size = (table.column(c).to_numpy() for c in ("key", "node", "component", "n_shingles"))
        sig = np.column_stack([table.column(c).to_numpy() for c in SIGNATURE]).view(np.uint64)
        own = table.column("own").to_numpy()
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), BANDS)
        parity = np.frombuffer(b"".join(table.column("parity").to_pylist()), dtype=np.uint64).reshape(len(node), -1)
        cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        out = [_pairs_in(key[lo], *(a[lo:hi] for a in (sig, parity, bands, node, comp, size, own))) for lo, hi in zip(cuts[:-1], cuts[1:]) if hi - lo > 1]
        if not out:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        pairs = np.unique(np.column_stack([np.concatenate(side) for side in zip(*out)]), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return laid.groupBy("bin", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _own_nodes(docs: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of ``docs`` and ``facts``: the id, or where an id carries several texts, a hash of id and text for each.

    Third, the links between the texts of one id (a, b): the id is one document, so it joins what they are near to.
    """
    many = facts.groupBy("id").agg(F.min("print").alias("least"), F.max("print").alias("most")).where("id is not null and least <> most").select("id")
    many = materialize(many, "minhash-repeated")
    if many.isEmpty():
        node = F.col("id").alias("node")
        return docs.select(node, "text"), facts.select("*", node), facts.sparkSession.createDataFrame([], "a long, b long")

    def named(rows: DataFrame) -> DataFrame:
        marked = rows.join(many.withColumn("many", F.lit(True)), "id", "left")
        return marked.withColumn("node", F.when(F.col("many"), F.col("print")).otherwise(F.col("id"))).drop("many")

    own = named(facts)
    texts = own.join(many, "id", "left_semi").select("id", "node").distinct()
    ends = texts.groupBy("id").agg(F.min("node").alias("b"))
    return named(docs).select("node", "text"), own, texts.join(ends, "id").where("node <> b").select(F.col("node").alias("a"), "b")


def link(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles, component_id and kept of every row."""
    docs = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    docs = docs.select("id", F.xxhash64("id", "text").alias("print"), "text")
    read = materialize(common.per_slice(docs, "text", ["id", "print"], SCHEMA, signatures), "minhash")
    docs, facts, siblings = _own_nodes(docs, read)
    known = facts.where("n_shingles > 0 and node is not null")
    classes = materialize(known.groupBy("print1", "print2", "n_shingles").agg(F.min("node").alias("rep")), "minhash-classes")
    reps = known.join(classes.select(F.col("rep").alias("node")).distinct(), "node", "left_semi").dropDuplicates(["node"])
    reps = materialize(reps, "minhash-reps")
    sigs = reps.select("node", "n_shingles", *SIGNATURE)
    rows = reps.select("node", F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(rows.join(hubs.select("key", "hub"), "key"), "minhash-buckets")

    pairs = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    tested = materialize(_likely(pairs, sigs), "minhash-pairs")
    edges = materialize(confirm(tested, docs), "minhash-links")
    same = known.select("node", "print1", "print2", "n_shingles").join(classes, ["print1", "print2", "n_shingles"]).where("node <> rep")
    labels = components(edges)
    named = shared.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_rows = materialize(named.join(mixed, "key", "left_semi"), "minhash-open")
    found = _across(open_rows, reps.select("node", "n_shingles", "parity", "bands", *SIGNATURE))
    seen = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    fresh = materialize(found.join(seen, ["a", "b"], "left_anti"), "minhash-fresh")
    edges = edges.union(materialize(confirm(fresh, docs), "minhash-links"))
    all_edges = edges.union(same.select(F.col("node").alias("a"), F.col("rep").alias("b"))).union(siblings)
    named = facts.select("id", "node", "n_shingles").join(components(all_edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    out = named.join(least, "component", "left")
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
