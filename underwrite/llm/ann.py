"""Nearest neighbours by inner product with a hash-prefix forest.

Every tree gives a vector a long hash string: one symbol per random rotation, the axis (with sign) nearest to
the rotated vector. Vectors are first lifted by one coordinate to a common norm, so that the largest inner
product is the smallest angle. A prefix of a tree is a hashed key with the number of its entries. A query descends
to the whole string and ascends in all trees at once: to shorter prefixes, then to the next best first symbols,
then to every row, until it meets enough candidates. Each query stops by its own counts. How many candidates are
enough is fitted: queries of every order of bucket size are searched by brute force over all rows, and the least
number is taken at which each order holds ``RECALL`` of its neighbours. Every vector is indexed; candidates are
scored with the original vectors in double precision. Queries that still get too few are answered by brute force.

Equal vectors are one entry with its smallest ids (as many as a result can hold), so a vector shared by many
rows costs one row per tree. Only prefixes at which a query stops are sent.

Defined results: vectors that are NULL, zero, of another length than most, or hold NULL or non-finite values
take no part, as queries or candidates; rows with a NULL id take no part; repeated rows count once; a table
with fewer candidates than ``k`` gives all of them; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from underwrite.llm.common import mix
from underwrite.session import materialize

TREES = 16
SYMBOLS = 6
SEED = 20
#: Fitted on this many queries of each order (power of two) of bucket size; the share of their neighbours to hold.
SAMPLE_QUERIES = 16
RECALL = 0.95
#: The ascent: (length of the prefix, first symbols tried). The last step is every row.
STEPS = (*((d, 1) for d in range(SYMBOLS, 0, -1)), (1, 2), (1, 3), (1, 4), (1, 6), (1, 8), (1, 12), (0, 1))
PROBES = max(p for _, p in STEPS)
#: Vectors of one prefix that meet in one task.
BLOCK = 4096


def rotations(dim: int, trees: int = TREES, symbols: int = SYMBOLS) -> np.ndarray:
    """trees x symbols random rotations of dim+1 coordinates, fixed by the seed."""
    rng = np.random.default_rng([SEED, dim])
    return np.linalg.qr(rng.standard_normal((trees, symbols, dim + 1, dim + 1)))[0]


def lifted(x: np.ndarray, norm2: float | None) -> np.ndarray:
    """Rows with one more coordinate: up to the common norm for entries, zero for queries (norm2 None)."""
    last = np.zeros(len(x)) if norm2 is None else np.sqrt(np.maximum(0.0, norm2 - (x * x).sum(axis=1)))
    return np.column_stack((x, last))


def strings(x: np.ndarray, turns: np.ndarray, probes: int = 1) -> np.ndarray:
    """rows x trees x symbols x probes: nearest signed axes, best first."""
    probes = min(probes, 2 * x.shape[1])
    out = np.empty((len(x), *turns.shape[:2], probes), dtype=np.int64)
    for t in range(turns.shape[0]):
        for s in range(turns.shape[1]):
            y = x @ turns[t, s]
            both = np.concatenate((-y, y), axis=1)
            if probes == 1:
                out[:, t, s, 0] = both.argmin(axis=1)
            else:
                out[:, t, s] = np.argsort(both, axis=1, kind="stable")[:, :probes]
    return out


def _chain(codes: np.ndarray) -> np.ndarray:
    """rows x trees x symbols: a key for each prefix of the strings in ``codes``, of the same shape."""
    key = np.broadcast_to(mix(np.arange(1, codes.shape[1] + 1, dtype=np.uint64)), codes.shape[:2])
    out = np.empty(codes.shape, dtype=np.int64)
    for s in range(codes.shape[2]):
        key = mix(key + (codes[:, :, s] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[:, :, s] = key.view(np.int64)
    return out


def entry_keys(x: np.ndarray, turns: np.ndarray, norm2: float) -> np.ndarray:
    """rows x trees x symbols: the prefixes that hold each entry."""
    return _chain(strings(lifted(x, norm2), turns)[..., 0])


def query_keys(x: np.ndarray, turns: np.ndarray) -> list[np.ndarray]:
    """For each step but the last, rows x keys: the prefixes that a query tries there."""
    up = lifted(x / np.linalg.norm(x, axis=1)[:, None], None)
    key = _chain(strings(up, turns)[..., 0])
    first = strings(up, turns[:, :1], PROBES)[:, :, 0]
    tried = np.stack([_chain(first[:, :, p : p + 1])[:, :, 0] for p in range(first.shape[2])], axis=2)
    return [(tried[:, :, :p] if d == 1 else key[:, :, d - 1 : d]).reshape(len(x), -1) for d, p in STEPS[:-1]]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (array of double) of the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    some = F.exists(v, lambda c: c != 0)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & some)
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (dims["d"] if dims else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, ties to smaller ids."""
    if scores.shape[1] > 4 * k:  # all that tie with the k-th stay in
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        wanted = np.flatnonzero((scores >= least[:, None]).any(axis=0))
    else:
        wanted = np.arange(scores.shape[1])
    order = np.lexsort((np.broadcast_to(ids[wanted], (len(scores), len(wanted))), -scores[:, wanted]), axis=1)[:, :k]
    return wanted[order]


def _scan(entries: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """qid, rep, score: the k best entries of each batch for a bounded set of queries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                reps = batch.column(0).to_numpy()
                scores = queries @ _matrix(batch.column(1)).T
                top = _best(scores, reps, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, top.shape[1])), pa.array(reps[top].ravel()), pa.array(np.take_along_axis(scores, top, axis=1).ravel())],
                    names=["qid", "rep", "score"],
                )

    return entries.select("rep", "v").mapInArrow(run, "qid long, rep long, score double")


def _top(found: DataFrame, k: int, by: str = "qid", ids: str = "rep") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), ids))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def enough(sizes: np.ndarray, recall: np.ndarray, order: np.ndarray) -> float:
    """The least number of candidates at which the queries of each order hold RECALL on the mean.

    sizes, recall: queries x steps, both growing from step to step; the last step holds everything.
    """
    for least in np.unique(sizes):
        stop = (sizes >= least).argmax(axis=1)
        got = recall[np.arange(len(recall)), stop]
        if all(got[order == o].mean() >= RECALL for o in np.unique(order)):
            return float(least)
    return float("inf")


def fit(entries: DataFrame, queries: DataFrame, sizes: DataFrame, turns: np.ndarray, norm2: float, k: int) -> float:
    """The number of candidates (over all trees) at which a query stops."""
    order = F.floor(F.log2(1 + F.col("sizes")[STEPS.index((1, 1))])).alias("order")
    place = F.row_number().over(Window.partitionBy("order").orderBy(F.xxhash64("qid"), "qid"))
    drawn = sizes.select("qid", "sizes", order).withColumn("place", place).where(F.col("place") <= SAMPLE_QUERIES)
    sample = drawn.join(queries, drawn["qid"] == queries["rep"]).select("qid", "order", "sizes", "v").collect()  # orders are few
    if not sample:
        return float("inf")
    ids, x = np.array([r["qid"] for r in sample]), np.array([r["v"] for r in sample])
    near = _top(_scan(entries, ids, x, k), k)
    pairs = near.join(entries, "rep").select("qid", "v").collect()  # at most k per sampled query
    at = {i: n for n, i in enumerate(ids)}
    asked = np.array([at[r["qid"]] for r in pairs])
    held = entry_keys(np.array([r["v"] for r in pairs]), turns, norm2)
    total = np.bincount(asked, minlength=len(ids))
    recall = np.ones((len(ids), len(STEPS)))
    for n, ((depth, _), keys) in enumerate(zip(STEPS, query_keys(x, turns))):
        tried = keys.reshape(len(x), turns.shape[0], -1)[asked]
        hit = (tried == held[:, :, depth - 1, None]).any(axis=(1, 2))
        recall[:, n] = np.bincount(asked[hit], minlength=len(ids)) / np.maximum(total, 1)
    counts = np.column_stack((np.array([r["sizes"] for r in sample], dtype=np.float64), np.full(len(ids), np.inf)))
    return enough(counts, recall, np.array([r["order"] for r in sample]))


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 512):
            yield batch.slice(lo, 512)


def _sizes(entries: DataFrame, queries: DataFrame, turns: np.ndarray, norm2: float) -> DataFrame:
    """qid, sizes: how many entries (over all trees) each query meets at each step but the last."""
    slots = [n for n, (d, _) in enumerate(STEPS) if d > 1]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            key, n = np.unique(entry_keys(_matrix(part.column(0)), turns, norm2), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            keys = query_keys(_matrix(part.column(1)), turns)
            last = keys[-1].reshape(len(part), turns.shape[0], -1)
            groups = [*(keys[n] for n in slots), *(last[:, :, p] for p in range(last.shape[2]))]
            for slot, key in enumerate(groups):
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(part)), key.shape[1])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(key.size, slot, dtype=np.int32)), pa.array(key.ravel())], names=["qid", "slot", "key"])

    counts = entries.select("v").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    asked = queries.select("rep", "v").mapInArrow(ask, "qid long, slot int, key long").join(counts, "key", "left")
    upto = [F.col("slot") == n if d > 1 else F.col("slot").between(len(slots), len(slots) + p - 1) for n, (d, p) in enumerate(STEPS[:-1])]
    return asked.groupBy("qid").agg(F.array(*(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in upto)).alias("sizes"))


def _entry_rows(entries: DataFrame, turns: np.ndarray, norm2: float, depths: list[int]) -> DataFrame:
    """id, key: the prefixes of each entry at these depths."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            key = entry_keys(_matrix(part.column(1)), turns, norm2)[:, :, [d - 1 for d in depths]].reshape(len(part), -1)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(part)), key.shape[1]))), pa.array(key.ravel())], names=["id", "key"])

    return entries.select("rep", "v").mapInArrow(run, "id long, key long")


def _query_rows(stopped: DataFrame, turns: np.ndarray) -> DataFrame:
    """id, key: the prefixes that each query tries where it stops."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            step = part.column(2).to_numpy()
            for n, keys in enumerate(query_keys(_matrix(part.column(1)), turns)):
                here = np.flatnonzero(step == n)
                ids = part.column(0).take(pa.array(np.repeat(here, keys.shape[1])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys[here].ravel())], names=["id", "key"])

    return stopped.select("rep", "v", "step").mapInArrow(run, "id long, key long")


def _to(n: str) -> Column:
    """Each number below the column ``n``."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def _tiles(held: DataFrame, asked: DataFrame, entries: DataFrame, queries: DataFrame, lots: int, k: int) -> DataFrame:
    """qid, rep, score: the k best per query and tile of at most about BLOCK entries and BLOCK queries of a prefix.

    Both sides: id, key, blocks (of entries), turns (blocks of queries). Prefixes of one tile share ``lots`` groups.
    """
    lot = F.when(F.col("blocks") * F.col("turns") == 1, F.pmod(F.xxhash64("key"), F.lit(lots))).otherwise(F.col("key")).alias("lot")
    mine, theirs = F.pmod(F.xxhash64("id"), F.col("blocks")), F.pmod(F.xxhash64("id"), F.col("turns"))
    dealt = held.select("id", "key", lot, mine.alias("block"), _to("turns").alias("turn"), F.lit(0).alias("role"))
    sent = asked.select("id", "key", lot, _to("blocks").alias("block"), theirs.alias("turn"), F.lit(1).alias("role"))
    with_v = [rows.join(side.select(F.col("rep").alias("id"), "v"), "id") for rows, side in ((dealt, entries), (sent, queries))]

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        role = table.column("role").to_numpy()
        rows, wanted = (table.filter(pa.array(role == r)).combine_chunks() for r in (0, 1))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(rows) and len(wanted):
            ids, qids = rows.column("id").to_numpy(), wanted.column("id").to_numpy()
            x, q = (_matrix(t.column("v").combine_chunks()) for t in (rows, wanted))
            keys, asks = rows.column("key").to_numpy(), wanted.column("key").to_numpy()
            each = np.unique(asks)
            spans = zip(*(np.searchsorted(a, each, side).tolist() for a in (keys, asks) for side in ("left", "right")))
            for a, b, c, d in spans:
                for lo in range(c, d if b > a else c, 256):
                    hi = min(lo + 256, d)
                    scores = q[lo:hi] @ x[a:b].T
                    top = _best(scores, ids[a:b], k)
                    out.append((np.repeat(qids[lo:hi], top.shape[1]), ids[a:b][top].ravel(), np.take_along_axis(scores, top, axis=1).ravel()))
        return pa.table(dict(zip(("qid", "rep", "score"), map(np.concatenate, zip(*out)))))

    return with_v[0].unionByName(with_v[1]).groupBy("lot", "block", "turn").applyInArrow(score, "qid long, rep long, score double")


def _meet(held: DataFrame, asked: DataFrame, entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, rep, score of what meets in a prefix. held, asked: id, key."""
    asked = materialize(asked, "ann-asked")
    turns = asked.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("turns"))
    held = materialize(held.join(turns, "key"), "ann-held")  # only prefixes where a query stops
    load = materialize(held.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.first("turns").alias("turns")), "ann-load")
    lots = max(1, held.count() // BLOCK)
    return _tiles(held.join(load.select("key", "blocks"), "key"), asked.join(load, "key"), entries, queries, lots, k)


def _every(entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, rep, score against all rows."""
    n = [F.lit(-(-side.count() // BLOCK)).cast("long") for side in (entries, queries)]
    held, asked = (side.select(F.col("rep").alias("id"), F.lit(0).cast("long").alias("key"), n[0].alias("blocks"), n[1].alias("turns")) for side in (entries, queries))
    return _tiles(held, asked, entries, queries, 1, k)


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank, id, score of the k nearest found of every row for which ``is_query`` (over ``id``) holds."""
    rows = materialize(usable(df, key, vector).dropDuplicates(["id"]), "ann-rows")
    entries = materialize(rows.groupBy("v").agg(F.min("id").alias("rep")).select("rep", "v"), "ann-entries")
    named = materialize(rows.join(entries, "v").select("id", "rep"), "ann-names")
    total = rows.count()
    queries = materialize(named.where(is_query).select("rep").distinct().join(entries, "rep"), "ann-queries")
    first = entries.first()
    if first is None:
        return named.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id"), F.lit(0.0).alias("score")).limit(0)
    turns = rotations(len(first["v"]))
    norm2 = entries.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).first()[0]
    need = k + 1  # one may be the query itself
    sizes = materialize(_sizes(entries, queries, turns, norm2), "ann-sizes")
    least = fit(entries, queries, sizes, turns, norm2, need)
    stop = F.coalesce(*(F.when(F.col("sizes")[n] >= F.lit(least), n) for n in range(len(STEPS) - 1)), F.lit(len(STEPS) - 1))
    stopped = materialize(queries.join(sizes.select(F.col("qid").alias("rep"), stop.alias("step")), "rep").select("rep", "v", "step"), "ann-stopped")
    steps = [r["step"] for r in stopped.select("step").distinct().collect()]
    last = len(STEPS) - 1
    depths = sorted({STEPS[n][0] for n in steps if n < last})
    rest = stopped.where(F.col("step") == last)
    found = None
    if depths:
        found = _meet(_entry_rows(entries, turns, norm2, depths), _query_rows(stopped.where(F.col("step") < last), turns), entries, queries, need)
    if last in steps or found is None:
        every = _every(entries, rest, need)
        found = found.union(every) if found is not None else every
    best = materialize(_top(found.groupBy("qid", "rep").agg(F.max("score").alias("score")), need), "ann-best")

    members = named.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("place") <= need)
    members = materialize(members.select("id", "rep"), "ann-members")  # what one result can hold of equal vectors
    wide = best.join(members, "rep").select("qid", "id", "score")
    short = wide.groupBy("qid").agg(F.count("*").alias("n"))
    lost = queries.join(short, queries["rep"] == short["qid"], "left").where(F.coalesce("n", F.lit(0)) < min(need, total)).select("rep", "v")
    lost = materialize(lost.join(stopped.where(F.col("step") < last).select("rep"), "rep", "left_semi"), "ann-lost")
    if not lost.isEmpty():
        again = _top(_every(entries, lost, need), need)
        kept = best.join(lost.select(F.col("rep").alias("qid")), "qid", "left_anti").select("qid", "rep", "score")
        wide = kept.union(again.select("qid", "rep", "score")).join(members, "rep").select("qid", "id", "score")
    nearest = materialize(_top(wide, need, "qid", "id").select("qid", "id", "score"), "ann-nearest")
    asked = named.where(is_query).select(F.col("id").alias("query_id"), F.col("rep").alias("qid"))
    out = asked.join(nearest, "qid").where("id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.select("query_id", place.alias("rank"), "id", "score").where(F.col("rank") <= k)
