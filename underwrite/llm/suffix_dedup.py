"""Remove every byte covered by a string of ``LENGTH`` bytes that also starts somewhere else.

1. Anchors deal the work out. In every window of LENGTH bytes the GRAM-byte string with the smallest hash
   (leftmost on ties) is its anchor; equal windows have equal anchors at equal places, so only windows of one
   anchor hash can be equal. Consecutive windows with one anchor form a run. Runs are counted by anchor and by
   content (combined map-side): equal runs repeat as a whole, and an anchor with one run needs nothing more.
2. What is left, different runs of one anchor, is cut by the anchor's place in the window into pieces whose
   windows all contain one CORE of LENGTH - STEP + 1 bytes. Pieces meet by core. A piece becomes a short string:
   up to STEP - 1 bytes, the core as one symbol, up to STEP - 1 bytes; a window is a substring of STEP symbols.
3. On the Burrows-Wheeler transform of a batch of such strings, backward extension refines the intervals of
   equal prefixes breadth first: after round l the boundaries are the places whose common prefix is shorter than
   l. It stops at the threshold; intervals of two or more suffixes are the repeated windows. Cores with very many
   pieces skip the batch: their windows are counted one by one, which gives the same answer for any number.
4. Repeated windows are joined to their document and the covered bytes removed.

Defined results: a NULL text is empty; texts shorter than LENGTH keep every byte; equal rows repeat each other;
rows with equal keys and different texts are treated apart; an empty table gives an empty table; other columns
are not read. Texts are read as UTF-8 bytes; what is left of a text need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwrite.llm import common
from underwrite.session import materialize

LENGTH = 200
GRAM = 32
STEP = 21
CORE = LENGTH - STEP + 1
#: Pieces of one core beyond which its windows are counted one by one.
HOT = 4096
#: Pieces in one batch of the transform.
BATCH = 20_000
#: Longer texts are read in overlapping chunks.
CHUNK = 1 << 22

_k = common.keys(31, 8) | np.uint64(1)
_POSITION = np.uint64((1 << 24) - 1)


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each position."""
    n = len(data) - GRAM + 1
    eight = np.ndarray((n + GRAM - 8,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    h = eight[:n] * _k[0]
    for j in range(1, GRAM // 8):
        h += eight[8 * j : 8 * j + n] * _k[j]
        h ^= h >> np.uint64(29)
        h *= _k[j + 4]
    return h ^ (h >> np.uint64(32))


def runs(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of all texts: text number, first window, number of windows, place of the anchor, anchor and content hash."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return {n: none for n in ("doc", "start", "windows", "place", "anchor", "content")}
    grams = _grams(data)
    low = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: len(data) - LENGTH + 1], low[width - span : width - span + len(data) - LENGTH + 1])
    at = (low & _POSITION).astype(np.int64)
    valid = np.zeros(len(at) + 1, dtype=np.int32)
    whole = np.flatnonzero(np.diff(bounds) >= LENGTH)
    valid[bounds[whole]] += 1
    valid[np.minimum(bounds[whole + 1] - LENGTH + 1, len(at))] -= 1
    valid = np.cumsum(valid)[:-1] > 0
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    new[bounds[whole]] = True
    start = np.flatnonzero(new & valid)
    edge = np.flatnonzero(new | ~valid)
    follow = np.searchsorted(edge, start, side="right")
    end = np.where(follow < len(edge), edge[np.minimum(follow, len(edge) - 1)], len(at))
    windows, anchor = end - start, at[start]
    content = common.mix(common.span_hashes(data, start, end - 1 + LENGTH) + (anchor - start).astype(np.uint64) * _k[7])
    doc = np.searchsorted(bounds, start, side="right") - 1
    return {
        "doc": doc, "start": start - bounds[doc], "windows": windows, "place": anchor - start,
        "anchor": common.mix(grams[anchor]).view(np.int64), "content": content.view(np.int64),
    }


def _chunks(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Text numbers and runs, slice by slice; a long text in chunks that share LENGTH - 1 bytes."""
    for lo, hi in common.slices(bounds):
        if bounds[hi] - bounds[lo] <= CHUNK:
            found = runs(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            yield found["doc"] + lo, found
            continue
        for at in range(bounds[lo], bounds[hi] - LENGTH + 1, CHUNK):
            part = data[at : min(bounds[hi], at + CHUNK + LENGTH - 1)]
            found = runs(part, np.array([0, len(part)]))
            found["start"] = found["start"] + (at - bounds[lo])
            yield found["doc"] + lo, found


def _runs_of(docs: DataFrame) -> DataFrame:
    fields = ("start", "windows", "place", "anchor", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, found in _chunks(*common.text_buffers(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *(pa.array(found[f]) for f in fields)], names=["row", *fields])

    return docs.select("row", "text").mapInArrow(run, "row long, start long, windows long, place long, anchor long, content long").select(
        "row", F.col("start").cast("int").alias("start"), (F.col("windows") * 256 + F.col("place")).cast("int").alias("shape"), "anchor", "content"
    )


def _pieces_of(held: DataFrame) -> DataFrame:
    """row, text, runs (array of start, shape, alone) -> pieces: core (two hashes), row, first window, both sides."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(1), batch.column(2)
            for i in range(len(batch)):
                data, _ = common.text_buffers(texts.slice(i, 1))
                item = lists[i].values
                start, shape, alone = (item.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "shape", "alone"))
                windows, place = shape // 256, shape % 256
                rows = []
                # windows of a run have the anchor at place, place - 1, ..., place - windows + 1
                for j in range((LENGTH - GRAM) // STEP + 1):
                    first = np.maximum(start, start + place - (STEP * j + STEP - 1))
                    last = np.minimum(start + windows - 1, start + place - STEP * j)
                    ok = last >= first
                    core = (start + place - STEP * j)[ok]
                    rows.append(np.column_stack((first[ok], last[ok], core, alone[ok])))
                first, last, core, alone = np.concatenate(rows).T
                at = (core, core + CORE)
                one = common.span_hashes(data, *at)
                two = common.mix(common.span_hashes(data[::-1], len(data) - at[1], len(data) - at[0]))
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column(0).take(pa.array(np.full(len(first), i))), pa.array(first), pa.array(alone == 1),
                        pa.array([raw[a:b] for a, b in zip(first, core)], pa.binary()), pa.array([raw[a:b] for a, b in zip(core + CORE, last + LENGTH)], pa.binary()),
                    ],
                    names=["core1", "core2", "row", "first", "alone", "left", "right"],
                )

    return held.mapInArrow(run, "core1 long, core2 long, row long, first long, alone boolean, left binary, right binary")


def suffix_order(symbols: np.ndarray, least: int) -> np.ndarray:
    """Positions ordered by their first ``least`` symbols or more (prefix doubling)."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    span = 1
    order = np.argsort(rank, kind="stable")
    while span < least:
        key = rank.astype(np.int64) * (n + 1)
        key[: n - span] += rank[span:] + 1
        order = np.argsort(key, kind="stable")
        step = np.ones(n, dtype=np.int64)
        step[0] = 0
        step[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)
        span *= 2
    return order


def repeated_starts(symbols: np.ndarray, least: int) -> np.ndarray:
    """Positions whose next ``least`` symbols occur again and hold no separator (0), by interval expansion."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    order = suffix_order(symbols, least)
    first = symbols[order]
    transform = symbols[order - 1]  # of position 0 the last symbol, a separator
    source = np.argsort(transform, kind="stable")  # row k of the first column stands at row source[k] of the last
    single = first == 0
    bound = np.zeros(n, dtype=bool)  # a boundary before this row: the common prefix with the row above is shorter than l
    bound[0] = True
    change = np.ones(n, dtype=bool)
    change[1:] = first[1:] != first[:-1]
    change |= single
    change[1:] |= single[:-1]
    live = np.flatnonzero(~change)
    for _ in range(least):
        interval = np.cumsum(bound)
        fresh = interval[source[live]] != interval[source[live - 1]]
        bound = change.copy()
        if fresh.any():
            change[live[fresh]] = True
            bound[live[fresh]] = True
            live = live[~fresh]
        else:
            bound = change.copy()
        if not len(live):
            break
    again = ~change
    again[:-1] |= ~change[1:]
    return order[again]


def _windows_again(pieces: pa.Table) -> pa.Table:
    """row, first, count of repeated windows among the pieces of some cores."""
    pieces = pieces.combine_chunks()
    left, right = pieces.column("left").to_pylist(), pieces.column("right").to_pylist()
    core = np.unique(np.column_stack([pieces.column(c).to_numpy() for c in ("core1", "core2")]), axis=0, return_inverse=True)[1].ravel()
    if not len(left):
        return pa.table({"row": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "size": pa.array([], pa.int64())})
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    begin = np.concatenate(([0], np.cumsum(size_l + size_r + 2)))
    symbols = np.zeros(begin[-1], dtype=np.int64)
    begin = begin[:-1]
    spot = lambda base, size: np.repeat(base - (np.cumsum(size) - size), size) + np.arange(size.sum())
    symbols[spot(begin, size_l)] = np.frombuffer(b"".join(left), dtype=np.uint8).astype(np.int64) + 1
    symbols[begin + size_l] = core + 257
    symbols[spot(begin + size_l + 1, size_r)] = np.frombuffer(b"".join(right), dtype=np.uint8).astype(np.int64) + 1
    hits = np.sort(repeated_starts(symbols, STEP))
    piece = np.searchsorted(begin, hits, side="right") - 1
    wanted = pieces.column("alone").to_numpy()[piece]
    hits, piece = hits[wanted], piece[wanted]
    return _spans(pieces.column("row").to_numpy()[piece], pieces.column("first").to_numpy()[piece] + hits - begin[piece])


def _spans(row: np.ndarray, window: np.ndarray) -> pa.Table:
    """Consecutive windows of a row as one span of bytes."""
    order = np.lexsort((window, row))
    row, window = row[order], window[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    return pa.table({"row": row[at], "start": window[at], "size": window[last] - window[at] + LENGTH if len(at) else np.zeros(0, np.int64)})


def _one_by_one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of pieces: core, row, window, hash of the bytes around the core with their place."""
    for batch in batches:
        out = []
        for k, (left, right, first, alone) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("left", "right", "first", "alone")))):
            for t in range(len(left) + len(right) - STEP + 2):
                cut = STEP - 1 - (len(left) - t)
                out.append((k, first + t, left[t:] + b"|" + bytes([len(left) - t]) + right[:cut], alone))
        pick = pa.array([o[0] for o in out], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("core1").take(pick), batch.column("core2").take(pick), batch.column("row").take(pick), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.bool_())],
            names=["core1", "core2", "row", "start", "around", "alone"],
        )


def find(docs: DataFrame) -> DataFrame:
    """row, text -> row, start, size of repeated stretches (they may overlap)."""
    every = materialize(_runs_of(docs), "runs")
    # the shape is part of the content hash; a representative serves where a content occurs once
    contents = every.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "shape")).alias("one"))
    contents = materialize(contents, "run-contents")
    shared = contents.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    equal = every.join(contents.where("n > 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
    whole = equal.select("row", F.col("start").cast("long"), (F.shiftright("shape", 8) + LENGTH - 1).cast("long").alias("size"))

    open_runs = contents.join(shared, "anchor", "left_semi").select("one.row", F.struct("one.start", "one.shape", (F.col("n") == 1).cast("int").alias("alone")).alias("run"))
    held = open_runs.groupBy("row").agg(F.collect_list("run").alias("runs")).join(docs, "row").select("row", "text", "runs")
    pieces = materialize(_pieces_of(held), "pieces")
    sizes = pieces.groupBy("core1", "core2").agg(F.count("*").alias("n"), F.max(F.col("alone").cast("int")).alias("open")).where("n > 1 and open = 1")
    met = materialize(pieces.join(sizes.select("core1", "core2", "n"), ["core1", "core2"]), "pieces-met")
    bins = max(1, met.count() // BATCH)
    few = met.where(F.col("n") <= HOT).withColumn("bin", F.pmod(F.xxhash64("core1", "core2"), F.lit(bins)))
    expanded = few.groupBy("bin").applyInArrow(_windows_again, "row long, start long, size long")
    single = met.where(F.col("n") > HOT).drop("n").mapInArrow(_one_by_one, "core1 long, core2 long, row long, start long, around binary, alone boolean")
    names = ["core1", "core2", "around"]
    again = single.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").select(*names)
    counted = single.where("alone").join(again, names, "left_semi").select("row", "start", F.lit(LENGTH).cast("long").alias("size"))
    return whole.union(expanded).union(counted)


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal stretches (start, end) of possibly overlapping (start, size)."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 0] + spans[:, 1])
    new = np.ones(len(spans), dtype=bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    return np.column_stack((spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]))


def remove(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row of ``df``."""
    name, body = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    docs = df.select(name.alias("key"), body.alias("text")).withColumn("row", F.xxhash64("key", "text"))
    spans = find(docs.select("row", "text"))
    lists = spans.groupBy("row").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, marks in zip(batch.column(1), batch.column(2)):
                raw = value.as_py().encode()
                if not marks.is_valid:
                    out.append((len(raw), 0, 0, raw))
                    continue
                item = marks.values
                gone = merged(np.column_stack([item.field(f).to_numpy() for f in ("start", "size")]))
                keep, at = [], 0
                for a, b in gone:
                    keep.append(raw[at:a])
                    at = b
                out.append((len(raw), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), b"".join([*keep, raw[at:]])))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "n_bytes", "n_removed", "n_spans", "kept"])

    joined = docs.join(lists, "row", "left").select("key", "text", "spans")
    return joined.mapInArrow(cut, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def brute(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """What ``remove`` must give, by counting every window."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out
