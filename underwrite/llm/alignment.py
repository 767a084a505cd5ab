"""Two tokenizers aligned over every text: groups of tokens between common ends, and the corpus-wide links.

Tokens of A (byte-level pairs of bytes) and B (pieces with byte fallback) are byte intervals of space + text. They
are coalesced: all tokens of both sides are sorted by start, the running maximum of their ends is taken, and a
group breaks where a start reaches it. Overlapping pairs are expanded from the sorted bounds, and a pair that ends
together is a link.

A text is cut into stretches at every space that follows a character other than white space. No token of either
side crosses such a place (checked when the vocabulary is read), so a stretch is aligned once per worker and the
parts of a text are put together by arrays. Stretches not seen before are encoded as one joined string. The table
of remembered stretches is bounded and holds the stretches themselves, so nothing rests on hashes.

Linked id pairs end in the same byte, so one token is a suffix of the other: their number is bounded by the
vocabulary (``Coder.pair_bound``), whatever the corpus holds. Only that table of counts is sent to the tasks.

Defined results: a NULL or empty text, and one whose tokens of A or B do not spell space + text, has no tokens:
all numbers are 0 and the digest is empty; strings of special tokens inside a text are plain text; a text without
such spaces is one stretch and is encoded whole; repeated rows count as often as they occur; the caller's columns
are packed in a struct, so their names never clash; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwrite.llm.common import slices
from underwrite.session import materialize

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Stretches a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Characters of text handled at once; one text is never cut.
SLICE = 1 << 20
SPACE = "▁"


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, read backwards: printable ones stand for
    themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self._a = tokenizers.Tokenizer.from_file(a_file)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self._space = self._b.piece_to_id(SPACE)  # a text's last space alone; the library gives the empty string no piece
        letters = _byte_letters()
        with open(a_file, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        self.b_bytes = []
        for i in range(self._b.get_piece_size()):
            piece = self._b.id_to_piece(i)
            if SPACE in piece.lstrip(SPACE) and not self._b.is_byte(i):
                raise ValueError(f"piece {piece!r} joins stretches")
            self.b_bytes.append(bytes([int(piece[1:-1], 16)]) if self._b.is_byte(i) else piece.replace(SPACE, " ").encode())
        self.a_length = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        #: An id with what follows it in a group: A inside, A last, B inside, B last.
        self.written = [x + after for size, after in ((len(self.a_bytes), ","), (len(self.a_bytes), "|"), (len(self.b_bytes), ","), (len(self.b_bytes), ";")) for x in names[:size]]
        self.written_length = np.array([len(x) for x in self.written], dtype=np.int64)

    def encode(self, stretches: list[str]) -> tuple[list[int], list[int], bool]:
        """Ids of both sides for the stretches, each after its space, and whether both spell them."""
        joined = " " + " ".join(stretches)
        a = self._a.encode(joined, add_special_tokens=False).ids
        b = [i for s, one in zip(stretches, self._b.encode(stretches, num_threads=1)) for i in (one if s else [self._space])]
        want = joined.encode()
        return a, b, b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want

    def pair_bound(self) -> int:
        """Number of id pairs of which one token's bytes end the other's: no more can ever be linked."""
        def held(tokens: list[bytes]) -> dict[bytes, int]:
            out: dict[bytes, int] = {}
            for t in tokens:
                if t:
                    out[t] = out.get(t, 0) + 1
            return out

        a, b = held(self.a_bytes), held(self.b_bytes)
        longer_a = sum(n * b.get(t[i:], 0) for t, n in a.items() for i in range(len(t)))
        longer_b = sum(n * a.get(t[i:], 0) for t, n in b.items() for i in range(1, len(t)))
        return longer_a + longer_b


@lru_cache(maxsize=2)
def coder(a_file: str = A_FILE, b_file: str = B_FILE) -> Coder:
    return Coder(a_file, b_file)


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every A and every B interval; groups are the connected runs of overlapping intervals."""
    n = len(a_start)
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), dtype=np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[:n], group[n:]


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping pairs (position in A, position in B); both sides ascend and do not overlap among themselves."""
    first = np.searchsorted(b_end, a_start, side="right")
    count = np.maximum(np.searchsorted(b_start, a_end, side="left") - first, 0)
    a = np.repeat(np.arange(len(a_start)), count)
    return a, np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(a))


def stretches(text: str) -> tuple[list[str], str | None]:
    """Stretches of a text without the space before each, and a last one that ends in white space."""
    out: list[str] = []
    run: str | None = None
    for part in text.split(" "):
        run = part if run is None else f"{run} {part}"
        if part and not part[-1].isspace():
            out.append(run)
            run = None
    return out, run


class Aligner:
    """Aligned stretches of one worker: numbers, links and groups by a code for each stretch."""

    def __init__(self, coder: Coder):
        self.coder = coder
        self.clear()

    def clear(self) -> None:
        self.closed: dict[str, int] = {}
        self.open: dict[str, int] = {}
        self.n_a, self.n_b, self.n_groups, self.spelt = array("q"), array("q"), array("q"), array("b")
        self.link_ends, self.links, self.groups = array("q"), array("i"), []

    def codes(self, texts: Sequence[str]) -> list[list[int]]:
        """Codes of the stretches of each text."""
        if len(self.groups) > REMEMBERED:
            self.clear()
        fresh: list[str] = []
        at = len(self.groups)
        get, out, last = self.closed.get, [], []
        for k, text in enumerate(texts):
            if not text:
                out.append([])
                continue
            parts = text.split(" ")
            codes = list(map(get, parts))
            unknown = [i for i, code in enumerate(codes) if code is None]
            # A part that ends in white space, or an empty one, is never remembered as it is.
            if any(not parts[i] or parts[i][-1].isspace() for i in unknown):
                parts, tail = stretches(text)
                codes = list(map(get, parts))
                unknown = [i for i, code in enumerate(codes) if code is None]
                if tail is not None:
                    last.append((k, tail))
            for i in unknown:
                code = get(parts[i])
                if code is None:
                    code = self.closed[parts[i]] = at + len(fresh)
                    fresh.append(parts[i])
                codes[i] = code
            out.append(codes)
        if fresh:
            self._learn(fresh)
        for k, tail in last:  # nothing may follow white space in the joined string: these are encoded alone
            if tail not in self.open:
                self.open[tail] = len(self.groups)
                self._learn([tail])
            out[k].append(self.open[tail])
        return out

    def _learn(self, fresh: list[str]) -> None:
        a, b, good = self.coder.encode(fresh)
        if good:
            self._add(fresh, a, b)
        elif len(fresh) > 1:
            half = len(fresh) // 2
            self._learn(fresh[:half])
            self._learn(fresh[half:])
        else:
            for column, value in ((self.n_a, 0), (self.n_b, 0), (self.n_groups, 0), (self.spelt, 0), (self.link_ends, len(self.links))):
                column.append(value)
            self.groups.append("")

    def _add(self, fresh: list[str], a_ids: list[int], b_ids: list[int]) -> None:
        a, b = np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)
        a_end, b_end = np.cumsum(self.coder.a_length[a]), np.cumsum(self.coder.b_length[b])
        a_start, b_start = a_end - self.coder.a_length[a], b_end - self.coder.b_length[b]
        a_group, b_group = coalesce(a_start, a_end, b_start, b_end)
        x, y = overlaps(a_start, a_end, b_start, b_end)
        together = a_end[x] == b_end[y]
        x, y = x[together], y[together]
        size = len(self.coder.a_bytes)
        inside_a, inside_b = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool)
        inside_a[:-1], inside_b[:-1] = a_group[1:] == a_group[:-1], b_group[1:] == b_group[:-1]
        inside_a[-1] = inside_b[-1] = False
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        written = np.concatenate([a + size * ~inside_a, 2 * size + b + len(self.coder.b_bytes) * ~inside_b])[order]
        groups = "".join(map(self.coder.written.__getitem__, written.tolist()))
        group_ends = np.cumsum(self.coder.written_length[written])
        ends = np.cumsum(np.array([len(s.encode()) + 1 for s in fresh], dtype=np.int64))
        upto_a, upto_b = np.searchsorted(a_end, ends, side="right"), np.searchsorted(b_end, ends, side="right")
        upto_group = a_group[upto_a - 1] + 1
        upto_link = np.searchsorted(a_end[x], ends, side="right")
        for column, upto in ((self.n_a, upto_a), (self.n_b, upto_b), (self.n_groups, upto_group)):
            column.extend(np.diff(upto, prepend=0).tolist())
        self.link_ends.extend((upto_link + len(self.links)).tolist())
        self.links.extend((a[x] * len(self.coder.b_bytes) + b[y]).tolist())
        self.spelt.extend([1] * len(fresh))
        lo = 0
        for hi in group_ends[upto_a + upto_b - 1].tolist():
            self.groups.append(groups[lo : hi - 1])
            lo = hi


@lru_cache(maxsize=1)
def _aligner(a_file: str, b_file: str) -> Aligner:
    return Aligner(coder(a_file, b_file))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its count says."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _aligned(aligner: Aligner, texts: Sequence[str], whole: bool) -> dict[str, pa.Array]:
    listed = aligner.codes(texts)
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in listed])]).astype(np.int64)
    codes = np.array([c for one in listed for c in one], dtype=np.int64)
    good = _sums(1 - np.array(aligner.spelt, dtype=np.int64)[codes], bounds) == 0
    out = {}
    for name, column in (("n_a", aligner.n_a), ("n_b", aligner.n_b), ("n_groups", aligner.n_groups)):
        out[name] = pa.array(_sums(np.array(column, dtype=np.int64)[codes], bounds) * good)
    link_ends = np.concatenate([[0], np.array(aligner.link_ends, dtype=np.int64)])
    counts = (link_ends[codes + 1] - link_ends[codes]) * np.repeat(good, np.diff(bounds))
    links = np.array(aligner.links, dtype=np.int32)[_spread(link_ends[codes], counts)]
    ends = np.concatenate([[0], np.cumsum(counts)])[bounds]
    out["links"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(links))
    get = aligner.groups.__getitem__
    joined = [";".join(map(get, c)) if c and g else "" for c, g in zip(listed, good.tolist())]
    out["groups"] = pa.array(joined) if whole else pa.array([sha256(g.encode()).hexdigest() if g else "" for g in joined])
    return out


def tokens(df: DataFrame, text: str = "text", keep: Sequence[str] = (), whole: bool = False, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """kept (struct of the columns ``keep``), n_a, n_b, n_groups, links (a * size of B's vocabulary + b, in order) and
    groups: ``a1,a2|b1;...`` as text if ``whole``, else its SHA-256."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(True).alias("row"))
    source = df.select(kept.alias("kept"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = f"kept {source.schema['kept'].dataType.simpleString()}, n_a long, n_b long, n_groups long, links array<int>, groups string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_file, b_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= SLICE):
                    size += len(texts[hi] or "")
                    hi += 1
                part = _aligned(aligner, texts[lo:hi], whole)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *part.values()], names=["kept", *part])
                lo = hi

    return source.mapInArrow(run, schema)


def _by_links(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with about a million links at once: the batch, the bounds of each row's links, the links."""
    for batch in batches:
        lists = batch.column(column)
        upto = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]).astype(np.int64)
        for lo, hi in slices(upto):
            yield batch.slice(lo, hi - lo), upto[lo : hi + 1] - upto[lo], np.asarray(lists.slice(lo, hi - lo).flatten())


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: how many links of the corpus hold each id pair; each task adds up what it reads first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for _, _, links in _by_links(batches, 0):
            fresh, m = np.unique(links, return_counts=True)
            both, where = np.unique(np.concatenate([pairs, fresh]), return_inverse=True)
            total = np.zeros(len(both), dtype=np.int64)
            np.add.at(total, where, np.concatenate([n, m]))
            pairs, n = both, total
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int32()), pa.array(n, pa.int64())], names=["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(df: DataFrame, text: str = "text", keep: Sequence[str] = (), whole: bool = False, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """The columns ``keep`` and n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row.

    n_best counts the links whose pair is, corpus-wide, the most frequent of its B id (ties included); count_sum adds
    the corpus-wide counts of all links. The caller's columns stay in the struct ``kept`` until the end, and names of
    results that the caller also keeps are refused with an error.
    """
    clash = {"n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are results of align; rename them before")
    spark = df.sparkSession
    rows = materialize(tokens(df, text, keep, whole, a_file, b_file), "align-tokens")
    here = coder(a_file, b_file)
    b_size = len(here.b_bytes)
    table = link_counts(rows).toArrow()  # at most pair_bound() rows, whatever the corpus holds
    if table.num_rows > here.pair_bound():
        raise AssertionError("more linked pairs than the vocabularies allow")
    pair, n = table["pair"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    most = np.zeros(b_size, dtype=np.int64)
    np.maximum.at(most, pair % b_size, n)
    shared = spark.sparkContext.broadcast((pair, n, n == most[pair % b_size]))
    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch, bounds, links in _by_links(batches, 4):
            at = np.searchsorted(pair, links)
            sums = [pa.array(x) for x in (np.diff(bounds), _sums(best[at].astype(np.int64), bounds), _sums(n[at], bounds))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *sums, batch.column(5)], names=["kept", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("kept").getField(c).alias(c) for c in keep], *out.columns[1:])
