"""SentencePiece-style encoding with seeded merge-dropout, and lossless decoding.

A text is cut before white space (no piece of a merge-type vocabulary joins letters to a following space, which
is checked when the vocabulary is read). The agenda of a stretch holds its adjacent pairs that form a piece;
the pair with the best score, leftmost first, is merged next, unless this candidate is skipped. The skips of an
occurrence are independent random bits, one per candidate in the order of the agenda, from a hash of seed,
document key and position: no two occurrences share their draw, and reruns on any partitioning agree. With
dropout 0 the result is the vocabulary's own segmentation. Characters without a piece become byte pieces, so
decoding returns every text unchanged.

A segmentation follows from the stretch and the skips that its candidates met, so it is remembered per (stretch,
skips met) in a bounded table of the worker; that saves work and restricts nothing.

Defined results: a NULL text has NULL ids, the empty text none; texts equal in key and content are cut alike;
a literal U+2581 is written as bytes, so that it is not read back as a space; an empty table gives an empty
table; ``encode`` keeps the columns it is told to keep.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from underwrite.llm.common import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 17
#: Segmentations a worker remembers.
REMEMBERED = 600_000
#: Bytes of text encoded at once.
SLICE = 1 << 21
#: Longer stretches use a heap instead of a scan of their pairs.
SHORT = 48
#: Stretches up to this length have at most 3 * (22 - 1) = 63 candidates, so one word holds their skips.
WORD = 22

#: Places of the table of pairs, as a power of two.
SLOT_BITS = 21

SPACE = "▁"
STRETCH = re.compile(rf" *[^ \n{SPACE}]+| +|\n|{SPACE}")
FAR = float("inf")
#: As many low bits as the index says.
ONES = [(1 << n) - 1 for n in range(3 * SHORT)]


@dataclass(frozen=True, eq=False)
class Vocabulary:
    """Pieces by id (bytes as decoded), ids and ranks (smaller first) by piece, ids of the byte pieces."""

    decoded: tuple[bytes, ...]
    ids: dict[str, int]
    ranks: dict[str, float]
    bytes_: tuple[int, ...]


@lru_cache(maxsize=4)
def vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    decoded, ids, ranks, raw = [], {}, {}, {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            raw[int(piece[1:-1], 16)] = i
            decoded.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            decoded.append(b"")
        else:
            if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                raise ValueError(f"piece {piece!r} joins stretches")
            ids[piece], ranks[piece] = i, -model.get_score(i)
            decoded.append(piece.replace(SPACE, " ").encode())
    if len(raw) != 256:
        raise ValueError("the vocabulary has no byte pieces")
    return Vocabulary(tuple(decoded), ids, ranks, tuple(raw[b] for b in range(256)))


def drops(keys: np.ndarray, word: int | np.ndarray, limit: int) -> np.ndarray:
    """64 independent bits per key (numbers 64 * word on), each set with probability limit / 65536."""
    if limit >= 65536:
        return np.full(len(keys), np.uint64(0xFFFFFFFFFFFFFFFF))
    out = np.zeros(len(keys), dtype=np.uint64)
    at = keys + np.asarray(word).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    for b in range(16):  # the binary digits of the probability, last first
        if limit >> b << b != limit or limit >> b & 1:
            x = mix(at + np.uint64((b + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            out = out | x if limit >> b & 1 else out & x
    return out


def _skips(length: int, base: int, limit: int) -> int:
    """The skips of all candidates a stretch of this length can have, first in the lowest bit."""
    if not limit:
        return 0
    n = 3 * length // 64 + 1
    return int.from_bytes(drops(np.full(n, base, dtype=np.uint64), np.arange(n), limit).tobytes(), "little")


def cut(stretch: str, ranks: dict[str, float], base: int, limit: int) -> list[str]:
    """Pieces of one stretch (spaces already written as the space sign), with the skips drawn for the key ``base``."""
    if len(stretch) > SHORT:
        return _cut_long(stretch, ranks, base, limit)
    return _cut_short(stretch, ranks, _skips(len(stretch), base, limit))[0]


def _cut_short(stretch: str, ranks: dict[str, float], skips: int) -> tuple[list[str], int]:
    """Pieces of one stretch, and how many candidates it had. ``skips``: one bit per candidate, first in the lowest."""
    parts = list(stretch)
    get = ranks.get
    agenda = [get(a + b, FAR) for a, b in zip(parts, stretch[1:])]
    met = 0
    while agenda:
        best = min(agenda)
        if best == FAR:
            break
        i = agenda.index(best)
        met += 1
        if skips >> met - 1 & 1:
            agenda[i] = FAR
            continue
        joined = parts[i] + parts[i + 1]
        parts[i] = joined
        del parts[i + 1], agenda[i]
        if i:
            agenda[i - 1] = get(parts[i - 1] + joined, FAR)
        if i < len(agenda):
            agenda[i] = get(joined + parts[i + 1], FAR)
    return parts, met


def _cut_long(stretch: str, ranks: dict[str, float], base: int, limit: int) -> list[str]:
    """As ``cut``, in n log n: a heap of candidates and links to the neighbours."""
    n = len(stretch)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once merged away
    before = list(range(-1, n - 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            rank = ranks.get(stretch[i : end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

    skips = _skips(n, base, limit).to_bytes(3 * n // 8 + 16, "little")
    met = 0
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or end[j] != k:
            continue
        met += 1
        if skips[met - 1 >> 3] >> (met - 1 & 7) & 1:
            continue
        end[i], end[j] = k, 0
        if k < n:
            before[k] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(stretch[i : end[i]])
        i = end[i]
    return out


class Pairs:
    """Ranks and merged ids by the ids of two adjacent pieces, as sorted arrays."""

    def __init__(self, words: Vocabulary):
        rows = []
        for piece, merged in words.ids.items():
            for k in range(1, len(piece)):
                left, right = words.ids.get(piece[:k]), words.ids.get(piece[k:])
                if left is not None and right is not None:
                    rows.append((left << 32 | right, merged, words.ranks[piece]))
        rows.sort()
        self.key = np.array([r[0] for r in rows], dtype=np.int64)
        self.merged = np.array([r[1] for r in rows], dtype=np.int64)
        self.rank = np.array([r[2] for r in rows], dtype=np.float64)
        # One place of a hash table says where most keys stand; keys that share a place are searched for.
        slots = self._slots(self.key)
        self.table = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        self.table[slots] = np.arange(len(rows))
        self.crowded = np.bincount(slots, minlength=1 << SLOT_BITS) > 1

    @staticmethod
    def _slots(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        slots = self._slots(key)
        at = self.table[slots].astype(np.int64)
        searched = np.flatnonzero(self.crowded[slots])
        at[searched] = np.minimum(np.searchsorted(self.key, key[searched]), len(self.key) - 1)
        hit = (self.key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], FAR), self.merged[at]


def cut_many(codes: np.ndarray, pairs: Pairs, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``cut`` for many stretches at once. ``codes``: piece ids of the characters, one row each, padded with -1.

    Every round takes the best candidate of each row; ``skips`` has a row of 64-bit words for each, one bit per
    round. Rows of the first result hold the ids where a piece starts, else -1; the second has their candidates.
    """
    n, width = codes.shape
    sym = np.full((n, width + 2), -1, dtype=np.int64)  # one column before and one behind as ends
    sym[:, 1:-1] = codes
    size = (codes >= 0).sum(axis=1)
    after = np.tile(np.arange(1, width + 3), (n, 1))
    before = after - 2
    agenda = np.full((n, width + 2), FAR)
    made = np.zeros((n, width + 2), dtype=np.int64)
    rank, merged = pairs.find(sym[:, 1:-2].ravel(), sym[:, 2:-1].ravel())
    agenda[:, 1:-2], made[:, 1:-2] = rank.reshape(n, -1), merged.reshape(n, -1)
    rows = np.flatnonzero(size > 1)
    met = np.zeros(n, dtype=np.int64)
    some = bool(skips.any())
    turn = -1
    while len(rows):
        turn += 1
        i = agenda[rows].argmin(axis=1)
        alive = agenda[rows, i] < FAR
        met[rows[~alive]] = turn
        rows, i = rows[alive], i[alive]
        j = after[rows, i]
        k = after[rows, j]
        if some:
            skip = (skips[rows, turn >> 6] >> np.uint64(turn & 63) & np.uint64(1)).astype(bool)
            agenda[rows[skip], i[skip]] = FAR
            m, i, j, k = rows[~skip], i[~skip], j[~skip], k[~skip]
        else:
            m = rows
        sym[m, i] = made[m, i]
        sym[m, j] = -1
        agenda[m, j] = FAR
        after[m, i] = k
        before[m, k] = i
        agenda[m, i], made[m, i] = pairs.find(sym[m, i], sym[m, k])
        h = before[m, i]
        agenda[m, h], made[m, h] = pairs.find(sym[m, h], sym[m, i])
    return sym[:, 1:-1], met


class Encoder:
    """Encodes texts with one vocabulary; remembers segmentations within a bound."""

    def __init__(self, words: Vocabulary, dropout: float = DROPOUT, seed: int = SEED):
        self.words, self.seed, self.pairs = words, seed, Pairs(words)
        self.limit = int(round(dropout * 65536))
        self.forget()
        self.code = np.full(0x110000, -1, dtype=np.int32)  # piece of a character; without one, or the space sign: -1
        for piece, i in words.ids.items():
            if len(piece) == 1:
                self.code[ord(" " if piece == SPACE else piece)] = i

    def forget(self) -> None:
        """Start the table of segmentations anew. An entry is a stretch cut with the skips it met: a bit for each
        candidate it had, and its ids as a range of one long array."""
        self.plain: dict[str, int] = {}
        #: Entry by (skips met << 32 | entry without skips).
        self.skipped: dict[int, int] = {}
        self.names: list[str] = []
        self.bits, self.ends, self.ids = array("Q"), array("q"), array("i")

    def base(self, name: str) -> int:
        """Key of a document; the position of an occurrence is added to it."""
        return int.from_bytes(blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8, key=str(self.seed).encode()).digest(), "little")

    def _ids(self, stretch: str, parts: list[str]) -> bytes:
        ids, raw = self.words.ids, self.words.bytes_
        if stretch == SPACE or stretch == "\n":
            return array("i", [raw[b] for b in stretch.encode()]).tobytes()
        out = []
        for piece in parts:
            known = ids.get(piece)
            out += [raw[b] for b in piece.encode()] if known is None else [known]
        return array("i", out).tobytes()

    def _together(self, stretches: list[str], skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many stretches in a row, how many each has, and its number of candidates; a row of words of skips each."""
        sizes = np.fromiter(map(len, stretches), dtype=np.int64, count=len(stretches))
        codes = np.full((len(stretches), int(sizes.max())), -1, dtype=np.int64)
        letters = self.code[np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), dtype="u4")]
        codes[np.arange(codes.shape[1]) < sizes[:, None]] = letters
        plain = np.add.reduceat(letters < 0, np.cumsum(sizes) - sizes) == 0
        codes[~plain] = -1
        found, met = cut_many(codes, self.pairs, skips)
        flat, count = found[found >= 0].astype("i4"), (found >= 0).sum(axis=1)
        others = np.flatnonzero(~plain)
        if len(others):  # characters without a piece: cut one by one and put in between
            spots, values = np.cumsum(count) - count, []
            for n in others.tolist():
                parts, met[n] = _cut_short(stretches[n].replace(" ", SPACE), self.words.ranks, int.from_bytes(skips[n].tobytes(), "little"))
                values.append(self._ids(stretches[n], parts))
            lengths = np.array([len(v) // 4 for v in values])
            flat = np.insert(flat, np.repeat(spots[others], lengths), np.frombuffer(b"".join(values), dtype="i4"))
            count[others] = lengths
        return flat, count, met

    def remember(self, stretches: list[str], skips: np.ndarray) -> np.ndarray:
        """New entries for (stretch, skips), those of similar length cut together."""
        lengths = np.fromiter(map(len, stretches), dtype=np.int64, count=len(stretches))
        order = np.argsort(lengths, kind="stable")
        at = len(self.bits) + np.argsort(order)
        for lo in range(0, len(order), 4096):
            part = order[lo : lo + 4096]
            flat, count, met = self._together([stretches[n] for n in part.tolist()], skips[part][:, None])
            self.ends.extend((len(self.ids) + np.cumsum(count)).tolist())
            self.ids.frombytes(flat.tobytes())
            self.bits.extend(((np.uint64(1) << met.astype(np.uint64)) - np.uint64(1)).tolist())
        return at

    def _long(self, stretches: list[str], keys: list[int]) -> list[bytes]:
        """Ids of stretches above ``WORD`` characters, each for the key of its occurrence."""
        out = [b"" if len(p) <= SHORT else self._ids(p, cut(p.replace(" ", SPACE), self.words.ranks, k, self.limit)) for p, k in zip(stretches, keys)]
        short = [n for n, p in enumerate(stretches) if len(p) <= SHORT]
        for lo in range(0, len(short), 4096):
            part = short[lo : lo + 4096]
            base = np.array([keys[n] for n in part], dtype=np.uint64)
            skips = np.column_stack([drops(base, w, self.limit) for w in range(3 * SHORT // 64 + 1)])
            flat, count, _ = self._together([stretches[n] for n in part], skips)
            for n, ids in zip(part, np.split(flat, np.cumsum(count)[:-1])):
                out[n] = ids.tobytes()
        return out

    def encode_many(self, texts: list[str], names: list[str]) -> list[np.ndarray]:
        """Ids of each text; ``names`` are the document keys."""
        parts: list[str] = []
        counts, bases = [], []
        if len(self.bits) > REMEMBERED:
            self.forget()
        for text, name in zip(texts, names):
            had = len(parts)
            if text:
                parts += STRETCH.findall(" " + text)
            counts.append(len(parts) - had)
            bases.append(self.base(name))
        ends = np.cumsum(counts)
        place = np.arange(len(parts)) - np.repeat(ends - counts, counts)
        keys = mix(np.repeat(np.array(bases, dtype=np.uint64), counts) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        step = 1 << 14
        drawn = np.concatenate([np.zeros(0, np.uint64), *(drops(keys[lo : lo + step], 0, self.limit) for lo in range(0, len(parts), step))])

        new = [p for p in set(parts).difference(self.plain) if len(p) <= WORD]
        if new:
            entries = self.remember(new, np.zeros(len(new), dtype=np.uint64))
            self.plain.update(zip(new, entries.tolist()))
            self.names += [""] * (len(self.bits) - len(self.names))
            for p, n in zip(new, entries.tolist()):
                self.names[n] = p
        get = self.plain.get
        word = np.array(list(map(get, parts, repeat(-1))), dtype=np.int64)
        entry, met = word.copy(), np.zeros(len(parts), dtype=np.uint64)
        open_ = np.flatnonzero(word >= 0)
        while True:
            bits = np.array(self.bits, dtype=np.uint64)
            differ = drawn[open_] & bits[entry[open_]] ^ met[open_] if len(open_) else np.zeros(0, np.uint64)
            open_, differ = open_[differ != 0], differ[differ != 0]
            if not len(open_):
                break
            # Each met one more skip than those remembered so far: the first that differs.
            met[open_] |= differ & (~differ + np.uint64(1))
            entry[open_] = self._with_skips(word[open_], met[open_])

        long = np.flatnonzero(word < 0)
        apart = self._long([parts[n] for n in long.tolist()], keys[long].tolist())
        ids, stops = np.array(self.ids, dtype="i4"), np.concatenate([[0], np.array(self.ends, dtype=np.int64)])
        entry[long] = len(stops) - 1 + np.arange(len(long))
        stops = np.concatenate([stops, stops[-1] + np.cumsum([len(x) // 4 for x in apart], dtype=np.int64)])
        ids = np.concatenate([ids, np.frombuffer(b"".join(apart), dtype="i4")])
        starts, sizes = stops[entry], stops[entry + 1] - stops[entry]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])]
        return [flat[upto[e - c] : upto[e]] for e, c in zip(ends.tolist(), counts)]

    def _with_skips(self, word: np.ndarray, met: np.ndarray) -> np.ndarray:
        """Entries of words cut with the skips they met."""
        order = np.lexsort((met, word))
        first = np.append(True, (word[order][1:] != word[order][:-1]) | (met[order][1:] != met[order][:-1]))
        at = order[first]
        names = [m << 32 | w for w, m in zip(word[at].tolist(), met[at].tolist())]
        get = self.skipped.get
        entries = np.fromiter((get(n, -1) for n in names), dtype=np.int64, count=len(names))
        fresh = np.flatnonzero(entries < 0)
        if len(fresh):
            entries[fresh] = self.remember([self.names[w] for w in word[at[fresh]].tolist()], met[at[fresh]])
            self.skipped.update(zip([names[n] for n in fresh.tolist()], entries[fresh].tolist()))
            self.names += [""] * (len(self.bits) - len(self.names))
        out = np.empty(len(word), dtype=np.int64)
        out[order] = np.repeat(entries, np.diff(np.append(np.flatnonzero(first), len(word))))
        return out

    def encode(self, text: str, key: str = "") -> np.ndarray:
        return self.encode_many([text], [key])[0]


def decode_ids(ids: np.ndarray, words: Vocabulary) -> str:
    """The text of the ids."""
    flat, starts, sizes = _decoded_bytes(words)
    size = sizes[ids]
    ends = np.cumsum(size)
    where = np.repeat(starts[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    text = flat[where].tobytes().decode("utf-8", errors="replace")
    return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=4)
def _decoded_bytes(words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(d) for d in words.decoded], dtype=np.int64)
    return np.frombuffer(b"".join(words.decoded), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


_encoders: dict[tuple, Encoder] = {}


def _encoder(token: tuple, shared, dropout: float, seed: int) -> Encoder:
    """The worker's encoder, kept between tasks."""
    if token not in _encoders:
        _encoders.clear()
        _encoders[token] = Encoder(shared.value, dropout, seed)
    return _encoders[token]


def encode(
    df: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, decoded: str | None = None
) -> DataFrame:
    """The columns ``keep`` and ``piece_ids`` of every row; with ``decoded``, also their text as a column of that name.

    Decoding where the ids arise saves a second set of Python workers, each of which would come to hold a table
    of segmentations, as Spark hands idle workers to either step. Names of results must not be kept.
    """
    clash = {"piece_ids", *([decoded] if decoded else [])} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are results of encode; rename them before")
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(model))  # bounded by the vocabulary
    token = (model, dropout, seed)
    back = ["back"] if decoded else []
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(True).alias("row"))
    packed = df.select(kept.alias("row"), F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = StructType([packed.schema["row"], StructField("ids", ArrayType(IntegerType())), *(StructField(c, StringType()) for c in back)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(token, shared, dropout, seed)
        for batch in batches:
            lo = 0
            texts, names = batch.column(2), batch.column(1)
            length = np.cumsum(pc.coalesce(pc.binary_length(texts), pa.scalar(0, pa.int32())).to_numpy(zero_copy_only=False).astype(np.int64))
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(length, (length[lo - 1] if lo else 0) + SLICE, side="right")))
                values = texts.slice(lo, hi - lo)
                ids = encoder.encode_many(values.fill_null("").to_pylist(), names.slice(lo, hi - lo).fill_null("").to_pylist())
                ends = np.cumsum([0, *map(len, ids)])
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()), mask=values.is_null())
                arrays = [batch.column(0).slice(lo, hi - lo), column]
                if back:
                    arrays.append(pa.array([decode_ids(i, encoder.words) if ok else None for i, ok in zip(ids, values.is_valid().to_pylist())], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "ids", *back])
                lo = hi

    out = packed.mapInArrow(run, schema)
    results = [F.col("ids").alias("piece_ids"), *([F.col("back").alias(decoded)] if decoded else [])]
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], *results)


def decode(df: DataFrame, ids: str = "piece_ids", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` with the decoded text of the column ``ids`` (NULL for NULL) as one more column."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(model))
    at, names = df.columns.index(ids), [*df.columns, into]
    schema = StructType([*df.schema, StructField(into, StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            texts = [None if not v.is_valid else decode_ids(v.values.to_numpy(), words) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return df.mapInArrow(run, schema)
