"""Quality rules as a short-circuit cascade.

Every rule is a whole-text test that can reject a document; a document is kept if no rule rejects it. The
rules are independent of each other, so their order changes the work and never the result: it is chosen on a
bounded sample by rejections per second of each rule (the classical order for a conjunction), and each rule
then looks only at the documents that all earlier ones let through.

Defined results: NULL or empty text has no words and is rejected by ``few_words``; repeated rows are judged
one by one; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwrite.llm import common

#: Documents on which cost and selectivity are measured (a bound of the sample, not of the result).
SAMPLE_ROWS = 2000

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
LOWER_CASE = np.zeros(256, dtype=bool)
LOWER_CASE[97:123] = True
UPPER_CASE = np.zeros(256, dtype=bool)
UPPER_CASE[65:91] = True


class Texts:
    """The texts of a slice; every measure is computed at most once."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def take(self, rows: np.ndarray) -> Texts:
        size = np.diff(self.bounds)
        chosen = np.zeros(len(self), dtype=bool)
        chosen[rows] = True
        return Texts(self.data[np.repeat(chosen, size)], np.concatenate(([0], np.cumsum(size[rows]))))

    def per_text(self, mask: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        bounds = self.bounds if bounds is None else bounds
        return sums[bounds[1:]] - sums[bounds[:-1]]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return common.words(self.data, self.bounds)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.per_text(~common.SPACE[self.data] & ((self.data & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.per_text(SYMBOL[self.data])

    @cached_property
    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        return self.per_text(LOWER_CASE[self.data]), self.per_text(UPPER_CASE[self.data])

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word and lines equal to an earlier one of the same text."""
        cuts = np.flatnonzero(self.data == 10)
        starts = np.unique(np.concatenate((self.bounds[:-1], cuts + 1)))
        starts = starts[starts < len(self.data)]
        if not len(starts):
            return np.zeros(len(self), np.int64), np.zeros(len(self), np.int64)
        ends = np.concatenate((starts[1:], [len(self.data)]))
        ends = ends - ((ends > starts) & (self.data[ends - 1] == 10))
        at = np.searchsorted(self.words[0], starts)
        full = np.searchsorted(self.words[0], ends) > at
        starts, ends = starts[full], ends[full]
        doc = np.searchsorted(self.bounds, starts, side="right") - 1
        seen = common.span_hashes(self.data, starts, ends)
        order = np.lexsort((seen, doc))
        again = (doc[order][1:] == doc[order][:-1]) & (seen[order][1:] == seen[order][:-1])
        return np.bincount(doc, minlength=len(self)), np.bincount(doc[order][1:][again], minlength=len(self))

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside five-word windows that occur twice or more in the text."""
        starts, ends, before = self.words
        total = len(starts)
        doc = np.repeat(np.arange(len(self)), np.diff(before))
        first = np.flatnonzero(before[1:][doc] - np.arange(total) >= 5)
        if not len(first):
            return np.zeros(len(self), np.int64)
        shingle, _ = common.shingle_hashes(common.span_hashes(self.data, starts, ends), before)
        short = np.diff(before) < 5
        if short.any():  # texts of one to four words have one shingle, which is no window
            _, owner = common.shingle_hashes(np.zeros(total, np.uint64), before)
            shingle = shingle[~short[owner]]
        order = np.lexsort((shingle, doc[first]))
        same = (shingle[order][1:] == shingle[order][:-1]) & (doc[first][order][1:] == doc[first][order][:-1])
        twice = np.zeros(len(first), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(total + 1, dtype=np.int64)
        hit = first[twice]
        cover[hit] += 1
        cover[hit + 5] -= 1
        return self.per_text(np.cumsum(cover)[:-1] > 0, before)


#: name -> documents that the rule rejects. All are ratios of whole numbers.
RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "few_words": lambda t: t.n_words < 10,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 20 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t: (10 * t.word_chars < 25 * t.n_words) | (t.word_chars > 14 * t.n_words),
    "repeated_lines": lambda t: 10 * t.lines[1] > 3 * t.lines[0],
    "capitals": lambda t: 10 * t.letters[1] > 3 * (t.letters[0] + t.letters[1]),
}


def reject(texts: Texts, order: Iterable[str], alive: np.ndarray | None = None) -> np.ndarray:
    """Position in ``order`` of the rule that rejects each text, -1 if none does; later rules skip it."""
    order = list(order)
    verdict = np.full(len(texts), -1, dtype=np.int32)
    rows = np.arange(len(texts)) if alive is None else np.flatnonzero(alive)
    held = texts if len(rows) == len(texts) else texts.take(rows)
    for k, name in enumerate(order):
        if not len(rows):
            break
        bad = RULES[name](held)
        verdict[rows[bad]] = k
        if bad.any():
            if 4 * bad.sum() >= len(rows):  # measures of the others are kept otherwise
                rows, held = rows[~bad], held.take(np.flatnonzero(~bad))
            else:
                return _rest(texts, order, k + 1, rows, bad, held, verdict)
    return verdict


def _rest(texts, order, k, rows, bad, held, verdict):
    """Go on with the same slice while few texts are rejected: a new slice would cost more than it saves."""
    dead = bad.copy()
    for at in range(k, len(order)):
        now = RULES[order[at]](held) & ~dead
        verdict[rows[now]] = at
        dead |= now
        if 4 * dead.sum() >= len(rows) and at + 1 < len(order):
            left = rows[~dead]
            tail = reject(texts.take(left), order[at + 1 :])
            verdict[left] = np.where(tail < 0, -1, tail + at + 1)
            break
    return verdict


def order_rules(df: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, seed: int = 7) -> list[str]:
    """Rules by rejections per second, best first, measured on about ``rows`` documents on the executors."""
    total = df.count()
    if not total:
        return list(RULES)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = common.text_buffers(batch.column(0))
            out = []
            for name, rule in RULES.items():
                rejected, began = 0, time.perf_counter()
                for lo, hi in common.slices(bounds):
                    part = Texts(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                    rejected += int(rule(part).sum())
                out.append((name, time.perf_counter() - began, rejected))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["rule", "seconds", "rejected"])

    sample = df.select(F.col(text).cast("string")).sample(min(1.0, rows / total), seed)
    facts = (
        sample.mapInArrow(measure, "rule string, seconds double, rejected long")
        .groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()
    )
    gain = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in facts}
    return sorted(RULES, key=lambda name: -gain.get(name, 0.0))


def assess(df: DataFrame, key: str = "doc_id", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """``key``, the base measures, ``base_failed``, ``kept`` and ``rejected_by`` (NULL if kept) of every row."""
    order = order_rules(df, text) if order is None else list(order)
    base = ("few_words", "repeated_words")
    method = [name for name in order if name not in base]
    names = pa.array([*method, *base])

    def work(data: np.ndarray, bounds: np.ndarray) -> dict[str, object]:
        texts = Texts(data, bounds)
        few, repeated = (RULES[name](texts) for name in base)
        failed = few | repeated
        verdict = reject(texts, method, ~failed)
        by = np.where(few, len(method), np.where(repeated, len(method) + 1, verdict))
        return {
            "n_words": texts.n_words, "word_chars": texts.word_chars, "n_symbols": texts.n_symbols,
            "n_dup_lines": texts.lines[1], "n_repeat_words": texts.n_repeat_words,
            "base_failed": failed, "kept": by < 0,
            "rejected_by": names.take(pa.array(by, mask=by < 0)),
        }

    return common.per_slice(
        df, text, [key],
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, rejected_by string", work,
    )
