"""Toxicity by a weighted lexicon matched with Aho-Corasick on folded text.

Folding lowers case, strips combining marks of compatibility forms, and maps homoglyphs (Cyrillic and Greek
look-alikes, full-width letters) and digit substitutions to plain letters, so ``1d10t`` and Cyrillic spellings
meet the lexicon's entry. A match counts if it stands between non-letters, adds its weight, and is cancelled
when it lies inside an exception phrase. The sum is divided by the logarithm of the text's words and a
two-parameter logistic curve turns it into a score.

Learning: the lexicon is chosen on a bounded labelled sample by log-odds and greedy cover: a word enters only
if it explains toxic documents that the words before it leave unexplained, so words that merely travel with a
group of toxic near copies stay out. Phrases around an entry that occur in documents marked clean become
exceptions. Only counts and at most ``SAMPLE_ROWS`` short rows reach the driver.

Defined results: NULL and empty texts match nothing and get the lowest score; without toxic labels the lexicon
is empty and every score is the same; repeated rows are scored one by one; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwrite.llm.quality_model import labelled_sample
from underwrite.session import materialize

#: Bound of the labelled sample and of the lexicon.
SAMPLE_ROWS = 20_000
MAX_WORDS = 2_000
#: A word must explain this many toxic documents more than those before it.
LEAST_NEW = 3
#: Phrases in clean documents before they are exceptions.
LEAST_CLEAN = 2
THRESHOLD = 0.3

#: Look-alikes of Latin letters (Cyrillic, then Greek) and digit substitutions: fixed values.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ӏ": "l",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
FOLDS = str.maketrans(HOMOGLYPHS | DIGITS)
#: Signs that end a word are punctuation, not letters.
LOOSE = re.compile(r"[$@]+(?![\w$@])|(?<![\w$@])[$@]{2,}")
WORD = re.compile(r"[^\W\d_]+")
ODD = re.compile(r"[ᴀ-ᶿ℀-⅏ﬀ-ﬆ＀-～\U0001D400-\U0001D7FF̀-ͯ​-‍­]")


def fold(text: str) -> str:
    """Folded text; its length may differ from the original's only where compatibility forms occur."""
    if ODD.search(text):
        text = "".join(c for c in unicodedata.normalize("NFKC", text) if not unicodedata.combining(c) and c not in "​‌‍­")
    if "$" in text or "@" in text:
        text = LOOSE.sub(lambda m: " " * len(m.group()), text)
    return text.lower().translate(FOLDS)


@dataclass(frozen=True)
class Lexicon:
    """Folded words with weights, exception phrases (folded, words joined by one space) and the curve."""

    weights: dict[str, float]
    exceptions: frozenset[str] = field(default_factory=frozenset)
    intercept: float = -3.0
    slope: float = 3.0

    def matcher(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        found = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            found.add_word(word, (word, weight))
        found.make_automaton()
        return found

    def matches(self, folded: str, automaton: ahocorasick.Automaton | None) -> Iterator[tuple[int, int, str, float]]:
        """(start, end, word, weight) of whole-word matches outside exception phrases."""
        if automaton is None:
            return
        size = len(folded)
        for last, (word, weight) in automaton.iter(folded):
            start, end = last + 1 - len(word), last + 1
            if (start and folded[start - 1].isalpha()) or (end < size and folded[end].isalpha()):
                continue
            if self.exceptions and any(p in self.exceptions for p in neighbours(folded, start, end)):
                continue
            yield start, end, word, weight

    def density(self, text: str, automaton: ahocorasick.Automaton | None) -> float:
        """Summed weights over the logarithm of the number of words."""
        if not text or automaton is None:
            return 0.0
        total = sum(m[3] for m in self.matches(fold(text), automaton))
        return total / math.log(3 + text.count(" ") + text.count("\n")) if total else 0.0

    def score(self, density: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * density, -30, 30)))


def neighbours(folded: str, start: int, end: int, reach: int = 40) -> list[str]:
    """Phrases of two and three words that contain the word at start:end."""
    before = WORD.findall(folded[max(0, start - reach) : start])[-2:]
    after = WORD.findall(folded[end : end + reach])[:2]
    word = folded[start:end]
    out = []
    if before:
        out.append(f"{before[-1]} {word}")
    if after:
        out.append(f"{word} {after[0]}")
    if before and after:
        out.append(f"{before[-1]} {word} {after[0]}")
    return out


def _words_of(df: DataFrame) -> DataFrame:
    """toxic, word: the distinct folded words of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[int, Counter] = defaultdict(Counter)
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update(set(WORD.findall(fold(text or ""))))
            for toxic, words in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([toxic] * len(words), pa.int32()), pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())],
                    names=["toxic", "word", "n"],
                )

    return df.select("text", "toxic").mapInArrow(run, "toxic int, word string, n long")


def _cover(rows: list[list[str]], odds: dict[str, float]) -> list[str]:
    """Words by greedy cover of the toxic documents, most new documents first."""
    holders: dict[str, set[int]] = defaultdict(set)
    for k, words in enumerate(rows):
        for word in words:
            holders[word].add(k)
    chosen: list[str] = []
    open_docs = set(range(len(rows)))
    while holders and len(chosen) < MAX_WORDS:
        best = max(holders, key=lambda w: (len(holders[w] & open_docs) * odds[w], w))
        new = holders.pop(best) & open_docs
        if len(new) < LEAST_NEW:
            break
        chosen.append(best)
        open_docs -= new
    return chosen


def _joint(rows: list[list[str]], chosen: list[str], odds: dict[str, float]) -> list[str]:
    """Companions of the cover: words about as frequent as it, spread like it over the toxic documents."""
    known = set(chosen)
    cover = sorted(sum(w in r for r in map(set, rows)) for w in chosen)
    least = cover[len(cover) // 2] / 2 if cover else math.inf
    counts = Counter(w for r in rows for w in set(r))
    return [w for w, n in counts.items() if w not in known and n >= least and odds[w] > 0]


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "toxic", rows: int = SAMPLE_ROWS) -> Lexicon:
    """Lexicon, exceptions and curve from the labels given (pass training folds only)."""
    sample = labelled_sample(labels, key, mark, rows)
    # at most ``rows`` keys: the broadcast is bounded
    known = docs.select(key, F.col(text).alias("text")).join(F.broadcast(sample), key).select("text", F.col("_mark").alias("toxic"))
    known = materialize(known, "toxic-sample")
    size = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad:
        return Lexicon({})
    counts = _words_of(known).groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good")
    )
    odds_of = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    ranked = counts.where(F.col("bad") >= LEAST_NEW).withColumn("odds", odds_of).where("odds > 3 and length(word) >= 3")
    best = ranked.orderBy(F.desc(F.col("bad") * F.col("odds")), "word").limit(MAX_WORDS).collect()
    odds = {r["word"]: r["odds"] for r in best}

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({w for w in WORD.findall(fold(t or "")) if w in odds}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["words"])

    rows_bad = sorted(r["words"] for r in known.where("toxic = 1").select("text").mapInArrow(held, "words array<string>").collect())
    chosen = _cover(rows_bad, odds)
    chosen += _joint(rows_bad, chosen, odds)
    weights = {w: round(odds[w], 6) for w in sorted(chosen)}
    draft = Lexicon(weights)

    def phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = draft.matcher()
        for batch in batches:
            out = []
            for value, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(value or "")
                out += [(p, toxic) for m in draft.matches(folded, automaton) for p in neighbours(folded, m[0], m[1])]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([t for _, t in out], pa.int32())], names=["phrase", "toxic"])

    clean = (
        known.select("text", "toxic").mapInArrow(phrases, "phrase string, toxic int").groupBy("phrase")
        .agg(F.sum(1 - F.col("toxic")).alias("good"), F.sum("toxic").alias("bad"))
        .where((F.col("good") >= LEAST_CLEAN) & (F.col("good") > 4 * F.col("bad"))).orderBy(F.desc("good"), "phrase").limit(MAX_WORDS)
    )
    lexicon = Lexicon(weights, frozenset(r["phrase"] for r in clean.collect()))
    facts = _density(known, lexicon, ["toxic"], "text").toPandas()
    a, b = _curve(facts["density"].to_numpy(), facts["toxic"].to_numpy(dtype=np.float64))
    return Lexicon(weights, lexicon.exceptions, a, b)


def _curve(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, ridge 0.01 on the slope; rows are sorted, so their order is no matter."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    a, b = math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - 0.01 * b])
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        da, db = np.linalg.solve(h, g)
        scale = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a + scale * da, b + scale * db
    return round(float(a), 9), round(max(float(b), 0.0), 9)


def _density(df: DataFrame, lexicon: Lexicon, keep: list[str], text: str) -> DataFrame:
    from pyspark.sql.types import StructType

    kept = ", ".join(f"`{name}` {df.schema[name].dataType.simpleString()}" for name in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.matcher()
        for batch in batches:
            found = pa.array([lexicon.density(t.as_py() or "", automaton) for t in batch.column(len(keep))], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), found], names=[*keep, "density"])

    return df.select(*keep, F.col(f"`{text}`").cast("string")).mapInArrow(run, StructType.fromDDL(f"{kept}, density double"))


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, density and score of every row."""
    out = _density(docs, lexicon, [key], text)
    z = F.lit(lexicon.intercept) + F.lit(lexicon.slope) * F.col("density")
    return out.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
