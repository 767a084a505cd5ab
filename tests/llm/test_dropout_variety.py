"""Merge-dropout draws every occurrence anew: no bound on the cuts of a word, skips as often as asked for."""

import numpy as np
from underwrite.llm import pieces


def test_a_frequent_word_has_more_cuts_than_a_few():
    encoder = pieces.Encoder(pieces.vocabulary(), dropout=0.1)
    cuts = {encoder.encode("international", str(k)).tobytes() for k in range(2000)}
    assert len(cuts) > 12
    the = [len(encoder.encode("the", str(k))) for k in range(2000)]
    assert len(set(the)) > 1  # a short word varies too


def test_remembered_cuts_are_those_of_the_plain_loop():
    words = pieces.vocabulary()
    encoder = pieces.Encoder(words, dropout=0.2)
    text = "the internationalization of antidisestablishmentarianism naïve 日本 " + "x" * 30
    for k in range(100):
        parts = pieces.STRETCH.findall(" " + text)
        keys = pieces.mix(np.uint64(encoder.base(str(k))) + np.arange(len(parts), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        want = b"".join(encoder._ids(p, pieces.cut(p.replace(" ", pieces.SPACE), words.ranks, int(key), encoder.limit)) for p, key in zip(parts, keys))
        assert encoder.encode(text, str(k)).tobytes() == want


def test_skips_are_drawn_with_the_probability():
    drawn = pieces.drops(pieces.mix(np.arange(100_000, dtype=np.uint64)), 0, 6554)
    share = [float((drawn >> np.uint64(b) & np.uint64(1)).mean()) for b in range(64)]
    assert max(abs(s - 0.1) for s in share) < 0.006
