import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from historymine.llm import collocations as c

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n int"
WORDS = ["a", "B", "the", "É", "é", "x-1", "\x1c", " ", "word", "of", "New", "York"]
BETWEEN = [" ", " ", " ", " ", "\t ", ". ", "\n", ", "]


def texts(seed, number, longest):
    drawn = np.random.default_rng(seed)
    return ["".join(w + b for w, b in zip(drawn.choice(WORDS, n), drawn.choice(BETWEEN, n))) for n in drawn.integers(1, longest, number)]


def counted(rows):
    """Counts of phrases per language, by enumeration."""
    found = defaultdict(Counter)
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                found[lang or "und"].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    return found


def brute(rows, least, share, first):
    for lang, f in counted(rows).items():
        n = sum(v for p, v in f.items() if " " not in p)
        candidates = {p: a for p, a in f.items() if " " in p and a >= least}
        scored = []
        for phrase, a in candidates.items():
            words = phrase.split(" ")
            cuts = [(1000000 * a * a // (f[" ".join(words[:k])] * f[" ".join(words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            if any(100 * other >= share * a for p, other in candidates.items() if len(p.split(" ")) > len(words) and f" {phrase} " in f" {p} "):
                continue
            scored.append((-score, -a, phrase.encode(), phrase, a, f[" ".join(words[:k])], f[" ".join(words[k:])], score))
        for rank, (*_, phrase, a, l, r, score) in enumerate(sorted(scored)[:first], 1):
            yield lang, rank, phrase, a, l, r, n, score


def frame(spark, rows):
    return spark.createDataFrame([(1, t, lang, "p", 7) for t, lang in rows], SCHEMA)


ROWS = [(t, lang) for lang, seed in (("en", 1), ("fr", 2), (None, 3)) for t in texts(seed, 40, 120)] + [(None, "en"), ("", "de"), (" . ", "de"), ("one two", "de")] + [("New York of the a", "en")] * 30


@pytest.mark.parametrize("shard_words", [1, 7, 100, c.SHARD_WORDS])
def test_equals_brute_force(spark, shard_words):
    got = c.collocations(frame(spark, ROWS), least=5, first=25, shard_words=shard_words)
    assert sorted(map(tuple, got.collect())) == sorted(brute(ROWS, 5, 50, 25))


def test_all_counts_across_cuts(spark):
    """One text far longer than a shard, in one piece, keeps every phrase across the cuts."""
    rows = [(" ".join(["red", "blue", "red", "green", "red"] * 200), "en")] + [("red blue", "en")] * 3
    got = {(r.lang, r.phrase): r.n for r in c.phrase_counts(frame(spark, rows), least=1, shard_words=10).collect()}
    assert got == {(lang, p): n for lang, f in counted(rows).items() for p, n in f.items()}


def test_intervals_in_step():
    """Extending left then right, or right then left, finds the same phrases with the same intervals and counts."""
    ids = np.random.default_rng(4).integers(0, 6, 500)
    index = c.ShardIndex(np.append(ids, 0))
    words = index.words()
    one, other = (index.extended(index.extended(words, a), not a) for a in (True, False))
    as_rows = lambda found: sorted(zip(found.words.tolist(), found.forward.tolist(), found.backward.tolist(), found.size.tolist()))
    assert as_rows(one) == as_rows(other)
    wanted = Counter(tuple(t) for t in zip(ids.tolist(), ids[1:].tolist(), ids[2:].tolist()) if 0 not in t)
    assert {tuple(w): n for w, n in zip(one.words.tolist(), one.size.tolist())} == wanted


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(c, "BITMAP_BITS", 1 << 15)
    monkeypatch.setattr(c, "phrase_hash", lambda left, right: np.zeros(len(left), dtype=np.int64))
    got = c.collocations(frame(spark, ROWS), least=5, first=25)
    assert sorted(map(tuple, got.collect())) == sorted(brute(ROWS, 5, 50, 25))


def test_empty_tables(spark):
    assert c.collocations(frame(spark, [])).collect() == []
    assert c.collocations(frame(spark, [(None, None), ("", "en"), ("...", "en"), ("only", "en")])).collect() == []
