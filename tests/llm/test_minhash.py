import random

import pytest

from historymine.llm import minhash

SCHEMA = "doc_id bigint, text string, id string, component int, a int, key string"


def brute(rows, how):
    """Sets of words as strings, all pairs, smallest id reachable."""
    sets = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        width = min(how.words, len(words))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
    ids = sorted({r[0] for r in rows if r[0] is not None})
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, *_) in enumerate(rows):
        for y, (j, *_) in enumerate(rows[:x]):
            both = len(sets[x] & sets[y])
            if None not in (i, j) and both and 100 * both >= how.percent * len(sets[x] | sets[y]):
                low, high = sorted((root(i), root(j)))
                up[high] = low
    return sorted([(r[0], len(s), r[0] and root(r[0]), None if r[0] is None else root(r[0]) == r[0]) for r, s in zip(rows, sets)], key=repr)


def texts(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    out = []
    for _ in range(25):
        base = draw.choices(vocabulary, k=draw.choice([8, 60, 300]))
        for _ in range(draw.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(draw.randrange(0, 1 + len(base) // 25)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            out.append(" ".join(copy))
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("how", [minhash.MinHash(), minhash.MinHash(words=3, percent=85)])
def test_equals_brute_force(spark, how):
    many = texts(how.words)
    rows = [(10 + i, t, "x", 1, 2, "k") for i, t in enumerate(many)]
    rows += [(1, None, None, None, None, None), (2, "", "x", 0, 0, ""), (3, " \t\n", "x", 0, 0, ""), (4, "One two", "", 0, 0, ""), (5, "one\x0bTWO ", "", 0, 0, "")]
    rows += [(None, many[0], "", 0, 0, ""), (12, many[2], "repeated row", 1, 2, "k"), (13, many[40] + " other text of the same id", "", 1, 2, "k"), (13, "", "", 0, 0, "")]
    rows += [(6, "É é " * 30_000, "", 0, 0, ""), (7, "É é " * 29_000, "", 0, 0, ""), (8, "x" * 100_000, "", 0, 0, ""), (9, "x" * 100_000, "", 0, 0, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), how)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, how)


def test_large_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "MEMBERS_PER_SLICE", 5)
    draw = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(4):
            copy[draw.randrange(120)] = f"n{draw.random()}"
        rows.append((i, " ".join(copy), "", 0, 0, ""))
    how = minhash.MinHash(words=3, percent=85)
    assert sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), how).collect()), key=repr) == brute(rows, how)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
