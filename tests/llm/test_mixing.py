import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from historymine.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size int, target string, place string, shard int, words int"


def brute_targets(sizes, how):
    """Share by weight, stop at the limit, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: how.weights[i % len(how.weights)] for i, s in enumerate(order)}
    left, got, open_ = how.share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > how.repeats * sizes[s]}
        if not over:
            return got | {s: level * weight[s] for s in open_}
        got |= {s: how.repeats * sizes[s] for s in over}
        left -= sum(how.repeats * sizes[s] for s in over)
        open_ -= over
    return got


def brute_quotas(votes, seats):
    quotients = sorted((-v / (2 * k + 1), i) for i, v in enumerate(votes) for k in range(seats) if v)
    won = Counter(i for _, i in quotients[:seats])
    return [won[i] for i in range(len(votes))]


def sample():
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 3}", 1, "t", "p", 1, 1) for i in range(900)]
    rows += [(1000 + i, "x y z", "zeta", None, None, None, None, None) for i in range(40)]
    rows += [(2000, None, "s1", 0, "", "", 0, 0), (2001, "", "empty", 0, "", "", 0, 0), (None, "no id", None, 0, "", "", 0, 0), (2002, "one word two", None, 0, "", "", 0, 0)]
    return rows + [(5, "w w", "s0", 0, "", "", 0, 0)] * 3 + [(2003, "long " * 50_000, "é", 0, "", "", 0, 0)]


@pytest.mark.parametrize("how", [mixing.Mix(docs_per_shard=50), mixing.Mix(docs_per_shard=100, blocks=5000), mixing.Mix()])
def test_mix(spark, how):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df.repartition(4), how, carried=("doc_id", "text")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(7), how, carried=("doc_id", "text")).collect()), key=repr)
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(r[:3] for r in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    wanted = brute_targets(sizes, how)
    block = max(1, int(how.share * sum(sizes.values()) / how.blocks))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= block * (2 + sizes[s] // how.docs_per_shard)


def test_sources_below_a_block_and_at_their_limit_reach_their_targets(spark):
    """Blocks of about 4,500 words: one source of 300 words in all, one of short texts held at twice its size in many shards."""
    rows = [(i, "w " * 30, "large", 0, "", "", 0, 0) for i in range(2_000)]
    rows += [(10_000 + i, "w " * 10, "tail", 0, "", "", 0, 0) for i in range(30)] + [(20_000 + i, "w w w", "a_short", 0, "", "", 0, 0) for i in range(3_000)]
    how = mixing.Mix(blocks=23, docs_per_shard=300)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), how).collect()
    target, taken, held = {r.source: r.target for r in got}, defaultdict(int), defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        held[r.source] += 2 * r["size"]
        assert 0 <= r.taken <= 2 * r["size"]
    assert target["a_short"] == held["a_short"] and 0 < target["tail"] <= held["tail"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_quotas_by_highest_quotients(spark):
    votes = [100.0, 100.0, 37.5, 12.0, 0.0, 3.0]
    for seats in (0, 1, 2, 7, 50):
        df = spark.createDataFrame(list(enumerate(votes)), "place int, target double")
        got = [r.quota for r in mixing.source_quotas(df, seats).orderBy("place").collect()]
        assert got == brute_quotas(votes, seats)
        assert mixing.apportion(np.array(votes), seats, np.full(6, 1000)).tolist() == got


def test_empty_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    only_null = mixing.mix(spark.createDataFrame([(1, None, None, 0, "", "", 0, 0)], SCHEMA)).collect()
    assert [(r["size"], r.target, r.taken) for r in only_null] == [(0, 0.0, 0)]
