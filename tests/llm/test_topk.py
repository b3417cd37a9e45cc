import math

import numpy as np
import pytest

from historymine.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, annulus int, score string, query_id int"


def brute(rows, every=50, k=5):
    kept = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * float(np.float32(x))) for x in v]
        kept[i] = min(kept.get(i, ints), ints)
    out = []
    for q in (i for i in kept if i % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(kept[q], v)), i) for i, v in kept.items() if i != q)
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("how", [topk.PivotIndex(), topk.PivotIndex(pivots=6, rings=4, sample=60, block=16, query_block=3)])
@pytest.mark.parametrize("unequal", [False, True])
def test_equals_brute_force(spark, how, unequal):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(20, 12))[draw.integers(0, 20, 700)] + draw.normal(scale=0.02, size=(700, 12))
    x *= draw.uniform(0, 3, size=(700, 1)) if unequal else 1 / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i - 50, v.tolist(), 1, 2, "clash", 3) for i, v in enumerate(x.astype(np.float32))]
    rows += [(1000 + i, rows[50][1], 0, 0, "", 0) for i in range(60)]  # ties
    rows += [(2000, None, 0, 0, "", 0), (2050, [1.0, None], 0, 0, "", 0), (2100, [float("nan")], 0, 0, "", 0), (None, [9.0] * 12, 0, 0, "", 0), (2150, [], 0, 0, "", 0), (100, [9.0] * 12, 0, 0, "", 0), (2200, [0.5], 0, 0, "", 0)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(4), how=how)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_few_and_large(spark):
    rows = [(0, [1e6, 2e6], 0, 0, "", 0), (50, [-3e6, 1e6], 0, 0, "", 0), (7, [2e6, 2e6], 0, 0, "", 0)]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
    alone = topk.top_k(spark.createDataFrame(rows[:1], SCHEMA))
    assert alone.collect() == []


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).collect() == []
