import numpy as np
import pytest

from historymine.llm import forest

SCHEMA = "vec_id bigint, embedding array<float>, label int, links string, leaf int, component string"


def brute(rows, cosine=0.95):
    units = [None if r[0] is None else forest.unit(None if r[1] is None else [np.float32(v) if v is not None else None for v in r[1]]) for r in rows]
    dim = max((len(u) for u in units if u is not None), default=1)
    x = np.array([np.zeros(dim) if u is None else np.pad(u, (0, dim - len(u))) for u in units])
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    up = {r[0]: r[0] for r in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in np.argwhere(near):
        low, high = sorted((root(rows[a][0]), root(rows[b][0])))
        up[high] = low
    return sorted([(r[0], int(n), r[0] and root(r[0]), None if r[0] is None else root(r[0]) == r[0]) for r, n in zip(rows, near.sum(axis=1))], key=repr)


def planted(n, seed):
    """Vectors of unlike clusters, with close copies; one cluster holds a third."""
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n // 6, 32))
    picks = np.where(draw.random(n) < 0.33, 0, draw.integers(0, len(base), n))
    x = base[picks] + draw.normal(scale=0.12, size=(n, 32))
    return [(10 + i, v.tolist(), 1, "clash", 1, "clash") for i, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("how", [forest.Forest(leaf=40, least_sampled=6, block=16), forest.Forest()])
def test_recall_and_precision(spark, how):
    rows = planted(900, 4)
    got = {r[0]: tuple(r) for r in forest.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), how).collect()}
    wanted = {r[0]: r for r in brute(rows)}
    assert got.keys() == wanted.keys()
    assert all(got[i][1] <= wanted[i][1] for i in wanted)  # no link is counted twice or made up
    assert sum(r[1] for r in got.values()) >= 0.95 * sum(r[1] for r in wanted.values())
    assert np.mean([got[i] == wanted[i] for i in wanted]) >= 0.9


def test_dense_group_at_the_smallest_leaves():
    """A third of the vectors close around one direction, median cosine 0.92: its linked pairs share a leaf of some tree."""
    how, draw = forest.Forest(), np.random.default_rng(3)
    centre = draw.normal(size=64)
    group = centre / np.linalg.norm(centre) + draw.normal(scale=np.sqrt((1 / 0.92 - 1) / 64), size=(1200, 64))
    x = np.vstack([group, draw.normal(size=(2400, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x[:1200] @ x[:1200].T >= how.cosine
    np.fill_diagonal(linked, False)
    met = np.zeros_like(linked)
    for _ in range(how.trees):
        for _, rows in forest.Tree(x, 2 * how.least_sampled, how, draw).place(x):
            inside = rows[rows < 1200]
            met[np.ix_(inside, inside)] = True
    assert linked.sum() > 1000
    assert (linked & met).sum() >= 0.99 * linked.sum()


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v, 0, "", 0, ""), (3, [2.0, 4.0, 6.0], 0, "", 0, ""), (4, v, 0, "", 0, ""), (4, v, 0, "", 0, ""), (6, None, 0, "", 0, ""), (7, [0.0] * 3, 0, "", 0, ""),
            (8, [1.0, None, 3.0], 0, "", 0, ""), (9, [float("nan"), 1.0, 1.0], 0, "", 0, ""), (10, [float("inf"), 1.0, 1.0], 0, "", 0, ""), (11, [], 0, "", 0, ""),
            (None, v, 0, "", 0, ""), (12, [1.0, 2.0], 0, "", 0, ""), (12, [-5.0, 0.0, 1.0], 0, "", 0, ""), (13, [1.0, 2.0, 0.0], 0, "", 0, ""), (14, [3e38, -3e38, 3e38], 0, "", 0, ""), (2, [3e38, -3e38, 3e38], 0, "", 0, "")]
    got = forest.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty_table(spark):
    assert forest.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("dim", [32, 48])
def test_links_that_no_leaf_holds(spark, dim):
    """Without spill the trees part many linked pairs; none of them is lost, and none counts twice."""
    draw = np.random.default_rng(dim)
    base = draw.normal(size=(120, dim))
    x = (base[draw.integers(0, len(base), 700)] + draw.normal(scale=0.2, size=(700, dim))).astype(np.float32)
    rows = [(10 + i, v.tolist(), 1, "", 1, "") for i, v in enumerate(x)] + [(9000, x[5].tolist(), 1, "", 1, ""), (3, x[6].tolist(), 1, "", 1, "")]
    how = forest.Forest(leaf=40, least_sampled=6, block=16, spill=0.0, check_blocks=3)
    got = forest.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), how).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_chain_whose_middle_is_not_the_least(spark):
    """10 and 11 have a smaller neighbour each, and are linked with each other: one component, in a leaf as between blocks."""
    at = {1: 0.0, 10: 0.3, 11: 0.6, 2: 0.9, 40: 2.0, 41: 2.3, 42: 2.6, 43: 2.3 + 2**-10}
    rows = [(k, [float(np.cos(a)), float(np.sin(a))], 0, "", 0, "") for k, a in at.items()]
    for how in (forest.Forest(), forest.Forest(block=3)):
        got = {r[0]: tuple(r)[:3] for r in forest.near_duplicates(spark.createDataFrame(rows, SCHEMA), how).collect()}
        assert got == {1: (1, 1, 1), 10: (10, 2, 1), 11: (11, 2, 1), 2: (2, 1, 1), 40: (40, 2, 40), 41: (41, 3, 40), 42: (42, 2, 40), 43: (43, 3, 40)}
