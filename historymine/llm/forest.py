"""Near-duplicate vectors through a forest of random-projection trees.

Trees are fitted on a bounded sample: a node draws random directions and splits
near the median where few vectors lie; vectors within a margin of the split go to
both sides (spill). Every vector then falls into one or more leaves of every tree,
and the vectors of a leaf are compared with each other. A pair that shares several
leaves counts in the first of them only, so pairs are never listed: a leaf gives,
for each vector, the number of its links and the smallest id that these links reach inside the leaf.

A linked pair may miss all common leaves, since its vectors may lie further apart along a
direction than the margin. A check of all pairs of blocks follows, which counts the linked
pairs that share no leaf; a few rotated components rule out nearly all others. With it the
result is exact. Its work is quadratic in the vectors, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from historymine.llm.common import components, hash_share, map_rows, stored


CHECK_ROWS = 2_048  # of a tile in the check of all pairs
CHECK_DIM = 16  # rotated components that rule out most pairs


@dataclass(frozen=True)
class Forest:
    """``trees`` are fitted on about ``sample`` vectors, down to about ``leaf`` vectors of all data or ``least_sampled`` of the sample.

    A split tries ``directions``; ``spill`` is the margin in units of the largest
    possible difference of two linked unit vectors along a direction: their
    distance over the square root of the dimension. Leaves are compared by ``block``
    vectors; the check of all pairs makes ``check_blocks`` blocks, or more, so that none holds much more than ``check_block``.
    """

    cosine: float = 0.95
    trees: int = 4
    sample: int = 20_000
    leaf: int = 1_000
    least_sampled: int = 24
    directions: int = 12
    spill: float = 0.75
    block: int = 2_048
    check_blocks: int = 16
    check_block: int = 32_768
    seed: int = 11


class Tree:
    """Inner nodes as arrays; ``low`` and ``high`` are the next node, or a leaf as ``-1 - leaf``."""

    def __init__(self, sample: np.ndarray, least: float, how: Forest, draw: np.random.Generator):
        self.directions: list[np.ndarray] = []
        self.at: list[float] = []
        self.next: list[list[int]] = []
        self.leaves = 0
        dim = sample.shape[1]
        self.margin = how.spill * np.sqrt(max(0.0, 2 - 2 * how.cosine) / dim)
        self._grow(sample, max(least, 2 * how.least_sampled), how, draw)

    def _grow(self, rows: np.ndarray, least: float, how: Forest, draw: np.random.Generator) -> int:
        if len(rows) <= least:
            self.leaves += 1
            return -self.leaves
        tried = draw.normal(size=(how.directions, rows.shape[1]))
        tried /= np.linalg.norm(tried, axis=1, keepdims=True)
        best = None
        for direction, seen in zip(tried, (rows @ tried.T).T):
            for cut in np.quantile(seen, (0.4, 0.5, 0.6)):
                both = np.count_nonzero(np.abs(seen - cut) <= self.margin)
                if best is None or both < best[0]:
                    best = both, direction, float(cut), seen
        both, direction, cut, seen = best
        if both > 0.5 * len(rows):  # nothing parts these vectors; more copies would not help
            self.leaves += 1
            return -self.leaves
        me = len(self.at)
        self.directions.append(direction)
        self.at.append(cut)
        self.next.append([0, 0])
        self.next[me][0] = self._grow(rows[seen <= cut + self.margin], least, how, draw)
        self.next[me][1] = self._grow(rows[seen >= cut - self.margin], least, how, draw)
        return me

    def place(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(leaf, rows of x)``; a row may be in several leaves."""
        todo = [(0 if self.at else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                yield -1 - node, rows
                continue
            seen = x[rows] @ self.directions[node]
            for side, inside in zip(self.next[node], (seen <= self.at[node] + self.margin, seen >= self.at[node] - self.margin)):
                if inside.any():
                    todo.append((side, rows[inside]))


def unit(values: list | None) -> np.ndarray | None:
    """The vector at length 1 in double precision; none if it is null, zero or holds null or non-finite components."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, dtype=np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x /= np.abs(x).max()  # so that squares neither overflow nor vanish
    return x / np.sqrt(x @ x)


def usable(embedding: Column) -> Column:
    """Whether ``unit`` gives a vector."""
    plain = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & plain & F.exists(embedding, lambda v: v != 0), F.lit(False))


def padded(vectors: list[np.ndarray], dim: int | None = None) -> np.ndarray:
    """One matrix; shorter vectors end in zeros."""
    dim = dim or max(map(len, vectors))
    out = np.zeros((len(vectors), dim))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def fit(vectors: DataFrame, n_vectors: int, how: Forest) -> list[Tree]:
    """Fit on a sample chosen by a hash of the class; at most about ``how.sample`` rows come to the driver."""
    picked = vectors.where(hash_share(F.struct("h1", "h2"), how.sample, n_vectors)).select("embedding", "h1", "h2").toPandas().sort_values(["h1", "h2"])
    if picked.empty:
        return []
    sample = padded([unit(list(v)) for v in picked["embedding"]])
    draw = np.random.default_rng(how.seed)
    return [Tree(sample, how.leaf * len(sample) / n_vectors, how, draw) for _ in range(how.trees)]


def _units(raw: list[bytes]) -> np.ndarray:
    """Unit vectors from the bytes of doubles, shorter ones ending in zeros."""
    width = max(map(len, raw))
    x = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), dtype="<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _unite(up: list[int], ids: np.ndarray, near: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join in ``up``, a parent per row, the rows that ``near`` links, ``a`` down and ``b`` across; a root has the least id of its rows."""

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    back = np.ascontiguousarray(near.T)
    new_a, new_b = near.any(axis=1), near.any(axis=0)
    for start in np.flatnonzero(new_a):
        if not new_a[start]:
            continue
        new_a[start] = False
        front, joined = np.array([start]), [a[start : start + 1]]
        while len(front):
            across = np.flatnonzero(near[front].any(axis=0) & new_b)
            new_b[across] = False
            front = np.flatnonzero(back[across].any(axis=0) & new_a)
            new_a[front] = False
            joined += [b[across], a[front]]
        roots = {root(k) for k in np.concatenate(joined).tolist()}
        least = min(roots, key=lambda k: ids[k])
        for k in roots:
            up[k] = least


def _least(up: list[int], ids: np.ndarray) -> np.ndarray:
    """The least id that each row is joined with."""
    at = np.array(up)
    while (at != at[at]).any():
        at = at[at]
    return ids[at]


def _compare(unit_rows: list[tuple], cosine: float) -> Iterator[tuple]:
    """``(id, h1, h2, links, least)`` of each vector in one pair of blocks of a leaf."""
    leaf, i, j = unit_rows[0][:3]
    rows = list({(r[5], r[6]): r for r in unit_rows}.values())  # a class once
    a = [k for k, r in enumerate(rows) if r[3] == i]
    b = [k for k, r in enumerate(rows) if r[3] == j]
    if not a or not b:
        return
    x = _units([r[8] for r in rows])
    near = x[a] @ x[b].T >= cosine
    if i == j:
        np.fill_diagonal(near, False)
    if not near.any():
        return
    # Pairs that share an earlier leaf are counted there.
    earlier = sorted({n for r in rows for n in r[9] if n < leaf})
    if earlier:
        place = {n: k for k, n in enumerate(earlier)}
        inside = np.zeros((len(rows), len(earlier)), dtype=np.float32)
        for k, r in enumerate(rows):
            inside[k, [place[n] for n in r[9] if n < leaf]] = 1
        first = near & ~((inside[a] @ inside[b].T) > 0)
    else:
        first = near
    ids = np.array([r[4] for r in rows])
    copies = np.array([r[7] for r in rows])
    links = np.zeros(len(rows), dtype=np.int64)
    np.add.at(links, a, first @ copies[b])
    if i != j:
        np.add.at(links, b, first.T @ copies[a])
    up = list(range(len(rows)))
    _unite(up, ids, near, np.array(a), np.array(b))
    least = _least(up, ids)
    for k, r in enumerate(rows):
        if links[k] or least[k] != ids[k]:
            yield r[4], r[5], r[6], int(links[k]), int(least[k])


def _share_leaf(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For each of ``a`` and each of ``b`` whether their lists of leaves meet."""
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    meet = np.zeros((len(a), len(b)), dtype=bool)
    for start in range(0, len(both), CHECK_ROWS):
        part = both[start : start + CHECK_ROWS]
        sides = []
        for lists in (a, b):
            inside = np.zeros((len(lists), len(part)), dtype=np.float32)
            row, leaf = np.repeat(np.arange(len(lists)), [len(n) for n in lists]), np.concatenate(lists)
            at = np.minimum(np.searchsorted(part, leaf), len(part) - 1)
            here = part[at] == leaf
            inside[row[here], at[here]] = 1
            sides.append(inside)
        meet |= sides[0] @ sides[1].T > 0
    return meet


def _missed(rows: pa.Table, how: Forest) -> Iterator[tuple]:
    """``(id, h1, h2, links, least)`` of the linked vectors in one pair of blocks that share no leaf, tile by tile."""
    i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
    own, raw = rows["own"].to_numpy(), rows["embedding"].to_pylist()
    ids, copies, h1, h2 = (rows[c].to_numpy() for c in ("rep", "copies", "h1", "h2"))
    leaves = np.empty(len(raw), dtype=object)
    leaves[:] = [np.array(n, dtype=np.int64) for n in rows["leaves"].to_pylist()]
    x = _units(raw)
    few = x.shape[1] > 2 * CHECK_DIM
    if few:  # the distance along some orthonormal directions is at most the distance: one product gives its square
        turned = np.linalg.qr(np.random.default_rng(how.seed).normal(size=(x.shape[1], CHECK_DIM)))[0]
        y = x @ turned
        square, one = (y * y).sum(axis=1, keepdims=True), np.ones((len(y), 1))
        left, right = np.hstack([-2 * y, square, one]).astype(np.float32), np.hstack([y, one, square]).astype(np.float32)
    furthest = 2 - 2 * how.cosine + 1e-4
    links, up = np.zeros(len(raw), dtype=np.int64), list(range(len(raw)))
    tiles = [[at[k : k + CHECK_ROWS] for k in range(0, len(at), CHECK_ROWS)] for at in (np.flatnonzero(own == i), np.flatnonzero(own == j))]
    for p, a in enumerate(tiles[0]):
        for b in tiles[1][p:] if i == j else tiles[1]:
            if few:
                maybe = left[a] @ right[b].T <= furthest
                a_in, b_in = a[maybe.any(axis=1)], b[maybe.any(axis=0)]
            else:
                a_in, b_in = a, b
            if not len(a_in) or not len(b_in):
                continue
            near = x[a_in] @ x[b_in].T >= how.cosine
            if i == j:
                near &= a_in[:, None] < b_in[None, :]
            a_in, b_in, near = a_in[near.any(axis=1)], b_in[near.any(axis=0)], near[near.any(axis=1)][:, near.any(axis=0)]
            if not near.size:
                continue
            near &= ~_share_leaf(leaves[a_in].tolist(), leaves[b_in].tolist())
            links[a_in] += near @ copies[b_in]
            links[b_in] += near.T @ copies[a_in]
            _unite(up, ids, near, a_in, b_in)
    least = _least(up, ids)
    for k in np.flatnonzero(links):
        yield int(ids[k]), int(h1[k]), int(h2[k]), int(links[k]), int(least[k])


def missed_links(indexed: DataFrame, n_vectors: int, how: Forest) -> DataFrame:
    """``(rep, h1, h2, links, least)`` over the linked pairs that no leaf holds: all pairs of blocks, each in a task of its own.

    A vector is copied once per block. There are ``check_blocks`` of them until they would hold more than ``check_block`` vectors.
    """
    blocks = max(how.check_blocks, -(-n_vectors // how.check_block))
    own = F.pmod(F.xxhash64("h1", "h2"), F.lit(blocks)).cast("int")
    spread = indexed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    units = spread.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "h1", "h2", "copies", "embedding", "leaves")
    names = ["rep", "h1", "h2", "links", "least"]
    out = pa.schema([(n, pa.int64()) for n in names])

    def check(rows: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([dict(zip(names, r)) for r in _missed(rows, how)], schema=out)

    return units.groupBy("i", "j").applyInArrow(check, ", ".join(f"{n} bigint" for n in names))


def near_duplicates(vectors: DataFrame, how: Forest = Forest(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors``; other columns are ignored.

    Equal vectors are one class and enter the forest once, with their number as
    weight. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing. Shorter vectors count as ending in zeros. Every
    row counts as a vector of its own: repeated rows are linked with each other
    and come back repeated, rows that share an id share its component. A row
    without id has no links and null for component and kept. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("embedding"))
    key = ["h1", "h2"]
    keyed = rows.where(F.col("id").isNotNull() & usable(F.col("embedding"))).select("id", "embedding", F.xxhash64(F.lit(1), "embedding").alias("h1"), F.xxhash64("embedding", F.lit(2)).alias("h2"))
    classes = stored(keyed.groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "forest-classes")
    members = stored(
        keyed.join(classes, key).select("id", *key, "rep", "copies", F.when(F.col("id") == F.col("rep"), F.col("embedding")).alias("embedding")), "forest-vectors"
    )
    entering = members.where("embedding is not null")
    n_classes = classes.count()
    trees = fit(entering, n_classes, how)
    offsets = np.cumsum([0, *[t.leaves for t in trees]]).tolist()
    dim = max((len(d) for t in trees for d in t.directions), default=0)

    def place():
        placed: list[tuple[bytes, list[int]]] = []

        def prepare(rows: list[tuple]) -> None:
            """Send many vectors down the trees together."""
            raw = [np.array(r[4], dtype="<f8").tobytes() for r in rows]
            x = _units([r[: 8 * dim] if dim else r for r in raw])
            x = np.pad(x, ((0, 0), (0, max(0, dim - x.shape[1]))))
            leaves: list[list[int]] = [[] for _ in rows]
            for tree, offset in zip(trees, offsets):
                for leaf, at in tree.place(x):
                    for k in at.tolist():
                        leaves[k].append(offset + leaf)
            placed[:] = list(zip(raw, map(sorted, leaves)))[::-1]

        def one(row) -> Iterator[tuple]:
            yield *row[:4], *placed.pop()

        one.prepare = prepare
        return one

    indexed = stored(
        map_rows(entering.select("rep", *key, "copies", "embedding"), place, "rep bigint, h1 bigint, h2 bigint, copies bigint, embedding binary, leaves array<int>"), "forest-index"
    )
    # At most as many rows as the forest has leaves, which the sample bounds.
    sizes = indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / how.block).cast("int").alias("blocks"))
    copied = indexed.withColumn("leaf", F.explode("leaves")).join(F.broadcast(sizes), "leaf")
    spread = copied.withColumn("own", F.pmod(F.xxhash64(*key), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = spread.select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", *key, "copies", "embedding", "leaves")

    def compare():
        unit_rows: list[tuple] = []

        def one(row) -> Iterator[tuple]:
            if unit_rows and row[:3] != unit_rows[0][:3]:
                yield from _compare(unit_rows, how.cosine)
                unit_rows.clear()
            unit_rows.append(row)

        one.finish = lambda: list(_compare(unit_rows, how.cosine)) if unit_rows else []
        return one

    ordered = units.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
    found = stored(map_rows(ordered, compare, "rep bigint, h1 bigint, h2 bigint, links bigint, least bigint"), "forest-links")
    if trees and all(t.leaves > 1 for t in trees):  # otherwise a leaf holds all vectors
        found = found.union(stored(missed_links(indexed, n_classes, how), "forest-missed"))

    counted = found.groupBy(*key).agg(F.sum("links").alias("links"))
    repeated = members.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id")
    ties = members.join(repeated, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    label = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")).union(ties), "forest")
    linked = members.select("id", *key, "rep", "copies").join(counted, key, "left").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    linked = linked.select("id", n_links.alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where(F.col("id").isNull() | ~usable(F.col("embedding"))).select("id").join(label, "id", "left")
    alone = alone.select("id", F.lit(0).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
