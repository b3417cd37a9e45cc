"""Exact top-k by inner product through a pivot-distance index.

Vectors get one more component that makes all of them equally long, so a larger
inner product is a smaller distance. Each vector is keyed by its nearest pivot
and by its distance from it; a pivot's vectors, sorted by distance, are cut into
annuli. A query first searches the annuli nearest to it, which bounds the
distance of its k-th neighbour, and then only those annuli that the triangle
inequality leaves: a vector at distance d from a pivot is at least
|d - distance(query, pivot)| away. Pivots come from a bounded sample; every
vector is indexed, and the result is exact whatever the pivots are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from historymine.llm.common import hash_share, map_rows, stored
from historymine.llm.forest import padded

SLACK = 1e-9  # relative; distances are doubles, scores are integers


@dataclass(frozen=True)
class PivotIndex:
    """``pivots`` from a sample of about ``sample`` vectors; each has ``rings`` annuli; a unit of search holds about ``block`` vectors and ``query_block`` queries."""

    pivots: int = 48
    rings: int = 16
    sample: int = 10_000
    block: int = 2_048
    query_block: int = 1_024
    scale: int = 256
    seed: int = 5


def usable(column: str) -> Column:
    plain = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(F.col(column).isNotNull() & plain, F.lit(False))


def _scores(queries: list[list[int]], vectors: list[list[int]]) -> list[list[int]] | np.ndarray:
    """Integer inner products: in doubles while those are exact, else in Python integers."""
    most = max((abs(v) for rows in (queries, vectors) for row in rows for v in row), default=0)
    dim = max(max(map(len, queries)), max(map(len, vectors)), 1)
    if most * most * dim < 1 << 53:
        return (padded([np.array(q, dtype=float) for q in queries], dim) @ padded([np.array(v, dtype=float) for v in vectors], dim).T).astype(np.int64)
    return np.array([[sum(a * b for a, b in zip(q, v)) for v in vectors] for q in queries], dtype=object)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> list[int]:
    """Places of the k highest scores, ties to the smaller id."""
    if scores.dtype == object:
        return sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= cut)
    else:
        places = np.arange(len(ids))
    return places[np.lexsort((ids[places], -scores[places]))][:k].tolist()


class Pivots:
    """Pivots in the space with the additional component, spread by farthest-first choice over the sample."""

    def __init__(self, sample: np.ndarray, longest: float, how: PivotIndex):
        self.longest_squared = longest
        x = self.raised(sample)
        chosen, far, at = [], np.full(len(x), np.inf), 0
        for _ in range(min(how.pivots, len(x))):
            chosen.append(x[at])
            far = np.minimum(far, np.linalg.norm(x - x[at], axis=1))
            at = int(far.argmax())
            if not far[at]:
                break
        self.points = np.array(chosen) if chosen else np.zeros((1, x.shape[1]))
        reach = np.array([self.distances(row) for row in x]).reshape(len(x), len(self.points))
        cell, steps = reach.argmin(axis=1), np.linspace(0, 1, how.rings + 1)[1:-1]
        self.bounds = [np.quantile(reach[cell == p, p], steps) if (cell == p).any() else np.zeros(len(steps)) for p in range(len(self.points))]

    def raised(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors with the component that makes them equally long; queries have none of it."""
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.longest_squared - (x * x).sum(axis=1)))
        return np.hstack([x, last[:, None]])

    def distances(self, raised: np.ndarray) -> np.ndarray:
        return np.linalg.norm(self.points - raised, axis=1)


def _search(pairs: DataFrame, index: DataFrame, k: int, how: PivotIndex) -> DataFrame:
    """``(query_id, vec_id, score)``: the ``k`` best of each unit for each of its queries.

    ``pairs`` has ``(annulus, id, v)``, a query for an annulus. Annuli are cut into
    blocks of vectors and of queries, which meet pair by pair.
    """
    wanted = pairs.groupBy("annulus").agg(F.ceil(F.count(F.lit(1)) / how.query_block).cast("int").alias("query_blocks"))
    held = index.groupBy("annulus").agg(F.ceil(F.count(F.lit(1)) / how.block).cast("int").alias("blocks"))
    plan = F.broadcast(wanted.join(held, "annulus"))  # at most pivots * rings rows

    def side(rows: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        placed = rows.join(plan, "annulus").withColumn("own", F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        i, j = ("own", "other") if kind else ("other", "own")
        return placed.select("annulus", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(kind).alias("kind"), "id", "v")

    both = side(pairs, "query_blocks", "blocks", 0).unionByName(side(index.select("annulus", "id", "v"), "blocks", "query_blocks", 1))

    def make():
        unit: list[tuple] = []

        def best() -> Iterator[tuple]:
            queries, vectors = [r for r in unit if not r[3]], [r for r in unit if r[3]]
            if not queries or not vectors:
                return
            ids = np.array([r[4] for r in vectors])
            for query, row in zip(queries, _scores([r[5] for r in queries], [r[5] for r in vectors])):
                other = np.flatnonzero(ids != query[4])
                for at in _best(ids[other], row[other], k):
                    score = int(row[other[at]])
                    yield query[4], int(ids[other[at]]), max(-(1 << 63), min((1 << 63) - 1, score))

        def one(row) -> Iterator[tuple]:
            if unit and row[:3] != unit[0][:3]:
                yield from best()
                unit.clear()
            unit.append(row)

        one.finish = lambda: list(best()) if unit else []
        return one

    ordered = both.repartition("annulus", "i", "j").sortWithinPartitions("annulus", "i", "j", "kind", "id")
    return map_rows(ordered, make, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, how: PivotIndex = PivotIndex()) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` highest scores of each query, ties to the smaller id.

    Components become ``floor(scale * x)``, held within 62 bits; a score is the integer inner
    product, held within 64 bits. Queries are the ids that ``every`` divides, candidates all
    other ids. Vectors that are null or hold null or non-finite components take no part, nor
    do rows without id. Rows that share an id count once, with the smallest of
    their vectors; shorter vectors end in zeros. With fewer than ``k`` candidates all are
    returned; an empty table gives an empty result. Other columns are ignored.
    """
    within = float(1 << 62)
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(how.scale * x.cast("double"), F.lit(within)), F.lit(-within))).cast("bigint"))
    rows = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("bigint").alias("id"), whole.alias("v"))
    rows = stored(rows.groupBy("id").agg(F.min("v").alias("v")), "topk-vectors")
    squared = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(squared).alias("longest")).first()
    dim = shape["dim"] or 0
    picked = rows.where(hash_share(F.col("id"), how.sample, shape["n"])).toPandas().sort_values("id")
    pivots = Pivots(padded([np.array(v, dtype=float) for v in picked["v"]], dim) if len(picked) else np.zeros((0, dim)), shape["longest"] or 0.0, how)

    def place():
        def one(row) -> Iterator[tuple]:
            reach = pivots.distances(pivots.raised(padded([np.array(row[1], dtype=float)], dim))[0])
            cell = int(reach.argmin())
            yield *row, cell * how.rings + int(np.searchsorted(pivots.bounds[cell], reach[cell])), float(reach[cell])

        return one

    index = stored(map_rows(rows, place, "id bigint, v array<bigint>, annulus int, reach double"), "topk-index")
    annuli = index.groupBy("annulus").agg(F.min("reach").alias("low"), F.max("reach").alias("high"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("annulus")
    ring, low, high, held = (annuli[c].to_numpy() for c in ("annulus", "low", "high", "n"))

    def bounds(v: list[int]) -> tuple[np.ndarray, float]:
        """The least distance from a query to each annulus, and what all its squared distances are counted from."""
        query = pivots.raised(padded([np.array(v, dtype=float)], dim), query=True)[0]
        reach = pivots.distances(query)[ring // how.rings]
        return np.maximum(0.0, np.maximum(low - reach, reach - high)), float(query @ query) + pivots.longest_squared

    def nearest(least: np.ndarray) -> np.ndarray:
        order = np.argsort(least, kind="stable")
        return order[: int(np.searchsorted(np.cumsum(held[order]), k + 1)) + 1]

    def first():
        def one(row) -> Iterator[tuple]:
            for at in nearest(bounds(row[1])[0]):
                yield int(ring[at]), *row

        return one

    def rest():
        def one(row) -> Iterator[tuple]:
            least, base = bounds(row[1])
            done = set(nearest(least).tolist())
            reach = np.inf if row[2] is None else base - 2.0 * row[2] + SLACK * base  # the squared distance of the k-th neighbour so far
            for at in np.flatnonzero(least**2 <= reach):
                if at not in done:
                    yield int(ring[at]), row[0], row[1]

        return one

    queries = index.where(F.col("id") % every == 0).select("id", "v")
    pair = "annulus int, id bigint, v array<bigint>"
    near = stored(_search(stored(map_rows(queries, first, pair), "topk-pairs"), index, k, how), "topk-near")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best_first))
    bound = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    more = stored(map_rows(queries.join(bound, "id", "left").select("id", "v", "bound"), rest, pair), "topk-pairs")
    found = near.unionByName(_search(more, index, k, how))
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
