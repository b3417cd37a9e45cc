"""Mixing sources to target weights in integer quotas of equal-token blocks.

Targets are shares by weight, held below a multiple of what a source has.
Words are apportioned to sources by Sainte-Lague: the highest quotients
target / 1, target / 3, target / 5, ... win a word each. The whole blocks among a
source's words are apportioned to its shards in the same way; what is left, and
blocks that no shard can hold, go to shards as words. Inside a shard documents lie end
to end in a seeded order, cut into blocks of equal words; the first blocks of
that order are taken, and the order starts again when it is used up.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from historymine.functions.ordinals import number_rows
from historymine.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
CANDIDATES = 32
OWN = ("size", "source", "source_size", "target", "taken")


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in order; together they get ``share`` of all words, each at most ``repeats`` times its own.

    ``blocks`` sets the size of a block, the words of the mix over ``blocks``; a source has a shard for each
    ``docs_per_shard`` documents.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    repeats: int = 2
    blocks: int = 2_000_000
    docs_per_shard: int = 2_000
    seed: int = 7


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, how: Mix) -> DataFrame:
    """``(source, place, source_size, docs, target)`` from ``(source, source_size, docs)``.

    The level of all sources below their limit rises until the shares add up;
    each round fixes the sources that the level passes, as sharing an excess again and again does.
    """
    lasting = sources.withColumn("_null", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit("")))
    placed = number_rows(lasting, ["_null", "_name"], "place")
    weight = F.element_at(F.array(*map(F.lit, how.weights)), (F.col("place") % len(how.weights) + 1).cast("int")).cast("double")
    placed = stored(placed.select("source", F.col("place").cast("int").alias("place"), "source_size", "docs", weight.alias("weight")), "mix-sources")
    whole = how.share * (placed.agg(F.sum("source_size")).first()[0] or 0)
    limit = how.repeats * F.col("source_size").cast("double")
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > limit
        now = placed.agg(
            F.sum(F.when(above, 1).otherwise(0)).alias("full"), F.sum(F.when(above, limit).otherwise(0.0)).alias("held"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open")
        ).first()
        if now["full"] == full or not now["open"]:
            break
        full, level = now["full"], (whole - now["held"]) / now["open"]
    return placed.select("source", "place", "source_size", "docs", F.least(F.col("weight") * F.lit(level), limit).alias("target"))


def _won(votes: str, divisor: float) -> Column:
    """Quotients of a source above ``divisor``: votes / (2 k + 1) > divisor."""
    return F.greatest(F.ceil((F.col(votes) / F.lit(divisor) - 1) / 2), F.lit(0))


def dealt_words(size: np.ndarray, words: int, block: int, repeats: int) -> np.ndarray:
    """``words`` over shards in blocks, the rest in parts of a block by the highest quotients; a shard gets at most ``repeats`` times its size."""
    won = apportion(size.astype(float), words // block, repeats * size // block)
    got = won * block
    order = np.argsort(-size / (2 * won + 1), kind="stable")
    room = (repeats * size - got)[order]
    left = max(0, words - int(got.sum()))
    got[order] += np.clip(left - (np.cumsum(room) - room), 0, room)
    return got


def source_quotas(sources: DataFrame, n_blocks: int) -> DataFrame:
    """Adds ``quota``: ``n_blocks`` blocks by highest quotients of ``target``, ties by ``place``.

    The last quotient that wins is found by trying divisors, many in one pass over
    the sources; those at the very last quotient are taken in order.
    """
    low, high = 0.0, float(sources.agg(F.max("target")).first()[0] or 0)
    if not n_blocks or not high:
        return sources.withColumn("quota", F.lit(0).cast("bigint"))
    while True:  # too many blocks are won above low, few enough above high
        tried = np.linspace(low, high, CANDIDATES + 2)[1:-1].tolist()
        won = sources.agg(*[F.sum(_won("target", d)) for d in tried]).first()
        few = [d for d, n in zip(tried, won) if n <= n_blocks]
        many = [d for d, n in zip(tried, won) if n > n_blocks]
        exact = [d for d, n in zip(tried, won) if n == n_blocks]
        if exact:
            return sources.withColumn("quota", _won("target", exact[0]).cast("bigint"))
        before, (low, high) = (low, high), (max(many, default=low), min(few, default=high))
        if (low, high) == before or high - low <= 1e-12 * high:
            break
    sure = sources.withColumn("quota", _won("target", high).cast("bigint"))
    left = n_blocks - (sure.agg(F.sum("quota")).first()[0] or 0)
    tied = number_rows(sure.where(_won("target", low) > F.col("quota")).select("place"), ["place"], "nth").where(F.col("nth") < left)
    return sure.join(tied, "place", "left").withColumn("quota", F.col("quota") + F.col("nth").isNotNull().cast("bigint")).drop("nth")


def apportion(votes: np.ndarray, seats: int, limits: np.ndarray) -> np.ndarray:
    """Sainte-Lague with limits, ties by position: most seats at once, the last ones by a heap of quotients."""
    won = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0 or not votes.sum():
        return won
    # Below this divisor's seats nobody can win more; start a little lower than the exact shares.
    won = np.minimum(np.maximum(np.floor(votes * (seats / votes.sum()) - 0.5).astype(np.int64), 0), limits)
    heap = [(-v / (2 * w + 1), i) for i, (v, w) in enumerate(zip(votes.tolist(), won.tolist())) if w < limits[i] and v > 0]
    heapq.heapify(heap)
    left = seats - int(won.sum())
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        won[i] += 1
        left -= 1
        if won[i] < limits[i]:
            heapq.heappush(heap, (-votes[i] / (2 * int(won[i]) + 1), i))
    return won


def mix(docs: DataFrame, how: Mix = Mix(), carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` columns and ``(size, source, source_size, target, taken)`` per row of ``docs``.

    ``size`` counts words, ``taken`` the words that the mix takes, repeats counted.
    A null text has no words; a null source is the last source. A row without
    id is ordered by its size. Repeated rows are documents of their own, taken
    each for itself. Without any words all targets are 0, and an empty table
    gives an empty result. Columns that are not carried are ignored, carried ones
    that are named like a result column give way to it.
    """
    rows = docs.select(F.struct(*carried).alias("row"), F.col("doc_id").cast("bigint").alias("id"), "source", n_words(F.col("text")).alias("size"))
    sized = stored(rows, "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sources = stored(targets(sources, how), "mix-targets")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, int(how.share * words / how.blocks))
    sources = source_quotas(sources, round(min(how.share, how.repeats) * words))
    shards = F.ceil(F.col("docs") / how.docs_per_shard).cast("int")
    sources = stored(sources.select(F.col("source").alias("of"), "place", "source_size", "target", "quota", shards.alias("shards")), "mix-quotas")

    placed = sized.join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn("shard", F.pmod(F.xxhash64(F.lit(how.seed), "id", "size"), "shards").cast("int"))
    cells = placed.groupBy("place", "shard").agg(F.sum("size").alias("cell_size"), F.first("quota").alias("quota"))

    def spread(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        words = dealt_words(group["cell_size"].to_numpy(), int(group["quota"].iloc[0]), block, how.repeats)
        return group.assign(words=words).drop(columns="quota")

    dealt = stored(cells.groupBy("place").applyInPandas(spread, "place int, shard int, cell_size bigint, words bigint"), "mix-cells")

    seeded = Window.partitionBy("place", "shard").orderBy(F.xxhash64(F.lit(how.seed + 1), "id", "size"), "id", "size")
    start = F.sum("size").over(seeded.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    laid = placed.join(dealt, ["place", "shard"]).withColumn("start", start)
    rounds = F.expr("coalesce(words div nullif(cell_size, 0), 0)")
    rest = F.col("words") - rounds * F.col("cell_size")
    part = F.greatest(F.least(F.col("start") + F.col("size"), rest) - F.col("start"), F.lit(0))
    others = [F.col("row")[c].alias(c) for c in carried if c not in OWN]
    return laid.select(*others, "size", "source", "source_size", "target", (rounds * F.col("size") + part).cast("bigint").alias("taken"))
