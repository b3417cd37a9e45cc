"""Row numbers and running totals without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from historymine.session import materialize

_SLOT_BITS = 33  # monotonically_increasing_id: partition above, row in partition below
BLOCKS_PER_RANGE = 10_000


def number_rows(
    df: DataFrame, order_by: Sequence[str], name: str, within: Sequence[str] = (), start: int = 0
) -> DataFrame:
    """Number rows from ``start`` in ``order_by`` order, per ``within`` group if given.

    ``order_by`` has to be a total order inside a group. The rows are range
    partitioned and sorted, so a group of any size spreads over as many
    partitions as it needs; what a group has in earlier partitions is added from
    a table with at most one row per partition, which is safe to broadcast.
    The placement is written out once because a second evaluation could draw
    other range bounds.
    """
    keys = [*within, *order_by]
    placed = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()),
        "ordinals",
    ).select("*", F.shiftright("_at", _SLOT_BITS).alias("_slot"))

    in_slot = placed.groupBy("_slot", *within).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        in_slot.withColumn("_carry", F.sum("_n").over(earlier)).where(F.col("_carry") > 0).select("_slot", *within, "_carry")
    )
    if within:
        local = F.row_number().over(Window.partitionBy("_slot", *within).orderBy("_at")) - 1
    else:
        local = F.col("_at").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return (
        placed.withColumn("_local", local.cast("bigint"))
        .join(F.broadcast(carried), ["_slot", *within], "left")
        .withColumn(name, F.col("_local") + F.coalesce("_carry", F.lit(0)) + F.lit(start))
        .drop("_at", "_slot", "_local", "_carry")
    )


def running_totals(blocks: DataFrame, block: str, values: Sequence[str]) -> DataFrame:
    """Replace ``values`` by their running totals in the order of the dense integer ``block``.

    Two levels: totals inside ranges of BLOCKS_PER_RANGE blocks, plus what all
    earlier ranges hold. The single-task window sees one row per range.
    """
    ranged = blocks.withColumn("_range", F.expr(f"`{block}` div {BLOCKS_PER_RANGE}"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranged.groupBy("_range")
        .agg(*[F.sum(v).alias(v) for v in values])
        .select("_range", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_base_{v}") for v in values])
    )
    inside = Window.partitionBy("_range").orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    others = [c for c in blocks.columns if c not in values]
    return (
        ranged.select(*others, "_range", *[F.sum(v).over(inside).alias(v) for v in values])
        .join(bases, "_range")
        .select(*others, *[(F.col(v) + F.col(f"_base_{v}")).alias(v) for v in values])
    )
