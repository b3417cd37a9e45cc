"""Joins that hold when one key carries a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from historymine.session import materialize

# A key is sliced once it has more rows than this.
ROWS_PER_SLICE = 1_000_000
# ... and more than this share of the rows of all such keys. Fewer than 10,000 keys can
# hold that much each, so the list of sliced keys is small by counting alone.
HOT_SHARE = 1e-4


def hot_keys(facts: DataFrame, on: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The keys worth slicing and the number of slices of each, as a stored table of fewer than 10,000 rows."""
    counted = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    many = materialize(counted.where(F.col("_rows") > rows_per_slice), "hot-keys")
    share = many.agg(F.coalesce(F.sum("_rows"), F.lit(0)) * HOT_SHARE).scalar()
    return many.where(F.col("_rows") > share).select(*on, F.ceil(F.col("_rows") / rows_per_slice).cast("int").alias("_slices"))


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    rows_per_slice: int = ROWS_PER_SLICE,
    within: DataFrame | None = None,
) -> DataFrame:
    """Join ``facts`` (many rows per key) to ``lookup`` (few rows per key).

    Rows of a hot key are cut into slices by a hash of ``spread_by``, and only
    the lookup rows of that key are repeated, once per slice. The slice is a
    function of the row, so a task that is run again places it alike. ``how``
    is ``inner`` or ``left``: the slices keep both exact. The keys are counted
    in a job of their own; without a hot one the result is a plain join. ``within``, a
    stored table with no fewer rows than ``facts``, spares that job where the whole of
    it is no more than a slice, for then no key can be hot; its rows are counted from file footers.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"spread_join does not support how={how!r}")
    if within is not None and within.count() <= rows_per_slice:
        return facts.join(lookup, list(on), how)
    hot = hot_keys(facts, on, rows_per_slice)
    if hot.isEmpty():
        return facts.join(lookup, list(on), how)
    hot = F.broadcast(hot)
    slices = F.coalesce("_slices", F.lit(1))
    sliced = facts.join(hot, list(on), "left").withColumn(
        "_slice", F.pmod(F.xxhash64(*spread_by), slices).cast("int")
    )
    repeated = lookup.join(hot, list(on), "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), slices - 1))
    )
    joined = sliced.drop("_slices").join(repeated.drop("_slices"), [*on, "_slice"], how)
    return joined.drop("_slice")


def pick_rows(rows: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keep the ``rows`` whose key is in ``wanted``, a stored table with one row per key.

    Spark knows the bytes of a stored table: a list below its broadcast threshold
    filters wide rows where they are read, a longer one is joined by shuffle, evenly
    since its keys are unique. For lists of many megabytes raise
    ``spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold``, so that a
    Bloom filter of the list spares most rows the shuffle.
    """
    return rows.join(wanted.select(*on), list(on), "left_semi")
