"""What several operators need: row-wise Arrow maps, bounded samples, words, components of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from historymine.session import materialize

ROWS_AT_ONCE = 128
FLUSH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared scratch folder and read back."""
    return materialize(df, name)


def map_rows(df: DataFrame, make: Callable[[], Callable[[tuple], Iterator[tuple]]], schema: str) -> DataFrame:
    """Run a generator over the rows of ``df``, on Arrow batches.

    ``make`` builds the row function once per task. Only a few rows are Python
    objects at a time and output leaves in small batches, so a task's memory
    does not depend on how many long texts an Arrow batch holds. If the row
    function has an attribute ``finish``, that is called after the last row, if
    ``prepare``, that is called with each list of rows before they are mapped.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of = make()
        rows: list[tuple] = []
        weight = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                taken = list(zip(*[c.to_pylist() for c in part.columns]))
                getattr(row_of, "prepare", len)(taken)
                for row in taken:
                    for made in row_of(row):
                        rows.append(made)
                        weight += 64 + sum(len(v) for v in made if isinstance(v, (str, bytes, list)))
                        if weight >= FLUSH_BYTES:
                            yield flush()
                            rows, weight = [], 0
        rows += getattr(row_of, "finish", tuple)()
        if rows:
            yield flush()

    return df.mapInArrow(run, schema)


def hash_share(key: Column, wanted: int, of: int) -> Column:
    """Pick about ``wanted`` of ``of`` rows by a hash of ``key``: the same rows in every run."""
    if of <= wanted:
        return F.lit(True)
    scale = 1 << 30
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(scale)) < int(scale * (wanted / of))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once; Spark shares no subexpressions inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


CHUNK = 256  # values that one fold appends before it starts a new array


def chunked(values: Column) -> Column:
    """An array cut into arrays of at most ``CHUNK`` values."""
    starts = lambda v: F.filter(F.sequence(F.lit(1), F.size(v) + 1, F.lit(CHUNK)), lambda at: at <= F.size(v))
    return bound(values, lambda v: F.transform(starts(v), lambda at: F.slice(v, at, F.lit(CHUNK))))


def running(values: Column, seed: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What a fold puts out at each value, as an array of ``kind`` without nulls: ``step(state, value)`` gives the next state and the output.

    An array that grows by one value is copied whole each time, so outputs are
    gathered in chunks, and the time stays in proportion to the values.
    """
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, value: Column) -> Column:
        state, out = step(acc["state"], value)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(out.cast(kind))).alias("out"))

    def some(acc: Column, chunk: Column) -> Column:
        after = F.aggregate(chunk, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return bound(after, lambda a: F.struct(a["state"].alias("state"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

    return F.aggregate(chunked(values), F.struct(seed.alias("state"), nothing.alias("out")), some, lambda acc: F.array_compact(F.flatten(acc["out"])))


def crc_mod5(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def components(links: DataFrame, name: str) -> DataFrame:
    """``(id, component)`` for every id in ``links (a, b)``: the smallest id reachable.

    Labels only sink: each round takes the least label among the neighbours of
    an id, then the label of that label (which halves long chains). Rounds are
    stored tables and minima combine before they shuffle, so a hub of any
    degree costs one row per task. It ends when a round changes nothing.
    """
    both = stored(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        f"{name}-links",
    )
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), f"{name}-labels")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        sunk = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("near", "component").alias("component"))
        target = labels.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        after = stored(
            sunk.join(target, "component", "left").select(
                "id", "was", F.least("component", F.coalesce("beyond", "component")).alias("component")
            ),
            f"{name}-labels",
        )
        labels = after.select("id", "component")
        if after.where("was <> component").isEmpty():
            return labels
