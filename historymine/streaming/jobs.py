"""Incremental runs: new reports, running tallies and first-seen contents as streams.

Keys seen so far are in Spark's state store. With the RocksDB provider
(``spark.sql.streaming.stateStore.providerClass``) the state is on disk and grows with the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from historymine.functions.skew import pick_rows
from historymine.operators.scan import rule_scan
from historymine.session import materialize
from historymine.sources.rules import Rule


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived since the last run with this checkpoint, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _own_folder(batch: DataFrame, batch_id: int) -> str:
    """A folder for this batch of this streaming query: a replay finds it again, another checkpoint never does."""
    return f"stream={batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}/batch_id={batch_id}"


def _of_other_queries(spark: SparkSession, table: str, schema: T.StructType, own: str) -> DataFrame:
    """Rows that other streaming queries have written to the table."""
    stored = T.StructType([*schema.fields, T.StructField("stream", T.StringType())])
    try:
        rows = spark.read.schema(stored).parquet(table)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stored)
    return rows.where(F.col("stream") != own.split("/")[0].removeprefix("stream="))


def first_arrivals(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the least row of the batch that first brought it, in update mode; ``_at`` and ``_last`` tell that batch from the current one.

    The state store keeps one row per key, so a batch costs what it brings,
    however much came before. Rows of a key are folded before they are shuffled.
    A batch that is run again has the same time, which Spark stores with its offsets.
    """
    others = [c for c in stream.columns if c not in keys]
    timed = stream.withColumn("_at", F.current_timestamp())  # one value per batch
    kept = timed.groupBy(*keys).agg(F.min(F.struct("_at", *others)).alias("_row"), F.max("_at").alias("_last"))
    return kept.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others], F.col("_row._at").alias("_at"), "_last")


def _append_first(table: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Batch writer that adds the keys a batch of ``first_arrivals`` brought for the first time.

    What this query has written before is in its state and is not read again; what
    other queries have added to the table is read for the keys of the batch. A batch
    owns a folder by its query and number: a replay after a failure writes it again.
    One query at a time may write a table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        own = _own_folder(batch, batch_id)
        new = materialize(batch.where(F.col("_at") == F.col("_last")).drop("_at", "_last"), "batch")
        seen = pick_rows(_of_other_queries(batch.sparkSession, table, new.schema, own).select(*keys), new, keys)
        new.join(seen, list(keys), "left_anti").write.mode("overwrite").parquet(f"{table}/{own}")

    return write


def ingest_reports(stream: DataFrame, table: str, checkpoint: str, key: str = "commit") -> None:
    """Append reports that are new to ``table``, each commit exactly once.

    The first batch that brings a commit wins; inside a batch its least row does.
    """
    run_available(first_arrivals(stream, [key]), _append_first(table, [key]), checkpoint, mode="update")


def dedup_contents(stream: DataFrame, table: str, checkpoint: str, keys: Sequence[str] = ("hash", "ruleset_id")) -> None:
    """Append the contents no earlier batch has seen; these are the ones to analyze."""
    run_available(first_arrivals(stream, keys), _append_first(table, keys), checkpoint, mode="update")


def running_tally(
    files: DataFrame, rules: Iterable[Rule], table: str, checkpoint: str, keys: Sequence[str] = ("hash",)
) -> None:
    """Findings per rule over everything streamed so far, rewritten after every batch.

    The state has one row per rule. Files are scanned where they are read, and
    counts are combined before the shuffle.
    """
    counts = rule_scan(files, rules, keys).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{table}/{_own_folder(batch, batch_id)}"
        batch.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(path)

    run_available(counts, write, checkpoint, mode="complete")


def latest_tally(spark: SparkSession, table: str) -> DataFrame:
    """The tally of the query that began last, as of its last batch.

    A query begins with its first batch; when a later one was written does not
    matter, so an old batch that is run again replaces nothing.
    """
    versions = spark.read.parquet(table)
    begun = versions.groupBy("stream").agg(F.min(F.struct("batch_id", "written_at")).alias("_first"), F.max("batch_id").alias("batch_id"))
    last = begun.agg(F.max_by(F.struct("stream", "batch_id"), F.struct("_first.written_at", "stream")).alias("_q")).select("_q.*")
    return versions.join(F.broadcast(last), ["stream", "batch_id"], "left_semi").select("rule", "n")
