"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("historymine")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors of different machines would not see each other's files.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="historymine-"))
        shared = context.getCheckpointDir()
    return shared.rstrip("/")


_RUN: ContextVar[str] = ContextVar("run", default="")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared scratch folder, inside the folder of the current run if there is one."""
    return f"{scratch_root(spark)}/historymine/{_RUN.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[None]:
    """Own the intermediate tables made inside the block and delete them at its end.

    Write or collect results inside the block: DataFrames that read such a table
    cannot be computed afterwards.
    """
    run = f"run-{uuid.uuid4().hex}/"
    token = _RUN.set(run)
    try:
        yield
    finally:
        _RUN.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/historymine/{run}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Later readers get column pruning and true sizes, and a lost executor costs
    a re-read of the table instead of a re-run of everything before it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
