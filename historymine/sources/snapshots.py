"""File trees."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from historymine.functions.scalars import content_hash


def with_hash(snapshots: DataFrame) -> DataFrame:
    """Add the content hash unless the table stores it already."""
    return snapshots if "hash" in snapshots.columns else snapshots.withColumn("hash", content_hash("content"))


_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?/*"


def read_trees(spark: SparkSession, root: str, suffix: str | None = ".java") -> DataFrame:
    """``(commit, path, n_bytes, content, hash)`` from exported trees ``<root>/<commit>/<path>``.

    The suffix prunes the file listing, so other files are never opened. Hashes
    are taken over the raw bytes; ``content`` is their UTF-8 text with a
    substitute for bytes that are none. The root may be relative or have a scheme and a
    host or not; a file that is not below it is an error.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    bare = re.sub(_SCHEME, "/", root)  # schemes and hosts are spelled in several ways
    where = F.regexp_replace("path", _SCHEME, "/")
    # A relative root is found where it starts: after the working folder, which Spark puts before it.
    folder = bare.rstrip("/") if bare.startswith("/") else "/" + re.sub(r"^(\./)+", "", bare).rstrip("/")
    begin = F.locate(folder + "/", where)
    below = begin == 1 if bare.startswith("/") else begin > 0
    inside = F.when(below, F.substring(where, begin + len(folder) + 1, F.length(where))).otherwise(
        F.raise_error(F.concat(F.lit(f"not below {root}: "), F.col("path")))
    )
    files = reader.load(root).select(inside.alias("inside"), "length", "content")
    return files.select(
        F.substring_index("inside", "/", 1).alias("commit"),
        F.regexp_replace("inside", "^[^/]+/", "").alias("path"),
        F.col("length").alias("n_bytes"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.sha1("content").alias("hash"),
    )


def spread_scan(table: DataFrame) -> DataFrame:
    """Repartition a table as read, if it has fewer partitions than there are cores.

    A few large row groups would keep a few tasks busy matching patterns while
    all other cores wait. A table of many partitions is left alone. Call it on a
    plain scan: there, counting the partitions starts no job.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)
