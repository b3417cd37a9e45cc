"""Result caches of earlier runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from historymine import schema as S


def empty_cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], S.CACHE)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table at ``path``; a missing one counts as empty."""
    try:
        return spark.read.schema(S.CACHE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty_cache(spark)
        raise


def cache_from_json(documents: DataFrame, ruleset: str, text: str = "text", version: int = 0) -> DataFrame:
    """Cache rows from JSON maps ``hash -> {warnings_by_rule, num_java_files}``; unreadable text gives none."""
    entries = documents.select(F.explode(F.from_json(text, S.CACHE_JSON)).alias("hash", "_e"))
    return entries.select(
        "hash",
        F.lit(ruleset).alias("ruleset_id"),
        F.coalesce("_e.warnings_by_rule", F.create_map().cast("MAP<STRING,BIGINT>")).alias("warnings_by_rule"),
        F.coalesce("_e.num_java_files", F.lit(1)).cast("bigint").alias("num_files"),
        F.lit(version).cast("bigint").alias("version"),
    )
