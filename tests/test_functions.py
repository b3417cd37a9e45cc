"""Expressions, numbering, running totals and skew-proof joins."""

import random

import pytest
from pyspark.sql import functions as F

from historymine import functions as fn
from historymine.functions.skew import hot_keys


def test_paths(spark):
    df = spark.createDataFrame([("a/B.java",), ("/w/a/B.java",), ("/wx/B.java",)], "p STRING")
    out = df.select(fn.absolute_path("/w", "p").alias("a"), fn.relative_path("/w", "p").alias("r")).collect()
    assert [tuple(r) for r in out] == [
        ("/w/a/B.java", "a/B.java"), ("/w/a/B.java", "a/B.java"), ("/wx/B.java", "/wx/B.java"),
    ]


def test_expressions(spark):
    df = spark.createDataFrame([("", "S", 3, 0, "a\n\nb\n"), (None, None, 1, 4, "")], "rule STRING, ruleset STRING, a INT, b INT, t STRING")
    out = df.select(
        fn.rule_key(), fn.safe_ratio("a", "b"), fn.non_blank_lines("t"), fn.content_hash("t"), fn.short_hash(fn.content_hash("t"))
    ).collect()
    assert tuple(out[0])[:3] == ("S", 0.0, ["a", "b"])
    assert tuple(out[1]) == ("UNKNOWN", 0.25, [], "da39a3ee5e6b4b0d3255bfef95601890afd80709", "da39a3ee")


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_number_rows(spark, partitions):
    values = random.Random(1).sample(range(10**6), 5000)
    df = spark.createDataFrame([(v,) for v in values], "v BIGINT").repartition(partitions)
    numbered = fn.number_rows(df, ["v"], "n").orderBy("v").collect()
    assert [r.n for r in numbered] == list(range(5000))
    assert [r.v for r in numbered] == sorted(values)


def test_number_rows_in_groups_with_a_hot_one(spark):
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(50)}", i) for i in range(6000)]
    rng.shuffle(data)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(data, "g STRING, v BIGINT").repartition(5)
        got = {(r.g, r.v): r.n for r in fn.number_rows(df, ["v"], "n", within=["g"], start=1).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen = {}
    for g, v in sorted(data):
        seen[g] = seen.get(g, 0) + 1
        assert got[g, v] == seen[g]
    assert len(got) == 6000


def test_running_totals(spark, monkeypatch):
    monkeypatch.setattr("historymine.functions.ordinals.BLOCKS_PER_RANGE", 7)
    df = spark.range(100).select(F.col("id").alias("block"), (F.col("id") * 2).alias("a"), F.lit(1).cast("bigint").alias("b"))
    out = fn.running_totals(df, "block", ["a", "b"]).orderBy("block").collect()
    assert [(r.a, r.b) for r in out] == [(i * (i + 1), i + 1) for i in range(100)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_join(spark, rows, how):
    """A third of the rows has one key; slicing it must change nothing but the plan."""
    facts = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v")
    )
    lookup = spark.range(0, 60, 2).select(F.col("id").alias("k"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("w"))
    assert hot_keys(facts, ["k"], 50).count() == 1
    spread = fn.spread_join(facts, lookup, ["k"], ["v"], how, rows_per_slice=50)
    assert rows(spread, "k", "v", "w") == rows(facts.join(lookup, "k", how), "k", "v", "w")


def test_pick_rows(spark, rows):
    assert rows(fn.pick_rows(spark.range(100), spark.range(5, 8), ["id"])) == [(5,), (6,), (7,)]


def test_every_hot_key_is_sliced(spark):
    """More keys than were ever sliced under a fixed cap: all of equal weight, all above the threshold."""
    facts = spark.range(30_000).select((F.col("id") % 3000).alias("k"))
    assert hot_keys(facts, ["k"], 5).count() == 3000
