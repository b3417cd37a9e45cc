"""From raw documents to token sequences: the stages of a training corpus, each written as a table.

Every stage takes the documents that its predecessor kept and returns documents
with the same columns; the last one returns what was encoded. A text changes
only where a secret is masked, and then ``n_chars`` follows it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from historymine.functions.ordinals import number_rows
from historymine.llm import bpe, langid, minhash, mixing, secrets
from historymine.llm.common import stored, table
from historymine.llm.queries import language_model, token_digests

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told: no text or no letter. A missing label is filled in."""
    found = langid.predict(docs.select(*COLUMNS), language_model(docs), carried=COLUMNS)
    lang = F.coalesce("lang", "lang_pred").alias("lang")
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select(*[lang if c == "lang" else F.col(c) for c in COLUMNS])


def _own_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_digest`` of the text and ``_key``: the id, but another one for every further text that shares it.

    Which ids have unlike texts is known from two digests per id; their texts are as few as there are such rows.
    """
    digest = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")).alias("_digest")
    named = docs.where("doc_id is not null").select(*COLUMNS, digest)
    shared = named.groupBy("doc_id").agg(F.min("_digest").alias("_first"), F.max("_digest").alias("_last")).where("_first <> _last")
    further = named.select("doc_id", "_digest").join(shared, "doc_id").where("_digest <> _first").select("doc_id", "_digest").distinct()
    further = stored(number_rows(further, ["doc_id", "_digest"], "_n", start=1), "pipeline-shared-ids")
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).scalar()
    return named.join(further, ["doc_id", "_digest"], "left").withColumn("_key", F.coalesce(top + F.col("_n"), F.col("doc_id"))).drop("_n")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group alike at 0.8 or more in shingles of five words, that of the smallest id; rows without id stay.

    Rows that share an id are one document only if their texts are equal; of these the
    smallest by its columns stays. Unlike texts of one id stand or fall on their own.
    """
    docs = docs.select(*COLUMNS)
    keyed = _own_ids(docs)
    kept = minhash.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("_key")).distinct()
    one = keyed.join(kept, "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return one.select("row.*").unionByName(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found by a mark; all documents stay."""
    found = secrets.find_secrets(docs, carried=COLUMNS).withColumn("text", F.when(F.col("text").isNotNull(), secrets.redacted("text", "spans")))
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars")
    return found.select(*[n_chars if c == "n_chars" else F.col(c) for c in COLUMNS])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole documents so that sources come near their shares.

    The mix takes up to twice a document's words; the document enters as many times
    as that is of its size, rounded. Documents without words are in no share and go.
    """
    mixed = mixing.mix(docs, carried=COLUMNS)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text that is left, once per time that it was mixed in; returns digests of the tokens per document."""
    return token_digests(bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language", languages),
    ("near_duplicates", near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("tokens", tokens),
]
ORACLE_SQL = None  # models, hashing and tokenizers are beyond SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
