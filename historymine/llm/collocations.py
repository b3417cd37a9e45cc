"""Phrase collocations from FM-indexes over word ids.

A task gathers the words of its texts into shards of a bounded number of words. A
shard is indexed in both directions: the Burrows-Wheeler transform of its word ids
and that of the ids reversed. Intervals of phrases are extended to the left through
the first and to the right through the second, both kept in step, which enumerates
all phrases up to a length with their counts; an extension's size is the count of
the longer phrase. Counts of shards are summed over the corpus.

The index is sorted by ``ORDER`` words only, which is enough for phrases of that length.

Longer phrases are enumerated in a second pass from the frequent shorter ones. A
bitmap of fixed size tells a shard which two-word phrases may be frequent; it lets
some others pass, never stops a frequent one, and the sums decide.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from historymine.llm.common import stored

SHARD_WORDS = 700_000
ORDER = 4  # words by which suffixes are sorted
BITMAP_BITS = 1 << 26
BATCH_ROWS = 1 << 16
_BUCKET_BITS = 1 << 15  # of Spark's bitmap functions
_ENDS = ".,;:!?\n\x0b\x0c\r"  # of pieces
_SCHEMA = "lang string, phrase string, words int, n bigint"
_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


class _Ids(dict):
    """Numbers words as they come; ends of pieces are 0."""

    def __init__(self):
        super().__init__({".": 0})
        self.words = [""]

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


def tokens_of(text: str) -> list[str]:
    """Words, and a full stop for each end of a piece, in order; A-Z in lower case."""
    text = text.encode().lower().decode()  # of bytes, only A-Z have a lower case
    for end in _ENDS:
        if end in text:
            text = text.replace(end, " . ")
    return [word for word in text.replace("\t", " ").split(" ") if word]


@dataclass(frozen=True)
class Intervals:
    """Phrases of one length: where their rows start in both indexes, how many they are, and the phrases' words."""

    forward: np.ndarray
    backward: np.ndarray
    size: np.ndarray
    words: np.ndarray  # one row per phrase

    def where(self, keep: np.ndarray) -> Intervals:
        return Intervals(self.forward[keep], self.backward[keep], self.size[keep], self.words[keep])


def _stable_order(keys: np.ndarray) -> np.ndarray:
    """The order of small keys, ties by place; numbers that differ sort faster than a stable sort of equal ones."""
    return np.argsort(keys.astype(np.int64) * len(keys) + np.arange(len(keys)))


class _Transform:
    """The Burrows-Wheeler transform of ``ids`` read as a circle, and the row that the symbol of each row leads to."""

    def __init__(self, ids: np.ndarray):
        rank = ids.astype(np.int64)
        reach = 1
        while reach < ORDER:
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -reach)
            order = np.argsort(key)
            new = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
            rank[order] = new
            reach *= 2
        self.symbols = np.roll(ids, 1)[np.argsort(rank)]
        self.leads_to = np.empty(len(ids), dtype=np.int64)
        self.leads_to[_stable_order(self.symbols)] = np.arange(len(ids))


class ShardIndex:
    """A bidirectional FM-index over word ids; 0 ends a piece and is in no phrase."""

    def __init__(self, ids: np.ndarray):
        self.n_words = int(ids.max()) + 1
        self.ids = ids
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=self.n_words))])

    @functools.cached_property
    def forward(self) -> _Transform:
        return _Transform(self.ids)

    @functools.cached_property
    def backward(self) -> _Transform:
        return _Transform(self.ids[::-1])

    def words(self) -> Intervals:
        """All words: both indexes start with the same symbols, so the intervals are the same."""
        at = np.arange(1, self.n_words, dtype=np.int64)
        start = self.starts[at]
        return Intervals(start, start, self.starts[at + 1] - start, at[:, None])

    def extended(self, of: Intervals, left: bool) -> Intervals:
        """Every phrase one word longer on one side, for all intervals at once.

        The symbols in a phrase's rows are its extensions on that side. Their rows lie
        together where the first of them leads to, and in the other index in the order
        of the symbols inside the phrase's own interval.
        """
        if not len(of.size):
            return Intervals(of.forward, of.backward, of.size, np.empty((0, of.words.shape[1] + 1), dtype=np.int64))
        index, near, far = (self.forward, of.forward, of.backward) if left else (self.backward, of.backward, of.forward)
        phrase = np.repeat(np.arange(len(of.size)), of.size)
        before = np.cumsum(of.size) - of.size
        rows = np.arange(len(phrase)) - before[phrase] + near[phrase]
        key = phrase * self.n_words + index.symbols[rows]
        order = _stable_order(key) if len(key) * int(key[-1] + self.n_words) < 1 << 62 else np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        of_phrase, symbol = key[first] // self.n_words, key[first] % self.n_words
        in_near = index.leads_to[rows[order[first]]]
        in_far = far[of_phrase] + first - before[of_phrase]
        words = np.column_stack([symbol, of.words[of_phrase]] if left else [of.words[of_phrase], symbol])
        made = Intervals(in_near, in_far, size, words) if left else Intervals(in_far, in_near, size, words)
        return made.where(symbol > 0)


def phrase_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places in the bitmap of two-word phrases, from hashes of their words."""
    with np.errstate(over="ignore"):
        mixed = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + (left >> np.uint64(29)))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(32)).astype(np.int64) % BITMAP_BITS


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def _batches(lang: str, ids: _Ids, found: Intervals, sign: int = 1) -> Iterator[pa.RecordBatch]:
    names = pa.array(ids.words, pa.string())
    for at in range(0, len(found.size), BATCH_ROWS):
        part = slice(at, at + BATCH_ROWS)
        columns = [names.take(pa.array(found.words[part, k])) for k in range(found.words.shape[1])]
        phrase = pc.binary_join_element_wise(*columns, " ") if len(columns) > 1 else columns[0]
        n = len(phrase)
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(n, dtype=np.int64))), phrase, pa.array(np.full(n, len(columns), dtype=np.int32)), pa.array(sign * found.size[part], pa.int64())], schema=_ARROW)


def _shard_counts(docs: DataFrame, phrases: Callable[[str, ShardIndex, _Ids], Iterator[Intervals]], shard_words: int) -> DataFrame:
    """Sums over shards of what ``phrases`` enumerates of each; ``docs`` has ``lang`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, tuple[_Ids, list[np.ndarray]]] = {}
        held = 0

        def counted(lang: str, ids: _Ids, parts: list[np.ndarray], sign: int = 1) -> Iterator[pa.RecordBatch]:
            whole = np.concatenate(parts)
            if whole.any():
                for found in phrases(lang, ShardIndex(whole), ids):
                    yield from _batches(lang, ids, found, sign)

        for batch in batches:
            for k in range(batch.num_rows):
                lang = batch.column(0)[k].as_py()
                words = tokens_of(batch.column(1)[k].as_py())
                for at in range(0, len(words), shard_words):
                    ids, parts = shards.setdefault(lang, (_Ids(), []))
                    part = np.array([*map(ids.__getitem__, words[at : at + shard_words + ORDER - 2]), 0], dtype=np.int64)
                    parts.append(part)
                    held += len(part)
                    if at + shard_words < len(words):
                        # What the next part starts with was added to see across the cut; its own phrases count there.
                        yield from counted(lang, ids, [part[shard_words:]], sign=-1)
                    if held >= shard_words:
                        for name, shard in shards.items():
                            yield from counted(name, *shard)
                        shards, held = {}, 0
        for name, shard in shards.items():
            yield from counted(name, *shard)

    return docs.mapInArrow(run, _SCHEMA).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """Which places two-word phrases have, over all languages: at most BITMAP_BITS bits, merged where they are made."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [p.split(" ") for p in batch.column(0).to_pylist()]
            if pairs:
                left, right = (word_hashes([p[k] for p in pairs]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(phrase_hash(left, right)))], names=["place"])

    marked = phrases.select("phrase").mapInArrow(places, "place bigint")
    buckets = marked.groupBy((F.col("place") / _BUCKET_BITS).cast("bigint").alias("bucket")).agg(F.bitmap_construct_agg((F.col("place") % _BUCKET_BITS)).alias("bits"))
    bits = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for row in buckets.toLocalIterator():
        bits[row["bucket"] * _BUCKET_BITS // 8 :][: _BUCKET_BITS // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return bits


def phrase_counts(docs: DataFrame, least: int = 10, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(lang, phrase, words, n)`` of all words, and of phrases of two and three words with ``n >= least``, as a stored table."""
    texts = _texts(docs, text_col, lang_col)

    def short(lang: str, index: ShardIndex, ids: _Ids) -> Iterator[Intervals]:
        words = index.words()
        yield words
        yield index.extended(words, left=True)

    upto_two = stored(_shard_counts(texts, short, shard_words).where((F.col("words") == 1) | (F.col("n") >= least)), "phrases-2")
    bits = _bitmap(upto_two.where("words = 2"))

    def long(lang: str, index: ShardIndex, ids: _Ids) -> Iterator[Intervals]:
        hashes = word_hashes(ids.words)

        def maybe(words: np.ndarray) -> np.ndarray:
            place = phrase_hash(hashes[words[:, -2]], hashes[words[:, -1]])
            return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0

        pairs = index.extended(index.words(), left=True)
        triples = index.extended(pairs.where(maybe(pairs.words)), left=False)
        yield triples.where(maybe(triples.words))

    three = _shard_counts(texts, long, shard_words).where(F.col("n") >= least)
    return upto_two.unionByName(stored(three, "phrases-3"))


def collocations(docs: DataFrame, least: int = 10, share: int = 50, first: int = 2000, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The ``first`` best phrases per language: ``(lang, rank, phrase, a, l, r, n, score)``.

    A phrase of two or three words with count ``a >= least`` is scored at its worst cut
    into parts with counts ``l`` and ``r``, as floor(1000000 * a * a / (l * r)), ties to
    the smaller first part; ``n`` is the number of words of the language. Phrases inside
    a longer one that has ``share`` percent of their count or more are left out.

    A null language is ``und``, a null or empty text has no words. Repeated rows count each.
    Very long texts are cut into shards without losing a phrase across a cut. An empty
    table gives an empty one, and other columns of any name are ignored.
    """
    counts = phrase_counts(docs, least, text_col, lang_col, shard_words)
    totals = counts.where("words = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    phrases = counts.where("words > 1").withColumn("parts", F.split("phrase", " "))
    cut = lambda k: F.struct(
        F.lit(k).alias("k"), F.array_join(F.slice("parts", 1, k), " ").alias("left"), F.array_join(F.slice("parts", k + 1, ORDER), " ").alias("right")
    )
    cuts = phrases.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.when(F.col("words") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))).alias("cut"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    sided = cuts.select("lang", "phrase", "words", "a", "cut.*").join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    worst = sided.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("at"))
    inner = lambda at: F.array_join(F.slice("parts", at, 2), " ")
    longer = phrases.where("words = 3").select("lang", F.col("n").alias("of"), F.explode(F.array_distinct(F.array(inner(1), inner(2)))).alias("phrase"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("of").alias("of"))
    kept = worst.join(covered, ["lang", "phrase"], "left").where(F.coalesce(F.col("of") * 100 < F.col("a") * share, F.lit(True)) | (F.col("words") == 3))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.select("lang", "phrase", "a", "at.l", "at.r", "at.score").withColumn("rank", place).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
