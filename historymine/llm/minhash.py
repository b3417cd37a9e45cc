"""Near-duplicates by one-permutation MinHash with optimal densification.

A document is the set of its shingles. One hash function splits the hash range
into bins and keeps each bin's minimum; an empty bin copies from bins that a
fixed random sequence names, the same for every document. Bins are banded into
bucket keys. Inside a bucket only a star of candidate pairs is formed, every
member with the smallest one, so pairs grow with the members and not with their
square. A pair becomes a link only after its full shingle sets were compared.

A star can miss a link between two members that are both unlike its centre.
Where a bucket still holds several components, members whose signatures look
alike form families, and inside a family every pair that looks similar enough
and is in two components is compared in full, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from historymine.llm.common import components, map_rows, stored

MEMBERS_PER_SLICE = 128
BLOCK = 256
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


@dataclass(frozen=True)
class MinHash:
    """Shingles of ``words`` words; links at ``percent`` per cent similarity or more; ``bands`` of ``rows`` bins.

    With 21 bands of 6 bins a pair at similarity 0.85 misses every bucket in 5 of 100,000 cases, one at 0.8 in 2 of 1,000.
    """

    words: int = 5
    percent: int = 80
    bands: int = 21
    rows: int = 6
    margin: float = 0.1  # estimates that far below the threshold, 3 deviations of the estimate, are not compared

    @property
    def bins(self) -> int:
        return self.bands * self.rows


class WordHashes(dict):
    """64-bit hash of a word's bytes; forgets when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z are lower-cased, ASCII white space parts words.

    Fewer than ``words`` words are one shingle; no words give the empty set.
    """
    parts = (text or "").encode().lower().split()  # of bytes: both touch ASCII only
    if not parts:
        return np.array([], dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, parts), dtype=np.uint64, count=len(parts))
    width = min(words, len(h))
    acc = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        acc = _mixed(acc * _MIX[0] + h[i : i + len(acc)])
    return np.unique(acc)


class Densified:
    """One-permutation signatures. Empty bin i copies from bins h(i, 1), h(i, 2), ... : the first that is not empty."""

    def __init__(self, bins: int):
        self.bins = bins
        attempts = np.arange(1, 4097, dtype=np.uint64)
        self.order = (_mixed(np.arange(bins, dtype=np.uint64)[:, None] * _MIX[0] + attempts * _MIX[1]) >> np.uint64(11)) % np.uint64(bins)
        self.order = self.order.astype(np.int64)

    def __call__(self, hashed: np.ndarray) -> np.ndarray:
        h = np.sort(_mixed(hashed + _MIX[0]))
        at = (((h >> np.uint64(40)) * np.uint64(self.bins)) >> np.uint64(24)).astype(np.int64)
        first = np.minimum(np.searchsorted(at, np.arange(self.bins)), len(h) - 1)
        full = at[first] == np.arange(self.bins)
        signature = h[first]
        empty = np.flatnonzero(~full)
        for width in (32, self.order.shape[1]):
            if len(empty):
                hits = full[self.order[empty, :width]]
                found = hits.any(axis=1)
                signature[empty[found]] = signature[self.order[empty[found], hits[found].argmax(axis=1)]]
                empty = empty[~found]
        return signature


def signatures(docs: DataFrame, how: MinHash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, set_1, set_2, keys, signature)``: a 128-bit digest of the set, bucket keys, 16 bits of each bin."""

    def make():
        hashes, densified = WordHashes(), Densified(how.bins)
        seeds = np.arange(1, how.bands + 1, dtype=np.uint64)

        def one(row) -> Iterator[tuple]:
            found = shingle_set(row[1], how.words, hashes)
            if not len(found):
                yield row[0], 0, None, None, None, None
                return
            digest = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), dtype="<i8")
            signature = densified(found)
            keys = seeds * _MIX[2]
            for column in signature.reshape(how.bands, how.rows).T:
                keys = _mixed(keys * _MIX[0] + column)
            yield row[0], len(found), int(digest[0]), int(digest[1]), keys.astype(np.int64).tolist(), (signature & np.uint64(0xFFFF)).astype("<u2").tobytes()

        return one

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, "id bigint, n_shingles bigint, set_1 bigint, set_2 bigint, keys array<bigint>, signature binary")


def _similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    low, high = sorted((len(one), len(other)))
    if 100 * low < percent * high:
        return False
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both > 0 and 100 * both >= percent * (low + high - both)


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bins agree, for each row of ``a`` with each row of ``b``."""
    same = np.zeros((len(a), len(b)), dtype=np.int16)
    for column in range(a.shape[1]):
        same += a[:, column, None] == b[None, :, column]
    return same


def _in_block_pairs(members: DataFrame, group: str, block: int, *columns: str) -> DataFrame:
    """Rows ``(group, i, j, own, id, *columns)``, ordered within their unit, for each pair of blocks of a group.

    ``members`` has the group's ``size``; a unit holds about two blocks however large the group is.
    """
    placed = members.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = spread.select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", *columns)
    return unit.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "own", "id")


def _by_unit(rows: DataFrame, make: Callable[[], Callable[[list[tuple]], list[tuple]]], schema: str) -> DataFrame:
    """Apply a function to each unit of ``_in_block_pairs``."""

    def start():
        of_unit, unit = make(), []

        def one(row) -> Iterator[tuple]:
            if unit and row[:3] != unit[0][:3]:
                yield from of_unit(unit)
                unit.clear()
            unit.append(row)

        one.finish = lambda: of_unit(unit) if unit else []
        return one

    return map_rows(rows, start, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, how: MinHash) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough.

    Members of a centre ``a`` are cut into slices, each with its own copy of the
    centre's text, and stream past it: a task holds two sets at a time.
    """
    sliced = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_SLICE).cast("int").alias("slices"))
    members = pairs.join(sliced, "a").select("a", F.pmod(F.xxhash64("b"), "slices").cast("int").alias("slice"), F.col("b").alias("id"), F.lit(1).alias("member"))
    centres = sliced.select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("a").alias("id"), F.lit(0).alias("member"))
    streamed = members.union(centres).join(texts, "id").select("a", "slice", "member", "id", "text")

    def make():
        hashes = WordHashes()
        at, sets = None, []

        def one(row) -> Iterator[tuple]:
            nonlocal at, sets
            a, piece, member, b, text = row
            found = shingle_set(text, how.words, hashes)
            if (a, piece) != at:
                at, sets = (a, piece), []
            if not member:
                sets.append(found)  # several only where rows share an id
            elif any(_similar(found, centre, how.percent) for centre in sets):
                yield a, b

        return one

    return map_rows(streamed.repartition("a", "slice").sortWithinPartitions("a", "slice", "member", "id"), make, "a bigint, b bigint")


def _families(members: DataFrame, how: MinHash) -> DataFrame:
    """``(a, b)`` that connect the members of a bucket whose signatures look similar enough, a tree for each unit.

    ``members`` has ``(key, size, id, signature)``.
    """
    least = how.percent / 100 - how.margin

    def make():
        def roots(unit: list[tuple]) -> list[tuple]:
            signature = np.frombuffer(b"".join(r[5] for r in unit), dtype="<u2").reshape(len(unit), -1)
            near = _agreeing(signature, signature) >= least * signature.shape[1]
            root = np.arange(len(unit))
            while True:
                lower = np.where(near, root[None, :], len(unit)).min(axis=1)
                lower = lower[lower]
                if (lower == root).all():
                    return [(r[4], unit[k][4]) for r, k in zip(unit, root.tolist()) if r[4] != unit[k][4]]
                root = lower

        return roots

    return _by_unit(_in_block_pairs(members, "key", BLOCK, "signature"), make, "a bigint, b bigint")


def _missed(members: DataFrame, how: MinHash) -> DataFrame:
    """Links ``(a, b)`` between components of a family: all its pairs that look similar enough, compared in full.

    ``members`` has ``(family, size, id, component, text)``. A pair of which a link
    found before in the same unit has joined the components is passed over.
    """
    least = how.percent / 100 - how.margin

    def make():
        hashes, densified = WordHashes(), Densified(how.bins)

        def links(unit: list[tuple]) -> list[tuple]:
            first = [r for r in unit if r[3] == unit[0][1]]
            second = [r for r in unit if r[3] == unit[0][2]]
            if not first or not second or len({r[5] for r in unit}) == 1:
                return []
            sets = [[shingle_set(r[6], how.words, hashes) for r in rows] for rows in (first, second)]
            a, b = (np.array([densified(x) & np.uint64(0xFFFF) for x in side], dtype=np.uint16) for side in sets)
            same = _agreeing(a, b)
            joined = {r[5]: r[5] for r in unit}

            def root(c: int) -> int:
                while joined[c] != c:
                    c = joined[c]
                return c

            found = []
            near = np.argwhere(same >= least * a.shape[1])
            for x, y in near[np.argsort(-same[near[:, 0], near[:, 1]], kind="stable")].tolist():
                low, high = sorted((root(first[x][5]), root(second[y][5])))
                if low != high and _similar(sets[0][x], sets[1][y], how.percent):
                    joined[high] = low
                    found.append((first[x][4], second[y][4]))
            return found

        return links

    return _by_unit(_in_block_pairs(members, "family", BLOCK // 2, "component", "text"), make, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, how: MinHash = MinHash()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``, whose other columns are ignored.

    Equal sets are one class from the start and enter the search once. A document
    without words has no shingles and is linked with nothing. A row without id
    takes no part and returns null for component and kept. Rows that share an id
    share its component; repeated rows come back repeated. An empty table gives
    an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = stored(signatures(docs, how), "minhash-signatures")
    entered = found.where("n_shingles > 0 and id is not null")
    classes = stored(entered.groupBy("set_1", "set_2").agg(F.min("id").alias("rep")), "minhash-classes")
    same = ["set_1", "set_2"]
    reps = stored(
        entered.join(classes.withColumnRenamed("rep", "id"), ["id", *same], "left_semi").dropDuplicates(["id", *same]), "minhash-classes"
    )
    buckets = reps.select("id", "n_shingles", F.explode("keys").alias("key"))

    centres = buckets.groupBy("key").agg(F.min(F.struct("id", "n_shingles")).alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    able = F.least("n_shingles", "centre.n_shingles") * 100 >= F.greatest("n_shingles", "centre.n_shingles") * how.percent
    star = stored(
        buckets.join(centres, "key").where("id <> centre.id").select(F.col("centre.id").alias("a"), F.col("id").alias("b"), able.alias("able")).distinct(), "minhash-pairs"
    )
    # Texts move once, for the documents that share a bucket; a fixed join keeps the plan alike at every size.
    sharing = star.select(F.col("a").alias("id")).union(star.select("b")).distinct()
    texts = stored(docs.withColumnRenamed("doc_id", "id").join(sharing.hint("merge"), "id", "left_semi"), "minhash-texts")

    # Rows that share an id tie their classes together.
    repeated = entered.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id")
    ties = entered.join(repeated, "id").join(classes, same).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = stored(confirmed(star.where("able").select("a", "b"), texts, how).unionByName(ties), "minhash-links")
    label = components(links, "minhash")

    # Where a bucket still holds several components, what its star missed.
    labelled = buckets.join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    split = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    members = labelled.join(split.select("key", "size"), "key").join(reps.select("id", "signature"), "id")
    alike = stored(_families(members, how), "minhash-alike")
    family = components(alike.unionByName(links), "minhash").select("id", F.col("component").alias("family"))
    inside = stored(family.join(label, "id", "left").select("id", "family", F.coalesce("component", "id").alias("component")), "minhash-families")
    several = inside.groupBy("family").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    missed = stored(_missed(inside.join(several.select("family", "size"), "family").join(texts, "id"), how), "minhash-links")
    if not missed.isEmpty():
        label = components(links.unionByName(missed), "minhash")

    of_rep = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    placed = entered.join(of_rep, same).select("id", "n_shingles", "component")
    alone = found.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.lit(None).cast("bigint").alias("component"))
    # An id with an empty text in one row and words in another has the component of its words.
    own = repeated.join(label, "id").select("id", F.col("component").alias("of_id"))
    rows = placed.unionByName(alone).join(own, "id", "left")
    component = F.coalesce("component", "of_id", "id")
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept"))
