"""Alignment of the tokens of two tokenizers over the same texts.

Every distinct text is tokenized and aligned once: texts are shuffled whole and
counted, the distinct ones become numbered rows with their measures and their linked
id pairs, and a pair's count is the sum of the copies of the texts that hold it.
The measures go back to the documents by a digest of the text.

Both tokenizers end a token before a space that follows no white space (the first by
its pattern, the second because no piece of it holds a space after something
else). A text is cut there into units, and a worker aligns each unit it has not met lately.

Counts of frequent pairs travel to the tasks: those with more than a
``KNOWN_PAIRS``-th of all linked pairs, so their number is bounded by counting. The
other pairs are joined by shuffle, where for the same reason no key is large.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from operator import mul

import numpy as np
from pyspark.sql import DataFrame, functions as F

from historymine.llm.bpe import _byte_alphabet
from historymine.llm.common import map_rows, stored

SPACES = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S) ")
KEPT_UNITS, KEPT_CHARS = 150_000, 48  # units that a worker keeps before it forgets those not used lately, and the longest
UNITS_AT_ONCE, UNITS_JOINED = 8192, 64  # aligned in one go, and in one string for the tokenizers
PAIRS_OF_UNIT = 256  # a unit of more links is aligned by itself, where equal pairs are folded
KNOWN_PAIRS = 1_000_000
PAIRS_AT_ONCE = 1 << 21  # collected in a task before equal ones are folded
_B_IDS = 1 << 16  # a pair is a * _B_IDS + b, an unsigned integer of 32 bits


class Aligner:
    """A byte-level BPE file of the ``tokenizers`` library (A) and a SentencePiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        alphabet = _byte_alphabet()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [bytes(alphabet.get(c, 63) for c in name) for name in names]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        b_ids = range(self.b.get_piece_size())
        self.space = [self.b.piece_to_id("▁")]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b_ids for p in [self.b.id_to_piece(i)]]
        self.a_lengths, self.b_lengths = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.names = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.sizes = np.array(self.a_lengths), np.array(self.b_lengths)
        self.named = [name + mark for mark in (",", "|", ";", "") for name in self.names]  # a token and what follows it in the text form
        self.once = [np.ones(n, dtype="<i8").tobytes() for n in range(PAIRS_OF_UNIT + 1)]
        if any(" " in p.lstrip(" ") for p in (self.b.id_to_piece(i).replace("▁", " ") for i in b_ids)):
            raise ValueError("a piece of the second tokenizer holds a space after something else")
        if max(len(self.a_bytes), len(self.b_bytes)) > _B_IDS:
            raise ValueError("more ids than a pair can hold")
        self.units: dict[str, tuple | bool] = {}
        self.before: dict[str, tuple | bool] = {}

    def text(self, text: str) -> tuple[int, int, int, int, str, bytes, bytes] | None:
        """``(n_a, n_b, n_groups, n_links, groups, pairs, links of each pair)`` of space + text; None if bytes differ."""
        units = self._units(text)
        counted = Counter(units)
        known = self._known(counted)
        if False in known:
            return None
        times = counted.values()
        n_a, n_b, n_groups, n_links, groups, pairs, links = zip(*known)
        total = lambda numbers: sum(map(mul, numbers, times))
        weights = np.repeat(np.array([*times], dtype=np.int64), np.array([*map(len, pairs)]) // 4)
        distinct, weights = folded(np.frombuffer(b"".join(pairs), dtype="<u4"), np.frombuffer(b"".join(links), dtype="<i8") * weights)
        named = dict(zip(counted, groups))
        return total(n_a), total(n_b), total(n_groups), total(n_links), ";".join(map(named.__getitem__, units)), distinct.tobytes(), weights.tobytes()

    @staticmethod
    def _units(text: str) -> list[str]:
        """Each has a space before it."""
        return CUT.split(text) if SPACES.search(" " + text) else text.split(" ")

    def prepare(self, texts: list[str]) -> None:
        """Align the new short units of some texts together, as many as are kept; ``text`` aligns those that are left."""
        self._forget()
        units, before, new = self.units, self.before, set()

        def take() -> None:
            several = list(new)
            units.update(zip(several, self._aligned(several)))
            new.clear()

        for text in texts:
            new.update([u for u in set(self._units(text)) if len(u) <= KEPT_CHARS and u not in units and u not in before])
            if len(new) >= UNITS_AT_ONCE:
                take()
                if len(units) > KEPT_UNITS:
                    return
        take()

    def _forget(self) -> None:
        if len(self.units) > KEPT_UNITS:  # what was not used since the last time is forgotten
            self.units, self.before = {}, self.units

    def _known(self, wanted: Counter) -> list[tuple | bool]:
        self._forget()
        units, before = self.units, self.before
        known = list(map(units.get, wanted))
        if None not in known:
            return known
        names, new, places = list(wanted), [], []
        for k in [k for k, m in enumerate(known) if m is None]:
            u = names[k]
            known[k] = m = before.get(u)
            if m is None:
                new.append(u)
                places.append(k)
            else:
                units[u] = m
        for at in range(0, len(new), UNITS_AT_ONCE):
            several = new[at : at + UNITS_AT_ONCE]
            for k, u, m in zip(places[at : at + UNITS_AT_ONCE], several, self._aligned(several)):
                known[k] = m
                if len(u) <= KEPT_CHARS:
                    units[u] = m
        return known

    def _aligned(self, units: list[str]) -> list[tuple | bool]:
        """What each unit adds to its text; False where its bytes differ."""
        made: list[tuple | bool | None] = [None] * len(units)
        short = [k for k, u in enumerate(units) if u and len(u) <= KEPT_CHARS and not u[-1].isspace()]
        parts = [short[i : i + UNITS_JOINED] for i in range(0, len(short), UNITS_JOINED)]
        texts = [" ".join([units[k] for k in part]) for part in parts]
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        same = [part for part in zip(parts, a, b, texts) if self._equal((" " + part[3]).encode(), part[1], part[2])]
        if same:
            places = [k for part in same for k in part[0]]
            for k, m in zip(places, self._align_all([units[k] for k in places], [i for part in same for i in part[1]], [i for part in same for i in part[2]])):
                made[k] = m
        left = [k for k, m in enumerate(made) if m is None]
        if left:
            a, b = self.a.encode_batch_fast([" " + units[k] for k in left], add_special_tokens=False), self.b.encode([units[k] for k in left], num_threads=1)
            for k, of_a, of_b in zip(left, a, b):
                made[k] = self._align(units[k], of_a.ids, of_b or self.space)  # a space alone gives no ids without its text before it
        return made

    def _equal(self, data: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b_bytes.__getitem__, b))

    def _align_all(self, units: list[str], a_ids: list[int], b_ids: list[int]) -> list[tuple | None]:
        """What each of several units adds to its text, from the tokens of all; None for a unit to be aligned by itself."""
        a, b = np.array(a_ids), np.array(b_ids)
        a_ends, b_ends = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        ends = np.cumsum([1 + len(u.encode()) for u in units])
        at_a, at_b = np.zeros(ends[-1] + 1, dtype=bool), np.zeros(ends[-1] + 1, dtype=bool)
        at_a[a_ends] = at_b[b_ends] = True
        both = at_a & at_b
        if not both[ends].all() or not self.sizes[0][a].all() or not self.sizes[1][b].all():
            return [None] * len(units)
        shared = np.cumsum(both)
        a_group, b_group = shared[a_ends - 1], shared[b_ends - 1]  # shared ends before a token's own
        of_a, of_b = np.bincount(a_group), np.bincount(b_group)  # tokens of each group
        a_first, b_first = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        last_group = shared[ends]  # groups up to the end of each unit
        upto = lambda counts: np.concatenate([[0], np.cumsum(counts)])[last_group]
        own = lambda totals: np.diff(totals, prepend=0)
        n_a, n_b, n_groups, n_links = own(upto(of_a)), own(upto(of_b)), own(last_group), own(upto(of_a * of_b))

        last_a, last_b = np.append(a_group[1:] != a_group[:-1], True), np.append(b_group[1:] != b_group[:-1], True)
        marks_b = np.where(last_b, 2, 0)
        marks_b[upto(of_b) - 1] = 3
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + b_first[a_group]] = a + len(self.names) * last_a
        order[np.arange(len(b)) + (a_first + of_a)[b_group]] = b + len(self.names) * marks_b
        named = list(map(self.named.__getitem__, order.tolist()))

        few = n_links <= PAIRS_OF_UNIT
        partners = np.where(np.repeat(few, n_groups), of_b, 0)[a_group]  # of each token of A
        first = np.repeat(b_first[a_group] - (np.cumsum(partners) - partners), partners)
        pairs = (np.repeat(a, partners) * _B_IDS + b[first + np.arange(len(first))]).astype("<u4").tobytes()
        made: list[tuple | None] = []
        token = pair = 0
        for of_a, of_b, groups, links in zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist()):
            tokens = named[token : token + of_a + of_b]
            token += of_a + of_b
            if links > PAIRS_OF_UNIT:
                made.append(None)
                continue
            made.append((of_a, of_b, groups, links, "".join(tokens), pairs[4 * pair : 4 * (pair + links)], self.once[links]))
            pair += links
        return made

    def _align(self, unit: str, a: list[int], b: list[int]) -> tuple | bool:
        """What a unit adds to its text; False if its bytes differ."""
        if not self._equal((" " + unit).encode(), a, b):
            return False
        names = self.names
        a_lengths, b_lengths = self.a_lengths, self.b_lengths
        links: dict[int, int] = {}
        groups = []
        n_links = a0 = a1 = b0 = b1 = ahead = 0  # ahead: bytes of A less bytes of B
        while a1 < len(a):
            ahead += a_lengths[a[a1]]
            a1 += 1
            while ahead > 0:
                ahead -= b_lengths[b[b1]]
                b1 += 1
            if ahead:
                continue
            if a1 - a0 == 1 and b1 - b0 == 1:
                x, y = a[a0], b[b0]
                groups.append(names[x] + "|" + names[y])
                links[x * _B_IDS + y] = links.get(x * _B_IDS + y, 0) + 1
                n_links += 1
            else:
                of_a, of_b = a[a0:a1], b[b0:b1]
                groups.append(",".join([names[x] for x in of_a]) + "|" + ",".join([names[y] for y in of_b]))
                n_links += len(of_a) * len(of_b)
                short = len(of_a) + len(of_b) < 16  # else distinct ids of both sides, never occurrence by occurrence
                for x, n in [(x, 1) for x in of_a] if short else Counter(of_a).items():
                    for y, m in [(y, 1) for y in of_b] if short else Counter(of_b).items():
                        links[x * _B_IDS + y] = links.get(x * _B_IDS + y, 0) + n * m
            a0, b0 = a1, b1
        return len(a), len(b), len(groups), n_links, ";".join(groups), array("I", links).tobytes(), array("q", links.values()).tobytes()


def folded(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.array([], dtype=np.int64)
    return keys[starts], np.add.reduceat(values[order], starts) if len(starts) else values[:0]


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One instance per Python worker, so that its units serve all tasks of the worker."""
    return Aligner(a_path, b_path)


def aligned_texts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """The distinct texts that both tokenizers reproduce, as a stored table.

    ``(text_id, digest, copies, n_a, n_b, n_groups, n_links, groups, pairs, links)``:
    ``groups`` is the SHA-256 of the text form of all groups, ``pairs`` the distinct id pairs and
    ``links`` how many links of the text each has, as little-endian integers of 32 and 64 bits.
    """
    texts = docs.select(F.col(text_col).alias("text")).where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))

    def align():
        pair = aligner(a_path, b_path)

        def one(row: tuple) -> Iterator[tuple]:
            made = pair.text(row[0])
            if made is not None:
                groups = hashlib.sha256(made[4].encode()).hexdigest()
                yield row[1], row[2], *made[:4], groups, *made[5:]

        one.prepare = lambda rows: pair.prepare([row[0] for row in rows])
        return one

    schema = "digest binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs binary, links binary"
    made = map_rows(texts.select("text", _digest("text"), "copies"), align, schema)
    return stored(made.withColumn("text_id", F.monotonically_increasing_id()), "aligned-texts")


def _digest(text_col: str):
    return F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)).alias("digest")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, a, b, count, best)``: documents that hold a pair linked, and whether no pair of its A id has more."""

    def count():
        keys: list[np.ndarray] = []
        copies: list[np.ndarray] = []
        held = 0

        def fold() -> None:
            nonlocal held
            k, c = folded(np.concatenate(keys), np.concatenate(copies))
            keys[:], copies[:], held = [k], [c], len(k)

        def rows() -> Iterator[tuple]:
            fold()
            made = list(zip(keys[0].tolist(), copies[0].tolist()))
            keys.clear()
            copies.clear()
            return iter(made)

        def one(row: tuple) -> Iterator[tuple]:
            nonlocal held
            keys.append(np.frombuffer(row[0], dtype="<u4"))
            copies.append(np.full(len(keys[-1]), row[1], dtype=np.int64))
            held += len(keys[-1])
            if held >= PAIRS_AT_ONCE:
                fold()
                if held >= PAIRS_AT_ONCE // 2:
                    yield from rows()
                    held = 0

        one.finish = lambda: list(rows()) if keys else []
        return one

    parts = map_rows(aligned.select("pairs", "copies"), count, "pair bigint, count bigint")
    counted = stored(parts.groupBy("pair").agg(F.sum("count").alias("count")), "pair-counts")
    counted = counted.select("pair", F.expr(f"pair div {_B_IDS}").alias("a"), F.pmod("pair", F.lit(_B_IDS)).alias("b"), "count")
    highest = counted.groupBy("a").agg(F.max("count").alias("highest"))
    return stored(counted.join(highest, "a").select("pair", "a", "b", "count", (F.col("count") == F.col("highest")).alias("best")), "pair-counts")


def measures(aligned: DataFrame, counts: DataFrame, known_pairs: int = KNOWN_PAIRS) -> DataFrame:
    """``(text_id, n_best, count_sum)``: links whose pair is the best of its A id, and the sum of counts over all links."""
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).scalar()
    often = F.col("count") * known_pairs > F.lit(total)
    known = counts.where(often).select("pair", "count", "best").toPandas().sort_values("pair")
    keys, count, best = known["pair"].to_numpy(np.int64), known["count"].to_numpy(np.int64), known["best"].to_numpy(bool)

    def parts(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        pairs, links = np.frombuffer(row[1], dtype="<u4").astype(np.int64), np.frombuffer(row[2], dtype="<i8")
        at = np.searchsorted(keys, pairs)
        hit = np.zeros(len(pairs), dtype=bool)
        inside = at < len(keys)
        hit[inside] = keys[at[inside]] == pairs[inside]
        return pairs, links, at, hit

    def sums():
        def one(row: tuple) -> Iterator[tuple]:
            _, links, at, hit = parts(row)
            at, links = at[hit], links[hit]
            yield row[0], int(links[best[at]].sum()), int((links * count[at]).sum())

        return one

    def others():
        def one(row: tuple) -> Iterator[tuple]:
            pairs, links, _, hit = parts(row)
            for pair, n in zip(pairs[~hit].tolist(), links[~hit].tolist()):
                yield row[0], pair, n

        return one

    rows = aligned.select("text_id", "pairs", "links")
    near = map_rows(rows, sums, "text_id bigint, n_best bigint, count_sum bigint")
    far = map_rows(rows, others, "text_id bigint, pair bigint, n bigint").join(counts.where(~often), "pair")
    far = far.groupBy("text_id").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum"))
    more = lambda value, extra: (F.col(value) + F.coalesce(extra, F.lit(0))).alias(value)
    return near.join(far, "text_id", "left").select("text_id", more("n_best", "more_best"), more("count_sum", "more_sum"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` per row of ``docs``; ``groups`` is a SHA-256 of the groups.

    A text that is null, empty, or not reproduced by both tokenizers byte by byte has
    no tokens: zeros and an empty ``groups``. Repeated rows each count as a document and
    keep their own result rows; a null id is kept; an empty table gives an empty one;
    other columns of any name are ignored. Texts of any length are aligned whole.
    """
    aligned = aligned_texts(docs, a_path, b_path, text_col)
    found = stored(aligned.drop("pairs", "links", "copies").join(measures(aligned, pair_counts(aligned)), "text_id"), "alignment-measures")
    rows = docs.select(F.col(id_col).alias("id"), _digest(text_col)).join(found, "digest", "left")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return rows.select("id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers], F.coalesce("groups", F.lit("")).alias("groups"))
