"""Byte-level byte-pair encoding by folds of Spark's higher-order functions.

A text is cut into words by the pattern of the vocabulary. A word is an array of
bytes, each a token of its own; a fold replaces, as long as there is one, the
first adjacent pair of lowest rank by the token of that rank. The ranks are
literals of the plan: a pair ``(a, b)`` has its token at place ``offset[a] + b`` of
one array, where the rows of different ``a`` are shifted so that none overlap.
Ranks stand above the bits of a position, so one minimum gives the lowest rank and
the first pair that has it.

Frequent words of the corpus are encoded once. They fall into ``SLOTS`` slots by
hash, the ``PER_SLOT`` most frequent of each slot enter a literal table, and a word
there has at most ``TABLE_BYTES`` bytes: the table's size has a bound by
construction. A slot is searched from its end, where its most frequent word is. Other words are encoded in the text that holds them.

Words beyond ``LONG_BYTES`` are folded in overlapping windows, which are joined
where both neighbours have the same two adjacent tokens: a sequence whose adjacent
tokens all stand side by side in an encoding is the encoding of the whole. Where
neighbours have no such place, windows are 16 times as long, and at last the whole word.

Tokens of a text travel as a string with one character per id. With a NUL after
each, these are the ids as unsigned 32-bit integers in UTF-16, little-endian. Ids
have to be below 0xD800, where surrogates start.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from historymine.llm.common import bound, stored

WORDS = (  # the pattern of the vocabulary, with the white space of Unicode
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
CUT = r"(?= )(?<=\P{IsWhite_Space})"  # before a space that follows no white space, words always end
LONG_BYTES = 96
WINDOW_BYTES = 64  # step of the windows of long words; each covers two steps
SLOTS, PER_SLOT = 1 << 14, 16  # of the table of frequent words
TABLE_BYTES = 24
_RANK = 1 << 31  # above the positions in a word
_ROW = 1 << 47  # above the ranks, which are below 2^16
_KEY, _VALUE = "\ue000", "\ue001"  # marks in the table; words that hold them do not enter it


@dataclass(frozen=True)
class Ranks:
    """A vocabulary as literals: tokens by rank, places of pairs, single bytes."""

    pieces: tuple[bytes, ...]  # by id; ids without token are empty
    offsets: tuple[int, ...]  # by id of the left token
    places: tuple[int, ...]  # (left + 1) * _ROW + rank * _RANK, or 0
    of_byte: tuple[int, ...]  # id of each byte


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int]:
    """The two tokens that become ``token``: what merges of lower rank leave of its bytes.

    No other split of it can stand side by side: as long as nothing crosses its
    ends, merges inside happen in the order they do here.
    """
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [ranks.get(a + b, _ROW) for a, b in zip(parts, parts[1:])]
        k = found.index(min(found))
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return ranks[parts[0]], ranks[parts[1]]


@functools.cache
def read_ranks(path: str) -> Ranks:
    """The ranks file: a base64 token and its rank per line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    size = max(ranks.values()) + 1
    pieces = [b""] * size
    rows: dict[int, dict[int, int]] = {}
    for token, rank in ranks.items():
        pieces[rank] = token
        if len(token) > 1:
            left, right = _last_merge(token, ranks)
            rows.setdefault(left, {})[right] = rank

    places = np.zeros(4 * size, dtype=np.int64)
    offsets = [0] * size
    rng = np.random.default_rng(0)
    for left, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        at = np.fromiter(row, dtype=np.int64, count=len(row))
        offset = 0
        while places[offset + at].any():
            offset = int(rng.integers(3 * size))
        offsets[left] = offset
        places[offset + at] = (left + 1) * _ROW + np.fromiter(row.values(), dtype=np.int64, count=len(row)) * _RANK
    return Ranks(tuple(pieces), tuple(offsets), tuple(places.tolist()), tuple(ranks[bytes([b])] for b in range(256)))


def _literal(value: object, kind: str) -> Column:
    """A nested literal; Spark folds it once while it plans."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"), ensure_ascii=False)), kind)


def _all_bound(values: list[Column], body: Callable[..., Column], *before: Column) -> Column:
    if not values:
        return body(*before)
    return bound(values[0], lambda value: _all_bound(values[1:], body, *before, value))


@dataclass(frozen=True)
class Folds:
    """Column expressions over one vocabulary, whose tables are bound variables."""

    n: int
    of_byte: Column
    offsets: Column
    places: Column
    chars: Column
    pieces: Column
    lengths: Column

    @classmethod
    def over(cls, ranks: Ranks, body: Callable[[Folds], Column]) -> Column:
        """``body`` of the expressions, with every literal in the plan once."""
        n = len(ranks.pieces)
        tables = [
            _literal(ranks.of_byte, "array<int>"),
            _literal(ranks.offsets, "array<int>"),
            _literal(ranks.places, "array<bigint>"),
            _literal(list(map(chr, range(n))), "array<string>"),
            _literal([p.hex() for p in ranks.pieces], "array<string>"),
            _literal([len(p) for p in ranks.pieces], "array<int>"),
        ]
        return _all_bound(tables, lambda *tables: body(cls(n, *tables)))

    def _rank(self, left: Column, right: Column) -> Column:
        """That of a pair of ids in units of _RANK, or at least _ROW."""
        return F.get(self.places, F.get(self.offsets, left) + right).bitwiseXOR(F.shiftleft((left + F.lit(1)).cast("bigint"), 47))

    def fold(self, data: Column, everywhere: bool = False) -> Column:
        """The ids of a binary value: the ranked merges folded over the array of its bytes.

        ``everywhere`` replaces a pair wherever it stands, which long runs need. That
        equals one after the other: what the first makes with a neighbour ranks higher.
        """

        def merged(ids: Column, token: Column, k: Column) -> Column:
            if everywhere:
                pair = F.concat(F.get(self.chars, F.get(ids, k)), F.get(self.chars, F.get(ids, k + 1)))
                after = self.ids(F.replace(self.string(ids), pair, F.get(self.chars, token)))
            else:
                after = F.array_remove(F.transform(ids, lambda x, i: F.when(i == k, token).when(i == k + 1, F.lit(-1)).otherwise(x)), F.lit(-1))
            return F.struct(after.alias("ids"), (F.size(ids) > 2).alias("more"))

        def first(ids: Column, best: Column) -> Column:
            at = bound(best.bitwiseAND(F.lit(_RANK - 1)).cast("int"), lambda k: merged(ids, F.shiftright(best, 31).cast("int"), k))
            return F.when(best < F.lit(_ROW), at).otherwise(F.struct(ids.alias("ids"), F.lit(False).alias("more")))

        def step(state: Column, _: Column) -> Column:
            ids = state["ids"]
            found = F.transform(ids, lambda x, i: self._rank(x, F.get(ids, i + 1)) + i)  # null after the last
            return F.when(state["more"], bound(F.array_min(found), lambda best: first(ids, best))).otherwise(state)

        def over(ids: Column) -> Column:
            return F.aggregate(ids, F.struct(ids.alias("ids"), (F.size(ids) > 1).alias("more")), step, lambda state: state["ids"])

        return bound(F.transform(F.split(F.decode(data, "ISO-8859-1"), ""), lambda c: F.get(self.of_byte, F.ascii(c))), over)

    def windows(self, data: Column, step: int) -> Column:
        """The ids of a long binary value from windows of two steps, or null if neighbours do not agree somewhere."""
        count = F.ceil(F.octet_length(data) / step).cast("int") - 1

        def window(k: Column) -> Column:
            """``(start, id, next id)`` of every token, by place in the whole word."""
            part = self.fold(F.substring(data, k * step + 1, F.lit(2 * step)), everywhere=True)
            start = lambda seen, x: F.struct((seen["at"] + F.get(self.lengths, x)).alias("at"), F.concat(seen["starts"], F.array(seen["at"])).alias("starts"))
            none = F.struct((k * step).alias("at"), F.array().cast("array<int>").alias("starts"))
            starts = lambda ids: F.aggregate(ids, none, start, lambda seen: seen["starts"])
            return bound(part, lambda ids: F.zip_with(starts(ids), F.transform(ids, lambda x, i: F.struct(x.alias("id"), F.get(ids, i + 1).alias("next"))), self._token))

        def agreed(all_: Column) -> Column:
            """Where the tokens of a window end and those of the next one begin: the start of the later of two tokens that both have."""
            same = lambda k: F.array_intersect(F.filter(F.get(all_, k), lambda t: t["next"].isNotNull()), F.get(all_, k + 1))
            at = lambda k: F.array_min(F.transform(same(k), lambda t: t["start"] + F.get(self.lengths, t["id"])))
            return F.transform(F.filter(F.sequence(F.lit(0), count - 1), lambda k: k < count - 1), at)

        def joined(all_: Column, cuts: Column) -> Column:
            inside = lambda k: lambda t: (t["start"] >= F.coalesce(F.get(cuts, k - 1), F.lit(0))) & (t["start"] < F.coalesce(F.get(cuts, k), F.octet_length(data)))
            kept = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.transform(F.filter(F.get(all_, k), inside(k)), lambda t: t["id"]))
            return F.when(~F.exists(cuts, lambda c: c.isNull()), F.flatten(kept))

        return bound(F.transform(F.sequence(F.lit(0), count - 1), window), lambda all_: bound(agreed(all_), lambda cuts: joined(all_, cuts)))

    @staticmethod
    def _token(start: Column, ids: Column) -> Column:
        return F.struct(start.alias("start"), ids["id"].alias("id"), ids["next"].alias("next"))

    def word(self, word: Column) -> Column:
        """The ids of a word."""
        data = word.cast("binary")
        long = F.coalesce(self.windows(data, WINDOW_BYTES), F.when(F.octet_length(data) > 32 * WINDOW_BYTES, self.windows(data, 16 * WINDOW_BYTES)), self.fold(data, everywhere=True))
        return F.when(F.octet_length(data) > LONG_BYTES, long).otherwise(self.fold(data))

    def string(self, ids: Column) -> Column:
        """Ids as characters."""
        return F.array_join(F.transform(ids, lambda x: F.get(self.chars, x)), "")

    @staticmethod
    def ids(tokens: Column) -> Column:
        """Ids of characters; not of an empty string."""
        return F.transform(F.split(tokens, ""), lambda c: F.ascii(c))

    def decode(self, chars: Column) -> Column:
        """The bytes of an array of ids as characters: their pieces, concatenated."""
        return F.unhex(F.array_join(F.transform(chars, lambda c: F.get(self.pieces, F.ascii(c))), ""))


def units(text: Column) -> Column:
    """Parts of a text between places where words always end; no words of an empty one."""
    return F.array_remove(F.split(text, CUT), "")


def _words(unit: Column) -> Column:
    return F.regexp_extract_all(unit, F.lit(WORDS), F.lit(0))


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def frequent(texts: DataFrame, ranks: Ranks) -> list[str]:
    """The table of frequent words: of every slot, its words and their tokens, the most frequent last; at most SLOTS * PER_SLOT words of TABLE_BYTES bytes.

    Counts cover all texts: of units, and of the words in them.
    """
    counted = stored(texts.select(F.explode(units("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "byte-bpe-units")
    both = counted.select(F.explode(F.array_distinct(F.concat(F.array("word"), _words(F.col("word"))))).alias("word"), "n")
    short = both.where((F.octet_length("word") <= TABLE_BYTES) & ~F.col("word").rlike(f"[{_KEY}{_VALUE}]"))
    summed = short.groupBy("word").agg(F.sum("n").alias("n")).withColumn("slot", _slot(F.col("word")))
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("n"), "word"))
    most = stored(summed.withColumn("rank", rank).where(F.col("rank") <= PER_SLOT).select("slot", "rank", "word"), "byte-bpe-frequent")
    tokens = Folds.over(ranks, lambda folds: F.array_join(F.transform(_words(F.col("word")), lambda w: folds.string(folds.fold(w.cast("binary")))), ""))
    entries = most.repartition("slot").select("slot", "rank", F.concat(F.lit(_KEY), "word", F.lit(_VALUE), tokens).alias("entry"))
    last_first = F.reverse(F.array_sort(F.collect_list(F.struct("rank", "entry"))))
    slots = entries.groupBy("slot").agg(F.array_join(F.transform(last_first, lambda e: e["entry"]), "").alias("entries"))
    table = [""] * SLOTS
    for row in slots.toLocalIterator():
        table[row["slot"]] = row["entries"]
    return table


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, decoded)`` per row of ``docs``.

    ``ids`` are little-endian unsigned 32-bit integers as one binary value, ``decoded``
    the bytes of these ids. No text is shuffled, whatever its length; only the counts
    of distinct words are.

    A null text counts as empty and gives no ids; rows that are repeated or have a
    null or repeated id keep their own result rows; an empty table gives an empty
    one; other columns of any name are ignored.
    """
    ranks = read_ranks(ranks_path)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def looked_up(table: Column, word: Column, otherwise: Column) -> Column:
        """A word's tokens by the table, or else ``otherwise``."""
        after = F.call_function("substring_index", F.get(table, _slot(word)), F.concat(F.lit(_KEY), word, F.lit(_VALUE)), F.lit(-1))
        return bound(F.substring_index(after, _KEY, 1), lambda found: F.when(found != "", found).otherwise(otherwise))

    def encoded(folds: Folds, table: Column) -> Column:
        of_word = lambda word: looked_up(table, word, folds.string(folds.word(word)))
        of_unit = lambda unit: looked_up(table, unit, F.array_join(F.transform(_words(unit), of_word), ""))
        return bound(F.array_join(F.transform(units(F.col("text")), of_unit), ""), lambda tokens: finished(folds, tokens))

    def finished(folds: Folds, tokens: Column) -> Column:
        return F.when(tokens != "", bound(F.split(tokens, ""), lambda chars: whole(folds, chars))).otherwise(F.struct(F.lit(b"").alias("ids"), F.lit(b"").alias("decoded")))

    def whole(folds: Folds, chars: Column) -> Column:
        ids = F.encode(F.concat(F.array_join(chars, "\0"), F.lit("\0")), "UTF-16LE")
        return F.struct(ids.alias("ids"), folds.decode(chars).alias("decoded"))

    table = _literal(frequent(rows, ranks), "array<string>")
    made = Folds.over(ranks, lambda folds: bound(table, lambda table: encoded(folds, table)))
    return rows.select("id", made.alias("_")).select("id", "_.ids", "_.decoded")
