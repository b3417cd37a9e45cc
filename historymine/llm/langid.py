"""Language identification by unigram pieces, summed over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary. A
word's probability is the sum over every way to cut it into pieces, by a forward
pass; a text's is the product over its words. The distributions are fitted by
expectation maximization on the words of a bounded sample of labelled texts per
language, where the expected use of a piece comes from a forward and a backward
pass.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from historymine.llm.common import crc_mod5, hash_share, map_rows

WORD_RUN = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
WORD_CHARS = 48  # longer runs of letters are scored in parts of this length
KEPT_WORDS = 150_000
_KEY, _SLOT, _SLOT_BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 20


@dataclass(frozen=True)
class Fit:
    """Up to about ``per_language`` labelled texts of at most ``max_chars`` code points fit each language; ``rounds`` of expectation maximization.

    ``prior`` is added to every piece's expected use. Letters that are no piece of the
    vocabulary have probability ``unknown`` in every language.
    """

    per_language: int = 300
    max_chars: int = 20_000
    rounds: int = 3
    prior: float = 0.05
    unknown: float = 1e-7


@functools.cache
def vocabulary(model_path: str) -> dict[str, int]:
    """Pieces of letters and word starts of a SentencePiece model, by number; the model's own scores are not used."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = dict.fromkeys(model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    letters = [p for p in pieces if all(c == "▁" or c.isalpha() for c in p) and p.rfind("▁") <= 0]
    return {p: i for i, p in enumerate(letters)}


class Lattice:
    """Forward and backward passes over batches of words."""

    def __init__(self, pieces: dict[str, int], unknown: float):
        self.pieces, self.unknown = pieces, unknown
        self.longest = max(map(len, pieces))
        self.slot_keys = np.zeros(1 << _SLOT_BITS, dtype=np.uint64)
        self.slot_pieces = np.full(1 << _SLOT_BITS, -1, dtype=np.int32)
        self.farthest = 0
        for piece, number in pieces.items():
            key = 0
            for letter in piece:
                key = (key * int(_KEY) + ord(letter)) % (1 << 64)
            slot, step = (key * int(_SLOT) % (1 << 64)) >> (64 - _SLOT_BITS), 0
            while self.slot_pieces[(slot + step) % (1 << _SLOT_BITS)] >= 0:
                step += 1
            self.slot_keys[(slot + step) % (1 << _SLOT_BITS)], self.slot_pieces[(slot + step) % (1 << _SLOT_BITS)] = key, number
            self.farthest = max(self.farthest, step)

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``piece[w, end, length - 1]`` for every piece inside every word, -1 for none, -2 for a single unknown letter; and lengths."""
        lengths = np.array([len(w) for w in words])
        n = int(lengths.max())
        longest = min(self.longest, n)
        codes = np.zeros((len(words), n), dtype=np.uint64)
        codes[np.arange(n) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        out = np.full((len(words), n + 1, longest), -1, dtype=np.int32)
        key = np.zeros((len(words), n + 1), dtype=np.uint64)
        for size in range(1, longest + 1):  # the key of a piece from that of the piece without its last letter
            key[:, 1:] = key[:, :-1] * _KEY + codes
            out[:, size:, size - 1] = self.find(key[:, size:])
        alone = out[:, :, 0]
        alone[(alone < 0) & (np.arange(n + 1) >= 1) & (np.arange(n + 1) <= lengths[:, None])] = -2
        return out, lengths

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these keys, -1 for none; the table of pieces is sparse, so few need a second look."""
        slot = (keys * _SLOT) >> np.uint64(64 - _SLOT_BITS)
        found = np.where(self.slot_keys[slot] == keys, self.slot_pieces[slot], -1)
        for step in range(1, self.farthest + 1):
            next_slot = (slot + np.uint64(step)) & np.uint64((1 << _SLOT_BITS) - 1)
            found = np.where((found < 0) & (self.slot_keys[next_slot] == keys), self.slot_pieces[next_slot], found)
        return found

    def padded(self, table: np.ndarray) -> np.ndarray:
        """``table[piece, language]`` with the rows that -2, an unknown letter, and -1, no piece, pick."""
        return np.vstack([table, np.full((1, table.shape[1]), self.unknown), np.zeros((1, table.shape[1]))])

    def forward(self, weights: np.ndarray) -> np.ndarray:
        n_words, n, longest, languages = weights.shape
        alpha = np.zeros((n_words, n, languages))
        alpha[:, 0] = 1
        for end in range(1, n):
            size = min(longest, end)
            alpha[:, end] = (weights[:, end, :size] * alpha[:, end - size : end][:, ::-1]).sum(axis=1)
        return alpha

    def backward(self, weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n_words, n, longest, languages = weights.shape
        beta = np.zeros((n_words, n, languages))
        beta[np.arange(n_words), lengths] = 1
        for start in range(n - 2, -1, -1):
            for size in range(1, min(longest, n - 1 - start) + 1):
                beta[:, start] += weights[:, start + size, size - 1] * beta[:, start + size]
        return beta

    def log_words(self, words: list[str], padded: np.ndarray) -> np.ndarray:
        """log P(word) in each language, over all segmentations."""
        out = np.empty((len(words), padded.shape[1]))
        for part in _alike(words):
            arcs, lengths = self.arcs([words[i] for i in part])
            alpha = self.forward(padded[arcs])
            out[part] = np.log(alpha[np.arange(len(part)), lengths] + 1e-300)
        return out

    def expected(self, words: list[str], counts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``counts[w]`` copies of the words, for one language."""
        used, padded = np.zeros(len(self.pieces) + 2), self.padded(table)
        for part in _alike(words):
            arcs, lengths = self.arcs([words[i] for i in part])
            weights = padded[arcs]
            alpha, beta = self.forward(weights)[..., 0], self.backward(weights, lengths)[..., 0]
            total = alpha[np.arange(len(part)), lengths]
            share = counts[part] / np.maximum(total, 1e-300)
            for size in range(1, arcs.shape[2] + 1):
                ends = np.arange(size, arcs.shape[1])
                posterior = alpha[:, ends - size] * weights[:, ends, size - 1, 0] * beta[:, ends] * share[:, None]
                np.add.at(used, arcs[:, ends, size - 1], posterior)
        return used[: len(self.pieces)]


def _alike(words: list[str], at_once: int = 512) -> Iterator[np.ndarray]:
    """Words of about the same length together, so that padding is small."""
    order = np.argsort([len(w) for w in words], kind="stable")
    for start in range(0, len(order), at_once):
        yield order[start : start + at_once]


def _letter_runs(text: str) -> Iterator[str]:
    """Runs of letters, the Unicode classes L; other numerals than digits, such as fractions, are none."""
    for run in WORD_RUN.findall(text):
        if run.isalpha():
            yield run
        else:
            yield from "".join(c if c.isalpha() else " " for c in run).split()


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased, with a mark for the word start; very long runs in parts."""
    out = []
    for run in _letter_runs(text.lower()):
        if len(run) < WORD_CHARS:
            out.append("▁" + run)
        else:
            out += ["▁" * (at == 0) + run[at : at + WORD_CHARS - 1] for at in range(0, len(run), WORD_CHARS - 1)]
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # piece by language
    unknown: float
    model_path: str


def fit(docs: DataFrame, model_path: str, how: Fit = Fit()) -> Model:
    """Learn from text and non-null lang where crc32 of the id modulo 5 is not 0; rows are drawn per language by a hash of the id."""
    learnable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_mod5("doc_id") != 0) & (F.length("text") <= how.max_chars))
    learnable = learnable.select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in learnable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(lang for lang in counts if lang != UNDETERMINED)
    picked = F.lit(False)
    for lang in languages:
        picked = picked | ((F.col("lang") == lang) & hash_share(F.col("doc_id"), how.per_language, counts[lang]))
    used: dict[str, dict[str, int]] = {lang: {} for lang in languages}
    for row in learnable.where(picked).select("lang", "text").toLocalIterator():
        bag = used[row["lang"]]
        for word in words_of(row["text"]):
            bag[word] = bag.get(word, 0) + 1
    pieces = vocabulary(model_path)
    lattice = Lattice(pieces, how.unknown)
    table = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for k, lang in enumerate(languages):
        words = sorted(used[lang])
        n = np.array([used[lang][w] for w in words], dtype=float)
        column = table[:, k : k + 1]
        for _ in range(how.rounds if words else 0):
            expected = lattice.expected(words, n, column) + how.prior
            column = (expected / expected.sum())[:, None]
        table[:, k : k + 1] = column
    return Model(languages, table, how.unknown, model_path)


def predict(docs: DataFrame, model: Model, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` columns, ``lang_pred`` and ``score`` per row of ``docs``, from the whole text alone.

    ``score`` is the posterior of the predicted language among the learned ones, with the
    evidence per word raised to the square root of the number of words, so that long
    texts are not all at 1. A text that is null or has no letter is ``und`` with score
    0, as is every text where no language was learned; ties go to the first language by
    code point. Repeated rows are scored each; an empty table gives an empty one.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    languages, broadcast = model.languages, docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary

    def make():
        known = broadcast.value
        lattice = Lattice(vocabulary(known.model_path), known.unknown)
        padded = lattice.padded(known.table)
        cache: dict[str, int] = {}  # rows of scores
        scores = np.zeros((KEPT_WORDS, len(languages)))
        bags: list[list[str]] = []

        def prepare(rows: list[tuple]) -> None:
            """Score the new words of many texts together."""
            bags[:] = [words_of(r[-1]) if r[-1] else [] for r in reversed(rows)]
            new = list(dict.fromkeys(w for bag in bags for w in bag if w not in cache))
            if len(cache) + len(new) > KEPT_WORDS:
                cache.clear()
                new = list(dict.fromkeys(w for bag in bags for w in bag))
            if new and languages:
                made, start = lattice.log_words(new, padded), len(cache)
                if start + len(new) > len(scores):
                    scores.resize((start + len(new), len(languages)), refcheck=False)
                scores[start : start + len(new)] = made
                cache.update(zip(new, range(start, start + len(new))))

        def one(row) -> Iterator[tuple]:
            words = bags.pop()
            if not words or not languages:
                yield *row[:-1], UNDETERMINED, 0.0
                return
            total = scores[[cache[w] for w in words]].sum(axis=0) / np.sqrt(len(words))
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            yield *row[:-1], languages[best], float(odds[best] / odds.sum())

        one.prepare = prepare
        return one

    return map_rows(docs.select(*carried, F.col("text").alias("_text")), make, f"{schema}, lang_pred string, score double")
