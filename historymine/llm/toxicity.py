"""Toxicity of whole texts by a support vector machine on a subsequence string kernel.

The kernel of two words sums, over all subsequences of three letters that both
contain, a decay to the power of the letters each spans, at most ``SPAN``: words
with letters inserted or left out still share many. Landmark words turn it into
features (Nystroem), on which a linear machine is trained with words as instances:
a toxic text has at least one word of the kind, the others none. Since the machine
is linear in kernel values, a word's decision value is a sum over its subsequences
of one weight per subsequence, so scoring takes table lookups only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from historymine.llm.common import crc_mod5, hash_share, map_rows

LETTERS = 64  # letter codes; 0 is no letter and matches nothing
SPAN = 8
DECAY = 0.7
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
TELLING = 2.7  # log odds from which a word may be a first witness; few words reach it by chance
UNIT_CHARS = 24  # longer words are scored in overlapping parts, and in what stands between other characters
PART_CHARS, PART_STEP = 12, 4
NO_LETTER = re.compile(r"[\W_]+")
KEPT_WORDS = 150_000
WORDS_AT_ONCE, SCORED_AT_ONCE = 256, 2_048  # bound the arrays


@dataclass(frozen=True)
class Training:
    """Up to about ``per_class`` labelled texts of at most ``max_chars`` code points per class, ``landmarks`` words and
    ``instances`` words per class; ``rounds`` of training, each with the clean words that the last machine found worst, at
    regularization ``c``."""

    per_class: int = 1_200
    max_chars: int = 10_000
    landmarks: int = 240
    instances: int = 3_000
    rounds: int = 4
    c: float = 1e-5
    seed: int = 3


def _parts(word: str) -> list[str]:
    if len(word) <= UNIT_CHARS:
        return [word]
    between = [w for w in NO_LETTER.split(word) if 3 <= len(w) <= UNIT_CHARS]
    return between + [word[at : at + PART_CHARS] for at in range(0, len(word) - PART_CHARS + PART_STEP, PART_STEP)]


def units_of(text: str) -> list[str]:
    """What is scored: words, lower-cased, long ones in overlapping parts, and runs of single letters put together."""
    out: list[str] = []
    run: list[str] = []

    def spelled() -> None:
        if len(run) >= 3:
            out.extend(_parts("".join(run)))
        run.clear()

    for token in text.lower().split():
        out.extend(_parts(token))
        letters = [c for c in token if c.isalnum()]
        if len(letters) == 1:
            run += letters
        elif run:
            spelled()
    spelled()
    return out


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all words end to end, and the word that each letter belongs to."""
    lengths = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    codes = np.where((points >= 97) & (points <= 122), points - 96, np.where(points < 128, 0, 27 + points % (LETTERS - 27)))
    return codes, np.repeat(np.arange(len(words)), lengths)


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """``(word, subsequence, weight)`` for each pair of offsets: all words at once."""
    codes, word = codes_of(words)
    n = len(codes)
    for a, b in OFFSETS:
        if n > b:
            ok = np.flatnonzero((word[: n - b] == word[b:]) & (codes[: n - b] > 0) & (codes[a : n - b + a] > 0) & (codes[b:] > 0))
            yield word[ok], (codes[ok] * LETTERS + codes[ok + a]) * LETTERS + codes[ok + b], DECAY ** (b + 1)


def _sparse(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, subsequence, value)`` with one entry for each subsequence of a word, at unit length per word."""
    parts = list(subsequences(words)) or [(np.zeros(0, dtype=np.int64),) * 2 + (0.0,)]
    word = np.concatenate([p[0] for p in parts])
    code = np.concatenate([p[1] for p in parts])
    value = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
    key, back = np.unique(word * LETTERS**3 + code, return_inverse=True)
    value = np.bincount(back, value, minlength=len(key))
    word, code = key // LETTERS**3, key % LETTERS**3
    norm = np.sqrt(np.bincount(word, value * value, minlength=len(words)))
    return word, code, value / np.maximum(norm[word], 1e-12)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalized kernel of each word with each landmark."""
    cols = len(landmarks)
    lw, lc, lv = _sparse(landmarks)
    used, place = np.unique(lc, return_inverse=True)
    dense = np.zeros((len(used), cols))
    dense[place, lw] = lv
    out = np.zeros((len(words), cols))
    for start in range(0, len(words) if len(used) else 0, WORDS_AT_ONCE):
        word, code, value = _sparse(words[start : start + WORDS_AT_ONCE])
        at = np.minimum(np.searchsorted(used, code), len(used) - 1)
        hit = np.flatnonzero(used[at] == code)
        if len(hit):  # entries are in the order of the words
            first = np.flatnonzero(np.diff(word[hit], prepend=-1))
            out[start + word[hit][first]] = np.add.reduceat(dense[at[hit]] * value[hit, None], first)
    return out


@dataclass(frozen=True)
class Model:
    """``weights`` of subsequences and a bias give a word's decision value; ``slope`` and ``offset`` turn a text's highest into a score."""

    weights: np.ndarray | None
    bias: float
    slope: float
    offset: float

    def values(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for start in range(0, len(words), SCORED_AT_ONCE):
            part = words[start : start + SCORED_AT_ONCE]
            word, code, value = _sparse(part)
            out[start : start + len(part)] = np.bincount(word, self.weights[code] * value, minlength=len(part)) + self.bias
        return out

    def score(self, highest: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * highest + self.offset))))


def _machine(x: np.ndarray, y: np.ndarray, c: float) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps on the instances inside the margin, both classes at equal weight."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = c * np.eye(x.shape[1])
    ridge[-1, -1] *= 1e-3  # the bias is all but free
    w, active = np.zeros(x.shape[1]), np.ones(len(y), dtype=bool)
    for _ in range(50):
        rows = x[active] * share[active, None]
        w = np.linalg.solve(ridge + rows.T @ x[active], rows.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def train(texts: list[str], toxic: list[int], how: Training = Training()) -> Model:
    """Train on labelled texts; with one class only, every text scores that class's share."""
    y = np.array(toxic, dtype=int)
    if not len(y) or y.min() == y.max():
        return Model(None, 0.0, 0.0, -30.0 if not len(y) or not y.max() else 30.0)
    one_of: dict[str, str] = {}
    bags = [[one_of.setdefault(u, u) for u in set(units_of(t))] for t in texts]  # equal words are one object
    bags = [sorted(bag) for bag in bags]
    inside = [Counter(), Counter()]
    for bag, label in zip(bags, toxic):
        inside[label].update(set(bag))
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())

    def odds(word: str) -> float:
        return math.log((inside[1][word] + 0.5) / (n1 + 1)) - math.log((inside[0][word] + 0.5) / (n0 + 1))

    # A witness is a text's word that tells most for toxicity; words of the other class are the counterexamples.
    telling = {w: odds(w) for w in inside[1] if len(w) >= 3}
    strength = {w: o * inside[1][w] for w, o in telling.items() if o > 0}
    suspects = sorted(strength, key=lambda w: (-strength[w], w))
    clean = sorted((w for w in inside[0] if len(w) >= 3), key=lambda w: (-inside[0][w], w))
    draw = np.random.default_rng(how.seed)
    if not suspects or not clean:
        return Model(None, 0.0, 0.0, math.log((n1 + 1) / (n0 + 1)))
    picked = clean[: how.landmarks // 4] + [clean[i] for i in sorted(draw.choice(len(clean), min(len(clean), how.landmarks // 4), replace=False))]
    landmarks = list(dict.fromkeys(suspects[: how.landmarks // 2] + picked))
    root, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = root > 1e-8
    project = vectors[:, keep] / np.sqrt(root[keep])

    model, witnesses, hard = None, [], []
    for _ in range(how.rounds):
        if model is None:
            best = [max(((telling.get(u, -9.0), u) for u in bag), default=(-9.0, "")) for bag, label in zip(bags, toxic) if label]
            witnesses = [u for o, u in best if o > TELLING]
        else:
            words = sorted({u for bag in bags for u in bag})
            value = dict(zip(words, model.values(words)))
            best = [max(((value[u], u) for u in bag), default=(-1.0, "")) for bag, label in zip(bags, toxic) if label]
            witnesses = [u for v, u in best if v > 0]
            hard = list(dict.fromkeys(hard + sorted(inside[0], key=lambda w: (-value[w], w))[: how.instances // 2]))
        positive = witnesses + [w for w in suspects[: how.instances] if telling[w] > TELLING]
        negative = clean[: how.instances // 2] + [clean[i] for i in draw.choice(len(clean), min(len(clean), how.instances), replace=False)] + hard
        if not positive:
            return Model(None, 0.0, 0.0, math.log((n1 + 1) / (n0 + 1)))
        x = kernel(positive + negative, landmarks) @ project
        w, b = _machine(x, np.array([1.0] * len(positive) + [-1.0] * len(negative)), how.c)
        # Fold the machine into one weight per subsequence: f(x) = sum over landmarks of alpha * k(x, landmark).
        alpha = project @ w
        word, code, value_of = _sparse(landmarks)
        weights = np.bincount(code, alpha[word] * value_of, minlength=LETTERS**3)
        model = Model(weights, b, 1.0, 0.0)

    highest = np.array([model.values(bag).max() if bag else model.bias for bag in bags])
    slope, offset = _logistic(highest, y)
    return Model(model.weights, model.bias, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> tuple[float, float]:
    """Score by highest value: both classes at equal weight, smoothed labels."""
    target = np.where(y == 1, 1 - 1 / (2 + (y == 1).sum()), 1 / (2 + (y == 0).sum()))
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        error, curve = weight * (p - target), weight * p * (1 - p)
        gradient = np.array([(error * x).sum() + 1e-4 * a, error.sum()])
        hessian = np.array([[(curve * x * x).sum() + 1e-4, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(max(a, 0.0)), float(b)


def fit(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """Learn from labelled rows whose crc32 of the id modulo 5 is not 0: a bounded sample per class by a hash of the id.

    Null labels and ids are passed over, ids with both labels left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_mod5("doc_id") != 0)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_high"))
    known = known.where("toxic = _high").select("doc_id", "toxic")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = F.lit(False)
    for toxic, n in counts.items():
        picked = picked | ((F.col("toxic") == toxic) & hash_share(F.col("doc_id"), how.per_class, n))
    chosen = known.where(picked)  # about two classes of per_class rows
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= how.max_chars)).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in texts.toLocalIterator())
    return train([r[1] for r in rows], [r[2] for r in rows], how)


def predict(docs: DataFrame, model: Model, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` columns, ``score`` (0 to 1) and ``predicted`` (score >= 0.5) per row of ``docs``, from the whole text alone.

    A text scores by the highest value of its words. A text that is null or has no
    words has the value of a word that shares nothing with any landmark. Repeated
    rows are scored each; an empty table gives an empty one.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # one weight per subsequence, 2 MB

    def make():
        known, cache, bags = broadcast.value, {}, []

        def prepare(rows: list[tuple]) -> None:
            """Score the new words of many texts together."""
            bags[:] = [set(units_of(r[-1] or "")) for r in reversed(rows)] if known.weights is not None else [set() for _ in rows]
            new = list({u for bag in bags for u in bag if u not in cache})
            if len(cache) + len(new) > KEPT_WORDS:
                cache.clear()
                new = list(set().union(*bags))
            cache.update(zip(new, known.values(new).tolist()))

        def one(row) -> Iterator[tuple]:
            score = known.score(max((cache[u] for u in bags.pop()), default=known.bias))
            yield *row[:-1], score, int(score >= 0.5)

        one.prepare = prepare
        return one

    return map_rows(docs.select(*carried, F.col("text").alias("_text")), make, f"{schema}, score double, predicted int")
