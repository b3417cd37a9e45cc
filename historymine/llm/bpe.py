"""Byte-pair encoding of whole texts by tree concatenation.

A long text is normalized as a whole, cut into leaves, and the leaves are
encoded as rows of their own, so one text keeps many tasks busy. Neighbours
are then joined pairwise, level by level. At each join a window around the cut
is encoded again and grown until two adjacent tokens of the left side and two
of the right side reappear in it: tokens are taken from the left side up to the
first agreement, from the window up to the second, from the right side after it.

Positions are counted in bytes of the text without white space. White space is
in no token, so a token's end is the sum of the lengths of the tokens so far.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from historymine.llm.common import map_rows

LEAF_CHARS = 16_384
UNSPLIT_CHARS = 256  # a piece without white space beyond this is encoded as a tree too
FIRST_WINDOW = 24
CACHED_PIECES = 200_000

_SPACES = re.compile(r"[ \n\t\r]+")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes are themselves, others follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class TreeBpe:
    """A tokenizer file of the ``tokenizers`` library, applied by tree concatenation."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = dict(spec, normalizer=None, truncation=None, padding=None)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.plain = Tokenizer.from_str(json.dumps(plain))  # for text that is normalized already
        self.plain.encode_special_tokens = True
        self.normalizer = self.whole.normalizer
        self.at_specials = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        suffix = spec["model"].get("end_of_word_suffix") or ""
        size = self.whole.get_vocab_size(with_added_tokens=True)
        tokens = [self.whole.id_to_token(i) or "" for i in range(size)]
        self.tokens = np.array(tokens, dtype=object)
        self.n_bytes = np.array([len(t.removesuffix(suffix)) for t in tokens], dtype=np.int64)
        self.caches: dict[str, dict[str, bytes]] = {"whole": {}, "plain": {}}

    # Pieces between white space never share a token, so each distinct one is encoded once.
    def _pieces(self, text: str, kind: str) -> bytes:
        cache = self.caches[kind]
        pieces = [p for p in _SPACES.split(text) if p]
        new = [p for p in dict.fromkeys(pieces) if p not in cache]
        if new:
            if len(cache) + len(new) > CACHED_PIECES:
                cache.clear()
                new = list(dict.fromkeys(pieces))
            self._encode_new(new, cache, kind)
        return b"".join([cache[p] for p in pieces])

    def _encode_new(self, new: list[str], cache: dict[str, bytes], kind: str) -> None:
        """Encode distinct pieces; plain ones together, as one text, which is cut again by the lengths of its tokens."""
        together = []
        for piece in new:
            if len(piece) > UNSPLIT_CHARS:
                cache[piece] = self._tree(piece) if kind == "whole" else self._halves(piece)
            elif kind == "whole" and ("<|" in piece or piece.split() != [piece]):
                cache[piece] = self._tree(piece)
            else:
                together.append(piece)
        if not together:
            return
        text = " ".join(together)
        if kind == "whole":
            text = self.normalizer.normalize_str(text)
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.cumsum(self.n_bytes[ids])
        wanted = np.cumsum([len(part.encode()) for part in text.split(" ")])
        cuts = np.searchsorted(ends, wanted, side="right")
        start = 0
        for piece, cut in zip(together, cuts.tolist(), strict=True):
            cache[piece] = ids[start:cut].tobytes()
            start = cut

    def encode_short(self, text: str) -> bytes:
        return self._pieces(text, "whole")

    def encode_leaf(self, normalized: str) -> bytes:
        return self._pieces(normalized, "plain")

    def segments(self, text: str) -> Iterator[tuple[int, str]]:
        """``(special id or -1, normalized text)``: special strings stand on their own."""
        for part in self.at_specials.split(text):
            if part in self.specials:
                yield self.specials[part], ""
            elif part:
                yield -1, self.normalizer.normalize_str(part)

    def _tree(self, text: str) -> bytes:
        """One piece, its halves encoded in this task."""
        return b"".join(
            self._halves(part) if special < 0 else np.array([special], dtype="<u4").tobytes()
            for special, part in self.segments(text)
        )

    def _halves(self, text: str) -> bytes:
        if len(text) <= UNSPLIT_CHARS:
            return self._window(text).astype("<u4").tobytes()
        cuts = range(0, len(text), UNSPLIT_CHARS)
        leaves = [(t := text[a : a + UNSPLIT_CHARS], self._window(t)) for a in cuts]
        return self.join_all(leaves).astype("<u4").tobytes()

    def _window(self, text: str) -> np.ndarray:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype=np.int64)

    def join_all(self, leaves: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """Join neighbours pairwise, level by level."""
        while len(leaves) > 1:
            pairs = [self.join(*leaves[i], *leaves[i + 1]) for i in range(0, len(leaves) - 1, 2)]
            leaves = pairs + leaves[len(leaves) - len(leaves) % 2 :]
        return leaves[0][1] if leaves else np.array([], dtype=np.int64)

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> tuple[str, np.ndarray]:
        """Exact tokens of ``left + right`` from those of both sides."""
        reach = FIRST_WINDOW
        while True:
            tail, head = left[-reach:], right[:reach]
            w = self._window(tail + head)
            ends = np.cumsum(self.n_bytes[w])
            cut = _bytes(tail)
            first = (0, 0) if len(tail) == len(left) else self._agree(a, w, ends, cut, left_side=True)
            last = (len(b), len(w)) if len(head) == len(right) else self._agree(b, w, ends, cut, left_side=False)
            if first and last and first[1] <= last[1]:
                return left + right, np.concatenate([a[: first[0]], w[first[1] : last[1]], b[last[0] :]])
            reach *= 2

    def _agree(self, side: np.ndarray, w: np.ndarray, ends: np.ndarray, cut: int, left_side: bool) -> tuple[int, int] | None:
        """``(index in side, index in window)`` of a boundary with the same token before and after it in both."""
        starts = ends - self.n_bytes[w]
        if left_side:
            # Bytes from a token's end to the cut are its place on both sides.
            near = side[-len(w) - 1 :]
            offset = len(side) - len(near)
            place = cut - (np.cumsum(self.n_bytes[near][::-1])[::-1] - self.n_bytes[near])  # ends in window positions
            at = {int(p): i for i, p in enumerate(place)}
            for j in range(len(w) - 1, 0, -1):
                i = at.get(int(starts[j]))  # near[i] ends where w[j] starts
                if ends[j] <= cut and i is not None and i + 1 < len(near) and near[i] == w[j - 1] and near[i + 1] == w[j]:
                    return offset + i + 1, j
            return None
        near = side[: len(w) + 1]
        place = cut + np.cumsum(self.n_bytes[near])
        at = {int(p): i for i, p in enumerate(place)}
        for j in range(1, len(w)):
            i = at.get(int(starts[j]))
            if starts[j - 1] >= cut and i is not None and i + 1 < len(near) and near[i] == w[j - 1] and near[i + 1] == w[j]:
                return i + 1, j
        return None

    def decode(self, ids: np.ndarray) -> str:
        """What the library's decode gives for a file without decoder: tokens with a space between."""
        return " ".join(self.tokens[ids])


def _bytes(text: str) -> int:
    """Bytes that tokens cover; white space of a normalized text is the space alone."""
    return len(text.replace(" ", "").encode())


@functools.cache
def tree_bpe(path: str) -> TreeBpe:
    """One instance per Python worker, so that its cached pieces serve all tasks of the worker."""
    return TreeBpe(path)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``(id, ids, decoded)`` per row of ``docs``.

    ``ids`` are little-endian unsigned 32-bit integers as one binary value;
    ``decoded`` is the text of these ids. Texts up to ``leaf_chars`` code points
    are encoded where they are read; only longer ones are cut and shuffled.

    A null text counts as empty and gives no ids; rows that are repeated or have a
    null or repeated id keep their own result rows; an empty table gives an empty
    one; other columns of any name are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {id_type}, ids binary, decoded string"

    def short():
        bpe = tree_bpe(tokenizer_path)

        def one(row):
            ids = bpe.encode_short(row[1])
            yield row[0], ids, bpe.decode(np.frombuffer(ids, dtype="<u4"))

        return one

    def cut():
        bpe = tree_bpe(tokenizer_path)

        def one(row):
            leaf = 0
            for special, text in bpe.segments(row[1]):
                for at in range(0, max(1, len(text)), leaf_chars):
                    yield row[0], row[2], leaf, special, at > 0, text[at : at + leaf_chars]
                    leaf += 1

        return one

    def leaf():
        bpe = tree_bpe(tokenizer_path)

        def one(row):
            ids = bpe.encode_leaf(row[5]) if row[3] < 0 else np.array([row[3]], dtype="<u4").tobytes()
            yield *row, ids

        return one

    def joined(key, group):
        import pandas as pd

        bpe = tree_bpe(tokenizer_path)
        runs: list[list[tuple[str, np.ndarray]]] = []
        for r in group.sort_values("leaf").itertuples():
            part = (r.text, np.frombuffer(r.ids, dtype="<u4").astype(np.int64))
            if r.follows:
                runs[-1].append(part)
            else:
                runs.append([part])
        ids = np.concatenate([bpe.join_all(run) for run in runs])
        made = {"id": [group["id"].iloc[0]], "ids": [ids.astype("<u4").tobytes()], "decoded": [bpe.decode(ids)], "copies": [group["copies"].iloc[0]]}
        return pd.DataFrame(made)

    long_rows = rows.where(F.length("text") > leaf_chars).withColumn("digest", F.sha1(F.col("text").cast("binary")))
    key = f"id {id_type}, digest string, leaf int, special int, follows boolean, text string"
    # Rows that repeat have the same leaves; each is shuffled, encoded and joined once.
    same = [F.first(c).alias(c) for c in ("special", "follows", "text")]
    leaves = map_rows(long_rows, cut, key).groupBy("id", "digest", "leaf").agg(*same, F.count(F.lit(1)).alias("copies"))
    leaves = leaves.select("id", "digest", "leaf", "special", "follows", "text", "copies")
    encoded = map_rows(leaves, leaf, f"{key}, copies bigint, ids binary")
    once = encoded.groupBy("id", "digest").applyInPandas(joined, f"{schema}, copies bigint")
    whole = once.select("id", "ids", "decoded", F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).drop("_copy")
    return map_rows(rows.where(F.length("text") <= leaf_chars), short, schema).unionByName(whole)
