import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from historymine.llm import langid, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, score string, lang_pred int, _text string"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "rest"], "bb": ["sch", "ein", "ung", "er", "tz"], "cc": ["que", "ment", "eau", "oi", "re"]}


def text(draw, lang, n):
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randrange(1, 5))) for _ in range(n))


def documents():
    draw = random.Random(8)
    return [(i, text(draw, lang, draw.choice([3, 30, 200])), lang, "x", 1, "y") for i, lang in enumerate(draw.choices(list(SYLLABLES), k=300))]


def brute_word(word, probability, unknown):
    """Sum over all segmentations, by enumeration."""
    if not word:
        return 1.0
    total = 0.0
    for size in range(1, len(word) + 1):
        p = probability.get(word[:size], unknown if size == 1 else 0.0)
        total += p * brute_word(word[size:], probability, unknown) if p else 0.0
    return total


def test_forward_sums_all_segmentations():
    pieces = langid.vocabulary(PATH)
    lattice = langid.Lattice(pieces, 1e-4)
    table = np.random.default_rng(0).random((len(pieces), 2))
    words = ["▁the", "▁schein", "▁ñqueéx", "▁", "日本", "a", "▁walking"]
    got = lattice.log_words(words, lattice.padded(table))
    for k in range(2):
        probability = {p: table[i, k] for p, i in pieces.items()}
        assert got[:, k] == pytest.approx([math.log(brute_word(w, probability, 1e-4)) for w in words])


def test_expected_uses():
    pieces = langid.vocabulary(PATH)
    lattice = langid.Lattice(pieces, 1e-4)
    table = np.random.default_rng(1).random((len(pieces), 1))
    used = lattice.expected(["▁hand"], np.array([3.0]), table)
    # each segmentation covers every letter once
    assert sum(used[i] * len(p) for p, i in pieces.items()) == pytest.approx(3 * len("▁hand"), rel=1e-3)


def test_held_out(spark):
    rows = documents()
    extra = [(1000, None, "aa", "", 0, ""), (1001, "", "bb", "", 0, ""), (1002, "12 34 !! _", None, "", 0, ""), (None, "kalomi tulo", None, "", 0, ""), (1003, "einung" * 40_000, None, "", 0, ""), rows[0]]
    df = spark.createDataFrame(rows + extra, SCHEMA).repartition(3)
    model = langid.fit(df, PATH)
    got = langid.predict(df, model, carried=("doc_id", "lang")).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(unseen) > 40 and np.mean([r.lang_pred == r.lang for r in unseen]) > 0.95
    by_id = {r.doc_id: r.lang_pred for r in got if r.doc_id is None or r.doc_id >= 1000}
    assert by_id == {1000: "und", 1001: "und", 1002: "und", None: "aa", 1003: "bb"}


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "some text", None, "", 0, "")], SCHEMA)
    assert [tuple(r) for r in langid.predict(df, langid.fit(df, PATH)).collect()] == [(1, "und", 0.0)]
    none = spark.createDataFrame([], SCHEMA)
    assert langid.predict(none, langid.fit(none, PATH)).collect() == []


def test_held_out_documents(spark):
    got = queries.op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    rows = got.where("held_out and n_chars > 20").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_numerals_are_no_letters(spark):
    """Fractions, circled and superscript numbers and Roman numerals have no letter, as in the filter of the fit."""
    assert langid.words_of("½ ² ① Ⅳ 一 x½y") == ["▁一", "▁x", "▁y"]
    model = langid.fit(spark.createDataFrame(documents(), SCHEMA), PATH)
    texts = ["½ ² ①", "Ⅳ ⅸ", "12 !", None, "", "kalo½"]
    got = langid.predict(spark.createDataFrame([(i, t, None, "x", 1, "y") for i, t in enumerate(texts)], SCHEMA), model).collect()
    assert {r.doc_id: r.lang_pred == "und" for r in got} == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False}
    assert [i for i, t in enumerate(texts) if spark.createDataFrame([(t,)], "t string").where(r"t rlike '\\p{L}'").count()] == [5]
