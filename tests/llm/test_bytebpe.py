import base64

import numpy as np
import public_tokenizers
import tiktoken

from historymine.llm import bytebpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SCHEMA = "doc_id bigint, text string, id string, ids int"
PARTS = ["a", "th", "ing", " the", "'", "'ll", "!", "$$", "é", "ß", "本", "😀", "12", "²", " ", "  ", "\n", "\t \n", " ", "　", "\x00", "\x1c", "\x85", " ", "", "<|endoftext|>", "____", "====", "a" * 9]


def expected(text):
    return LIBRARY.encode_ordinary(text or "")


def encoded(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    got = bytebpe.encode(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    return {r.id: (np.frombuffer(r.ids, dtype="<u4").tolist(), bytes(r.decoded)) for r in got}


def texts_of(seed, number, longest):
    drawn = np.random.default_rng(seed)
    return ["".join(drawn.choice(PARTS, drawn.integers(longest))) for _ in range(number)]


def test_equals_library(spark):
    texts = texts_of(1, 300, 60) + texts_of(2, 5, 3000) + ["", " ", "  x", "x  ", "\n\n", "!", "!!!!", " " * 500, "\n" * 300 + "x"]
    got = encoded(spark, texts)
    assert [got[i] for i in range(len(texts))] == [(expected(t), t.encode()) for t in texts]


def test_long_words(spark):
    drawn = np.random.default_rng(3)
    letters = "".join(drawn.choice(list("etaoinshrdlu"), 6000))
    texts = ["x" * 200_000, "=" * 70_000, "-" * 129, "ab" * 5000, letters, letters[:97], "本語" * 900, "😀" * 700, "ÃÂ" * 2000, " " + "=" * 300 + "+" * 77 + "=" * 5000]
    got = encoded(spark, texts)
    assert [got[i] for i in range(len(texts))] == [(expected(t), t.encode()) for t in texts]


def test_every_frequent_word_is_encoded_once(spark):
    """Words of the table and words folded in their text give the same ids, whatever share of the words the table holds."""
    texts = [" ".join(["common", "words", str(i), "x" * (i % 40)]) for i in range(400)]
    got = encoded(spark, texts)
    assert [got[i][0] for i in range(len(texts))] == [expected(t) for t in texts]
    table = bytebpe.frequent(spark.createDataFrame([(t,) for t in texts], "text string"), bytebpe.read_ranks(PATH))
    assert len(table) == bytebpe.SLOTS and any(f"{bytebpe._KEY} words{bytebpe._VALUE}" in slot for slot in table)


def test_most_frequent_word_of_a_slot_is_last(spark):
    """Slots are searched from their end, so a frequent word does not cost a search of its whole slot."""
    words = [f"w{i}" for i in range(4000)]
    texts = spark.createDataFrame([(" ".join([w] * (1 + i % 7)),) for i, w in enumerate(words)], "text string")
    slots = [slot.split(bytebpe._KEY)[1:] for slot in bytebpe.frequent(texts, bytebpe.read_ranks(PATH))]
    counts = {f" {w}": i % 7 for i, w in enumerate(words)}
    found = [[counts[w] for w in (entry.split(bytebpe._VALUE)[0] for entry in slot) if w in counts] for slot in slots]
    assert any(len(set(n)) > 1 for n in found) and all(n == sorted(n) for n in found)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "It's 12 o'clock", None, None), (3, "twice", "x", 1), (3, "twice", "x", 1), (3, "other", "", 0)]
    got = bytebpe.encode(spark.createDataFrame(rows, SCHEMA), PATH)
    assert got.columns == ["id", "ids", "decoded"]
    found = sorted(((r.id, np.frombuffer(r.ids, dtype="<u4").tolist(), bytes(r.decoded)) for r in got.collect()), key=repr)
    assert found == sorted(((r[0], expected(r[1]), (r[1] or "").encode()) for r in rows), key=repr)
    assert bytebpe.encode(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_classes_of_characters(spark):
    """Words are cut alike for every assigned character, alone and between letters."""
    points = [c for c in range(1, 0x3000) if chr(c).isprintable() or chr(c).isspace()]
    texts = ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in points[i : i + 50]) for i in range(0, len(points), 50)]
    got = encoded(spark, texts)
    wrong = [chr(points[50 * i]) for i, t in enumerate(texts) if got[i][0] != expected(t)]
    assert wrong == []
