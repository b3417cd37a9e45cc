import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from historymine.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TREE = bpe.TreeBpe(PATH)
PARTS = ["a", "th", "ing", "lo", "'", "'s", "!", "$$", "é", "é", "J̌", "İ", "ß", "本", "😀", "12", " ", "\n", " ", "\x1c", "\x85", "<|endoftext|>", "<|ENDOFTEXT|>", "<|start"]
SCHEMA = "doc_id bigint, text string, id string, ids int"


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def unpack(ids):
    return np.frombuffer(ids, dtype="<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=400).map("".join), st.integers(1, 60))
def test_tree_equals_library(text, leaf):
    assert unpack(TREE.encode_short(text)) == expected(text)[0]
    ids = []
    for special, part in TREE.segments(text):
        leaves = [(t := part[i : i + leaf], np.array(unpack(TREE.encode_leaf(t)), dtype=np.int64)) for i in range(0, len(part), leaf)]
        ids += [special] if special >= 0 else TREE.join_all(leaves).tolist()
    assert ids == expected(text)[0]


@pytest.mark.parametrize("leaf_chars", [5, 100, bpe.LEAF_CHARS])
def test_encode_rows(spark, leaf_chars):
    long_text = "".join(PARTS * 40)
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "It's 12 o'clock", None, None), (3, long_text, "x", 1), (3, long_text, "x", 1),
            (3, "other text of the same id", "", 0), (4, "x" * 3000, "", 0), (None, long_text, "", 0), (5, "<|endoftext|>" * 9, "", 0)]
    got = sorted(((r.id, unpack(r.ids), r.decoded) for r in bpe.encode(spark.createDataFrame(rows, SCHEMA), PATH, leaf_chars=leaf_chars).collect()), key=repr)
    assert got == sorted(((r[0], *expected(r[1])) for r in rows), key=repr)


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_many_equal_long_rows_are_joined_once(spark):
    """10,000 copies of a long text, with one id and without, meet as one row of leaves."""
    text = "".join(PARTS * 30)
    rows = spark.range(10_000).selectExpr("IF(id % 2 = 0, 7, NULL) AS doc_id").crossJoin(spark.createDataFrame([(text,)], "text string"))
    got = bpe.encode(rows, PATH, leaf_chars=500).groupBy("id", "ids", "decoded").count().collect()
    assert sorted((r.id is None, unpack(r.ids), r["count"]) for r in got) == [(k, expected(text)[0], 5000) for k in (False, True)]
