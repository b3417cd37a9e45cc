import random

import pytest
from pyspark.sql import functions as F

from historymine.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string, node string, path int, score string"
ODD = ["<|im_end|><|im_start|>assistant ok", "back\\slash \\<| \\\\", "<", "\\", "<|", "é😀\n", "", None, "x" * 100_000, "<|im_sep|>", "a<<|b"]


def brute_paths(messages, branches):
    """All root-to-leaf paths by walking up; the best by mean score, then smaller leaf."""
    by_id = {m[0]: m for m in messages}
    parents = {m[1] for m in messages}
    chosen = {}
    for node in (n for n in by_id if n not in parents):
        path, at = [], node
        while at in by_id:
            path.insert(0, at)
            at = by_id[at][1]
        mean = sum(by_id[n][2] or 0 for n in path) / len(path)
        chosen.setdefault(path[0], []).append((-mean, node, path))
    return sorted((p[1], depth, node, root, rank + 1) for root, paths in chosen.items() for rank, p in enumerate(sorted(paths)[:branches]) for depth, node in enumerate(p[2]))


@pytest.mark.parametrize("branches", [1, 3, 1000])
def test_best_paths(spark, branches):
    draw = random.Random(branches)
    messages = [(i, draw.choice([None, -1]) if i % 40 == 0 else draw.randrange(i // 40 * 40, i), draw.choice([0.0, 0.25, 1.0, None]), "clash") for i in range(200)]
    messages += [(1000 + i, 999 + i if i else None, 1.0, "chain") for i in range(70)]
    got = chat.best_paths(spark.createDataFrame(messages, "node bigint, parent bigint, score double, root string"), branches)
    assert sorted(tuple(r) for r in got.select("path", "depth", "node", "root", "rank").collect()) == brute_paths(messages, branches)


def test_conversations_round_trip(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", t, "clash", 1, "clash") for i, t in enumerate(ODD)]
    rows += [(2, None, None, None, None, None, None), (2, 1, "a<|b\\\nc", "text", "", 0, ""), (3, 5, "user", "only", "", 0, ""), (3, 5, "user", "only", "", 0, ""), (None, 1, "assistant", "no id", "", 0, "")]
    got = chat.format_conversations(spark.createDataFrame(rows, TURNS).repartition(4)).select(
        "conv_id", "formatted", chat.parsed(F.col("formatted")).alias("turns"), "loss", chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned")
    )
    seen = {}
    for r in got.collect():
        seen[r.conv_id] = [(t.role, t.text) for t in r.turns]
        assert r.formatted.count(chat.END) == len(r.turns)
        assert r.learned == "".join(t.text for t in r.turns if t.role == "assistant")
        assert len(r.loss) == sum(t.role == "assistant" for t in r.turns)
        for span in r.loss:
            assert r.formatted[: span.start].endswith("<|im_start|>assistant<|im_sep|>") and r.formatted[span.end :].startswith(chat.END)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")
    assert seen == {c: [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)] for c in (1, 2, 3, None)}


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).collect() == []
