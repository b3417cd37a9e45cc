import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from historymine.llm import queries, toxicity

SCHEMA = "doc_id bigint, text string, lang string, score string, predicted int, _text string"


def brute_kernel(s, t):
    """Sum over the pairs of equal subsequences of three letters, each spanning at most SPAN, at unit length."""

    def features(w):
        out = Counter()
        codes, _ = toxicity.codes_of([w])
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN and codes[i] and codes[j] and codes[k]:
                out[codes[i], codes[j], codes[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    a, b = features(s), features(t)
    norm = lambda f: sum(v * v for v in f.values()) ** 0.5
    return sum(a[k] * b[k] for k in a) / max(1e-12, norm(a) * norm(b))


def documents(n=400):
    draw = random.Random(6)
    syllables = ["the", "an", "er", "ti", "on", "ing", "ha", "re", "es", "éa", "ou"]
    insults = ["blorgit", "snarvel", "quimpod"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(draw.choices(syllables, k=draw.randrange(1, 4))) for _ in range(draw.choice([5, 40, 300]))]
        toxic = int(draw.random() < 0.3)
        if toxic:
            for _ in range(draw.randrange(1, 4)):
                words[draw.randrange(len(words))] = draw.choice(insults)
        docs.append((i, " ".join(words), "en", "x", 1, "y"))
        labels.append((i, toxic))
    return docs, labels


def test_kernel_equals_enumeration():
    words = ["idiot", "i-d-i-o-t", "aaaa", "stupid", "ab", "", "naïve", "日本語日本語", "x" * 20]
    got = toxicity.kernel(words, words)
    assert got == pytest.approx(np.array([[brute_kernel(a, b) for b in words] for a in words]))


def test_decision_equals_landmark_sum():
    docs, labels = documents(150)
    model = toxicity.train([d[1] for d in docs], [t for _, t in labels])
    assert model.values(["blorgit"])[0] > 0 > model.values(["thean"])[0]
    assert model.values(["b.l.o.r.g.i.t", "bloorgit"]).min() > model.values(["thean", "oution"]).max()


def test_held_out(spark):
    docs, labels = documents()
    odd = [(1000, None, "en", "", 0, ""), (1001, "", "en", "", 0, ""), (None, "so blorgit here", "en", "", 0, ""), (1002, "tionher" * 20_000 + "..blorgit!!" + "anouti" * 5, "en", "", 0, ""), (1003, "b l o r g i t", "", "", 0, ""), docs[0]]
    df = spark.createDataFrame(docs + odd, SCHEMA).repartition(3)
    known = spark.createDataFrame(labels + [(None, 1), (5, None), (1001, 0), (7, 0), (7, 1)], "doc_id bigint, toxic int")
    got = toxicity.predict(df, toxicity.fit(df, known), carried=("doc_id", "lang")).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels)
    unseen = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(unseen) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.97
    by_id = {r.doc_id: r.predicted for r in got if r.doc_id not in truth}
    assert by_id == {1000: 0, 1001: 0, None: 1, 1002: 1, 1003: 1}


def test_one_class_no_labels_and_empty(spark):
    docs, labels = documents(20)
    df = spark.createDataFrame(docs, SCHEMA)
    for known in ([], [(i, 0) for i, _ in labels]):
        model = toxicity.fit(df, spark.createDataFrame(known, "doc_id bigint, toxic int"))
        assert {r.predicted for r in toxicity.predict(df, model).collect()} == {0}
    none = spark.createDataFrame([], SCHEMA)
    assert toxicity.predict(none, toxicity.fit(none, spark.createDataFrame([], "doc_id bigint, toxic int"))).collect() == []


def test_held_out_documents(spark):
    got = queries.op5_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = got.where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
