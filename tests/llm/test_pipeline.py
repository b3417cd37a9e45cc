import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from historymine.llm import minhash
from tests.llm.test_bpe import expected
from tests.llm.test_minhash import brute
from tests.llm.test_mixing import brute_targets
from historymine.llm.mixing import Mix

SF = "/root/testdata/sf0.001"
COLUMNS = list(pipeline.COLUMNS)


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and gives."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9000, None, "en", "src0", 0), (9001, "", None, None, None), (9002, "12 + 12", "en", "src0", 7), (None, "words without an id", None, None, 19),
           (9003, "password = hunter2hunter2 for the and of", None, "src1", 40), (9004, "x " * 30_000, "en", "src2", 60_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).repartition(4)
    seen = []
    for name, stage in pipeline.STAGES:
        got = pipeline.stored(stage(spark, docs.withColumn("extra", docs["doc_id"]), SF), f"test-{name}")
        seen.append((name, docs, got))
        docs = got
    return seen


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_columns_between_stages(stages):
    for _, _, got in stages[:-1]:
        assert got.columns == COLUMNS


def test_language_drops_what_has_no_letter(stages):
    _, before, after = stages[0]
    kept = Counter((r[0], r[1], r[3], r[4]) for r in rows(after))
    assert kept == Counter((r[0], r[1], r[3], r[4]) for r in rows(before) if any(c.isalpha() for c in r[1] or ""))
    labelled = {r[0]: r[2] for r in rows(before)}
    assert all(lang == labelled[i] or labelled[i] is None and lang for i, _, lang, *_ in rows(after))


def test_near_duplicates_keep_one_of_each_group(stages):
    _, before, after = stages[1]
    wanted = {i for i, _, _, kept in brute([(r[0], r[1]) for r in rows(before)], minhash.MinHash()) if kept}
    assert {r[0] for r in rows(after) if r[0] is not None} == wanted
    assert Counter(rows(after)) - Counter(rows(before)) == Counter()
    assert [r for r in rows(after) if r[0] is None] == [r for r in rows(before) if r[0] is None]


def test_secrets_are_masked_and_all_documents_stay(stages):
    _, before, after = stages[2]
    old = {r[0]: r for r in rows(before)}
    assert Counter(r[0] for r in rows(after)) == Counter(r[0] for r in rows(before))
    for i, text, lang, source, n_chars in rows(after):
        if text == old[i][1]:
            assert (lang, source, n_chars) == old[i][2:]
        else:
            assert "[secret]" in text and n_chars == len(text)
    masked = {r[0]: r[1] for r in rows(after)}
    assert masked[9003] == "[secret] for the and of"


def test_mix_near_targets(stages):
    _, before, after = stages[3]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, got, longest = Counter(), Counter(), Counter()
    for _, text, _, source, _ in rows(before):
        sizes[source] += size(text)
        longest[source] = max(longest[source], size(text))
    for _, text, _, source, _ in rows(after):
        got[source] += size(text)
    for source, target in brute_targets(sizes, Mix()).items():
        assert abs(got[source] - target) <= longest[source] + 100
    counts = Counter(rows(after))
    assert set(counts) <= set(rows(before)) and max(counts.values()) <= 2


def test_tokens(stages):
    import hashlib

    import numpy as np

    _, before, after = stages[4]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    wanted = []
    for r in rows(before):
        ids, decoded = expected(r[1])
        wanted.append((r[0], len(ids), digest(np.array(ids, dtype="<u4").tobytes()), digest(decoded.encode())))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_unlike_texts_of_one_id_stay(spark):
    """Rows that share an id are repeats of each other only if their texts are; near copies fall across ids."""
    unlike = [" ".join(f"{w}{i}" for i in range(40)) for w in "abc"]
    made = [(1, unlike[0]), (1, unlike[1]), (1, unlike[1]), (2, unlike[1] + " z"), (3, None), (3, unlike[2]), (4, unlike[2]), (None, unlike[0]), (None, unlike[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in made], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = pipeline.near_duplicates(spark, docs, "")
    assert got.columns == COLUMNS
    found = Counter((r[0], r[1]) for r in rows(got))
    families = Counter({unlike[0]: 3, unlike[1]: 1, unlike[2]: 1, None: 1})
    assert Counter((t or "").removesuffix(" z") or None for _, t in found.elements()) == families
    assert found[None, unlike[0]] == 2 and found[1, unlike[0]] + found[1, unlike[1]] >= 1
