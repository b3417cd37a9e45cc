import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from historymine.llm import alignment
from historymine.llm.bpe import _byte_alphabet

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
ALPHABET = _byte_alphabet()
PARTS = ["a", "th", "ing", " the", " of", "'ll", "!", "é", "ß", "本", "😀", "12", " ", "  ", "\n", "\t", " ", "　", "\x00", "\x1c", "\x85", "▁", "<|endoftext|>", "</s>", "==", "﷽"]
SCHEMA = "doc_id bigint, text string, digest string, copies int, pair string"


def tokens(text):
    """Ids and bytes of whole texts, by both libraries."""
    a, b = A.encode(" " + text, add_special_tokens=False), B.encode(text)
    a_bytes = [bytes(ALPHABET[c] for c in t) for t in a.tokens]
    b_bytes = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [B.id_to_piece(i)]]
    return list(zip(a.ids, a_bytes)), list(zip(b, b_bytes))


def groups_of(text):
    if not text:
        return []
    a, b = tokens(text)
    data = (" " + text).encode()
    if b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
        return []
    ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
    groups, now, at = [], ([], []), [0, 0]
    for cut in sorted(ends[0] & ends[1]):
        for side, (found, ids) in enumerate(zip((a, b), now)):
            place = sum(len(x) for _, x in found[: at[side]])
            while place < cut:
                ids.append(found[at[side]][0])
                place += len(found[at[side]][1])
                at[side] += 1
        groups.append(now)
        now = ([], [])
    return groups


def brute(rows):
    """Result rows, from the statement of the task."""
    found = [(doc_id, groups_of(text)) for doc_id, text in rows]
    linked = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in found]
    counts = Counter(pair for links in linked for pair in links)
    highest = {}
    for (x, _), n in counts.items():
        highest[x] = max(n, highest.get(x, 0))
    for (doc_id, groups), links in zip(found, linked):
        named = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(named.encode()).hexdigest() if groups else ""
        best = sum(n for pair, n in links.items() if counts[pair] == highest[pair[0]])
        yield doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), links.total(), best, sum(n * counts[pair] for pair, n in links.items()), digest


def texts(seed, number, longest):
    drawn = np.random.default_rng(seed)
    return ["".join(drawn.choice(PARTS, drawn.integers(1, longest))) for _ in range(number)]


def aligned(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    return sorted(map(tuple, alignment.align(docs, *PATHS, **options).collect()), key=repr)


def test_equals_brute_force(spark):
    drawn = texts(1, 60, 40) + texts(2, 2, 1200) + ["It's the ants' house."] * 3 + ["x" * 3000, "本語" * 400, " ", "\n", "  a", "a "]
    rows = [*enumerate(drawn), (None, "no id"), (7, None), (8, ""), (3, drawn[3])]
    wanted = sorted(brute(rows), key=repr)
    assert sum(r[1] > 0 for r in wanted) > 30 and sum(r[1] == 0 for r in wanted) > 5
    assert aligned(spark, rows) == wanted


def test_rare_pairs_are_joined(spark):
    """Whatever pairs travel to the tasks, all others come by the join."""
    rows = [*enumerate(texts(3, 30, 30) + ["the same text"] * 5)]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    found = alignment.aligned_texts(docs, *PATHS)
    counts = alignment.pair_counts(found)
    results = [sorted(map(tuple, alignment.measures(found, counts, known).collect())) for known in (0, 20, 1_000_000)]
    assert results[0] == results[1] == results[2] and len(results[0]) == found.count()


def test_units_equal_whole_texts():
    pair = alignment.Aligner(*PATHS)
    for text in texts(4, 200, 60) + ["  ", "a  b", "a \n b", " a", "x" * 500 + " " + "y" * 70]:
        made, groups = pair.text(text), groups_of(text)
        if not groups:
            assert made is None
            continue
        assert made[4] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def test_a_worker_forgets_units(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_UNITS", 3)
    pair, fresh = alignment.Aligner(*PATHS), alignment.Aligner(*PATHS)
    for text in texts(5, 50, 30):
        fresh.units.clear()
        fresh.before.clear()
        assert pair.text(text) == fresh.text(text)


def test_empty_table(spark):
    assert aligned(spark, []) == []


def test_units_aligned_together_equal_units_alone(monkeypatch):
    """op11: many units in one string and one array give what each gives alone, also where one is not reproduced or ends in white space."""
    monkeypatch.setattr(alignment, "PAIRS_OF_UNIT", 64)
    rng = np.random.default_rng(5)
    units = sorted({"".join(rng.choice(PARTS, rng.integers(1, 7))) for _ in range(600)} | {"", "x" * 48, "𐍈" * 48, "㐀" * 47 + "a", "﻿w", "ﬁ"})
    units = [u for u in units if " " not in u.lstrip(" ")]
    together, alone = alignment.Aligner(*PATHS), alignment.Aligner(*PATHS)
    folded = lambda m: m and (*m[:5], *[x.tolist() for x in alignment.folded(np.frombuffer(m[5], dtype="<u4"), np.frombuffer(m[6], dtype="<i8"))])
    single = [alone._align(u, a.ids, b or alone.space) for u, a, b in zip(units, alone.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False), alone.b.encode(units))]
    assert [folded(m) for m in together._aligned(units)] == [folded(m) for m in single]
    assert False in single and max(m[3] for m in single if m) > alignment.PAIRS_OF_UNIT


def test_texts_of_a_batch_are_tokenized_in_few_strings(monkeypatch):
    texts = [" ".join(f"w{n}x{k}" for k in range(50)) for n in range(20)]
    together, alone, seen = alignment.Aligner(*PATHS), alignment.Aligner(*PATHS), []

    class Counted:
        def encode_batch_fast(self, strings, **options):
            seen.extend(strings)
            return alone.a.encode_batch_fast(strings, **options)

    together.a = Counted()
    together.prepare(texts)
    assert [together.text(t) for t in texts] == [alone.text(t) for t in texts]
    assert len(seen) <= 1000 // alignment.UNITS_JOINED + 1
