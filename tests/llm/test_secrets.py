import base64
import math
import random
import re
import time

from pyspark.sql import functions as F

from historymine.llm import secrets

SCHEMA = "doc_id bigint, text string, base string, spans int, tokens string, row int"
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": ("(AKIA[A-Z0-9]+)", 1, 16),
    "hex": ("([0-9a-f]+)", 1, 32),
}


def brute_base(text):
    found = [(m.start(), i, m.end()) for i, (p, g, n) in enumerate(PATTERNS.values()) for m in re.finditer(p, text or "") if len(m[g]) >= n]
    return sorted(found)


def brute_p(value, how):
    """The battery, written out for one token."""
    if not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
        return None
    alphabet = next((a for a in secrets.ALPHABETS.values() if set(value) <= set(a)), None)
    if alphabet is None:
        return None
    size, n, digits = len(alphabet), len(value), [alphabet.index(c) for c in value]
    tail = lambda z: math.exp(-max(z, 0) ** 2 / 2) / 2
    chi = sum(digits.count(d) ** 2 for d in range(size)) * size / n - n
    p = tail((size - 1 + how.excess * (n - 1) - chi) / math.sqrt(2 * (size - 1) + 4 * how.excess * (n - 1)))
    above = [d >= size / 2 for d in digits]
    expected = 2 * sum(above) * (n - sum(above)) / n
    runs = abs(sum(a != b for a, b in zip(above, above[1:])) - expected) / math.sqrt(max(expected * (expected - 1) / (n - 1), 1e-9))
    mid = (size - 1) / 2
    serial = abs(sum((a - mid) * (b - mid) for a, b in zip(digits, digits[1:]))) / (math.sqrt(n - 1) * (size * size - 1) / 12)
    return 1.0 if min(2 * tail(runs), 2 * tail(serial)) < how.least_p else p


def brute(texts, how):
    tested = []
    for i, text in enumerate(texts):
        base = brute_base(text)
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text or ""):
            p = brute_p(m[0], how)
            if p is not None and not any(s < m.end() and m.start() < e for s, _, e in base):
                tested.append((min(math.floor(-math.log10(max(p, 1e-300)) * secrets.STEPS), secrets.LAST_STEP), i, m.start(), m.end()))
    held = [t[0] for t in tested if 10 ** (-t[0] / secrets.STEPS) * len(tested) <= how.rate * sum(u[0] >= t[0] for u in tested)]
    least = min(held, default=math.inf)
    return [sorted([*brute_base(text), *[(s, 3, e) for step, j, s, e in tested if j == i and step >= least]]) for i, text in enumerate(texts)]


def test_equals_brute_force(spark):
    draw = random.Random(5)
    keys = [base64.b64encode(draw.randbytes(48)).decode() for _ in range(30)]
    texts = [None, "", "plain words only", 'token="token:abcdefgh" secret=secret=abcdefghij é😀 PASSWORD : \'x12345678',
             "AKIAAKIA1234 AKIA" + "A" * 12 + " " + "0af" * 11, "f" * 31 + " " + "f" * 32, "api_key = 12345678", "APIKEY=é12345678",
             "some_long_identifier_name_of_2024_or_so and word_word_word_word_1", "/usr/local/lib/python3/site-packages/module", "a1" * 30, "abcdefghijklmnopqrstuvwxyz0123456789",
             "x" * 200_000 + " token=12345678901 " + "y1" * 3000]
    texts += [f"é words {k} and words" for k in keys] + ["words " * 50 + keys[0] + " secret:" + keys[1]]
    rows = [(None if i % 7 == 6 else i, t, "clash", 1, "clash", 2) for i, t in enumerate(texts)]
    got = secrets.find_secrets(spark.createDataFrame(rows, SCHEMA).repartition(3), carried=("doc_id", "text")).collect()
    wanted = brute(texts, secrets.Battery())
    assert sorted(((r.text, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in got), key=repr) == sorted(((t, brute_base(t), w) for t, w in zip(texts, wanted)), key=repr)
    found = {t for t, w in zip(texts, wanted) if any(k == 3 for _, k, _ in w)}
    assert len(found) > 25 and all(any(k in t for k in keys) for t in found)  # keys are found, identifiers left alone


def test_redacted_and_listed(spark):
    df = secrets.find_secrets(spark.createDataFrame([(1, "é token=" + "0a" * 20 + " end", "", 0, "", 0), (2, "clean", "", 0, "", 0)], SCHEMA), carried=("doc_id", "text"))
    got = {r[0]: r[1:] for r in df.select("doc_id", secrets.redacted("text", "spans"), secrets.listed("spans")).collect()}
    assert got == {1: ("é [secret] end", "assign:2:48,hex:8:48"), 2: ("clean", "")}


def test_empty_table(spark):
    assert secrets.find_secrets(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_matches_and_overlaps(spark):
    """Tokens before, between, inside and around declared secrets, hundreds in one text, against plain search."""
    draw = random.Random(6)
    parts = [lambda: base64.b64encode(draw.randbytes(36)).decode(), lambda: draw.randbytes(20).hex(), lambda: "token=" + draw.randbytes(9).hex(), lambda: "words", lambda: "é/" + draw.randbytes(12).hex() + "+/Zz9", lambda: "AKIA" + "B7" * 9]
    texts = [draw.choice([" ", "/", ": "]).join(draw.choice(parts)() for _ in range(n)) for n in (3, 40, 300, 700) for _ in range(6)]
    df = secrets.find_secrets(spark.createDataFrame([(i, t, "", 0, "", 0) for i, t in enumerate(texts)], SCHEMA), carried=("doc_id", "text"))
    got = {r[0]: ([tuple(s) for s in r[1]], r[2]) for r in df.select("doc_id", "spans", secrets.redacted("text", "spans")).collect()}
    for i, (text, wanted) in enumerate(zip(texts, brute(texts, secrets.Battery()))):
        assert got[i][0] == wanted
        out, at = [], 0
        for start, _, end in wanted:
            if start >= at:
                out += [text[at:start], "[secret]"]
            at = max(at, end)
        assert got[i][1] == "".join(out) + text[at:]


def test_time_is_in_proportion_to_long_tokens_and_many_matches(spark):
    draw = random.Random(7)
    token = base64.b64encode(draw.randbytes(750_000)).decode()
    text = "é" + " ".join(f"token={draw.getrandbits(64):016x} {base64.b64encode(draw.randbytes(30)).decode()}" for _ in range(20_000))
    rows = [(1, "an image " + token, "", 0, "", 0), (2, text, "", 0, "", 0)]
    start = time.perf_counter()
    df = secrets.find_secrets(spark.createDataFrame(rows, SCHEMA).repartition(2), carried=("doc_id", "text"))
    got = {r.doc_id: (r.n, r.found, r.left) for r in df.select("doc_id", F.size("base").alias("n"), F.size("spans").alias("found"), F.length(secrets.redacted("text", "spans")).alias("left")).collect()}
    assert got[1][0] == 0 and got[1][1] == 1 and got[1][2] == len("an image [secret]")
    assert got[2][0] == 20_000 and got[2][2] < len(text)
    assert time.perf_counter() - start < 120
