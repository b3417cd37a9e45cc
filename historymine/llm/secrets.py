"""Secrets in texts, found with SQL functions alone.

Patterns find the declared ones. A battery of randomness tests adds tokens that
look drawn at random from the alphabet of an encoding: their letters are about
uniform (chi-squared), and neither runs above and below the middle of the
alphabet nor neighbouring values (serial correlation) show order. Prose that
merely uses the alphabet fails at least one. Each token gets a p-value, the
chance that text without a secret looks this random at its length, and a
false-discovery bound over the p-values of all documents decides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from historymine.llm.common import bound, chunked, running, stored

# The declared kinds in their order, what a match looks like, which group has to be how long.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
]
KINDS = [*[kind for kind, *_ in BASE], "random"]
SHORTEST = 20
TOKEN = f"[A-Za-z0-9+/_-]{{{SHORTEST},}}"
# The alphabets of the usual encodings in the order of their digits.
ALPHABETS = {
    "hex_lower": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64_url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
STEPS = 40  # p-values are rounded up to 10 ** (-k / STEPS), which keeps the bound on the safe side
LAST_STEP = 300 * STEPS


@dataclass(frozen=True)
class Battery:
    """Settings of the tests.

    ``excess`` is the least the letter counts of prose exceed uniform counts by, per letter and in units
    of the uniform variance: English in a 64-letter alphabet has about 2.3, hexadecimal text made of
    words more. ``least_p`` is the level at which the tests of order reject randomness, and ``rate`` the
    share of false discoveries accepted over all documents.
    """

    excess: float = 1.2
    least_p: float = 0.001
    rate: float = 0.01


def _places(text: Column, pattern: str, group: int) -> Column:
    """``array<struct<start, end, value>>`` of all matches in code points; ``value`` is the group's text.

    The texts between the matches come from ``split``, which stops at the same
    places, so positions are running sums of lengths.
    """
    kind = "struct<start:int,end:int,value:string>"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.zip_with(hits, values, lambda h, v: F.struct(F.length(h).alias("length"), v.alias("value")))
    steps = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))

    def add(at: Column, step: Column) -> tuple[Column, Column]:
        begin = at + step["gap"]
        end = begin + step["match"]["length"]
        match = F.when(end.isNotNull(), F.struct(begin.alias("start"), end.alias("end"), step["match"]["value"].alias("value")))
        return F.coalesce(end, begin), match

    return F.when(text.rlike(pattern), running(steps, F.lit(0), add, kind)).otherwise(F.array().cast(f"array<{kind}>"))


def _span(start: Column, kind: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), kind.cast("int").alias("kind"), end.alias("end"))


def _long_enough(matches: Column, least: int, kind: int) -> Column:
    kept = F.filter(matches, lambda m: F.length(m["value"]) >= least)
    return F.transform(kept, lambda m: _span(m["start"], F.lit(kind), m["end"]))


def counted(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def _base_spans(text: Column) -> Column:
    """Declared secrets by start, then kind."""
    parts = []
    for kind, (_, pattern, group, least) in enumerate(BASE):
        if group == 0:
            # Matches are whole runs, so the long ones are what asks for that many letters finds.
            fixed = len(pattern.split("[")[0])
            pattern = pattern.removesuffix("+") + f"{{{least - fixed},}}"
        parts.append(_long_enough(_places(text, pattern, group), least, kind))
    return F.array_sort(F.concat(*parts))


def _tail(z: Column) -> Column:
    """Upper bound of the chance of a standard normal value beyond ``z``; one half below zero."""
    z = F.greatest(z, F.lit(0.0))
    return F.exp(-z * z / 2) / 2


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _neighbours(values: Column, of: Callable[[Column, Column], Column]) -> Column:
    """The sum of ``of`` over each value and the next one."""
    last = F.size(values) - 1
    return _total(F.zip_with(F.slice(values, F.lit(1), last), F.slice(values, F.lit(2), last), lambda a, b: of(a, b).cast("double")))


def _p_value(value: Column, settings: Battery) -> Column:
    """p-value of a token under the smallest alphabet that holds it; 1 where a test of order rejects randomness.

    Null for tokens of words or numbers alone. The time is in proportion to the token.
    """
    alphabet = F.lit(None).cast("string")
    for letters in reversed(ALPHABETS.values()):
        inside = value.rlike("^[" + letters.replace("-", r"\-") + "]+$")
        alphabet = F.when(inside, F.lit(letters)).otherwise(alphabet)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")  # words alone and numbers alone are prose
    chars = F.regexp_extract_all(value, F.lit("."), F.lit(0))

    def tested(alphabet: Column) -> Column:
        digits = F.transform(chars, lambda c: (F.position(c, alphabet) - 1).cast("double"))
        return bound(digits, lambda digits: _tests(value, alphabet, digits, settings))

    return F.when(mixed, bound(alphabet, lambda alphabet: F.when(alphabet.isNotNull(), tested(alphabet))))


def _tests(value: Column, alphabet: Column, digits: Column, settings: Battery) -> Column:
    size, n = F.length(alphabet).cast("double"), F.length(value).cast("double")
    counts = F.transform(F.split(alphabet, ""), lambda letter: n - F.length(F.replace(value, letter, F.lit(""))).cast("double"))
    chi_squared = _total(F.transform(counts, lambda k: F.pow(k, F.lit(2.0)))) * size / n - n
    mean = (size - 1) + settings.excess * (n - 1)
    spread = F.sqrt(2 * (size - 1) + 4 * settings.excess * (n - 1))
    p = _tail((mean - chi_squared) / spread)

    def ordered(above: Column) -> Column:
        n_above = _total(above)
        expected = 2 * n_above * (n - n_above) / n
        variance = expected * (expected - 1) / (n - 1)
        runs = F.abs(_neighbours(above, lambda a, b: a != b) - expected) / F.sqrt(F.greatest(variance, F.lit(1e-9)))
        middle = (size - 1) / 2
        serial = F.abs(_neighbours(digits, lambda a, b: (a - middle) * (b - middle))) / (F.sqrt(n - 1) * (size * size - 1) / 12)
        return (2 * _tail(runs) < settings.least_p) | (2 * _tail(serial) < settings.least_p)

    return bound(F.transform(digits, lambda v: (v >= size / 2).cast("double")), lambda above: F.when(ordered(above), 1.0).otherwise(p))


def _free(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no declared secret, by one pass over both from each end."""
    kind = "struct<start:int,end:int,value:string,covered:boolean>"
    as_rows = lambda spans, value, covered: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), value(s).alias("value"), covered(s).alias("covered")).cast(kind))
    rows = F.array_sort(F.concat(as_rows(base, lambda s: F.lit(None), lambda s: F.lit(None)), as_rows(tokens, lambda s: s["value"], lambda s: F.lit(False))))

    def after(end: Column, row: Column) -> tuple[Column, Column]:
        """``end``: how far the secrets that start no later reach."""
        marked = F.struct(row["start"].alias("start"), row["end"].alias("end"), row["value"].alias("value"), (row["start"] < end).alias("covered"))
        return F.when(row["value"].isNull(), F.greatest(end, row["end"])).otherwise(end), marked

    def before(start: Column, row: Column) -> tuple[Column, Column]:
        """``start``: where the first of the secrets that start later begins."""
        kept = F.when(row["value"].isNotNull() & ~row["covered"] & (row["end"] <= start), row)
        return F.when(row["value"].isNull(), F.least(start, row["start"])).otherwise(start), kept

    kept = F.reverse(running(F.reverse(running(rows, F.lit(0), after, kind)), F.lit((1 << 31) - 1), before, kind))
    return F.when(F.size(base) > 0, F.transform(kept, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value")))).otherwise(tokens)


def _threshold(steps: DataFrame, rate: float) -> int:
    """The lowest step at which the share of false discoveries stays below ``rate`` (Benjamini and Hochberg).

    ``steps`` has the steps of all p-values in ``step``; they are at most ``LAST_STEP`` different ones.
    """
    counted = steps.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beyond = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    level = F.pow(F.lit(10.0), -F.col("step") / STEPS)
    held = counted.select("step", F.sum("n").over(total).alias("tests"), F.sum("n").over(beyond).alias("found")).where(level * F.col("tests") <= rate * F.col("found"))
    lowest = held.agg(F.min("step")).first()[0]
    return LAST_STEP + 1 if lowest is None else lowest


def find_secrets(docs: DataFrame, carried: Sequence[str] = ("doc_id",), settings: Battery = Battery()) -> DataFrame:
    """``carried`` columns of ``docs`` and ``base``, ``spans``: arrays of ``struct<start, kind, end>`` by start, then kind.

    ``base`` holds the declared secrets, ``spans`` also the tokens that look
    random and overlap none of them. Positions are code points, ``end`` exclusive,
    ``kind`` an index into ``KINDS``. Columns that are not carried are ignored.

    A null text counts as empty and has no spans; rows keep their number and may
    repeat or lack an id; an empty table gives an empty one. The texts are
    matched once; a table of what was found is stored, since whether a p-value
    is small enough depends on all of them. The time is in proportion to the texts,
    however long one of their tokens is and however many matches one has.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    down = lambda p: F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS), F.lit(LAST_STEP)).cast("int")
    step = lambda p: bound(p, lambda p: F.when(p.isNotNull(), down(p)))

    def tested(base: Column) -> Column:
        tokens = F.filter(_places(text, TOKEN, 0), lambda m: m["value"].rlike("[0-9]"))
        steps = F.transform(_free(tokens, base), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), step(_p_value(m["value"], settings)).alias("step")))
        return F.struct(base.alias("base"), F.filter(steps, lambda t: t["step"].isNotNull()).alias("tokens"))

    found = stored(docs.select(F.struct(*carried).alias("row"), bound(_base_spans(text), tested).alias("_")).select("row", "_.base", "_.tokens"), "secrets")
    least = _threshold(found.select(F.explode("tokens.step").alias("step")), settings.rate)
    random = F.transform(F.filter("tokens", lambda t: t["step"] >= least), lambda t: _span(t["start"], F.lit(len(BASE)), t["end"]))
    return found.select("row.*", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def listed(spans: str) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: str, mark: str = "[secret]") -> Column:
    """The text with ``mark`` in place of each span; spans that overlap become one."""
    whole = F.col(text)
    none = F.array().cast("array<string>")

    def add(acc: Column, s: Column, part: Column, begin: Column) -> Column:
        kept = F.concat(F.substring(part, acc["at"] - begin + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(kept))).otherwise(acc["out"]).alias("out")
        )

    def add_chunk(acc: Column, chunk: Column) -> Column:
        """Only the part of the text up to the last of a chunk of spans is walked for each of them."""
        part = F.substring(whole, acc["at"] + 1, F.greatest(F.get(chunk, F.size(chunk) - 1)["start"] - acc["at"], F.lit(0)))
        inside = lambda part: F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), lambda a, s: add(a, s, part, acc["at"]))
        return bound(bound(part, inside), lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(a["out"], ""))).alias("out")))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(whole, acc["at"] + 1, F.length(whole)))
    return F.when(F.size(spans) > 0, F.aggregate(chunked(F.col(spans)), start, add_chunk, done)).otherwise(whole)
