"""Analyzers written in Python, run on Arrow batches of whole files."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from historymine.operators.supervised import AnalyzerTimeout, calls_at_once

FINDING_COLUMNS = ["rule", "ruleset", "line", "message"]
FILES_PER_CALL = 32

# Takes the files of a batch, returns their findings: the key columns of a file
# plus FINDING_COLUMNS. A factory makes one analyzer per task.
Analyzer = Callable[[pd.DataFrame], pd.DataFrame]


def analyze(
    files: DataFrame, factory: Callable[[], Analyzer], keys: Sequence[str] = ("hash",), content: str = "content", seconds: float | None = None
) -> DataFrame:
    """``(keys, rule, ruleset, line, message, error)``.

    The analyzer gets up to FILES_PER_CALL files at a time. A call that fails is
    halved until the bad files stand alone, so one bad file costs one error row
    and a few repeated calls, and nothing else; a result of wrong types or for
    files that were not given is such a failure. Large files need a session with
    ``spark.sql.execution.arrow.maxBytesPerBatch`` set.

    With ``seconds`` the analyzer runs in processes of its own. A call
    that takes longer, or during which the process ends, is a failure like the
    others, and the process is started again; after a timeout the files of the
    call are tried one by one, so that a file that hangs takes the limit twice.
    Calls that wait without computing do so side by side, see ``calls_at_once``: a
    task has one process at work, and up to 16 in all.
    """
    keys = list(keys)
    columns = [*keys, *FINDING_COLUMNS, "error"]

    def shaped(found: pd.DataFrame) -> pd.DataFrame:
        return found.reindex(columns=columns).astype(object)

    def checked(found: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        """What the analyzer returned, or an error here: Arrow would end the job on a wrong type."""
        given = set(part[keys].itertuples(index=False, name=None))
        if not set(found.reindex(columns=keys).itertuples(index=False, name=None)) <= given:
            raise ValueError("the analyzer returned a finding for a file that it was not given")
        found = shaped(found.drop(columns="error", errors="ignore"))
        found["line"] = [None if pd.isna(v) else operator.index(v) for v in found["line"]]
        for name in FINDING_COLUMNS:
            if name != "line" and not all(v is None or isinstance(v, str) or pd.isna(v) for v in found[name]):
                raise ValueError(f"the analyzer returned a {name} that is no text")
        return found

    def called(next_part: Callable[[], pd.DataFrame | None]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame | Exception]]:
        """One call after the other, inside the task."""
        analyzer = factory()
        while (part := next_part()) is not None:
            try:
                outcome = analyzer(part)
            except Exception as error:
                outcome = error
            yield part, outcome

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = lambda files, size: [files.iloc[i : i + size].reset_index(drop=True) for i in range(0, len(files), size)]
        arriving = (part for batch in batches for part in cut(batch, FILES_PER_CALL))
        pending: list[pd.DataFrame] = []
        next_part = lambda: pending.pop() if pending else next(arriving, None)
        for part, outcome in called(next_part) if seconds is None else calls_at_once(factory, seconds, next_part):
            try:
                if isinstance(outcome, Exception):
                    raise outcome
                found = checked(outcome, part)
            except Exception as error:
                if len(part) == 1:
                    found = shaped(part[keys].assign(error=str(error)))
                else:
                    pending += cut(part, 1 if isinstance(error, AnalyzerTimeout) else -(-len(part) // 2))[::-1]
                    continue
            yield found

    text = T.StringType()
    found = [T.StructField(c, T.IntegerType() if c == "line" else text) for c in [*FINDING_COLUMNS, "error"]]
    schema = T.StructType([*[files.schema[k] for k in keys], *found])
    return files.select(*keys, content).mapInPandas(run, schema)


def analyzer_findings(outcome: DataFrame) -> DataFrame:
    return outcome.where(F.col("error").isNull()).drop("error")


def analyzer_errors(outcome: DataFrame, keys: Sequence[str] = ("hash",)) -> DataFrame:
    return outcome.where(F.col("error").isNotNull()).select(*keys, "error")


def line_pattern_analyzer(pattern: str, rule: str, ruleset: str, fail_on: str | None = None) -> Callable[[], Analyzer]:
    """Factory of a regex analyzer on pandas strings; files containing ``fail_on`` make it raise."""

    def factory() -> Analyzer:
        def analyzer(batch: pd.DataFrame) -> pd.DataFrame:
            if fail_on is not None and batch["content"].str.contains(fail_on, regex=False).any():
                raise ValueError(f"cannot analyze a file with {fail_on}")
            lines = batch.assign(text=batch["content"].str.split("\n")).drop(columns="content").explode("text")
            lines["line"] = (lines.groupby(level=0).cumcount() + 1).astype("int32")
            hits = lines[lines["text"].str.contains(pattern, regex=True)]
            return hits.drop(columns="text").assign(rule=rule, ruleset=ruleset)

        return analyzer

    return factory
