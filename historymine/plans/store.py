"""The results of many runs below one folder.

A run writes its tables to folders of its own and then one line, its manifest.
Readers look at manifests only, so a run is there as a whole or not at all: what a
lost run left is never read. A commit may be in several runs; the run with the
highest position has its row, its counts and its documents. Cache entries are
appended per run and merged when they are read.

    root/commits/run=..   root/by-rule/run=..   root/findings/run=..   root/errors/run=..
    root/cache/run=..     root/reports/run=..   root/summary/run=..    root/manifests/run=..

Manifests and the list of runs pass through the driver: a line per run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F, types as T

from historymine import schema as S
from historymine.operators.cache import cache_merge
from historymine.sinks import write_errors, write_reports, write_summary

if TYPE_CHECKING:
    from historymine.plans.mining import MiningRun

RUN, COMPACTION = "run", "compaction"
TABLES = ("commits", "by-rule", "findings", "errors", "cache", "reports", "summary", "manifests")
# schema, format and key of the tables whose rows belong to commits
_OF_COMMITS = {
    "commits": (S.RUN_COMMITS, "parquet", "commit"),
    "by-rule": (S.RUN_BY_RULE, "parquet", "seq"),
    "errors": (S.RUN_ERRORS, "json", "commit"),
    "reports": (S.COMMIT_REPORT_JSON, "json", "commit"),
}


def _names(schema: str) -> list[str]:
    return T.StructType.fromDDL(schema).names


@dataclass(frozen=True)
class RunStore:
    """Runs below ``root``; one writer at a time, readers at any time."""

    spark: SparkSession
    root: str

    # --- reading ------------------------------------------------------------

    def runs(self) -> list[Row]:
        """Manifests of the finished runs, oldest first."""
        try:
            found = self.spark.read.schema(S.MANIFEST).json(f"{self.root}/manifests").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(found, key=lambda r: (r.position, r.run))

    def _read(self, name: str, schema: str, runs: Iterable[Row], form: str = "parquet") -> DataFrame:
        """A table of the given runs, with the columns ``run`` and ``position``."""
        runs = list(runs)
        if not runs:
            return self.spark.createDataFrame([], f"{schema}, run STRING, position BIGINT")
        positions = self._positions(runs)
        reader = self.spark.read.schema(f"{schema}, run STRING").option("basePath", f"{self.root}/{name}")
        return reader.format(form).load([f"{self.root}/{name}/run={r.run}" for r in runs]).join(F.broadcast(positions), "run")

    def _positions(self, runs: Iterable[Row]) -> DataFrame:
        return self.spark.createDataFrame([(r.run, r.position) for r in runs], "run STRING, position BIGINT")

    def _latest(self, runs: list[Row]) -> DataFrame:
        """``(commit, seq, run)``: the run that speaks for each commit, whether it reported it or failed on it."""
        runs = [r for r in runs if r.kind == RUN]
        keys = ["commit", "seq", "run", "position"]
        seen = self._read("commits", S.RUN_COMMITS, runs).select(*keys).unionByName(self._read("errors", S.RUN_ERRORS, runs, "json").select(*keys))
        return seen.groupBy("commit").agg(F.max_by(F.struct("seq", "run"), F.struct("position", "run")).alias("_at")).select("commit", "_at.*")

    def _of_commits(self, name: str, runs: list[Row]) -> DataFrame:
        """Rows of a table of commits, each commit from its latest run."""
        schema, form, key = _OF_COMMITS[name]
        rows = self._read(name, schema, [r for r in runs if r.kind == RUN], form)
        return rows.join(self._latest(runs).select("run", key), ["run", key], "left_semi").select(*_names(schema))

    def commits(self) -> DataFrame:
        """One row of counts per commit that its latest run reported."""
        return self._of_commits("commits", self.runs())

    def by_rule(self) -> DataFrame:
        return self._of_commits("by-rule", self.runs())

    def errors(self) -> DataFrame:
        """``(seq, commit, error)`` of the commits that their latest run failed on."""
        return self._of_commits("errors", self.runs())

    def reports(self) -> DataFrame:
        """The documents, see ``commit_reports``."""
        return self._of_commits("reports", self.runs())

    def findings(self, identity: str | None = None) -> DataFrame:
        """Findings by content under one rule set or analyzer, each content from the latest run that scanned it."""
        runs = [r for r in self.runs() if r.kind == RUN and identity in (None, r.identity)]
        rows = self._read("findings", S.FINDINGS_BY_CONTENT, runs)
        last = rows.groupBy("hash").agg(F.max("position").alias("position"))
        return rows.join(last, ["hash", "position"], "left_semi").select(*_names(S.FINDINGS_BY_CONTENT))

    def done(self) -> DataFrame:
        """``(commit)``: reported or failed on, by any finished run."""
        return self._latest(self.runs()).select("commit")

    def cache(self, identity: str | None = None) -> DataFrame:
        """All cache entries, the latest of each content and rule set; of one rule set, only its runs are read."""
        runs = [r for r in self.runs() if identity in (None, r.identity)]
        kept = [r for r in runs if r.position >= max((c.position for c in runs if c.kind == COMPACTION and c.identity == r.identity), default=0)]
        return cache_merge(self._read("cache", S.CACHE, kept).select(*_names(S.CACHE)))

    def summary(self, location: str, include_cached: bool = True) -> DataFrame:
        """The repository summary over all runs."""
        return self._summary(self.runs(), location, include_cached)

    def _summary(self, runs: list[Row], location: str, include_cached: bool = True) -> DataFrame:
        from historymine.plans.mining import summarize_commits

        return summarize_commits(self._of_commits("commits", runs), self._of_commits("by-rule", runs), location, include_cached)

    def stored_summary(self) -> DataFrame:
        """The summary as the last run left it, a line of JSON."""
        last = [r.run for r in self.runs() if r.kind == RUN][-1]
        return self.spark.read.text(f"{self.root}/summary/run={last}").select("value")

    def progress(self) -> DataFrame:
        """``(position, processed, succeeded, failed)`` after every finished run, commits counted once, under the latest run that has them."""
        runs = [r for r in self.runs() if r.kind == RUN]
        failed = self._of_commits("errors", runs).select("commit", F.lit(1).alias("_failed"))
        counts = self._latest(runs).join(failed, "commit", "left").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count("_failed").alias("f"))
        so_far = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per run
        steps = self._positions(runs).join(counts, "run", "left").select("position", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("f", F.lit(0)).alias("f"))
        return steps.select("position", F.sum("n").over(so_far).alias("processed"), F.sum(F.col("n") - F.col("f")).over(so_far).alias("succeeded"), F.sum("f").over(so_far).alias("failed"))

    # --- writing ------------------------------------------------------------

    def append(self, run: MiningRun, location: str) -> str:
        """Add a run; returns its name. Until the manifest is there, nothing of it counts."""
        entry = self._entry(RUN, run.identity, location)
        for write in self._steps(run, entry):
            write()
        return entry.run

    def _steps(self, run: MiningRun, entry: Row) -> Iterator[Callable[[], None]]:
        """The writes of a run, the manifest last."""
        folder = lambda name: f"{self.root}/{name}/run={entry.run}"
        errors = self.spark.createDataFrame([], S.RUN_ERRORS) if run.errors is None else run.errors
        yield lambda: run.commits.write.parquet(folder("commits"))
        run = replace(run, commits=self._read("commits", S.RUN_COMMITS, [entry]).select(*_names(S.RUN_COMMITS)))  # counted once, read from here on
        yield lambda: run.by_rule.write.parquet(folder("by-rule"))
        yield lambda: run.findings.write.parquet(folder("findings"))
        yield lambda: write_errors(errors, folder("errors"), with_seq=True)
        yield lambda: run.fresh_cache.write.parquet(folder("cache"))
        yield lambda: write_reports(run.reports(), folder("reports"))
        yield lambda: write_summary(self._summary([*self.runs(), entry], entry.location), folder("summary"))
        yield lambda: self._finish(entry)

    def compact_cache(self, identity: str) -> None:
        """Write the merged cache of one rule set or analyzer once; its earlier entries are not read again."""
        entry = self._entry(COMPACTION, identity, "")
        self.cache(identity).write.parquet(f"{self.root}/cache/run={entry.run}")
        self._finish(entry)

    def next_position(self) -> int:
        return max((r.position for r in self.runs()), default=0) + 1

    def _entry(self, kind: str, identity: str, location: str) -> Row:
        return Row(run=uuid.uuid4().hex, position=self.next_position(), kind=kind, identity=identity, location=location)

    def _finish(self, entry: Row) -> None:
        """One file with one line: moved into place when it is complete."""
        line = self.spark.createDataFrame([tuple(entry)], S.MANIFEST)
        line.coalesce(1).write.json(f"{self.root}/manifests/run={entry.run}")

    def discard_unfinished(self) -> list[str]:
        """Delete what lost runs left and return their names; call it while nothing is being written."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        finished, lost = {r.run for r in self.runs()}, set()
        for name in TABLES:
            folder = fs_path(f"{self.root}/{name}")
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                run = status.getPath().getName().removeprefix("run=")
                if run not in finished:
                    lost.add(run)
                    fs.delete(status.getPath(), True)
        return sorted(lost)
