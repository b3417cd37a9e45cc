"""Analyzers in processes of their own, so that they may crash or hang."""

from __future__ import annotations

import multiprocessing
import os
import signal
import time
from collections.abc import Callable, Iterator
from multiprocessing.connection import Connection, wait

import pandas as pd

GRACE_SECONDS = 5  # after which a child whose parent is gone ends by itself
START_SECONDS = 60
PATIENCE_SECONDS = 0.05  # without any work, after which a call counts as waiting
AT_ONCE = 16


class AnalyzerTimeout(Exception):
    """A call took longer than it may."""


class AnalyzerCrash(Exception):
    """The process ended during a call."""


class AnalyzerFailure(Exception):
    """The analyzer raised; carries its message."""


def _serve(factory: Callable[[], Callable], calls: Connection, other_end: Connection, seconds: float) -> None:
    """The child: one call after the other, each under an alarm that ends the process."""
    other_end.close()
    signal.signal(signal.SIGALRM, signal.SIG_DFL)
    try:
        analyzer = factory()
        calls.send(None)
        while True:
            files = calls.recv()
            signal.setitimer(signal.ITIMER_REAL, seconds + GRACE_SECONDS)
            began = time.monotonic()
            try:
                answer = (True, analyzer(files))
            except Exception as error:
                answer = (False, str(error))
            signal.setitimer(signal.ITIMER_REAL, 0)
            calls.send((*answer, time.monotonic() - began))
    except (EOFError, OSError):
        os._exit(0)  # the parent is gone


class Supervised:
    """Calls ``factory()`` in a child process, at most ``seconds`` per call; the child is started when needed and again after it was lost.

    Wrong files are not told apart here: the caller repeats a failed call with fewer files.
    """

    def __init__(self, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], seconds: float):
        self.factory, self.seconds = factory, seconds
        self.child: multiprocessing.Process | None = None
        self.calls: Connection | None = None
        self.until = 0.0
        self.seen: tuple | None = None  # when the call was last seen at work, and its processor time then

    def begin(self, files: pd.DataFrame) -> None:
        """Start a call; ``answer`` ends it."""
        if self.child is None:
            self._start()
        self.seen = None
        self.until = time.monotonic() + self.seconds
        try:
            self.calls.send(files)
        except OSError:
            raise AnalyzerCrash(self._ended()) from None

    def answer(self) -> pd.DataFrame:
        """What the call returned, if it has ended; otherwise it is given up."""
        try:
            worked, answer, took = self.calls.recv() if self.calls.poll() else (False, None, self.seconds + 1)
        except (EOFError, OSError):
            if time.monotonic() < self.until:
                raise AnalyzerCrash(self._ended()) from None
            worked, answer, took = False, None, self.seconds + 1
        if took > self.seconds:
            self.close()
            raise AnalyzerTimeout(f"the analyzer took longer than {self.seconds:g} seconds")
        if not worked:
            raise AnalyzerFailure(answer)
        return answer

    def waits(self) -> bool:
        """Whether the call sleeps and has used no processor time for a while; never where the system does not tell."""
        try:
            with open(f"/proc/{self.child.pid}/stat") as stat:
                state, *numbers = stat.read().rpartition(")")[2].split()
        except OSError:
            return False
        now, used = time.monotonic(), (numbers[10], numbers[11])
        if state not in "SD" or self.seen is None or self.seen[1] != used:
            self.seen = now, used
        return now - self.seen[0] >= PATIENCE_SECONDS

    def _start(self) -> None:
        fork = multiprocessing.get_context("fork")  # the factory need not be pickled again
        self.calls, theirs = fork.Pipe()
        self.child = fork.Process(target=_serve, args=(self.factory, theirs, self.calls, self.seconds), daemon=True)
        self.child.start()
        theirs.close()
        try:
            if not self.calls.poll(max(self.seconds, START_SECONDS)):
                self.close()
                raise AnalyzerTimeout(f"the analyzer took longer than {max(self.seconds, START_SECONDS):g} seconds to start")
            self.calls.recv()
        except (EOFError, OSError):
            raise AnalyzerCrash(self._ended()) from None

    def _ended(self) -> str:
        self.child.join(GRACE_SECONDS)
        code = self.child.exitcode
        self.close()
        if code is not None and code < 0:
            return f"the analyzer was ended by signal {-code}"
        return f"the analyzer ended with exit code {code}"

    def close(self) -> None:
        """End the child, whatever it is doing."""
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.calls.close()
            self.child = self.calls = None


def calls_at_once(
    factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], seconds: float, next_part: Callable[[], pd.DataFrame | None], at_once: int = AT_ONCE
) -> Iterator[tuple[pd.DataFrame, pd.DataFrame | Exception]]:
    """Call the analyzer for the parts that ``next_part`` gives, until it has none; yields each part with its answer or error.

    One call is at work at a time. While calls only wait, as those that hang do, the next ones
    are made in other processes, up to ``at_once`` of them; so calls that compute never
    take processor time, and with it their limit, from each other.
    """
    running: dict[Supervised, pd.DataFrame] = {}
    idle: list[Supervised] = []
    try:
        while True:
            while len(running) < at_once and all(child.waits() for child in running):
                part = next_part()
                if part is None:
                    break
                child = idle.pop() if idle else Supervised(factory, seconds)
                try:
                    child.begin(part)
                    running[child] = part
                except Exception as error:
                    idle.append(child)
                    yield part, error
            if not running:
                return
            left = min(child.until for child in running) - time.monotonic()
            ended = wait([child.calls for child in running], max(0, min(PATIENCE_SECONDS, left)))
            for child in [c for c in running if c.calls in ended or time.monotonic() >= c.until]:
                part = running.pop(child)
                idle.append(child)
                try:
                    outcome = child.answer()
                except Exception as error:
                    outcome = error
                yield part, outcome
    finally:
        for child in [*running, *idle]:
            child.close()
