"""Kernels around kernels: counters and timers of the run itself.

A wrapper has all that its kernel has, and looks on while a query runs.  They
nest in any order: ``Counter(Timer(kernel))``.  What they saw is there when the
query's result has been computed.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation

from .kernels import Kernel


class Wrapper:
    """A kernel that hands everything on to another."""

    def __init__(self, kernel: Kernel | Wrapper):
        self.kernel = kernel

    def __getattr__(self, name: str):
        if name.startswith("__") or name == "kernel":
            raise AttributeError(name)
        return getattr(self.kernel, name)


class Counter(Wrapper):
    """Calls of each stage, as metrics that Spark observes on the stages as they run.

    ``p2p`` counts every pair of particles of neighbouring leaves once within
    one set, ``p2p_inner`` both ways; pairs that go in batches are counted from lists of leaves.
    """

    def __init__(self, kernel: Kernel | Wrapper):
        super().__init__(kernel)
        self._seen: dict[str, Observation] = {}

    def watch(self, stage: str, rows: DataFrame, **counts: Column) -> DataFrame:
        rows = self.kernel.watch(stage, rows, **counts)
        if stage in self._seen:  # a stage that is planned again was counted
            return rows
        self._seen[stage] = Observation(f"{stage}-{id(self)}")
        return rows.observe(self._seen[stage], *(c.alias(name) for name, c in counts.items()))

    def counts(self) -> dict[str, int]:
        """Calls by stage; waits for a stage whose job has not run."""
        return {name: int(n) for o in self._seen.values() for name, n in o.get.items()}


class Timer(Wrapper):
    """Seconds of each stage, each computed where it ends."""

    def __init__(self, kernel: Kernel | Wrapper):
        super().__init__(kernel)
        self.seconds: dict[str, float] = {}

    def finish(self, stage: str, make: Callable[[], DataFrame], keep: bool) -> DataFrame:
        began = time.perf_counter()
        table = self.kernel.finish(stage, make, True)
        self.seconds[stage] = self.seconds.get(stage, 0.0) + time.perf_counter() - began
        return table
