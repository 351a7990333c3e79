"""Time steps: evaluate, move, rebuild, again.

``simulate`` is an iterative batch job; ``attach`` runs a query for every
micro-batch of a stream of target positions against a fixed set of sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import SpatialConfig
from ..functions.kernels import Kernel
from ..plans.fmm import Query
from ..staging import once


def simulate(particles: DataFrame, cfg: SpatialConfig, kernel: Kernel, move: Callable[[list[str]], dict[str, Column]], steps: int) -> DataFrame:
    """Particles after ``steps`` moves, with the outputs of the last evaluation.

    ``move`` gets the output names and returns new values of columns as
    expressions over positions and outputs.  Each step is computed once and
    kept, in the session's shared folder where one is set, so the plan does not grow.
    """
    state = particles
    for _ in range(steps):
        state = once(state.drop(*kernel.outputs).join(Query(cfg, kernel, state).execute(), "pid").withColumns(move(list(kernel.outputs))))
    return state


def attach(targets: DataFrame, sources: DataFrame, cfg: SpatialConfig, kernel: Kernel, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Evaluate each micro-batch of ``targets`` (a streaming frame) and hand the result to ``sink``."""

    def step(batch: DataFrame, number: int) -> None:
        sink(Query(cfg, kernel, batch, sources).execute(), number)

    return targets.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
