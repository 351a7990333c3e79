"""Preparation that all plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .functions.kernels import Kernel
from .keeping import folder, once

__all__ = ["folder", "once", "staged"]


def staged(rows: DataFrame, kernel: Kernel, stage: str, d: list[Column]) -> tuple[DataFrame, list[Column]]:
    """Rows with the distance and the kernel's shared terms as columns."""
    rows = rows.withColumns({f"_d{k}": v for k, v in enumerate(d)})
    d = [F.col(f"_d{k}") for k in range(len(d))]
    extra = kernel.prepare(stage, d)
    return (rows.withColumns(extra) if extra else rows), d
