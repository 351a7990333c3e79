"""What lies above the root of a periodic box: more images, at growing scale.

One row per scale; the box itself is slot 0 of each larger box.  All scales
but the last reach -2..3 boxes of their size, the last -3..2, so that the
images together fill an interval (see ``SpatialConfig.image_interval``).
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, functions as F

from ..config import SpatialConfig
from ..functions.kernels import Kernel
from ..staging import staged


def scale_offsets(cfg: SpatialConfig, scale: int) -> list[tuple[int, ...]]:
    """Images of the box of one scale that act on it."""
    n = cfg.extra_levels
    reach = range(-3, 4) if n == 0 else range(-3, 3) if scale == n else range(-2, 4)
    return [o for o in product(reach, repeat=cfg.dim) if max(map(abs, o)) > 1]


def _explode(rows: DataFrame, offsets: list[tuple[int, ...]], dim: int) -> DataFrame:
    items = ", ".join("array(" + ", ".join(f"{v}.0D" for v in o) + ")" for o in offsets)
    return rows.withColumn("o", F.explode(F.expr(f"array({items})"))).withColumns({f"o{k}": F.col("o")[k] for k in range(dim)})


def root_locals(root: DataFrame, cfg: SpatialConfig, kernel: Kernel) -> DataFrame:
    """level 0, boxes and locals of the root, from all images beyond the 3**dim nearest.

    ``root`` has the root's moments in one row, so everything here is tiny.
    """
    moments = {m: F.col(m) for m in kernel.moments}
    at = root.select(*kernel.moments)
    out = None
    for scale in range(cfg.extra_levels + 1):
        widths = [w * (1 << scale) for w in cfg.widths]
        if scale:  # 2**dim copies of the smaller box
            half = [w / 2 for w in widths]
            copies = _explode(at, list(product((0, 1), repeat=cfg.dim)), cfg.dim)
            copies, d = staged(copies, kernel, "m2m", [(F.col(f"o{k}") - 0.5) * h for k, h in enumerate(half)])
            moved = kernel.m2m(d, moments)
            at = copies.select(*(e.alias(k) for k, e in moved.items())).groupBy().agg(*(F.sum(m).alias(m) for m in kernel.moments))
        images = _explode(at, scale_offsets(cfg, scale), cfg.dim)
        images, d = staged(images, kernel, "m2l", [-F.col(f"o{k}") * w for k, w in enumerate(widths)])
        came = images.select(*(e.alias(k) for k, e in kernel.m2l(d, moments).items()))
        total = came.groupBy().agg(*(F.sum(v).alias(v) for v in kernel.locals_))
        # from the centre of the larger box, whose slot 0 holds the root, to the root's
        total, d = staged(total, kernel, "l2l", [F.lit((w0 - w) / 2) for w0, w in zip(cfg.widths, widths, strict=True)])
        down = kernel.l2l(d, {v: F.col(v) for v in kernel.locals_})
        part = total.select(*(e.alias(k) for k, e in down.items()))
        out = part if out is None else out.unionByName(part)
    summed = out.groupBy().agg(*(F.sum(v).alias(v) for v in kernel.locals_))
    return summed.select(F.lit(0).alias("level"), *(F.lit(0).cast("bigint").alias(b) for b in cfg.boxes), *kernel.locals_).where(F.col(kernel.locals_[0]).isNotNull())
