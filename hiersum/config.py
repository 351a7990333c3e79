"""Geometry of the box that is divided, and of the levels."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import IntFlag
from functools import cached_property

AXES = ("x", "y", "z")
BOXES = ("ix", "iy", "iz")


class Ops(IntFlag):
    """Stages of a query.  The bits are part of the public interface."""

    P2P, P2M, M2M, M2L, L2L, L2P = 1, 2, 4, 8, 16, 32
    NEAR = 1
    UPWARD = 2 | 4
    DOWNWARD = 16 | 32
    FAR = 2 | 4 | 8 | 16 | 32
    ALL = 63


@dataclass(frozen=True)
class SpatialConfig:
    """A box of ``dim`` axes, halved ``height - 1`` times on each.

    Leaves are at level ``height - 1``.  ``extra_levels`` (periodic boxes
    only) is the number of levels above the root that stand for more images;
    -1 means the 3**dim images that the lists reach by themselves.
    """

    dim: int = 3
    height: int = 4
    centre: tuple[float, ...] = (0.5, 0.5, 0.5)
    widths: tuple[float, ...] = (1.0, 1.0, 1.0)
    periodic: bool = False
    extra_levels: int = -1
    block_size: int | None = None

    def __post_init__(self) -> None:
        if self.dim not in (2, 3) or self.height < 1 or self.extra_levels < -1:
            raise ValueError("dim is 2 or 3, height at least 1, extra_levels at least -1")
        if self.periodic and self.extra_levels >= 0 and self.height < 2:
            raise ValueError("images above the root need a height of 2")
        object.__setattr__(self, "centre", tuple(self.centre[: self.dim]))
        object.__setattr__(self, "widths", tuple(self.widths[: self.dim]))

    def for_count(self, n: int, per_leaf: int = 40) -> SpatialConfig:
        """The same box at the height whose leaves hold about ``per_leaf`` of n evenly spread particles."""
        height = 1
        while n > per_leaf << (self.dim * (height - 1)):
            height += 1
        return replace(self, height=height)

    @cached_property
    def corner(self) -> tuple[float, ...]:
        return tuple(c - w / 2 for c, w in zip(self.centre, self.widths, strict=True))

    @property
    def leaf_level(self) -> int:
        return self.height - 1

    @property
    def leaf_widths(self) -> tuple[float, ...]:
        return self.widths_at(self.leaf_level)

    @property
    def stop_level(self) -> int:
        """First level with a far field."""
        return 1 if self.periodic else 2

    @property
    def far_levels(self) -> range:
        return range(self.stop_level, self.height)

    @property
    def axes(self) -> tuple[str, ...]:
        return AXES[: self.dim]

    @property
    def boxes(self) -> tuple[str, ...]:
        return BOXES[: self.dim]

    @property
    def children(self) -> int:
        return 1 << self.dim

    @property
    def max_m2l(self) -> int:
        """Longest interaction list of an inner box."""
        return 6**self.dim - 3**self.dim

    @property
    def max_neighbours(self) -> int:
        return 3**self.dim - 1

    def widths_at(self, level: int) -> tuple[float, ...]:
        return tuple(w / (1 << level) for w in self.widths)

    def boxes_at(self, level: int) -> int:
        """Boxes per axis."""
        return 1 << level

    def cells_at(self, level: int) -> int:
        return 1 << (level * self.dim)

    @property
    def repetitions(self) -> int:
        """Images of the box per axis that a periodic query sums over."""
        if not self.periodic:
            return 1
        n = self.extra_levels
        return 3 if n == -1 else 7 if n == 0 else 6 << n

    @property
    def image_interval(self) -> tuple[int, int]:
        """First and last image per axis, the box itself being 0."""
        if not self.periodic:
            return 0, 0
        n, r = self.extra_levels, self.repetitions
        return (-1, 1) if n == -1 else (-3, 3) if n == 0 else (-(r // 2), r // 2 - 1)

    @property
    def levels_above(self) -> int:
        """Levels between the root of a plain tree that holds all images and the box itself."""
        return self.extra_levels + 3 if self.periodic else 0

    @property
    def extended_height(self) -> int:
        """Height of that plain tree, down to the same leaves."""
        return self.height + self.levels_above

    @property
    def extended(self) -> SpatialConfig:
        """The plain box that holds all images; its lowest corner is that of the first image."""
        if not self.periodic:
            return self
        widths = tuple(w * (1 << self.levels_above) for w in self.widths)
        centre = tuple(c + self.image_interval[0] * w + b / 2 for c, w, b in zip(self.corner, self.widths, widths, strict=True))
        return replace(self, height=self.extended_height, centre=centre, widths=widths, periodic=False, extra_levels=-1)

    def with_(self, **changes) -> SpatialConfig:
        return replace(self, **changes)
