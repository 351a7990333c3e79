"""Space-filling indexes and list codes as column expressions.

Nothing here needs a Python worker: every function takes and returns columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, functions as F

from ..config import SpatialConfig

Columns = Sequence[Column]


def long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def box_of(position: Column, corner: float, leaf_width: float, n_boxes: int) -> Column:
    """Box number along one axis.  The upper face belongs to the last box."""
    inside = position if corner == 0 else position - corner
    return F.when(inside == leaf_width * n_boxes, long(n_boxes - 1)).otherwise(F.floor(inside / leaf_width))


def boxes_of(cfg: SpatialConfig, positions: Columns | None = None) -> list[Column]:
    """Leaf box numbers of a position, one per axis."""
    positions = positions or [F.col(a) for a in cfg.axes]
    return [box_of(p, c, w, cfg.boxes_at(cfg.leaf_level)) for p, c, w in zip(positions, cfg.corner, cfg.leaf_widths, strict=True)]


def morton(boxes: Columns, bits: int) -> Column:
    """Interleave: axis 0 is the most significant bit of each group."""
    dim, out = len(boxes), long(0)
    for b in range(bits):
        for axis, box in enumerate(boxes):
            bit = F.shiftright(box, b).bitwiseAND(long(1))
            out = out.bitwiseOR(F.shiftleft(bit, b * dim + dim - 1 - axis))
    return out


def morton_boxes(index: Column, dim: int, bits: int) -> list[Column]:
    """De-interleave."""
    out = []
    for axis in range(dim):
        box = long(0)
        for b in range(bits):
            box = box.bitwiseOR(F.shiftleft(F.shiftright(index, b * dim + dim - 1 - axis).bitwiseAND(long(1)), b))
        out.append(box)
    return out


def corner_of(boxes: Columns, cfg: SpatialConfig, level: int) -> list[Column]:
    """Lower corner of a box."""
    return [b * w + c for b, w, c in zip(boxes, cfg.widths_at(level), cfg.corner, strict=True)]


def centre_of(box: Column, axis: int, cfg: SpatialConfig, level: Column) -> Column:
    """Centre of a box along one axis; the level may differ from row to row."""
    return F.lit(cfg.corner[axis]) + (box.cast("double") + 0.5) * (F.lit(cfg.widths[axis]) / F.call_function("shiftleft", long(1), level.cast("int")).cast("double"))


def parent(index: Column, dim: int) -> Column:
    return F.shiftright(index, dim)


def child_slot(index: Column, dim: int) -> Column:
    return index.bitwiseAND(long((1 << dim) - 1))


def child(index: Column, slot: Column, dim: int) -> Column:
    return F.shiftleft(index, dim).bitwiseOR(slot)


def _code(offsets: Columns, base: int) -> Column:
    out = long(0)
    for d in offsets:
        out = out * base + (d + base // 2)
    return out


def _offsets(code: Column, dim: int, base: int) -> list[Column]:
    return [F.pmod(F.floor(code / base ** (dim - 1 - axis)), F.lit(base)) - base // 2 for axis in range(dim)]


def interaction_code(offsets: Columns) -> Column:
    """Relative position of a far box, each axis in -3..3."""
    return _code(offsets, 7)


def interaction_offsets(code: Column, dim: int) -> list[Column]:
    return _offsets(code, dim, 7)


def neighbour_code(offsets: Columns) -> Column:
    """Relative position of a near box, each axis in -1..1."""
    return _code(offsets, 3)


def neighbour_offsets(code: Column, dim: int) -> list[Column]:
    return _offsets(code, dim, 3)


def colour(boxes: Columns) -> Column:
    """Leaves of one colour are no neighbours of each other."""
    out = long(0)
    for b in boxes:
        out = out * 3 + F.pmod(b, F.lit(3))
    return out


def near_offsets(dim: int) -> list[tuple[int, ...]]:
    return list(product((-1, 0, 1), repeat=dim))


def far_offsets(dim: int) -> list[tuple[int, ...]]:
    """Every relative position of a far box; a given box has those that fit its parity."""
    return [o for o in product(range(-3, 4), repeat=dim) if max(map(abs, o)) > 1]


def _at(array: Column, k: int) -> Column:
    return F.element_at(array, k + 1)


def _let(value: Column, body) -> Column:
    """Evaluate once and use many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _turn(q: int, i: int, n: int):
    """One step of the transposition, its own inverse: invert the low bits of axis 0, or swap them with axis i."""
    p = long(q - 1)

    def run(a: Column) -> Column:
        swap = _at(a, 0).bitwiseXOR(_at(a, i)).bitwiseAND(p)
        flip = _at(a, i).bitwiseAND(long(q)) != 0
        first = F.when(flip, _at(a, 0).bitwiseXOR(p)).otherwise(_at(a, 0).bitwiseXOR(swap))
        other = F.when(flip, _at(a, i)).otherwise(_at(a, i).bitwiseXOR(swap))
        return F.array(*(first if k == 0 else other if k == i else _at(a, k) for k in range(n)))

    return run


def hilbert(boxes: Columns, bits: int) -> Column:
    """Position along a Hilbert curve, for ordering; any number of axes.

    Gray-code transposition (J. Skilling, "Programming the Hilbert curve",
    2004), unrolled over the bits into arithmetic on columns.
    """
    n, x = len(boxes), F.array(*boxes)
    for b in range(bits - 1, 0, -1):
        for i in range(n):
            x = _let(x, _turn(1 << b, i, n))

    def gray(a: Column) -> Column:
        done = [_at(a, 0)]
        for k in range(1, n):
            done.append(_at(a, k).bitwiseXOR(done[-1]))
        return F.array(*done)

    def finish(a: Column) -> Column:
        t = long(0)
        for b in range(bits - 1, 0, -1):
            t = F.when(_at(a, n - 1).bitwiseAND(long(1 << b)) != 0, t.bitwiseXOR(long((1 << b) - 1))).otherwise(t)
        return _let(t, lambda m: morton([_at(a, k).bitwiseXOR(m) for k in range(n)], bits))

    return _let(_let(x, gray), finish)


def hilbert_boxes(index: Column, dim: int, bits: int) -> Column:
    """Array of the boxes at a position along the curve: the inverse of ``hilbert``."""

    def ungray(a: Column) -> Column:
        return F.array(_at(a, 0).bitwiseXOR(F.shiftright(_at(a, dim - 1), 1)), *(_at(a, k).bitwiseXOR(_at(a, k - 1)) for k in range(1, dim)))

    x = _let(F.array(*morton_boxes(index, dim, bits)), ungray)
    for b in range(1, bits):
        for i in range(dim - 1, -1, -1):
            x = _let(x, _turn(1 << b, i, dim))
    return x


# The other Hilbert order, by a state machine.  A state turns the axes of a triplet r times and then flips the axes in
# f.  In the first state the curve visits the triplets of ``GRAY``, and the k-th of them goes on in the state ``TURNS[k]``.
#: The order of triplets, and (r, f) of each child.
GRAY = (0, 1, 3, 2, 6, 7, 5, 4)
TURNS = ((1, 0), (2, 0), (2, 0), (0, 3), (0, 3), (2, 6), (2, 6), (1, 5))


def _turned_axes(t: Column, r: Column) -> Column:
    """Bits of a triplet moved up r places, around."""
    wide = t.bitwiseOR(F.shiftleft(t, 3)).cast("int")
    return F.call_function("shiftright", F.call_function("shiftleft", wide, r), F.lit(3)).bitwiseAND(F.lit(7)).cast("int")


def _listed(values: Sequence[int], k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), k + 1)


def _walk(index: Column, bits: int, height: int, back: bool) -> Column:
    """Morton index to place on the curve, or ``back``: one state for each triplet from the top."""
    start = F.struct(F.lit((height - bits) % 3).alias("r"), F.lit(0).alias("f"), long(0).alias("out"))

    def step(state: Column, level: Column) -> Column:
        given = F.call_function("shiftright", index, 3 * level).bitwiseAND(long(7)).cast("int")
        if back:
            place = given
            out = _turned_axes(_listed(GRAY, given), state["r"]).bitwiseXOR(state["f"])
        else:  # undo the flips and the turn, then look up the place
            place = out = _listed([GRAY.index(t) for t in range(8)], _turned_axes(given.bitwiseXOR(state["f"]), F.pmod(3 - state["r"], F.lit(3))))
        turn, flip = _listed([t[0] for t in TURNS], place), _listed([t[1] for t in TURNS], place)
        return F.struct(
            F.pmod(state["r"] + turn, F.lit(3)).alias("r"),
            _turned_axes(flip, state["r"]).bitwiseXOR(state["f"]).alias("f"),
            F.shiftleft(state["out"], 3).bitwiseOR(out.cast("bigint")).alias("out"),
        )

    if bits == 0:
        return index * 0
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda state: state["out"])


def hilbert_states(boxes: Columns, bits: int, height: int) -> Column:
    """Place of a 3D box along the state machine's curve, in a tree of ``height`` levels.

    The machine reads ``height`` triplets whatever the level, so each level
    above the leaves begins one turn of the axes further.
    """
    return _walk(morton(boxes, bits), bits, height, False)


def hilbert_states_boxes(index: Column, bits: int, height: int) -> list[Column]:
    """Boxes at a place along the curve."""
    return morton_boxes(_walk(index, bits, height, True), 3, bits)
