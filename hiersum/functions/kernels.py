"""Kernels as column expressions.

A kernel never sees the tree.  It states how charges make moments, how moments
and locals move, and what one particle does to another; each statement is
linear in the values, so every stage of a query is a join and a sum.  All of
these kernels re-centre exactly, so one step may span any number of levels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from copy import copy
from dataclasses import dataclass
from math import factorial, pi

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..keeping import once

Columns = Sequence[Column]


class Kernel:
    """The contract.  Methods get columns and return {name: column}."""

    moments: tuple[str, ...] = ()
    locals_: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    #: Columns of a particle, besides its position, that the kernel reads.  With ``q`` alone the methods get that column,
    #: else a dict of columns by name.  They come from the particles, or by pid from the query's ``data``.
    values: tuple[str, ...] = ("q",)
    #: Whether P2P needs nothing but the number of particles of a leaf.
    by_count = False
    #: Whether a plan of columns makes the near field in batches, through ``parts`` and ``results`` (see ``Pairwise``).
    batched = False
    #: Sources from which on it does; fewer go by columns.
    batched_from = 0
    #: Whether P2P has no finite value at distance zero: particles that coincide then do nothing to each other.
    singular = False
    #: What each axis is multiplied by before the distance is taken; None: nothing.
    stretch: Sequence[float] | None = None

    def watch(self, stage: str, rows: DataFrame, **counts: Column) -> DataFrame:
        """Called with the rows of every stage that runs, and with aggregates that count its calls."""
        return rows

    def finish(self, stage: str, make: Callable[[], DataFrame], keep: bool) -> DataFrame:
        """The table that ends a stage, ``keep``: computed here and now."""
        return once(make()) if keep else make()

    def prepare(self, stage: str, d: Columns) -> dict[str, Column]:
        """Columns to add before a stage's own expressions, which then refer to them by name.

        Shared terms belong here: an expression that repeats a long term grows
        with every use, and a column does not.
        """
        return {}

    def p2m(self, d: Columns, q: Column) -> dict[str, Column]:
        """d: particle minus centre."""
        raise NotImplementedError

    def m2m(self, d: Columns, m: dict[str, Column]) -> dict[str, Column]:
        """d: old centre minus new."""
        raise NotImplementedError

    def m2l(self, d: Columns, m: dict[str, Column]) -> dict[str, Column]:
        """d: target centre minus source centre."""
        raise NotImplementedError

    def l2l(self, d: Columns, l: dict[str, Column]) -> dict[str, Column]:  # noqa: E741
        """d: new centre minus old."""
        raise NotImplementedError

    def l2p(self, d: Columns, l: dict[str, Column], q: Column) -> dict[str, Column]:  # noqa: E741
        """d: particle minus centre."""
        raise NotImplementedError

    def p2p(self, d: Columns, q_target: Column, q_source: Column) -> dict[str, Column]:
        """d: source minus target."""
        raise NotImplementedError


class Count(Kernel):
    """Every particle counts all others: the exact check of any list or plan."""

    moments, locals_, outputs, values, by_count = ("m",), ("l",), ("rhs",), (), True

    def p2m(self, d, q):
        return {"m": F.lit(1).cast("bigint")}

    def m2m(self, d, m):
        return {"m": m["m"]}

    def m2l(self, d, m):
        return {"l": m["m"]}

    def l2l(self, d, l):  # noqa: E741
        return {"l": l["l"]}

    def l2p(self, d, l, q):  # noqa: E741
        return {"rhs": l["l"]}

    def p2p(self, d, q_target, q_source):
        return {"rhs": F.lit(1).cast("bigint")}


@dataclass
class Complex:
    re: Column
    im: Column

    def __add__(self, o: Complex) -> Complex:
        return Complex(self.re + o.re, self.im + o.im)

    def __mul__(self, o: Complex | float) -> Complex:
        if isinstance(o, Complex):
            return Complex(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)
        return Complex(self.re * o, self.im * o)


def _powers(z: Complex, n: int) -> dict[str, Column]:
    """Columns of z**1 .. z**n, each from modulus and argument."""
    radius, angle = F.sqrt(z.re * z.re + z.im * z.im), F.atan2(z.im, z.re)
    part = {"r": F.cos, "i": F.sin}
    return {f"_p{p}{k}": F.pow(radius, F.lit(float(k))) * f(angle * k) for k in range(1, n + 1) for p, f in part.items()}


def _power(k: int) -> Complex:
    return Complex(F.col(f"_pr{k}"), F.col(f"_pi{k}")) if k else Complex(F.lit(1.0), F.lit(0.0))


def _total(parts: Sequence[Complex]) -> Complex:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


class Log2D(Kernel):
    """The plane's logarithmic potential, -ln(r) / (2 pi), expanded to ``order``.

    Complex coefficients are pairs of columns.
    """

    outputs = ("pot",)
    batched, singular, gradients, channels, fields = True, True, False, ((0, 0, 0),), 1
    #: k over ln(r**2).
    logarithmic = -0.25 / pi

    def __init__(self, order: int = 8):
        self.order = order
        names = [f"{p}_{k}" for k in range(order + 1) for p in ("re", "im")]
        self.moments = tuple(f"w{n}" for n in names)
        self.locals_ = tuple(f"u{n}" for n in names)

    def _get(self, prefix: str, c: dict[str, Column]) -> list[Complex]:
        return [Complex(c[f"{prefix}re_{k}"], c[f"{prefix}im_{k}"]) for k in range(self.order + 1)]

    def _put(self, prefix: str, c: Sequence[Complex]) -> dict[str, Column]:
        return {f"{prefix}{p}_{k}": getattr(v, p) for k, v in enumerate(c) for p in ("re", "im")}

    def prepare(self, stage, d):
        if stage == "p2p":
            return {}
        if stage != "m2l":
            return _powers(Complex(*d), self.order)
        square = d[0] * d[0] + d[1] * d[1]
        return _powers(Complex(d[0] / square, -d[1] / square), 2 * self.order)

    def p2m(self, d, q):
        return self._put("w", [_power(k) * (q / float(factorial(k))) for k in range(self.order + 1)])

    def m2m(self, d, m):
        w = self._get("w", m)
        return self._put("w", [_total([_power(k - s) * w[s] * (1.0 / factorial(k - s)) for s in range(k + 1)]) for k in range(self.order + 1)])

    def m2l(self, d, m):
        w, p = self._get("w", m), self.order
        x, y = d
        angle = F.when((y == 0) & (x < 0), -pi).otherwise(F.atan2(y, x))
        first = _total([Complex(F.log(x * x + y * y) * -0.5, -angle) * w[0], *(_power(k) * w[k] * float(factorial(k - 1)) for k in range(1, p + 1))])
        rest = [_total([_power(k + n) * w[n] * float((-1) ** k * factorial(k + n - 1)) for n in range(p + 1)]) for k in range(1, p + 1)]
        return self._put("u", [first, *rest])

    def l2l(self, d, l):  # noqa: E741
        u = self._get("u", l)
        return self._put("u", [_total([_power(m - k) * u[m] * (1.0 / factorial(m - k)) for m in range(k, self.order + 1)]) for k in range(self.order + 1)])

    def l2p(self, d, l, q):  # noqa: E741
        u = self._get("u", l)
        return {"pot": _total([_power(m) * u[m] * (1.0 / factorial(m)) for m in range(self.order + 1)]).re / (2 * pi)}

    def p2p(self, d, q_target, q_source):
        return {"pot": q_source * F.log(d[0] * d[0] + d[1] * d[1]) * (-0.25 / pi)}

    def parts(self, d):
        return [(np.log(d[0] * d[0] + d[1] * d[1]) * (-0.25 / pi), [])]

    def radial(self, r2, k, pull=None):
        np.multiply(np.log(r2, out=k), -0.25 / pi, out=k)

    def results(self, pot, grad, q):
        return {"pot": pot[:, 0]}


def _square(d: Columns) -> Column:
    out = d[0] * d[0]
    for v in d[1:]:
        out = out + v * v
    return out


class Pairwise(Kernel):
    """P2P only: a radial interaction k(r) given by its value and derivative over r as functions of r squared.

    ``degree``: k scales as r ** -degree; None, if it does not scale.  The
    array expansions take the same numbers from ``parts``: an interaction may
    have several components, and ``channels`` say which component of which
    value adds to which field.  Components are even functions of the distance.
    """

    degree: int | None = None
    #: (value, component, field), by number.
    channels: tuple[tuple[int, int, int], ...] = ((0, 0, 0),)
    #: Whether the results ask for the fields' gradients.
    gradients = True
    singular, batched_from = True, 5_000

    def __init__(self, dim: int = 3):
        self.dim = dim
        self.outputs = (*(f"f{a}" for a in "xyz"[:dim]), "pot")

    @property
    def batched(self) -> bool:
        """With a ``field`` (or ``parts``), pairs go in batches."""
        return type(self).field is not Pairwise.field or type(self).parts is not Pairwise.parts

    @property
    def fields(self) -> int:
        return 1 + max(f for _, _, f in self.channels)

    def field(self, d: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """k, and its derivatives by the target's position, on arrays of distances (source minus target)."""
        raise NotImplementedError

    def parts(self, d: Sequence[np.ndarray]) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """``field`` of each component; no derivatives where nothing asks for gradients."""
        return [self.field(d)]

    def radial(self, r2: np.ndarray, k: np.ndarray, pull: np.ndarray | None = None) -> None:
        """``field`` by the squared distance, written into ``k`` and ``pull``: derivatives are ``pull`` times the distance (both stretched).

        Optional, for kernels with one component; sums of pairs are faster by it.
        """
        raise NotImplementedError

    def potential(self) -> Pairwise:
        """The same kernel without its forces."""
        out = copy(self)
        out.gradients, out.outputs = False, ("pot",)
        return out

    def at_distance(self, d: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Each component."""
        return [k for k, _ in self.parts(d)]

    def results(self, pot: np.ndarray, grad: np.ndarray, q: np.ndarray) -> dict[str, np.ndarray]:
        """The outputs from the fields (n x fields), their gradients (n x fields x 3) and the particles' own values (n x values)."""
        forces = {f"f{a}": grad[:, 0, k] * q[:, 0] for k, a in enumerate("xyz"[: self.dim])} if self.gradients else {}
        return forces | {"pot": pot[:, 0]}

    def value(self, r2: Column) -> Column:
        raise NotImplementedError

    def slope(self, r2: Column) -> Column:
        """k'(r) / r."""
        raise NotImplementedError

    def _apart(self, r2: Column) -> Column:
        """Null, which sums leave out, where particles coincide under a singular kernel."""
        return F.when(r2 != 0, r2) if self.singular else r2

    def p2p(self, d, q_target, q_source):
        r2 = self._apart(_square(d))
        pull = -q_target * q_source * self.slope(r2)
        return {f"f{a}": pull * v for a, v in zip("xyz", d, strict=False)} | {"pot": q_source * self.value(r2)}


class InverseR(Pairwise):
    """1 / r.  The force points to the source for like charges."""

    degree = 1

    def field(self, d):
        k = 1 / np.sqrt(sum(v * v for v in d))
        cube = k * k * k
        return k, [cube * v for v in d]

    def radial(self, r2, k, pull=None):
        np.divide(1.0, np.sqrt(r2, out=k), out=k)
        if pull is not None:
            np.multiply(np.multiply(k, k, out=pull), k, out=pull)

    def value(self, r2):
        return 1 / F.sqrt(r2)

    def slope(self, r2):
        return -1 / (r2 * F.sqrt(r2))


class InverseR2(Pairwise):
    """1 / r**2."""

    degree = 2

    def field(self, d):
        k = 1 / sum(v * v for v in d)
        return k, [2 * k * k * v for v in d]

    def radial(self, r2, k, pull=None):
        np.divide(1.0, r2, out=k)
        if pull is not None:
            np.multiply(np.multiply(k, k, out=pull), 2.0, out=pull)

    def value(self, r2):
        return 1 / r2

    def slope(self, r2):
        return -2 / (r2 * r2)


class LennardJones(Pairwise):
    """r**-12 - r**-6."""

    def field(self, d):
        r2 = sum(v * v for v in d)
        k6 = 1 / (r2 * r2 * r2)
        pull = (12 * k6 * k6 - 6 * k6) / r2
        return k6 * k6 - k6, [pull * v for v in d]

    def radial(self, r2, k, pull=None):
        k6 = 1 / (r2 * r2 * r2)
        np.subtract(k6 * k6, k6, out=k)
        if pull is not None:
            np.divide(12 * k6 * k6 - 6 * k6, r2, out=pull)

    def value(self, r2):
        r6 = r2 * r2 * r2
        return 1 / (r6 * r6) - 1 / r6

    def slope(self, r2):
        r6 = r2 * r2 * r2
        return (6 / r6 - 12 / (r6 * r6)) / r2


class OneOverAPlusR2(Pairwise):
    """1 / (a + r**2)."""

    def __init__(self, a: float = 1.0, dim: int = 3):
        super().__init__(dim)
        self.a, self.singular = a, a == 0

    def field(self, d):
        k = 1 / (self.a + sum(v * v for v in d))
        return k, [2 * k * k * v for v in d]

    def radial(self, r2, k, pull=None):
        np.divide(1.0, np.add(r2, self.a, out=k), out=k)
        if pull is not None:
            np.multiply(np.multiply(k, k, out=pull), 2.0, out=pull)

    def value(self, r2):
        return 1 / (r2 + self.a)

    def slope(self, r2):
        return -2 / ((r2 + self.a) * (r2 + self.a))


class AnisotropicInverseR(Pairwise):
    """1 / r after stretching each axis; the stretch is a parameter."""

    degree = 1

    def __init__(self, stretch: Sequence[float] = (1.0, 1.0, 1.0)):
        super().__init__(len(stretch))
        self.stretch = stretch

    def field(self, d):
        k = 1 / np.sqrt(sum((v * s) ** 2 for v, s in zip(d, self.stretch, strict=True)))
        cube = k * k * k
        return k, [cube * v * (s * s) for v, s in zip(d, self.stretch, strict=True)]

    radial = InverseR.radial

    def p2p(self, d, q_target, q_source):
        e = [v * s for v, s in zip(d, self.stretch, strict=True)]
        r2 = self._apart(_square(e))
        pull = q_target * q_source / (r2 * F.sqrt(r2))
        return {f"f{a}": pull * v * s for a, v, s in zip("xyz", e, self.stretch, strict=False)} | {"pot": q_source / F.sqrt(r2)}


class Polynomial(Pairwise):
    """1 + r**2 + r**4: interpolation reproduces it, so a far field of it is exact but for rounding."""

    singular = False

    def field(self, d):
        r2 = sum(v * v for v in d)
        return 1 + r2 + r2 * r2, [-(2 + 4 * r2) * v for v in d]

    def radial(self, r2, k, pull=None):
        np.add(np.multiply(np.add(r2, 1.0, out=k), r2, out=k), 1.0, out=k)
        if pull is not None:
            np.multiply(np.add(r2, 0.5, out=pull), -4.0, out=pull)

    def value(self, r2):
        return 1 + r2 + r2 * r2

    def slope(self, r2):
        return 2 + 4 * r2


class Many(Pairwise):
    """One interaction for several charges of a particle at once; outputs are named after the charge.

    Lists, distances and spectra are shared; each charge has moments and a field of its own.
    """

    def __init__(self, kernel: Pairwise, values: Sequence[str]):
        super().__init__(kernel.dim)
        self.kernel, self.values, self.degree, self.singular = kernel, tuple(values), kernel.degree, kernel.singular
        self.gradients, self.stretch = kernel.gradients, kernel.stretch
        self.channels = tuple((v, 0, v) for v in range(len(values)))
        self.outputs = tuple(f"{o}_{v}" for v in values for o in kernel.outputs)

    @property
    def batched(self) -> bool:
        return self.kernel.batched

    def parts(self, d):
        return self.kernel.parts(d)

    def radial(self, r2, k, pull=None):
        self.kernel.radial(r2, k, pull)

    def results(self, pot, grad, q):
        each = (self.kernel.results(pot[:, [k]], grad[:, [k]], q[:, [k]]) for k in range(len(self.values)))
        return {f"{o}_{v}": c for v, out in zip(self.values, each, strict=True) for o, c in out.items()}

    def p2p(self, d, q_target, q_source):
        return {f"{o}_{v}": c for v in self.values for o, c in self.kernel.p2p(d, q_target[v], q_source[v]).items()}


class RTensor(Pairwise):
    """delta_ij / r - r_i r_j / r**3: six entries of the symmetric tensor, no force."""

    PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
    degree = 1
    channels = tuple((0, c, c) for c in range(6))
    gradients = False
    #: Components are delta_ij k - r_i r_j pull, both from ``radial``.
    tensor = True

    def __init__(self):
        super().__init__(3)
        self.outputs = tuple(f"r{i}{j}" for i, j in self.PAIRS)

    def parts(self, d):
        inverse = 1 / np.sqrt(sum(v * v for v in d))
        cube = inverse * inverse * inverse
        return [((inverse if i == j else 0.0) - d[i] * d[j] * cube, []) for i, j in self.PAIRS]

    radial = InverseR.radial

    def results(self, pot, grad, q):
        return {name: pot[:, k] for k, name in enumerate(self.outputs)}

    def p2p(self, d, q_target, q_source):
        inverse = 1 / F.sqrt(self._apart(_square(d)))
        cube = inverse * inverse * inverse
        return {f"r{i}{j}": q_source * ((inverse if i == j else F.lit(0.0)) - d[i] * d[j] * cube) for i, j in self.PAIRS}


class RTensorProduct(RTensor):
    """The same tensor times a vector that each source carries: three values in, three fields out."""

    def __init__(self, values: Sequence[str] = ("qx", "qy", "qz")):
        super().__init__()
        self.values, self.outputs = tuple(values), ("ux", "uy", "uz")
        self.channels = tuple((j, self.PAIRS.index((min(i, j), max(i, j))), i) for i in range(3) for j in range(3))

    def p2p(self, d, q_target, q_source):
        inverse = 1 / F.sqrt(self._apart(_square(d)))
        cube = inverse * inverse * inverse
        along = d[0] * q_source[self.values[0]] + d[1] * q_source[self.values[1]] + d[2] * q_source[self.values[2]]
        return {o: inverse * q_source[v] - d[k] * along * cube for k, (o, v) in enumerate(zip(self.outputs, self.values, strict=True))}
