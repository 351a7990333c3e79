"""3D expansions whose coefficients are too many for columns: numpy, in Arrow batches.

Coordinates are relative to a box centre and scaled so that the box is
[-1, 1]**3.  A unit system per level keeps every translation matrix the same
at all levels; only the transfer carries the level: as a power of the width
where the kernel is homogeneous, else through spectra of its own.
"""

from __future__ import annotations

from functools import cached_property
from itertools import product

import numpy as np

from .kernels import InverseR, InverseR2, Many, Pairwise

SLOTS = np.array(list(product((0, 1), repeat=3)))


class Expansion:
    """Contract of the array kernels.

    ``size`` values (float64) describe a box for one charge, or one field.  A
    row of moments has those of all charges, a row of locals those of all
    fields; the kernel's channels say which charge makes which field.
    """

    size: int
    #: The interaction itself, for the near field.  Its ``degree`` says how it scales.
    near: Pairwise

    @property
    def charges(self) -> int:
        return len(self.near.values)

    @property
    def fields(self) -> int:
        return self.near.fields

    def basis(self, x: np.ndarray) -> np.ndarray:
        """What a particle of charge 1 contributes: n x size."""
        raise NotImplementedError

    def p2m(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Contribution of each particle (q: n x charges), a row of moments."""
        return (q[:, :, None] * self.basis(x)[:, None, :]).reshape(len(x), -1)

    def lift(self, slot: int, rows: np.ndarray) -> np.ndarray:
        """Moments of children in a slot, as their parents'."""
        raise NotImplementedError

    def lower(self, slot: int, rows: np.ndarray) -> np.ndarray:
        """Locals of parents, as their children's in a slot."""
        raise NotImplementedError

    def spectrum(self, moments: np.ndarray) -> np.ndarray:
        """Moments as the transfer wants them: n x charges x ..."""
        return moments.reshape(len(moments), self.charges, self.size)

    def transfer(self, offset: tuple[int, int, int], spectrum: np.ndarray, width: float) -> np.ndarray:
        """What boxes of a width send over an offset (source minus target, in boxes): n x fields x ..."""
        raise NotImplementedError

    def scale(self, width: float) -> float:
        """From scaled to real distances, for boxes of a width; 1 where ``transfer`` sees to it."""
        return 1.0 if self.near.degree is None else (2 / width) ** self.near.degree

    def unspectrum(self, total: np.ndarray) -> np.ndarray:
        """Rows of locals."""
        return total.reshape(len(total), self.fields * self.size)

    def l2p(self, x: np.ndarray, local: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fields (n x fields) and gradients in scaled coordinates (n x fields x 3) of n particles in the boxes ``at``, given rows of locals."""
        raise NotImplementedError


class Lagrange(Expansion):
    """Interpolation at ``order`` equispaced nodes per axis; any kernel that is smooth away from zero.

    The transfer is a convolution over nodes, done as a product of spectra, and
    a box moves to its parent axis by axis.  ``kernel`` is a Pairwise kernel
    (or "1/r", "1/r2"), of which the components at a distance, the channels and
    the degree are asked here.
    """

    NAMED = {"1/r": InverseR, "1/r2": InverseR2}

    def __init__(self, order: int = 8, kernel: Pairwise | str = "1/r"):
        self.order, self.near = order, self.NAMED[kernel]() if isinstance(kernel, str) else kernel
        self.size = order**3
        self.nodes = np.linspace(-1, 1, order)
        self._spectra: dict[tuple, list[np.ndarray]] = {}

    @cached_property
    def _weights(self) -> np.ndarray:
        d = self.nodes[:, None] - self.nodes[None] + np.eye(self.order)
        return 1 / d.prod(1)

    def _basis(self, t: np.ndarray) -> np.ndarray:
        """Lagrange polynomials at t (clamped into the box): n x order."""
        t = np.clip(t, -1, 1)
        d = t[:, None] - self.nodes
        left = np.cumprod(np.concatenate([np.ones((len(t), 1)), d[:, :-1]], 1), 1)
        right = np.cumprod(np.concatenate([np.ones((len(t), 1)), d[:, :0:-1]], 1), 1)[:, ::-1]
        return left * right * self._weights

    @cached_property
    def _derivative(self) -> np.ndarray:
        """Values of the basis' derivatives at the nodes: node x polynomial."""
        w, x = self._weights, self.nodes
        d = (w[None] / w[:, None]) / (x[:, None] - x[None] + np.eye(self.order))
        d[np.diag_indices(self.order)] = 0
        d[np.diag_indices(self.order)] = -d.sum(1)
        return d

    def basis(self, x):
        b = [self._basis(x[:, k]) for k in range(3)]
        return (b[0][:, :, None, None] * b[1][:, None, :, None] * b[2][:, None, None, :]).reshape(len(x), -1)

    @cached_property
    def _child(self) -> list[np.ndarray]:
        """Per axis and half: the parent's polynomials at the child's nodes."""
        return [self._basis(self.nodes / 2 + (h - 0.5)) for h in (0, 1)]

    def _moved(self, rows: np.ndarray, matrices: list[np.ndarray]) -> np.ndarray:
        """One matrix (old node x new node) along each axis."""
        p, (a, b, c) = self.order, matrices
        u = rows.reshape(-1, p) @ c
        u = np.matmul(b.T, u.reshape(-1, p, p))
        return np.matmul(a.T, u.reshape(-1, p, p * p)).reshape(rows.shape)

    def lift(self, slot, rows):
        return self._moved(rows, [self._child[h] for h in SLOTS[slot]])

    def lower(self, slot, rows):
        return self._moved(rows, [self._child[h].T for h in SLOTS[slot]])

    def spectrum(self, moments):
        n = 2 * self.order - 1
        return np.fft.rfftn(moments.reshape(-1, self.charges, *[self.order] * 3), (n, n, n), axes=(2, 3, 4))

    def _kernels(self, offset: tuple[int, int, int], unit: float) -> list[np.ndarray]:
        """The spectrum of each component over an offset.  Components are even, so that of the opposite offset is the conjugate."""
        if (offset, unit) not in self._spectra:
            if offset < (0, 0, 0):
                found = [k.conj() for k in self._kernels(tuple(-o for o in offset), unit)]
            else:
                n, step = 2 * self.order - 1, 2 / (self.order - 1)
                lag = np.where(np.arange(n) < self.order, np.arange(n), np.arange(n) - n) * step
                d = np.meshgrid(*((2.0 * o - lag) * unit for o in offset), indexing="ij")  # source node minus target node
                found = [np.fft.rfftn(k) for k in self.near.at_distance(d)]
            self._spectra[offset, unit] = found
        return self._spectra[offset, unit]

    def transfer(self, offset, spectrum, width):
        kernels = self._kernels(offset, 1.0 if self.near.degree is not None else width / 2)
        if len(self.near.channels) == 1:
            return spectrum * kernels[0]
        out = np.zeros((len(spectrum), self.fields, *spectrum.shape[2:]), complex)
        for value, component, field in self.near.channels:
            out[:, field] += spectrum[:, value] * kernels[component]
        return out

    def unspectrum(self, total):
        n, p = 2 * self.order - 1, self.order
        return np.fft.irfftn(total, (n, n, n), axes=(2, 3, 4))[:, :, :p, :p, :p].reshape(len(total), -1)

    def l2p(self, x, local, at):
        p, n, f = self.order, len(x), self.fields
        b = [self._basis(x[:, k]) for k in range(3)]
        u = local[at].reshape(n, f * p * p, p)
        uz = np.matmul(u, b[2][:, :, None]).reshape(n, f * p, p)
        uy = np.matmul(uz, b[1][:, :, None]).reshape(n, f, p)
        pot = np.matmul(uy, b[0][:, :, None])[:, :, 0]
        if not self.near.gradients:
            return pot, np.zeros((n, f, 0))
        g = [v @ self._derivative for v in b]
        gz = np.matmul(np.matmul(u, g[2][:, :, None]).reshape(n, f * p, p), b[1][:, :, None]).reshape(n, f, p)
        gy = np.matmul(uz, g[1][:, :, None]).reshape(n, f, p)
        return pot, np.concatenate([np.matmul(uy, g[0][:, :, None]), np.matmul(gy, b[0][:, :, None]), np.matmul(gz, b[0][:, :, None])], 2)


#: From this order on, harmonics are transferred by rotations, and below it by one matrix, which is faster there.
ROTATE_FROM = 16


class Harmonic(Expansion):
    """Solid harmonics to ``order`` for 1/r, moved by their addition theorems.

    Y is regular (r**n), T irregular (r**-n-1), both without normalising roots:
    1/|x-y| = sum conj(Y(y)) T(x);  Y(a+b) = sum Y(a) Y(b);
    T(a+b) = sum (-1)**k conj(Y(b)) T(a), orders adding.

    Fields are real, so the coefficients of -m follow from those of m, and a
    box keeps (order + 1)**2 reals: of each degree the order 0, and real and
    imaginary parts of the orders above it.  Moves are real matrices on those.
    The transfer turns its direction into the z axis, where orders do not mix,
    moves there and turns back (order**3 instead of order**4 operations); at low
    orders one product with the whole matrix is faster.
    """

    def __init__(self, order: int = 8, charges: tuple[str, ...] = ("q",), rotate: bool | None = None):
        self.order, self.near = order, InverseR() if charges == ("q",) else Many(InverseR(), charges)
        self.rotate = order >= ROTATE_FROM if rotate is None else rotate
        self.index = {(n, m): n * n + n + m for n in range(2 * order + 1) for m in range(-n, n + 1)}
        self.size = (order + 1) ** 2
        self._matrices: dict = {}

    def _regular(self, x: np.ndarray, top: int) -> np.ndarray:
        out = np.zeros((len(x), (top + 1) ** 2), complex)
        xy, z, r2 = x[:, 0] + 1j * x[:, 1], x[:, 2], (x * x).sum(1)
        i = self.index
        out[:, 0] = 1
        for n in range(1, top + 1):
            out[:, i[n, n]] = -xy / (2 * n) * out[:, i[n - 1, n - 1]]
            for m in range(n):
                lower = r2 * out[:, i[n - 2, m]] if m <= n - 2 else 0
                out[:, i[n, m]] = ((2 * n - 1) * z * out[:, i[n - 1, m]] - lower) / (n * n - m * m)
            for m in range(1, n + 1):
                out[:, i[n, -m]] = (-1) ** m * out[:, i[n, m]].conj()
        return out

    def _irregular(self, x: np.ndarray, top: int) -> np.ndarray:
        out = np.zeros((len(x), (top + 1) ** 2), complex)
        xy, z, r2 = x[:, 0] + 1j * x[:, 1], x[:, 2], (x * x).sum(1)
        i = self.index
        out[:, 0] = 1 / np.sqrt(r2)
        for n in range(1, top + 1):
            out[:, i[n, n]] = -(2 * n - 1) * xy / r2 * out[:, i[n - 1, n - 1]]
            for m in range(n):
                lower = ((n - 1) ** 2 - m * m) * out[:, i[n - 2, m]] if m <= n - 2 else 0
                out[:, i[n, m]] = ((2 * n - 1) * z * out[:, i[n - 1, m]] - lower) / r2
            for m in range(1, n + 1):
                out[:, i[n, -m]] = (-1) ** m * out[:, i[n, m]].conj()
        return out

    def _low(self):
        return ((nm, t) for nm, t in self.index.items() if nm[0] <= self.order)

    @cached_property
    def _degrees(self) -> tuple[np.ndarray, np.ndarray]:
        """Degree and order of each complex coefficient."""
        return tuple(np.array([nm for nm, _ in self._low()]).T)

    # Real rows.  Degree n has the places n**2 .. n**2 + 2n: order 0, then real and imaginary part of each order.

    @cached_property
    def _places(self) -> list[tuple[int, int, int]]:
        """(degree, order, part) of each place; part 1 is imaginary."""
        return [(n, m, part) for n in range(self.order + 1) for m in range(n + 1) for part in ((0,) if m == 0 else (0, 1))]

    @cached_property
    def _full(self) -> np.ndarray:
        """Real rows times this are all complex coefficients."""
        out = np.zeros((self.size, self.size), complex)
        for k, (n, m, part) in enumerate(self._places):
            unit = 1j if part else 1
            out[k, self.index[n, m]] = unit
            if m:
                out[k, self.index[n, -m]] = (-1) ** m * np.conj(unit)
        return out

    def _packed(self, c: np.ndarray) -> np.ndarray:
        """Complex coefficients as real rows."""
        at = [self.index[n, m] for n, m, _ in self._places]
        part = np.array([p for *_, p in self._places], bool)
        return np.where(part, c[..., at].imag, c[..., at].real)

    def basis(self, x):
        return self._packed(self._regular(x, self.order))

    def _kept(self, key, make) -> np.ndarray:
        if key not in self._matrices:
            self._matrices[key] = make()
        return self._matrices[key]

    def _move(self, slot: int, down: bool) -> np.ndarray:
        """Child centre minus parent's is +-1/2 in parent units, and the child's unit is half the parent's."""
        y = self._regular((SLOTS[slot] - 0.5)[None], self.order)[0]
        n, m = self._degrees
        dn, dm = n[None] - n[:, None], m[None] - m[:, None]  # of the column less that of the row
        inside = np.abs(dm) <= dn
        c = np.where(inside, y[np.where(inside, dn * dn + dn + dm, 0)], 0) * 0.5 ** n[:, None]
        return self._packed(self._full @ (c.conj().T if down else c))

    def _times(self, rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        return (rows.reshape(-1, self.size) @ matrix).reshape(rows.shape)

    def lift(self, slot, rows):
        return self._times(rows, self._kept(("up", slot), lambda: self._move(slot, False)))

    def lower(self, slot, rows):
        return self._times(rows, self._kept(("down", slot), lambda: self._move(slot, True)))

    def _across(self, x: np.ndarray) -> np.ndarray:
        """From moments to the locals at a centre that lies at ``x`` from theirs."""
        t = self._irregular(x[None], 2 * self.order)[0]
        n, m = self._degrees
        dn, dm = n[None] + n[:, None], m[None] + m[:, None]
        return self._packed(self._full.conj() @ (t[dn * dn + dn + dm] * (-1.0) ** n[None]))

    @cached_property
    def _gradients(self) -> list[np.ndarray]:
        """Locals of the field's derivative along each axis, from locals."""
        step = []
        for i in (-1, 0, 1):
            c = np.zeros((self.size, self.size))
            for (n, m), to in self._low():
                if n < self.order:
                    c[self.index[n + 1, m + i], to] = 1
            step.append(c)
        low, flat, high = step
        return [self._packed(self._full @ c) for c in ((low - high) / 2, 1j * (low + high) / 2, flat)]

    @cached_property
    def _weight(self) -> np.ndarray:
        """Orders above 0 stand for two."""
        return np.array([1.0 if m == 0 else 2.0 for _, m, _ in self._places])

    def _turns(self, turn: np.ndarray) -> list[np.ndarray]:
        """For each degree the matrix from a row at x to the row at ``turn`` x.

        By recurrence over the degree: derivatives take a degree to the one
        below, where the matrix is known, and three of them determine a row.
        """
        out = [np.ones((1, 1))]
        for n in range(1, self.order + 1):
            # rows of degree n times these are their derivatives' rows of degree n - 1, in the weighted sum of a field
            low, here = slice((n - 1) ** 2, n * n), slice(n * n, (n + 1) ** 2)
            d = [(g[here, low] * self._weight[low] / self._weight[here, None]).T for g in self._gradients]
            right = [out[-1] @ sum(turn[b, a] * d[b] for b in range(3)) for a in range(3)]
            out.append(np.linalg.lstsq(np.concatenate(d), np.concatenate(right), rcond=None)[0])
        return out

    def _turned(self, offset: tuple[int, int, int]) -> tuple[list[np.ndarray], list[np.ndarray], list[tuple[list[int], np.ndarray]]]:
        """Turn there, turn back, and the moves along z by order (places, matrix)."""
        x = -2.0 * np.array(offset, float)
        length = np.sqrt((x * x).sum())
        z = x / length
        side = np.cross(z, [1.0, 0, 0] if abs(z[0]) < 0.9 else [0, 1.0, 0])
        side /= np.sqrt((side * side).sum())
        there = self._turns(np.stack([side, np.cross(z, side), z]))
        back = [self._weight[n * n : (n + 1) ** 2, None] * r.T / self._weight[n * n : (n + 1) ** 2] for n, r in enumerate(there)]

        def along() -> list[tuple[list[int], np.ndarray]]:
            whole = self._across(np.array([0, 0, length]))
            orders = {}
            for k, (_, m, part) in enumerate(self._places):
                orders.setdefault((m, part), []).append(k)
            return [(at, whole[np.ix_(at, at)]) for at in orders.values()]

        return there, back, self._kept(("z", round(float(x @ x))), along)

    def transfer(self, offset, spectrum, width):
        rows = spectrum.reshape(-1, self.size)
        if not self.rotate:
            return (rows @ self._kept(offset, lambda: self._across(-2.0 * np.array(offset, float)))).reshape(spectrum.shape)
        there, back, along = self._kept(("turn", offset), lambda: self._turned(offset))
        turned, moved, out = np.empty_like(rows), np.empty_like(rows), np.empty_like(rows)
        for n, r in enumerate(there):
            turned[:, n * n : (n + 1) ** 2] = rows[:, n * n : (n + 1) ** 2] @ r
        for at, z in along:
            moved[:, at] = turned[:, at] @ z
        for n, r in enumerate(back):
            out[:, n * n : (n + 1) ** 2] = moved[:, n * n : (n + 1) ** 2] @ r
        return out.reshape(spectrum.shape)

    def l2p(self, x, local, at):
        y = (self.basis(x) * self._weight)[:, None, :]
        rows = local.reshape(len(local), self.fields, self.size)
        value = lambda c: (y * c[at]).sum(2)
        return value(rows), np.stack([value(rows @ g) for g in self._gradients], 2)
