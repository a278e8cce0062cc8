"""Least-squares systems over the nodes of a support: families of rows, bounds, fixed nodes and solvers.

A support gives, for any places, the nodes that take part and their weights (`rows`) and slopes
(`slopes`). A family is a block of rows of equal width. Everything here is numpy inside one task; the
number of nodes is what bounds a task's memory, and `most_nodes` is checked before a solve.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd

from ..functions.grid import Grid
from ..functions.supports import Tetrahedra
from .interpolate import Field

MOST_NODES = 4_000_000
#: Rows of one interface up to which all pairs are made; beyond, each row is paired with the first.
ALL_PAIRS = 200


class Support(Protocol):
    size: int

    def rows(self, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]: ...

    def slopes(self, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]: ...

    def smoothness(self, weights: Mapping[str, float]) -> list[tuple[str, np.ndarray, np.ndarray]]: ...


#: Second derivatives by their axes.
SECOND = {"dxx": (0, 0), "dyy": (1, 1), "dzz": (2, 2), "dxy": (0, 1), "dxz": (0, 2), "dyz": (1, 2)}


class GridSupport:
    """A regular grid with trilinear weights."""

    def __init__(self, grid: Grid):
        self.grid, self.size = grid, int(np.prod(grid.nodes))
        self._field = Field(grid, np.zeros(0))
        self.rows, self.slopes = self._field.rows, self._field.slopes

    def _numbers(self) -> np.ndarray:
        return np.arange(self.size).reshape(self.grid.nodes[::-1])

    def smoothness(self, weights: Mapping[str, float]) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """Rows of second differences (name, nodes, coefficients); mixed ones by the corners of a cell's face, over the root of two."""
        numbers, out = self._numbers(), []

        def cut(shifts: dict[int, int], width: int, axes: tuple[int, ...]) -> np.ndarray:
            place = tuple(slice(shifts.get(a, 0), numbers.shape[2 - a] - width + shifts.get(a, 0)) if a in axes else slice(None) for a in (2, 1, 0))
            return numbers[place].reshape(-1)

        for name, (a, b) in SECOND.items():
            w = weights.get(name, 0.0)
            if not w or min(self.grid.nodes[a], self.grid.nodes[b]) < 3:
                continue
            if a == b:
                nodes = np.stack([cut({a: s}, 2, (a,)) for s in range(3)], 1)
                coefs = np.array([1.0, -2.0, 1.0])
            else:
                nodes = np.stack([cut({a: i, b: j}, 1, (a, b)) for i, j in ((0, 0), (1, 0), (0, 1), (1, 1))], 1)
                coefs = np.array([1.0, -1.0, -1.0, 1.0]) / np.sqrt(2.0)
            out.append((name, nodes, np.broadcast_to(coefs * w, nodes.shape)))
        return out

    def borders(self, w: float) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """No curvature across the faces: second differences of the three outermost layers."""
        numbers, out = self._numbers(), []
        for a in range(3):
            axis = 2 - a
            if numbers.shape[axis] < 3:
                continue
            for name, layers in (("low", (0, 1, 2)), ("high", (-1, -2, -3))):
                nodes = np.stack([np.take(numbers, i, axis).reshape(-1) for i in layers], 1)
                out.append((f"border_{'xyz'[a]}_{name}", nodes, np.broadcast_to(np.array([1.0, -2.0, 1.0]) * w, nodes.shape)))
        return out

    def nodes_at(self) -> np.ndarray:
        """The places of all nodes."""
        k, j, i = np.unravel_index(np.arange(self.size), self.grid.nodes[::-1])
        return np.array(self.grid.origin) + np.stack([i, j, k], 1) * np.array(self.grid.step)


class TetSupport:
    """Five tetrahedra for each cell of a grid, with linear weights."""

    def __init__(self, grid: Grid):
        self.grid, self.size = grid, int(np.prod(grid.nodes))
        self._cells = Field(grid, np.zeros(0))
        corners = np.array(Tetrahedra.CORNERS)  # place, corner, axis
        self._corners = np.stack([corners, np.where(np.arange(3) == 0, 1 - corners, corners)])  # even and odd cells
        edges = self._corners[:, :, 1:] - self._corners[:, :, :1]
        self._inverse = np.linalg.inv(edges.astype(float)).transpose(0, 1, 3, 2)

    def _found(self, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        inside, cell, place = self._cells._cell(xyz)
        odd = cell.sum(1) % 2
        away = place[:, None, :] - self._corners[odd, :, 0]
        w = np.einsum("npab,npb->npa", self._inverse[odd], away)
        w = np.concatenate([1 - w.sum(2, keepdims=True), w], 2)
        tet = w.min(2).argmax(1)
        return inside, cell, odd, tet, w[np.arange(len(xyz)), tet]

    def _nodes(self, cell: np.ndarray, odd: np.ndarray, tet: np.ndarray) -> np.ndarray:
        nx, ny, _ = self.grid.nodes
        at = cell[:, None, :] + self._corners[odd, tet]
        return at[:, :, 0] + nx * (at[:, :, 1] + ny * at[:, :, 2])

    def rows(self, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside, cell, odd, tet, w = self._found(xyz)
        return inside, self._nodes(cell, odd, tet), w

    def _slope(self, odd: np.ndarray, tet: np.ndarray) -> np.ndarray:
        inverse = self._inverse[odd, tet]  # n, corner 1 to 3, axis
        return np.concatenate([-inverse.sum(1, keepdims=True), inverse], 1) / np.array(self.grid.step)

    def slopes(self, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside, cell, odd, tet, _ = self._found(xyz)
        return inside, self._nodes(cell, odd, tet), self._slope(odd, tet)

    def elements(self) -> tuple[np.ndarray, np.ndarray]:
        """The nodes and the slopes of all tetrahedra."""
        cells = np.indices(self.grid.cells[::-1]).reshape(3, -1)[::-1].T
        cell, tet = np.repeat(cells, 5, 0), np.tile(np.arange(5), len(cells))
        odd = cell.sum(1) % 2
        return self._nodes(cell, odd, tet), self._slope(odd, tet)

    def faces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of tetrahedra that share a face, and the face's nodes."""
        nodes, _ = self.elements()
        face = np.concatenate([np.sort(np.delete(nodes, k, 1), 1) for k in range(4)])
        owner = np.tile(np.arange(len(nodes)), 4)
        order = np.lexsort(face.T)
        face, owner = face[order], owner[order]
        same = np.flatnonzero((face[1:] == face[:-1]).all(1))
        return owner[same], owner[same + 1], face[same]

    def smoothness(self, weights: Mapping[str, float]) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """The jump of the slope along the normal of each shared face; `weights` has one for `jump`."""
        w = weights.get("jump", 0.0)
        if not w:
            return []
        nodes, slopes = self.elements()
        one, two, face = self.faces()
        nx, ny, _ = self.grid.nodes
        place = np.stack([face % nx, face // nx % ny, face // (nx * ny)], 2) * np.array(self.grid.step)
        normal = np.cross(place[:, 1] - place[:, 0], place[:, 2] - place[:, 0])
        area = np.linalg.norm(normal, axis=1, keepdims=True)
        along = lambda t: np.einsum("nka,na->nk", slopes[t], normal / area)
        return [("jump", np.concatenate([nodes[one], nodes[two]], 1), w * np.sqrt(area) * np.concatenate([along(one), -along(two)], 1))]


@dataclass
class Block:
    name: str
    nodes: np.ndarray
    coefs: np.ndarray
    target: np.ndarray


@dataclass
class Bounds:
    """low <= Q c <= high, row by row."""

    nodes: np.ndarray
    coefs: np.ndarray
    low: np.ndarray
    high: np.ndarray


Solver = str | Callable[["System"], np.ndarray]


@dataclass
class System:
    """Rows of all families over `size` unknowns."""

    size: int
    blocks: list[Block] = field(default_factory=list)
    bounds: list[Bounds] = field(default_factory=list)
    fixed: dict[int, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.size > MOST_NODES:
            raise ValueError(f"{self.size} nodes; a task may hold {MOST_NODES}")

    def add(self, name: str, nodes: np.ndarray, coefs: np.ndarray, target: np.ndarray, w: np.ndarray | float = 1.0, scale: bool = True) -> None:
        """A family; rows are brought to length one before they are weighted."""
        if not len(nodes):
            return
        size = np.maximum(np.linalg.norm(coefs, axis=1), 1e-12) if scale else np.ones(len(nodes))
        factor = np.broadcast_to(w, len(nodes)) / size
        self.blocks.append(Block(name, nodes, coefs * factor[:, None], np.broadcast_to(target, len(nodes)) * factor))

    def bound(self, nodes: np.ndarray, coefs: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        if len(nodes):
            self.bounds.append(Bounds(nodes, coefs, np.broadcast_to(low, len(nodes)).astype(float), np.broadcast_to(high, len(nodes)).astype(float)))

    def forward(self, c: np.ndarray) -> list[np.ndarray]:
        return [(c[b.nodes] * b.coefs).sum(1) for b in self.blocks]

    def backward(self, parts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(self.size)
        for b, p in zip(self.blocks, parts, strict=True):
            out += np.bincount(b.nodes.reshape(-1), (b.coefs * p[:, None]).reshape(-1), self.size)
        return out

    def residuals(self, c: np.ndarray) -> dict[str, np.ndarray]:
        """Per family what each row misses its target by."""
        out: dict[str, np.ndarray] = {}
        for b, got in zip(self.blocks, self.forward(c), strict=True):
            out[b.name] = np.concatenate([out.get(b.name, np.empty(0)), got - b.target])
        return out

    def column_norms(self) -> np.ndarray:
        """The length of each unknown's column, 1 where it has none."""
        total = np.zeros(self.size)
        for b in self.blocks:
            total += np.bincount(b.nodes.reshape(-1), (b.coefs**2).reshape(-1), self.size)
        return np.where(total > 0, np.sqrt(total), 1.0)

    def solve(self, solver: Solver = "cg", start: np.ndarray | None = None, tol: float = 1e-10, ridge: float = 0.0, **options: float) -> np.ndarray:
        """Node values. solver: cg, lsmr, admm or a function of the system; admm is taken where there are bounds."""
        if callable(solver):
            return solver(self)
        x = np.zeros(self.size) if start is None else start.copy()
        free = np.ones(self.size, bool)
        for node, value in self.fixed.items():
            x[node], free[node] = value, False
        if self.bounds:
            return admm(self, x, free, tol=tol, ridge=ridge, **options)
        if solver == "lsmr":
            return lsmr(self, x, free, tol=tol)
        return least_squares(self, x, free, tol=tol, ridge=ridge)


def least_squares(system: System, x: np.ndarray, free: np.ndarray, tol: float = 1e-10, ridge: float = 0.0, extra: tuple[list[Bounds], float, list[np.ndarray]] | None = None, most: int = 4000) -> np.ndarray:
    """Conjugate gradients on the normal equations with columns brought to length one; nodes that aren't free stay."""
    scale = np.where(free, 1.0 / system.column_norms(), 0.0)

    def normal(v: np.ndarray) -> np.ndarray:
        out = system.backward(system.forward(v)) + ridge * v
        if extra is not None:
            out += extra[1] * _transposed(extra[0], _applied(extra[0], v), system.size)
        return out

    rhs = system.backward([b.target for b in system.blocks])
    if extra is not None:
        rhs += extra[1] * _transposed(extra[0], extra[2], system.size)
    r = scale * (rhs - normal(x))
    stop = tol * max(float(np.linalg.norm(scale * rhs)), 1e-300)
    p, rr, y = r.copy(), float(r @ r), np.zeros(system.size)
    for _ in range(most):
        if rr**0.5 <= stop:
            break
        q = scale * normal(scale * p)
        a = rr / float(p @ q)
        y += a * p
        r -= a * q
        new = float(r @ r)
        p, rr = r + (new / rr) * p, new
    return x + scale * y


def lsmr(system: System, x: np.ndarray, free: np.ndarray, tol: float = 1e-10, most: int = 4000) -> np.ndarray:
    """Bidiagonalisation of the system itself; the size of the normal equations' residual falls in every step."""
    mask = free.astype(float)
    norm = lambda parts: float(np.sqrt(sum((p @ p) for p in parts)))
    u = [b.target - f for b, f in zip(system.blocks, system.forward(x), strict=True)]
    beta = norm(u)
    if beta == 0:
        return x
    u = [p / beta for p in u]
    v = mask * system.backward(u)
    alpha = float(np.linalg.norm(v))
    if alpha == 0:
        return x
    v /= alpha
    zetabar, alphabar, rho, rhobar, cbar, sbar = alpha * beta, alpha, 1.0, 1.0, 1.0, 0.0
    h, hbar, out, first = v.copy(), np.zeros(system.size), np.zeros(system.size), alpha * beta
    for _ in range(most):
        u = [f - alpha * p for f, p in zip(system.forward(v), u, strict=True)]
        beta = norm(u)
        if beta > 0:
            u = [p / beta for p in u]
            v = mask * system.backward(u) - beta * v
            alpha = float(np.linalg.norm(v))
            v = v / alpha if alpha > 0 else v
        rho_old, rho = rho, float(np.hypot(alphabar, beta))
        c, s = alphabar / rho, beta / rho
        theta_new, alphabar = s * alpha, c * alpha
        rhobar_old, thetabar = rhobar, sbar * rho
        rho_temp = cbar * rho
        rhobar = float(np.hypot(rho_temp, theta_new))
        cbar, sbar = rho_temp / rhobar, theta_new / rhobar
        zeta, zetabar = cbar * zetabar, -sbar * zetabar
        hbar = h - (thetabar * rho / (rho_old * rhobar_old)) * hbar
        out += (zeta / (rho * rhobar)) * hbar
        h = v - (theta_new / rho) * h
        if abs(zetabar) <= tol * first or alpha == 0:
            break
    return x + out


def _applied(bounds: list[Bounds], c: np.ndarray) -> list[np.ndarray]:
    return [(c[b.nodes] * b.coefs).sum(1) for b in bounds]


def _transposed(bounds: list[Bounds], parts: list[np.ndarray], size: int) -> np.ndarray:
    out = np.zeros(size)
    for b, p in zip(bounds, parts, strict=True):
        out += np.bincount(b.nodes.reshape(-1), (b.coefs * p[:, None]).reshape(-1), size)
    return out


def admm(system: System, x: np.ndarray, free: np.ndarray, weight: float = 1.0, major: int = 200, least: int = 5, absolute: float = 1e-4, relative: float = 1e-3, tol: float = 1e-8, ridge: float = 0.0) -> np.ndarray:
    """Least squares with low <= Q c <= high: the bounds' values are projected, and what is left over is added to the next target.

    The weight grows where the bounds are missed by more than the projected values move, and shrinks in
    the other case, by two each time.
    """
    bounds = system.bounds
    z = [np.clip(q, b.low, b.high) for q, b in zip(_applied(bounds, x), bounds, strict=True)]
    over = [np.zeros(len(q)) for q in z]
    count = sum(len(q) for q in z)
    norm = lambda parts: float(np.sqrt(sum((p @ p) for p in parts)))
    for step in range(major):
        x = least_squares(system, x, free, tol, ridge, (bounds, weight, [a - b for a, b in zip(z, over, strict=True)]))
        q = _applied(bounds, x)
        old = z
        z = [np.clip(a + o, b.low, b.high) for a, o, b in zip(q, over, bounds, strict=True)]
        over = [o + a - c for o, a, c in zip(over, q, z, strict=True)]
        missed, moved = norm([a - b for a, b in zip(q, z, strict=True)]), weight * norm([a - b for a, b in zip(z, old, strict=True)])
        limit = absolute * count**0.5
        if step + 1 >= least and missed <= limit + relative * max(norm(q), norm(z)) * absolute and moved <= limit + relative * weight * norm(over):
            break
        change = 2.0 if missed > 10 * moved else 0.5 if moved > 10 * missed else 1.0
        weight, over = weight * change, [o / change for o in over]
    return x


@dataclass(frozen=True)
class Options:
    """Weights of the families and of smoothness, solver and its settings."""

    smooth: Mapping[str, float] = field(default_factory=lambda: dict.fromkeys(SECOND, 0.1) | {"jump": 0.1})
    directional: tuple[tuple[float, float, float], float] | None = None
    borders: float = 0.0
    weights: Mapping[str, float] = field(default_factory=dict)
    solver: Solver = "cg"
    tol: float = 1e-10
    norm: float | None = None
    rounds: int = 5


def regularisation(value: float | Mapping[str, float]) -> dict[str, float]:
    """One weight for all second derivatives and jumps, or one for each that is named."""
    names = [*SECOND, "jump"]
    if isinstance(value, Mapping):
        unknown = set(value) - set(names)
        if unknown:
            raise ValueError(f"no such regularisation: {sorted(unknown)}")
        return {n: float(value.get(n, 0.0)) for n in names}
    return dict.fromkeys(names, float(value))


def assemble(support: Support, data: pd.DataFrame, options: Options) -> System:
    """All families of a feature's constraints, in a fixed order; rows outside of the support take no part."""
    system = System(support.size)
    data = data.dropna(subset=["X", "Y", "Z"])
    xyz = data[["X", "Y", "Z"]].to_numpy(float)
    weight = data["w"].fillna(1.0).to_numpy(float) if "w" in data else np.ones(len(data))
    inside, node, value = support.rows(xyz)
    _, slope_node, slope = support.slopes(xyz)

    def of(*columns: str) -> tuple[np.ndarray, np.ndarray]:
        if not set(columns) <= set(data.columns):
            return np.zeros(len(data), bool), np.empty((0, len(columns)))
        some = data[list(columns)].notna().all(axis=1).to_numpy() & inside
        return some, data.loc[some, list(columns)].to_numpy(float)

    factor = lambda family: options.weights.get(family, 1.0)
    along = lambda some, v: np.einsum("nka,na->nk", slope[some], v)
    some, normal = of("nx", "ny", "nz")
    for a in range(3):
        system.add("normal", slope_node[some], slope[some][:, :, a], normal[:, a] if len(normal) else 0.0, weight[some] * factor("normal") / 3.0)
    some, gradient = of("gx", "gy", "gz")
    if some.any():  # flat along two directions across the gradient
        g = gradient / np.maximum(np.linalg.norm(gradient, axis=1, keepdims=True), 1e-12)
        other = np.where(np.abs(g[:, [2]]) < 0.9, np.array([[0.0, 0.0, 1.0]]), np.array([[1.0, 0.0, 0.0]]))
        first = np.cross(g, other)
        first /= np.linalg.norm(first, axis=1, keepdims=True)
        for across in (first, np.cross(g, first)):
            system.add("gradient", slope_node[some], along(some, across), 0.0, weight[some] * factor("gradient"))
    some, val = of("val")
    system.add("value", node[some], value[some], val[:, 0] if len(val) else 0.0, weight[some] * factor("value"))
    some, tangent = of("tx", "ty", "tz")
    if some.any():
        system.add("tangent", slope_node[some], along(some, tangent / np.maximum(np.linalg.norm(tangent, axis=1, keepdims=True), 1e-12)), 0.0, weight[some] * factor("tangent"))
    some, interface = of("interface")
    if some.any():
        i, j = _interface_pairs(interface[:, 0])
        n, v, w = node[some], value[some], weight[some]
        system.add("interface", np.concatenate([n[i], n[j]], 1), np.concatenate([v[i], -v[j]], 1), 0.0, np.sqrt(w[i] * w[j]) * factor("interface"))
    some, limits = of("l", "u")
    if some.any():
        system.bound(node[some], value[some], limits[:, 0], limits[:, 1])
    some, pair = of("pair_id")
    if some.any():
        i, j = _ordered_pairs(pair[:, 0])
        n, v = node[some], value[some]
        system.bound(np.concatenate([n[i], n[j]], 1), np.concatenate([v[i], -v[j]], 1), 0.0, np.inf)
    for name, nodes, coefs in support.smoothness(options.smooth):
        system.add(name, nodes, coefs, 0.0, scale=False)
    if options.directional is not None:
        vector, w = options.directional
        v = np.array(vector) / np.linalg.norm(vector)
        by_axes = {n: w * v[a] * v[b] * (1.0 if a == b else 2.0) for n, (a, b) in SECOND.items()}
        for name, nodes, coefs in support.smoothness(by_axes):
            system.add(f"directional_{name}", nodes, coefs, 0.0, scale=False)
    if options.borders:
        for name, nodes, coefs in support.borders(options.borders):
            system.add(name, nodes, coefs, 0.0, scale=False)
    return system


def _interface_pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal value: all pairs of a small interface, each row with the first in a large one."""
    left, right = [], []
    for x in np.unique(ids):
        rows = np.flatnonzero(ids == x)
        if len(rows) <= ALL_PAIRS:
            i, j = np.triu_indices(len(rows), 1)
            left.append(rows[i])
            right.append(rows[j])
        else:
            left.append(np.full(len(rows) - 1, rows[0]))
            right.append(rows[1:])
    return np.concatenate([np.empty(0, int), *left]).astype(int), np.concatenate([np.empty(0, int), *right]).astype(int)


def _ordered_pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower): every row of an id with every row of the next smaller id; the rest follow from these."""
    known = np.unique(ids)
    left, right = [np.empty(0, int)], [np.empty(0, int)]
    for low, high in zip(known[:-1], known[1:], strict=True):
        a, b = np.meshgrid(np.flatnonzero(ids == high), np.flatnonzero(ids == low), indexing="ij")
        left.append(a.reshape(-1))
        right.append(b.reshape(-1))
    return np.concatenate(left), np.concatenate(right)


def constant_norm(system: System, support: Support, places: np.ndarray, options: Options) -> np.ndarray:
    """Solved again and again with rows that hold the slope along its present direction at one size; their weight grows."""
    c = system.solve(options.solver, tol=options.tol)
    inside, nodes, slope = support.slopes(places)
    nodes, slope = nodes[inside], slope[inside]
    fixed = list(system.blocks)
    for i in range(1, options.rounds + 1):
        g = np.einsum("nk,nka->na", c[nodes], slope)
        way = g / np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)
        system.blocks = list(fixed)
        system.add("constant_norm", nodes, np.einsum("nka,na->nk", slope, way), options.norm, np.sqrt((0.1 * i) ** 2 + 0.01), scale=False)
        c = system.solve(options.solver, start=c, tol=options.tol)
    return c


def orthogonal(system: System, support: Support, places: np.ndarray, vectors: np.ndarray, w: float = 1.0, target: float = 0.0, name: str = "orthogonal") -> None:
    """Rows that hold the slope along given vectors at a target: 0 for fields at right angles, or a fold's directions."""
    inside, nodes, slope = support.slopes(places)
    system.add(name, nodes[inside], np.einsum("nka,na->nk", slope[inside], vectors[inside]), target, w)


@dataclass(frozen=True)
class FoldTerms:
    """Weights of a fold's rows: along its deformed orientation, its axis, and across both."""

    orientation: float = 1.0
    axis: float = 1.0
    normal: float = 1.0
    size: float = 1.0


def add_fold(system: System, support: Support, places: np.ndarray, direction: np.ndarray, axis: np.ndarray, terms: FoldTerms = FoldTerms()) -> None:
    """The field is flat along the fold's direction and axis, and has a given slope across them."""
    orthogonal(system, support, places, direction, terms.orientation, 0.0, "fold_direction")
    orthogonal(system, support, places, axis, terms.axis, 0.0, "fold_axis")
    across = np.cross(direction, axis)
    across /= np.maximum(np.linalg.norm(across, axis=1, keepdims=True), 1e-12)
    orthogonal(system, support, places, across, terms.normal, terms.size, "fold_normal")


class RadialField:
    """Values and a linear function over kernels of the cubed distance; dense, for a few thousand places."""

    def __init__(self, xyz: np.ndarray, values: np.ndarray, smooth: float = 0.0):
        n = len(xyz)
        if n > 5000:
            raise ValueError(f"{n} places; a dense system may have 5000")
        self.xyz = xyz
        far = np.linalg.norm(xyz[:, None] - xyz[None], axis=2) ** 3 + smooth * np.eye(n)
        flat = np.hstack([np.ones((n, 1)), xyz])
        whole = np.block([[far, flat], [flat.T, np.zeros((4, 4))]])
        rhs = np.concatenate([values, np.zeros((4, *values.shape[1:]))])
        self.coefs = np.linalg.lstsq(whole, rhs, rcond=None)[0]

    def value(self, xyz: np.ndarray) -> np.ndarray:
        far = np.linalg.norm(xyz[:, None] - self.xyz[None], axis=2) ** 3
        return far @ self.coefs[: len(self.xyz)] + np.hstack([np.ones((len(xyz), 1)), xyz]) @ self.coefs[len(self.xyz) :]


class SupportField:
    """Solved node values over any support."""

    def __init__(self, support: Support, values: np.ndarray):
        self.support, self.values = support, values

    def value(self, xyz: np.ndarray) -> np.ndarray:
        inside, nodes, w = self.support.rows(xyz)
        return np.where(inside, (self.values[nodes] * w).sum(1), np.nan)

    def gradient(self, xyz: np.ndarray) -> np.ndarray:
        inside, nodes, w = self.support.slopes(xyz)
        return np.where(inside[:, None], np.einsum("nk,nka->na", self.values[nodes], w), np.nan)


#: Name to support; the registry that `build` goes by, open to others.
SUPPORTS: dict[str, Callable[[Grid], Support]] = {"FDI": GridSupport, "PLI": TetSupport}


def build(kind: str, grid: Grid, data: pd.DataFrame, options: Options = Options()) -> SupportField:
    """The field of one feature by the named interpolator."""
    if kind not in SUPPORTS:
        raise ValueError(f"no interpolator {kind}; known are {sorted(SUPPORTS)}")
    support = SUPPORTS[kind](grid)
    system = assemble(support, data, options)
    if options.norm is not None:
        places = np.array(grid.origin) + (np.indices(grid.cells).reshape(3, -1).T + 0.5) * np.array(grid.step)
        return SupportField(support, constant_norm(system, support, places, options))
    return SupportField(support, system.solve(options.solver, tol=options.tol))
