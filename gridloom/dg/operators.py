"""One-dimensional operator matrices, element sets and the operators of a problem."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np

from gridloom.dg.basis import legendre, nodes, project, wavelet_matrix
from gridloom.dg.solve import Factors
from gridloom.dg.spec import FLUX, Dim, Partial, Problem, Term


def coefficient(p: Partial, dim: Dim, t: float = 0.0, rotate: bool = True) -> np.ndarray:
    """Matrix of a partial term in one dimension, in wavelet order if rotated.

    With c = g times the surface jacobian: mass has blocks of c phi phi^T; div has
    the volume part -c phi' phi^T and couples neighbours by their traces with the
    mean of c and its modulus times the flux scale; penalty has the jump part only;
    grad is minus the transpose of a div with exchanged boundaries and reversed flux.
    """
    k, n = dim.degree, 1 << dim.level
    h = (dim.high - dim.low) / n

    def c(x):
        v = np.ones_like(x) if p.g is None else np.asarray(p.g(x, t), float) * np.ones_like(x)
        return v if p.jacobian is None else v * np.asarray(p.jacobian(x), float)

    x, r, w = nodes(k, dim.level, dim.low, dim.high)
    phi, slope = legendre(r, k)
    phi, slope = phi / np.sqrt(h), slope / np.sqrt(h) * 2 / h
    out = np.zeros((n, k, n, k))
    at = np.arange(n)
    weight = c(x.ravel()).reshape(x.shape) * w * h / 2
    if p.kind == "mass":
        out[at, :, at, :] = np.einsum("cq,qi,qj->cij", weight, phi, phi)
    else:
        grad = p.kind == "grad"
        swap = {"dirichlet": "neumann", "neumann": "dirichlet", "periodic": "periodic"}
        left, right = (swap[p.left], swap[p.right]) if grad else (p.left, p.right)
        s = -FLUX[p.flux] if grad else FLUX[p.flux]
        if p.kind != "penalty":
            out[at, :, at, :] -= np.einsum("cq,qi,qj->cij", weight, slope, phi)
        low, high = (legendre(np.array([v]), k)[0][0] / np.sqrt(h) for v in (-1.0, 1.0))
        at_edges = dim.low + h * np.arange(n + 1)
        edges = c(at_edges)
        bad = ~np.isfinite(edges)  # a coefficient that has no value at an end is taken a little inside
        if bad.any():
            inward = np.where(at_edges < 0.5 * (dim.low + dim.high), 1e-7, -1e-7) * h
            edges[bad] = c(at_edges + inward)[bad]
        fl, fr = edges[:-1] / 2, edges[1:] / 2
        ml, mr = s * np.abs(fl), s * np.abs(fr)
        if p.kind == "penalty":
            fl, fr = np.zeros(n), np.zeros(n)
        ll, lr, rl, rr = np.outer(low, low), np.outer(low, high), np.outer(high, low), np.outer(high, high)
        for i in range(n):
            inner_left, inner_right = i > 0 or left == "periodic", i < n - 1 or right == "periodic"
            if inner_left:
                out[i, :, (i - 1) % n, :] += (-fl[i] - ml[i]) * lr
                out[i, :, i, :] += (-fl[i] + ml[i]) * ll
            elif p.kind == "penalty":
                out[i, :, i, :] += ml[i] * ll if left == "dirichlet" else 0
            elif left == "neumann":
                out[i, :, i, :] += -2 * fl[i] * ll
            if inner_right:
                out[i, :, i, :] += (fr[i] + mr[i]) * rr
                out[i, :, (i + 1) % n, :] += (fr[i] - mr[i]) * rl
            elif p.kind == "penalty":
                out[i, :, i, :] += mr[i] * rr if right == "dirichlet" else 0
            elif right == "neumann":
                out[i, :, i, :] += 2 * fr[i] * rr
    matrix = out.reshape(n * k, n * k)
    if p.kind == "grad":
        matrix = -matrix.T
    if rotate:
        w_ = wavelet_matrix(k, dim.level)
        matrix = w_ @ matrix @ w_.T
    return matrix


def mass_matrix(dim: Dim, weight=None) -> np.ndarray:
    """Mass matrix with a weight function (of x), by default the dimension's volume jacobian."""
    weight = dim.jacobian if weight is None else weight
    return coefficient(Partial("mass", None if weight is None else (lambda x, t: weight(x))), dim)


def lhs_mass(p: Partial, dim: Dim) -> np.ndarray:
    """Mass matrix that a partial term is solved with: its own left-hand weight times the volume jacobian."""
    weights = [f for f in (p.lhs, dim.jacobian) if f is not None]
    return mass_matrix(dim, lambda x: np.prod([np.asarray(f(x), float) for f in weights], axis=0))


def chain(parts: tuple[Partial, ...], dim: Dim, t: float = 0.0) -> np.ndarray:
    """Product of the partial terms, each with its left-hand mass solved."""
    out = None
    for p in parts:
        m = np.eye(dim.degree << dim.level) if p.identity else coefficient(p, dim, t)
        if (p.g or p.jacobian) and (p.lhs or dim.jacobian):
            m = np.linalg.solve(lhs_mass(p, dim), m)
        out = m if out is None else out @ m
    return out


def index_1d(level: int, cell: int) -> int:
    return 0 if level == 0 else (1 << (level - 1)) + cell


@dataclass(frozen=True)
class Elements:
    """Ordered elements: levels and cells, one row each; the order is that of the state vector."""

    levels: np.ndarray
    cells: np.ndarray

    @staticmethod
    def of(problem: Problem, full: bool = False) -> Elements:
        limits = [d.level for d in problem.dims]
        sets = [t for t in itertools.product(*[range(v + 1) for v in limits]) if full or sum(t) <= max(limits)]
        sets.sort(key=lambda t: t[::-1])
        if not full:
            sets.sort(key=lambda t: -sum(t))
        levels, cells = [], []
        for t in sets:
            for c in itertools.product(*[range(1 << max(0, v - 1)) for v in t[::-1]]):
                levels.append(t)
                cells.append(c[::-1])
        return Elements(np.array(levels), np.array(cells))

    def __len__(self) -> int:
        return len(self.levels)

    @property
    def indices(self) -> np.ndarray:
        return np.where(self.levels == 0, 0, (1 << np.maximum(self.levels - 1, 0)) + self.cells)

    def keep(self, mask: np.ndarray) -> Elements:
        return Elements(self.levels[mask], self.cells[mask])

    def grown(self, new: list[tuple]) -> Elements:
        if not new:
            return self
        return Elements(np.vstack([self.levels, [n[0] for n in new]]), np.vstack([self.cells, [n[1] for n in new]]))

    def children(self, chosen: np.ndarray, limits: list[int]) -> list[tuple]:
        """New children of the chosen elements in the order in which they are found."""
        known = {(*map(int, a), *map(int, b)) for a, b in zip(self.levels, self.cells, strict=True)}
        out = []
        for e in np.flatnonzero(chosen):
            for d in range(self.levels.shape[1]):
                level = int(self.levels[e, d])
                if level >= limits[d]:
                    continue
                for c in [0] if level == 0 else [2 * int(self.cells[e, d]), 2 * int(self.cells[e, d]) + 1]:
                    lev, cell = [int(v) for v in self.levels[e]], [int(v) for v in self.cells[e]]
                    lev[d], cell[d] = level + 1, c
                    if (*lev, *cell) not in known:
                        known.add((*lev, *cell))
                        out.append((tuple(lev), tuple(cell)))
        return out

    def dofs(self, degree: int) -> np.ndarray:
        """One-dimensional row of each coefficient in each dimension, last dimension fastest."""
        d = self.levels.shape[1]
        digits = np.array(list(itertools.product(range(degree), repeat=d)))
        return (self.indices[:, None, :] * degree + digits[None, :, :]).reshape(-1, d)


def combine(vectors: list[np.ndarray], dofs: np.ndarray) -> np.ndarray:
    out = np.ones(len(dofs))
    for d, v in enumerate(vectors):
        out = out * v[dofs[:, d]]
    return out


def separable(problem: Problem, functions, dofs: np.ndarray, t: float = 0.0, call_time: bool = True) -> np.ndarray:
    """Coefficients of a product of one-dimensional functions f(x, t), the dimensions' masses solved."""
    vectors = []
    for dim, f in zip(problem.dims, functions, strict=True):
        v = project(lambda x, f=f: f(x, t), dim.degree, dim.level, dim.low, dim.high, dim.jacobian)
        vectors.append(v if dim.jacobian is None else np.linalg.solve(mass_matrix(dim), v))
    return combine(vectors, dofs)


def apply_rows(factors: list[list[np.ndarray]], dofs: np.ndarray, x: np.ndarray, rows: slice = slice(None)) -> np.ndarray:
    """Rows of the sum of Kronecker products times x, block by block, so that no system matrix is held."""
    own = dofs[rows]
    out = np.zeros(len(own))
    for low in range(0, len(own), 512):
        block = own[low : low + 512]
        for one in factors:
            part = np.broadcast_to(x, (len(block), len(x))).copy()
            for d, f in enumerate(one):
                part *= f[np.ix_(block[:, d], dofs[:, d])]
            out[low : low + len(block)] += part.sum(1)
    return out


class Operators:
    """One-dimensional matrices of all terms at a time, applied to state vectors of an element set."""

    _last: Operators | None = None

    def __init__(self, problem: Problem, elements: Elements, t: float = 0.0, flag: str | None = None):
        self.problem, self.elements = problem, elements
        self.dofs = elements.dofs(problem.degree)
        terms = [x for x in problem.terms if flag is None or x.flag in ("both", flag)]
        self.factors = [[chain(c, d, t) for c, d in zip(x.chains, problem.dims, strict=True)] for x in terms]

    @staticmethod
    def cached(problem: Problem, elements: Elements, t: float) -> Operators:
        """The operators of the last call, if problem and elements are the same and no coefficient depends on time."""
        last = Operators._last
        if last is None or last.problem is not problem or last.elements is not elements or last.depends and last.t != t:
            last = Operators._last = Operators(problem, elements, t)
            last.t, last.depends = t, problem.depends_on_time()
            last.factored = {}
        return last

    @staticmethod
    def forget() -> None:
        """Lets the operators of the last call and their factors go: a run holds them as long as it goes on."""
        Operators._last = None

    def factors_of(self, dt: float) -> Factors:
        """LU factors of the implicit step's matrix, made once for a step size."""
        if dt not in self.factored:
            self.factored = {dt: Factors(np.eye(len(self.dofs)) - dt * self.matrix())}
        return self.factored[dt]

    def memory(self, limit: int) -> dict:
        """Bytes of matrices, indices and vectors, and in how many calls the rows go through within ``limit``."""
        matrices = sum(f.nbytes for factors in self.factors for f in factors)
        vectors, row = 3 * 8 * len(self.dofs), 2 * 8 * len(self.dofs)
        rows = max(1, (limit - matrices - self.dofs.nbytes - vectors) // row)
        calls = -(-len(self.dofs) // rows)
        return {"matrices": matrices, "indices": self.dofs.nbytes, "vectors": vectors, "rows_of_a_call": int(min(rows, len(self.dofs))), "calls": int(calls)}

    def matrix(self) -> np.ndarray:
        """Dense system matrix; for small sets only."""
        out = np.zeros((len(self.dofs), len(self.dofs)))
        for factors in self.factors:
            part = np.ones_like(out)
            for d, f in enumerate(factors):
                part *= f[np.ix_(self.dofs[:, d], self.dofs[:, d])]
            out += part
        return out

    def apply(self, x: np.ndarray, rows: slice = slice(None)) -> np.ndarray:
        return apply_rows(self.factors, self.dofs, x, rows)

    def diagonal(self) -> np.ndarray:
        return sum(np.prod([f[self.dofs[:, d], self.dofs[:, d]] for d, f in enumerate(factors)], axis=0) for factors in self.factors)


def trace_vector(p: Partial, dim: Dim, side: str, value: float, t: float) -> np.ndarray:
    """Wavelet coefficients of a boundary value times c at one end of the dimension."""
    n, h = 1 << dim.level, (dim.high - dim.low) / (1 << dim.level)
    x = np.array([dim.low if side == "left" else dim.high])

    def c(at):
        g = 1.0 if p.g is None else float(np.asarray(p.g(at, t), float).ravel()[0])
        return g * (1.0 if p.jacobian is None else float(np.asarray(p.jacobian(at), float).ravel()[0]))

    v = c(x)
    if not np.isfinite(v):
        v = c(x + (1e-7 if side == "left" else -1e-7) * h)
    out = np.zeros((n, dim.degree))
    end = legendre(np.array([-1.0 if side == "left" else 1.0]), dim.degree)[0][0] / np.sqrt(h)
    out[0 if side == "left" else -1] = (-1 if side == "left" else 1) * value * v * end
    return wavelet_matrix(dim.degree, dim.level) @ out.ravel()


def boundary_parts(problem: Problem, t: float) -> Iterator[tuple[float, list[np.ndarray]]]:
    """(factor, one vector per dimension) of each inhomogeneous boundary contribution at a time."""
    for term in problem.terms:
        for d, parts in enumerate(term.chains):
            for k, p in enumerate(parts):
                for side, values, factor in (("left", p.left_values, p.left_time), ("right", p.right_values, p.right_time)):
                    if values is None:
                        continue
                    vectors = []
                    for e, dim in enumerate(problem.dims):
                        if e == d:
                            at = np.array([dim.low if side == "left" else dim.high])
                            v = trace_vector(p, dim, side, float(np.asarray(values[e](at, t)).ravel()[0]), t)
                            v = np.linalg.solve(lhs_mass(p, dim), v) if p.lhs or dim.jacobian else v
                            for before in reversed(parts[:k]):
                                v = chain((before,), dim, t) @ v
                        else:
                            v = project(lambda x, f=values[e]: f(x, t), dim.degree, dim.level, dim.low, dim.high, dim.jacobian)
                            v = v if dim.jacobian is None else np.linalg.solve(mass_matrix(dim), v)
                            v = chain(term.chains[e][: k + 1], dim, t) @ v
                        vectors.append(v)
                    yield (factor(t) if factor is not None else t), vectors


def boundary(problem: Problem, elements: Elements, t: float) -> np.ndarray:
    """Sum of all inhomogeneous boundary contributions at a time."""
    dofs = elements.dofs(problem.degree)
    out = np.zeros(len(dofs))
    for factor, vectors in boundary_parts(problem, t):
        out += combine(vectors, dofs) * factor
    return out


def leveled(problem: Problem, elements: Elements) -> Problem:
    """The problem with each dimension at the largest level among the elements."""
    top = elements.levels.max(0)
    return replace(problem, dims=tuple(replace(d, level=int(v)) for d, v in zip(problem.dims, top, strict=True)))


__all__ = ["Elements", "Operators", "Term", "boundary", "boundary_parts", "chain", "coefficient", "combine", "leveled", "mass_matrix", "separable"]
