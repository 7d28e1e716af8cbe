"""Problem descriptions: dimensions, partial terms, terms, sources; with their checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

#: Scale of the jump term by flux.
FLUX = {"downwind": -1.0, "central": 0.0, "upwind": 1.0, "lax_friedrich": 0.0}
BOUNDARIES = ("periodic", "dirichlet", "neumann")


def one(x, t=0.0):
    return np.ones_like(np.asarray(x, float))


@dataclass(frozen=True)
class Dim:
    low: float
    high: float
    level: int = 2
    degree: int = 2
    name: str = "x"
    jacobian: Callable | None = None


@dataclass(frozen=True)
class Partial:
    """mass, div, grad or penalty with coefficient g(x, t), surface jacobian, flux and boundaries.

    ``left_values``/``right_values`` list, per dimension, the functions of an
    inhomogeneous condition (the trace's own entry is evaluated at the boundary);
    ``left_time``/``right_time`` are its factors in time.
    """

    kind: str = "mass"
    g: Callable | None = None
    flux: str = "central"
    left: str = "periodic"
    right: str = "periodic"
    jacobian: Callable | None = None
    lhs: Callable | None = None
    left_values: tuple | None = None
    right_values: tuple | None = None
    left_time: Callable | None = None
    right_time: Callable | None = None
    #: Whether the coefficients stay the same in time. Where it isn't declared, they are looked at at some points and times.
    steady: bool | None = None

    def __post_init__(self):
        if self.kind not in ("mass", "div", "grad", "penalty") or self.flux not in FLUX:
            raise ValueError(f"unknown operator {self.kind} or flux {self.flux}")
        if self.left not in BOUNDARIES or self.right not in BOUNDARIES or (self.left == "periodic") != (self.right == "periodic"):
            raise ValueError("boundaries must be known, and both or none periodic")

    @property
    def identity(self) -> bool:
        return self.kind == "mass" and self.g is None and self.jacobian is None and self.lhs is None


@dataclass(frozen=True)
class Term:
    """One chain of partial terms per dimension; flag: both, explicit or implicit."""

    chains: tuple[tuple[Partial, ...], ...]
    name: str = ""
    flag: str = "both"


@dataclass(frozen=True)
class Source:
    functions: tuple
    time: Callable


@dataclass(frozen=True)
class Problem:
    name: str
    dims: tuple[Dim, ...]
    terms: tuple[Term, ...]
    initial: tuple[tuple, ...]
    sources: tuple[Source, ...] = ()
    exact: tuple | None = None
    exact_time: Callable | None = None
    step_rule: Callable = field(default=lambda d: (d.high - d.low) / (1 << d.level))
    full_grid: bool = False

    def __post_init__(self):
        n = len(self.dims)
        if len({d.degree for d in self.dims}) > 1:
            raise ValueError("all dimensions must have one degree")
        if any(len(t.chains) != n for t in self.terms) or any(len(s.functions) != n for s in self.sources) or any(len(f) != n for f in self.initial):
            raise ValueError("terms, sources and initial conditions need one entry per dimension")

    @property
    def degree(self) -> int:
        return self.dims[0].degree

    def at(self, levels: list[int] | int | None = None, degree: int | None = None) -> Problem:
        """The same problem at other levels and another degree."""
        levels = [levels] * len(self.dims) if isinstance(levels, int) else levels
        dims = tuple(replace(d, level=levels[i] if levels else d.level, degree=degree or d.degree) for i, d in enumerate(self.dims))
        return replace(self, dims=dims)

    def with_terms(self, mask: list[int]) -> Problem:
        if len(mask) != len(self.terms) or not any(mask):
            raise ValueError("one flag per term, at least one of them on")
        return replace(self, terms=tuple(t for t, on in zip(self.terms, mask, strict=True) if on))

    def along(self, d: int = 0) -> Problem:
        """The problem in one of its dimensions alone, as moments need it."""
        one = lambda parts: (parts[d],)
        terms = tuple(replace(t, chains=one(t.chains)) for t in self.terms)
        sources = tuple(replace(s, functions=one(s.functions)) for s in self.sources)
        return replace(self, dims=one(self.dims), terms=terms, initial=tuple(one(f) for f in self.initial), sources=sources, exact=None)

    def depends_on_time(self) -> bool:
        """Whether a coefficient changes with time: as its partial term declares, else by its values at some points and times."""
        for t in self.terms:
            for dim, parts in zip(self.dims, t.chains, strict=True):
                x = dim.low + (dim.high - dim.low) * (np.arange(33) + 0.37) / 33.5
                for p in parts:
                    if p.steady is not None:
                        if not p.steady:
                            return True
                    elif p.g is not None and len({np.asarray(p.g(x, at), float).tobytes() for at in (0.0, 0.3, 1.7, 2.9, 17.0, 300.0)}) > 1:
                        return True
        return False

    def step(self, cfl: float = 0.01, dt: float | None = None) -> float:
        return dt if dt is not None else self.step_rule(self.dims[0]) * cfl


@dataclass(frozen=True)
class Options:
    """Options of a run, checked as a whole."""

    pde: str = "continuity_2"
    degree: int | None = None
    levels: tuple[int, ...] | None = None
    max_level: int = 8
    steps: int = 10
    cfl: float | None = None
    dt: float | None = None
    implicit: bool = False
    imex: bool = False
    solver: str | None = None
    adapt: bool = False
    threshold: float | None = None
    l_inf: bool = False
    full_grid: bool = False
    output_every: int = 0
    tolerance: float | None = None
    restart: int | None = None
    max_adapt_levels: tuple[int, ...] | None = None

    def __post_init__(self):
        checks = (
            (self.cfl is None or self.dt is None, "cfl and dt exclude each other"),
            (self.cfl is None or self.cfl > 0, "cfl must be positive"),
            (self.dt is None or self.dt > 0, "dt must be positive"),
            (self.degree is None or self.degree >= 1, "degree must be at least 1"),
            (self.levels is None or (min(self.levels) >= 0 and max(self.levels) > 0), "levels must not be negative, and one must be positive"),
            (self.steps >= 1, "there must be a step"),
            (not (self.implicit and self.imex), "implicit and imex exclude each other"),
            (self.solver is None or self.implicit or self.imex, "a solver needs an implicit step"),
            (not self.imex or self.solver in (None, "gmres"), "imex solves by gmres"),
            (self.threshold is None or (self.adapt and 0 < self.threshold <= 1), "a threshold needs adaptivity and lies in (0, 1]"),
            (self.tolerance is None or (self.solver == "gmres" or self.imex) and self.tolerance > 0, "a tolerance needs gmres"),
            (self.restart is None or (self.solver == "gmres" or self.imex) and self.restart > 0, "a restart needs gmres"),
            (self.max_adapt_levels is None or max(self.max_adapt_levels) <= self.max_level, "adaptivity must not pass the largest level"),
        )
        for good, why in checks:
            if not good:
                raise ValueError(why)
