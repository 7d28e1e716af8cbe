"""The problems that have exact or self-contained definitions, by name."""

from __future__ import annotations

import math
from functools import partial

import numpy as np

from gridloom.dg.spec import Dim, Partial, Problem, Source, Term

IDENTITY = (Partial(),)


def const(v: float):
    return lambda x, t=0.0: np.full_like(np.asarray(x, float), v)


def wave(kind: str, k: float):
    f = {"cos": np.cos, "sin": np.sin}[kind]
    return lambda x, t=0.0: f(k * x)


def slope(kind: str, k: float):
    return (lambda x, t=0.0: -k * np.sin(k * x)) if kind == "cos" else (lambda x, t=0.0: k * np.cos(k * x))


def continuity(name: str, ranges: list[float], waves: list[tuple[str, float]], speeds: list[float], rate: float, level: int = 2, degree: int = 2) -> Problem:
    """f_t + b . grad f = s, periodic, with a product of waves times sin(rate t) as its exact solution."""
    n = len(ranges)
    dims = tuple(Dim(-r, r, level, degree, f"x{i + 1}") for i, r in enumerate(ranges))
    terms = tuple(Term(tuple((Partial("div", const(-speeds[d]), "downwind"),) if e == d else IDENTITY for e in range(n)), f"d{d + 1}") for d in range(n))
    product = tuple(wave(*w) for w in waves)
    sources = [Source(product, lambda t: rate * np.cos(rate * t))]
    for d in range(n):
        functions = tuple(slope(*w) if e == d else wave(*w) for e, w in enumerate(waves))
        sources.append(Source(functions, lambda t, b=speeds[d]: b * np.sin(rate * t)))
    return Problem(name, dims, terms, (product,), tuple(sources), product, lambda t: np.sin(rate * t))


def advection_1() -> Problem:
    p = Partial("div", const(-2.0), "downwind", "dirichlet", "neumann", left_values=(const(1.0),), left_time=lambda t: 1.0)
    return Problem("advection_1", (Dim(0.0, np.pi, 4, 3),), (Term(((p,),)),), ((wave("cos", 1.0),),),
                   (Source((lambda x, t: -2 * np.sin(x),), lambda t: 1.0),), (wave("cos", 1.0),), lambda t: 1.0)


def diffusion_1() -> Problem:
    nu = np.pi / 2
    decay = lambda t: np.exp(-2 * nu * nu * t)
    f = wave("cos", nu)
    first = Partial("div", None, "downwind", "neumann", "neumann")
    second = Partial("grad", None, "upwind", "dirichlet", "dirichlet", left_values=(f,), left_time=decay, right_values=(f,), right_time=decay)
    zero = lambda flux: Term(((Partial("div", const(0.0), flux, "dirichlet", "dirichlet"),),))
    return Problem("diffusion_1", (Dim(0.0, 1.0, 3, 2),), (Term(((first, second),)), zero("downwind"), zero("central")), ((f,),),
                   (Source((lambda x, t: -nu * nu * np.cos(nu * x),), decay),), (f,), decay, lambda d: 0.25**d.level)


def diffusion_2() -> Problem:
    decay = lambda t: np.exp(-2 * np.pi**2 * t)
    f = wave("cos", np.pi)
    pair = (Partial("div", None, "upwind", "neumann", "neumann"),
            Partial("grad", None, "downwind", "dirichlet", "dirichlet", left_values=(f, f), left_time=decay, right_values=(f, f), right_time=decay))
    keep = (Partial(), Partial())
    dims = (Dim(0.0, 1.0, 3, 2, "x"), Dim(0.0, 1.0, 3, 2, "y"))
    return Problem("diffusion_2", dims, (Term((pair, keep)), Term((keep, pair))), ((f, f),), (), (f, f), decay, lambda d: 0.25**d.level)


def surface(z):
    return np.sqrt(np.maximum(0.0, 1 - z * z))


def pitch_angle(name: str, electric: float = 0.0, collision: float = 0.0, radiation: float = 0.0, start=None, rule=None) -> Problem:
    """df/dt = -E d/dz((1 - z^2) f) + C d/dz((1 - z^2) df/dz) - R d/dz(z (1 - z^2) f) on [-1, 1]."""
    terms = []
    if electric:
        terms.append(Term(((Partial("div", lambda z, t: -electric * surface(z), "downwind", "dirichlet", "dirichlet", jacobian=surface),),), "electric"))
    if collision:
        scale = None if collision == 1 else const(np.sqrt(collision))
        terms.append(Term(((Partial("div", scale, "downwind", "dirichlet", "dirichlet", jacobian=surface), Partial("grad", scale, "upwind", "neumann", "neumann", jacobian=surface)),), "collision"))
    if radiation:
        terms.append(Term(((Partial("div", lambda z, t: -radiation * z * surface(z), "downwind", "dirichlet", "dirichlet", jacobian=surface),),), "radiation"))
    return Problem(name, (Dim(-1.0, 1.0, 2, 2, "z"),), tuple(terms), ((start or const(1.0),),), step_rule=rule or (lambda d: (d.high - d.low) / (1 << d.level)))


#: Coefficients of the collision problem's start in Legendre polynomials.
LEGENDRE_START = (3.0, 0.5, 1.0, 0.7, 3.0, 0.0, 3.0)


def bell(z, t=0.0):
    return np.exp(-(z**2) / 0.1**2)


#: Fixed value: shift of the bell that the electric and collision problem starts from.
SHIFT = 0.36

erf = np.vectorize(math.erf, otypes=[float])
#: Mass ratio, charge and electric field of each case of the runaway problem.
RUNAWAY = {1: (0.042, 1.0, 0.0025), 2: (0.042, 1.0, 0.25), 3: (0.042, 1.0, 0.0025), 4: (0.3, 5.0, 0.4)}


def runaway(case: int) -> Problem:
    """Runaway electrons in momentum p and pitch z: collisions (three terms) and electric force (three terms)."""
    delta, charge, electric = RUNAWAY[case]
    speed = lambda p: p / np.sqrt(1 + (delta * p) ** 2)

    def psi(x):
        with np.errstate(all="ignore"):
            return np.where(np.abs(x) < 1e-5, 0.0, (erf(x) - x * 2 / np.sqrt(np.pi) * np.exp(-x * x)) / (2 * x * x))

    def along(p, t=0.0):
        with np.errstate(all="ignore"):
            return np.sqrt(psi(speed(p)) / speed(p))

    def across(p, t=0.0):
        v = speed(p)
        with np.errstate(all="ignore"):
            return np.sqrt(0.5 / v * (charge + erf(v) - psi(v) + delta**4 * v * v / 2))

    drag = lambda p, t=0.0: 2 * psi(speed(p))
    square, linear = (lambda p: p * p), (lambda p: p)
    keep = (Partial(), Partial())
    mass = Partial("mass", across, jacobian=linear)
    terms = (
        Term(((Partial("div", along, "upwind", "dirichlet", "neumann", jacobian=square), Partial("grad", along, "downwind", "neumann", "dirichlet", jacobian=square)), keep), "C1"),
        Term(((Partial("div", drag, "downwind", "neumann", "dirichlet", jacobian=square),), IDENTITY), "C2"),
        Term(((mass, mass), (Partial("div", None, "upwind", "dirichlet", "dirichlet", jacobian=surface), Partial("grad", None, "downwind", "neumann", "neumann", jacobian=surface))), "C3"),
        Term(((Partial("div", const(-electric), "downwind", "dirichlet", "neumann", jacobian=square),), (Partial("mass", lambda z, t: np.maximum(z, 0.0)),)), "E1"),
        Term(((Partial("div", const(-electric), "upwind", "neumann", "dirichlet", jacobian=square),), (Partial("mass", lambda z, t: np.minimum(z, 0.0)),)), "E2"),
        Term(((Partial("mass", None, jacobian=linear),), (Partial("div", lambda z, t: -electric * surface(z), "downwind", "neumann", "neumann", jacobian=surface),)), "E3"),
    )
    if case == 1:
        start = (lambda p, t=0.0: np.where(p <= 5, 1.5 / 125, 0.0), lambda z, t=0.0: np.where(z <= 0, 1.5 / 125, 0.0))
    elif case == 2:
        start = (lambda p, t=0.0: 2 / (8 * np.sqrt(np.pi)) * np.exp(-p * p / 8), const(1.0))
    elif case == 3:
        start = (lambda p, t=0.0: 2 / (3 * np.sqrt(np.pi)) * np.exp(-p * p), lambda z, t=0.0: np.polynomial.legendre.legval(z, LEGENDRE_START))
    else:
        bulk = lambda p: np.exp(-2 / delta**2 * np.sqrt(1 + (delta * p) ** 2))
        x, w = np.polynomial.legendre.leggauss(20)
        h = 20.0 / 1000
        at = (0.5 * (x + 1) + np.arange(1000)[:, None]) * h
        whole = (at * at * bulk(at) * w).sum() * h / 2
        start = (lambda p, t=0.0: bulk(p) / (2 * whole), const(1.0))
    dims = (Dim(0.0, 10.0, 2, 2, "p", lambda p: p * p), Dim(-1.0, 1.0, 2, 2, "z"))
    return Problem(f"fokkerplanck_2d_complete_case{case}", dims, terms, (start,))


PI = np.pi
BUILDERS = {
    "continuity_1": partial(continuity, "continuity_1", [1.0], [("cos", 2 * PI)], [1.0], 1.0),
    "continuity_2": partial(continuity, "continuity_2", [1.0, 2.0], [("cos", PI), ("sin", 2 * PI)], [1.0, 1.0], 2.0),
    "continuity_3": partial(continuity, "continuity_3", [1.0, 2.0, 3.0], [("cos", PI), ("sin", 2 * PI), ("cos", 2 * PI / 3)], [1.0] * 3, 2.0),
    "continuity_6": partial(continuity, "continuity_6", [1.0, 2.0, 3.0, 10.0, 20.0, 30.0],
                            [("cos", PI), ("sin", PI / 2), ("cos", PI / 3), ("cos", PI / 10), ("sin", PI / 20), ("cos", PI / 30)], [1.0, 1.0, 3.0, 4.0, 3.0, 2.0], 2.0, 2, 2),
    "advection_1": advection_1,
    "diffusion_1": diffusion_1,
    "diffusion_2": diffusion_2,
    "fokkerplanck_1d_4p3": partial(pitch_angle, "fokkerplanck_1d_4p3", radiation=1.0, start=bell),
    "fokkerplanck_1d_4p4": partial(pitch_angle, "fokkerplanck_1d_4p4", electric=4.0, collision=1.0, start=lambda z, t=0.0: bell(z + SHIFT)),
    "fokkerplanck_1d_4p5": partial(pitch_angle, "fokkerplanck_1d_4p5", electric=2.0, collision=1.0, radiation=2.0, start=bell),
    "fokkerplanck_1d_pitch_C": partial(pitch_angle, "fokkerplanck_1d_pitch_C", collision=1.0, start=lambda z, t=0.0: np.polynomial.legendre.legval(z, LEGENDRE_START), rule=lambda d: ((d.high - d.low) / (1 << d.level)) ** 2),
    **{f"fokkerplanck_2d_complete_case{c}": partial(runaway, c) for c in RUNAWAY},
    "fokkerplanck_1d_pitch_E_case1": partial(pitch_angle, "fokkerplanck_1d_pitch_E_case1", electric=1.0),
    "fokkerplanck_1d_pitch_E_case2": partial(pitch_angle, "fokkerplanck_1d_pitch_E_case2", electric=1.0, start=bell),
}


def problem(name: str, levels=None, degree: int | None = None) -> Problem:
    if name not in BUILDERS:
        raise KeyError(f"unknown problem {name}; known: {', '.join(sorted(BUILDERS))}")
    return BUILDERS[name]().at(levels, degree)
