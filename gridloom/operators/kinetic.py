"""Kinetic steps over a table's density in space and velocity, with moments fed back.

The state is (x, j, f): the density in cell x of a periodic space and cell j of the velocities,
every cell with a row. A step has two stages. In each, the field is solved from the density
in space, the state is carried by its velocity and the field (upwind, explicit), its moments
give mean velocity and temperature of each place, and collisions towards these are taken
implicitly: one tridiagonal system per place, all of them one behind the other in one
solve. State and moments stay in DataFrames. Mass is kept to rounding, since both parts are differences of fluxes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.tridiagonal import poisson, solve
from gridloom.sources.scratch import Scratch


@dataclass(frozen=True)
class Grid:
    """Cells and length of the space, cells and half width of the velocities."""

    places: int
    length: float
    speeds: int
    most: float

    @property
    def hx(self) -> float:
        return self.length / self.places

    @property
    def hv(self) -> float:
        return 2 * self.most / self.speeds

    def velocity(self, j: Column) -> Column:
        return (j + 0.5) * self.hv - self.most


def filled(spark, state: DataFrame, g: Grid) -> DataFrame:
    """With a row for every cell."""
    every = spark.range(g.places).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g.speeds - 1).cast("long"))).alias("j"))
    own = state.select(F.col("x").alias("s_x"), F.col("j").alias("s_j"), "f")
    return every.join(own, (F.col("x") == F.col("s_x")) & (F.col("j") == F.col("s_j")), "left").select("x", "j", F.coalesce("f", F.lit(0.0)).alias("f"))


def moments(state: DataFrame, g: Grid) -> DataFrame:
    """(x, n, u, theta): density, mean velocity and temperature of each place; 0 where nothing is."""
    v = g.velocity(F.col("j"))
    m = state.groupBy("x").agg(F.sum("f").alias("m0"), F.sum(v * F.col("f")).alias("m1"), F.sum(v * v * F.col("f")).alias("m2"))
    mean = lambda c: F.coalesce(F.col(c) / F.nullif("m0", F.lit(0.0)), F.lit(0.0))
    return m.select("x", (F.col("m0") * g.hv).alias("n"), mean("m1").alias("u"), (mean("m2") - mean("m1") * mean("m1")).alias("theta"))


def electric(m: DataFrame, g: Grid, parts: int = 8) -> DataFrame:
    """(x, e) from the moments: -phi'' is the density less its mean, e = -phi' by central differences. One row per place."""
    mean = m.agg(F.avg("n").alias("mean"))
    source = m.join(F.broadcast(mean)).where("x > 0").select(F.col("x").alias("k"), (F.col("n") - F.col("mean")).alias("y"))
    phi = poisson(source, g.places, 0.0, g.length, parts=parts)
    # each potential counts at both of its neighbours; that of place 0 is 0
    sent = phi.select(F.explode(F.array(
        F.struct(((F.col("k") + 1) % g.places).alias("x"), (F.col("x") / (2 * g.hx)).alias("e")),
        F.struct(((F.col("k") - 1) % g.places).alias("x"), (-F.col("x") / (2 * g.hx)).alias("e")))).alias("s"))
    return sent.select("s.*").groupBy("x").agg(F.sum("e").alias("e"))


def carried(state: DataFrame, field: DataFrame, g: Grid, dt: float) -> DataFrame:
    """The state after an explicit step: what a cell loses to its neighbour downstream in space and in velocity, that one gets."""
    v, e, f = g.velocity(F.col("j")), F.coalesce("e", F.lit(0.0)), F.col("f")
    own = field.select(F.col("x").alias("e_x"), "e")
    out, push = F.abs(v) / g.hx * f * dt, F.abs(e) / g.hv * f * dt
    to = F.col("j") + F.when(e >= 0, 1).otherwise(-1)
    inside = (to >= 0) & (to < g.speeds)
    push = F.when(inside, push).otherwise(0.0)
    moves = F.array(
        F.struct("x", "j", (f - out - push).alias("f")),
        F.struct(F.pmod(F.col("x") + F.when(v >= 0, 1).otherwise(-1), F.lit(g.places)).alias("x"), "j", out.alias("f")),
        F.struct("x", F.when(inside, to).otherwise(F.col("j")).alias("j"), push.alias("f")),
    )
    return state.join(own, F.col("x") == F.col("e_x"), "left").select(F.explode(moves).alias("m")).select("m.*").groupBy("x", "j").agg(F.sum("f").alias("f"))


def collided(state: DataFrame, m: DataFrame, g: Grid, tau: float, parts: int = 8) -> DataFrame:
    """f with f - tau d/dv ((v - u) f + theta df/dv) = state, no flux at the ends of the velocities."""
    own = m.select(F.col("x").alias("m_x"), "u", "theta")
    edge = lambda j: j * g.hv - g.most - F.col("u")  # noqa: E731  of the cell's lower end
    low, high, spread = edge(F.col("j")) / 2, edge(F.col("j") + 1) / 2, F.col("theta") / g.hv
    first, last = F.col("j") == 0, F.col("j") == g.speeds - 1
    a = F.when(first, 0.0).otherwise((spread - low) / g.hv)
    c = F.when(last, 0.0).otherwise((high + spread) / g.hv)
    b = (F.when(last, 0.0).otherwise(high - spread) - F.when(first, 0.0).otherwise(low + spread)) / g.hv
    rows = state.join(own, F.col("x") == F.col("m_x")).select((F.col("x") * g.speeds + F.col("j")).alias("k"), (-tau * a).alias("a"), (1 - tau * b).alias("b"), (-tau * c).alias("c"), F.col("f").alias("y"))
    return solve(rows, parts).select(F.floor(F.col("k") / g.speeds).alias("x"), (F.col("k") % g.speeds).alias("j"), F.col("x").alias("f"))


def step(state: DataFrame, g: Grid, dt: float, rate: float, parts: int = 8) -> DataFrame:
    """One implicit-explicit step of two stages; collisions have the given rate."""
    scratch = Scratch(state.sparkSession, "kinetic")

    def explicit(f):
        return scratch.write(carried(f, electric(moments(f, g), g, parts), g, dt))

    def implicit(f, tau):
        return scratch.write(collided(f, moments(f, g), g, tau, parts))

    first = explicit(state)
    one = implicit(first, rate * dt)
    second = explicit(one)
    both = state.unionByName(second).groupBy("x", "j").agg((F.sum("f") / 2).alias("f"))
    both = scratch.write(both)
    out = implicit(both, rate * dt / 2)
    scratch.drop(first, one, second, both)
    return out


def totals(state: DataFrame, g: Grid) -> tuple[float, float, float]:
    """Mass, momentum and kinetic energy."""
    v = g.velocity(F.col("j"))
    found = state.agg(F.sum("f"), F.sum(v * F.col("f")), F.sum(v * v * F.col("f")) / 2).first()
    return tuple(float(x) * g.hx * g.hv for x in found)
