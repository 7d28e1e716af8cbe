"""Index mathematics and small formulas as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest level per number of dimensions for which element ids fit 64 bits.
MAX_LEVEL = {1: 62, 2: 33, 3: 20, 4: 16, 5: 13, 6: 9}
#: Fixed value: what counts as zero after a projection.
EPS = 2.220446049250313e-16
#: Type of exact integers that may not fit 64 bits.
WIDE = "decimal(38,0)"


def pow2(k: Column) -> Column:
    """2**k as a bigint, for 0 <= k < 63."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def integer_type(largest: int) -> str:
    """The type for integers of at most this absolute value."""
    return "long" if largest < 1 << 63 else WIDE


def int_pow(base: Column, power: int, kind: str = "long") -> Column:
    """base**power by products of integers of a type: exact as long as it fits."""
    return reduce(lambda a, _: a * base, range(power), F.lit(1).cast(kind)).cast(kind)


def index_1d(level: Column, cell: Column) -> Column:
    """Place of a cell among all cells of its dimension: 0 for level 0, else 2**(level-1) + cell."""
    return F.when(level == 0, F.lit(0).cast("long")).otherwise(pow2(level - 1) + cell)


def level_of(index: Column) -> Column:
    """Level of a one-dimensional index: its number of binary digits, which is exact for all bigints."""
    return F.when(index == 0, 0).otherwise(F.length(F.bin(index))).cast("int")


def cell_of(index: Column) -> Column:
    return F.when(index < 2, F.lit(0).cast("long")).otherwise(index - pow2(level_of(index) - 1))


def element_id(indices: list[Column], max_level: int) -> Column:
    """Mixed-radix id of an element's one-dimensional indices, first dimension lowest."""
    if max_level > MAX_LEVEL[len(indices)]:
        raise ValueError("ids of this level and dimension do not fit 64 bits")
    return reduce(lambda a, b: a + b, [x.cast("long") * (1 << max_level * d) for d, x in enumerate(indices)])


def index_of_id(element: Column, max_level: int, dim: int) -> Column:
    """One-dimensional index of dimension ``dim`` of an element id."""
    return F.shiftright(element, max_level * dim).bitwiseAND(F.lit((1 << max_level) - 1).cast("long"))


def polyval(coefficients: list[float], x: Column) -> Column:
    """Polynomial with the highest power first, by Horner's rule."""
    return reduce(lambda a, c: a * x + F.lit(float(c)), coefficients, F.lit(0.0))


def legendre(x: Column, degree: int) -> list[Column]:
    """sqrt(2i+1) P_i(x), i < degree; zero outside [-1, 1]."""
    values = [F.lit(1.0), x]
    for i in range(1, degree - 1):
        values.append(((2 * i + 1) * x * values[i] - i * values[i - 1]) / (i + 1))
    return [F.when(F.abs(x) <= 1, F.sqrt(F.lit(2.0 * i + 1)) * v).otherwise(0.0) for i, v in enumerate(values[:degree])]


def clip_eps(v: Column, eps: float = EPS) -> Column:
    return F.when(F.abs(v) < eps, 0.0).otherwise(v)


def writes_at(step: Column, frequency: Column) -> Column:
    """Whether a step is written: never for 0, always for 1, else each ``frequency`` steps."""
    return (frequency > 0) & ((frequency == 1) | (F.pmod(step + 1, F.greatest(frequency, F.lit(1))) == 0))


def megabytes(count: Column, size: int = 8) -> Column:
    return count * size / float(1 << 20)


def default_restart(n: Column) -> Column:
    """Default number of inner iterations of a linear solver of n unknowns."""
    fits = F.floor(512.0 / megabytes(n)).cast("long")
    return F.least(F.greatest(fits, F.least(F.lit(10), n)), F.least(F.lit(200), n))


def packed_upper(i: Column, j: Column, kind: str = "long") -> Column:
    """Place of (i, j), i <= j, in a packed upper triangle: exact as long as it fits the type, since the even one of j and j + 1 is halved before they are multiplied."""
    return (i.cast(kind) + F.shiftright(j + 1, 1).cast(kind) * (j + 1 - j % 2)).cast(kind)


def ints_from_string(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, r"\s+"), lambda p: p != ""), lambda p: p.cast("int"))


def flops(dimensions: Column, n: Column, terms: Column, batch: Column) -> Column:
    """Floating-point operations of a batch of Kronecker products."""
    return (F.pow(n.cast("double"), dimensions + 1) * 2 * dimensions * terms * batch).cast("long")
