"""Scalar functions as Column expressions: cutoffs, pair functions, kernels, invariants, vectors.

All stay inside whole-stage code generation; none is a Python function of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = float | Column


def num(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


# Cutoffs


def cos_cutoff(r: Column, cutoff: float, width: float) -> Column:
    """1 up to cutoff - width, then half a cosine down to 0 at the cutoff."""
    ramp = 0.5 * (F.cos((r - (cutoff - width)) * (math.pi / width)) + 1.0) if width > 0 else F.lit(0.0)
    return F.when(r <= cutoff - width, F.lit(1.0)).when(r >= cutoff, F.lit(0.0)).otherwise(ramp)


def cos_cutoff_slope(r: Column, cutoff: float, width: float) -> Column:
    if width <= 0:
        return F.lit(0.0)
    inner = (r > cutoff - width) & (r < cutoff)
    return F.when(inner, -0.5 * math.pi / width * F.sin((r - (cutoff - width)) * (math.pi / width))).otherwise(F.lit(0.0))


def poly_cutoff(r: Column, cutoff: float, r_min: float) -> Column:
    """Fifth-order smooth step from 1 at r_min to 0 at the cutoff."""
    x = (r - r_min) / (cutoff - r_min)
    return F.when(r <= r_min, F.lit(1.0)).when(r >= cutoff, F.lit(0.0)).otherwise(1.0 - x * x * x * (x * (6.0 * x - 15.0) + 10.0))


def poly_cutoff_slope(r: Column, cutoff: float, r_min: float) -> Column:
    x = (r - r_min) / (cutoff - r_min)
    return F.when((r > r_min) & (r < cutoff), -30.0 * x * x * (x - 1.0) * (x - 1.0) / (cutoff - r_min)).otherwise(F.lit(0.0))


# Density pair functions


def poly_density(r: Column, cutoff: float, r_min: float = 0.0, prefactor: float = 1.0, unit_core: bool = False) -> Column:
    """Prefactor times the smooth step; unit_core keeps the old value 1 below r_min whatever the prefactor."""
    value = prefactor * poly_cutoff(r, cutoff, r_min)
    return F.when(r <= r_min, F.lit(1.0)).otherwise(value) if unit_core else value


def poly_density_slope(r: Column, cutoff: float, r_min: float = 0.0, prefactor: float = 1.0) -> Column:
    return prefactor * poly_cutoff_slope(r, cutoff, r_min)


def cos_density(r: Column, cutoff: float, r_min: float = 0.0, prefactor: float = 1.0, unit_core: bool = False) -> Column:
    value = prefactor * cos_cutoff(r, cutoff, cutoff - r_min)
    return F.when(r <= r_min, F.lit(1.0)).otherwise(value) if unit_core else value


def cos_density_slope(r: Column, cutoff: float, r_min: float = 0.0, prefactor: float = 1.0) -> Column:
    return prefactor * cos_cutoff_slope(r, cutoff, cutoff - r_min)


def power_density(r: Column, cutoff: float, degree: float = 3.0, prefactor: float = 1.0) -> Column:
    """Prefactor times (1 - r / cutoff) ** degree within the cutoff."""
    return F.when(r >= cutoff, F.lit(0.0)).otherwise(prefactor * F.pow(1.0 - r / cutoff, F.lit(float(degree))))


def power_density_slope(r: Column, cutoff: float, degree: float = 3.0, prefactor: float = 1.0) -> Column:
    return F.when(r >= cutoff, F.lit(0.0)).otherwise(-prefactor * degree / cutoff * F.pow(1.0 - r / cutoff, F.lit(float(degree) - 1.0)))


# Kernels


def se_kernel(a: Sequence[Column], b: Sequence[Number], length: float, energy: float) -> Column:
    """Squared-exponential kernel of two points of any dimension."""
    square = sum((x - num(y)) * (x - num(y)) for x, y in zip(a, b, strict=True))
    return energy * energy * F.exp(-square / (2.0 * length * length))


def se_kernel_slopes(a: Sequence[Column], b: Sequence[Number], length: float, energy: float) -> list[Column]:
    """Derivatives by the first point's coordinates."""
    k = se_kernel(a, b, length, energy)
    return [k * (num(y) - x) / (length * length) for x, y in zip(a, b, strict=True)]


def se_kernel_arrays(a: Column, b: Column, length: float, energy: float) -> Column:
    """The kernel of two array columns."""
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return energy * energy * F.exp(-square / (2.0 * length * length))


# Invariants


def triplet_invariants(r01: Column, r02: Column, r12: Column) -> tuple[Column, Column, Column]:
    """(sum, squared difference, far side): unchanged when the two neighbours swap."""
    return r01 + r02, (r01 - r02) * (r01 - r02), r12


def triplet_invariant_slopes(r01: Column, r02: Column) -> dict[str, tuple[Column, Column, Column]]:
    one, zero = F.lit(1.0), F.lit(0.0)
    return {"r01": (one, 2.0 * (r01 - r02), zero), "r02": (one, 2.0 * (r02 - r01), zero), "r12": (zero, zero, one)}


def invariant_cutoff(q1: Column, q2: Column, cutoff_value) -> Column:
    """Product of the cutoffs of the two sides that the invariants imply."""
    d = F.sqrt(q2)
    return cutoff_value((q1 + d) / 2.0) * cutoff_value((q1 - d) / 2.0)


# Vectors

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Vector, k: Number) -> Vector:
    return tuple(x * num(k) for x in a)  # type: ignore[return-value]


def plus(a: Vector, b: Vector, sign: float = 1.0) -> Vector:
    return tuple(x + sign * y for x, y in zip(a, b))  # type: ignore[return-value]


def unit(a: Vector) -> Vector:
    n = length(a)
    return tuple(x / n for x in a)  # type: ignore[return-value]


def project(a: Vector, b: Vector) -> Vector:
    """The part of a along b."""
    return scaled(b, dot(a, b) / dot(b, b))


def reject(a: Vector, *others: Vector) -> Vector:
    """The part of a across one vector, or across the plane of two."""
    if len(others) == 1:
        return plus(a, project(a, others[0]), -1.0)
    return project(a, cross(*others))


def least_magnitude(a: Vector) -> Column:
    return F.least(*[F.abs(x) for x in a])


# Screened repulsion

_E_CHARGE = 1.60217657e-19
_EPSILON0 = 8.854187817e-12
#: e / (4 pi epsilon0 * 1 angstrom), in volts.
COULOMB = _E_CHARGE / (4.0 * math.pi * _EPSILON0 * 1e-10)


def screening_length(z1: Column, z2: Column) -> Column:
    return 0.46848 / (F.pow(z1, F.lit(0.23)) + F.pow(z2, F.lit(0.23)))


def zbl_energy(r: Column, z1: Column, z2: Column, coefficients: Sequence[Column]) -> Column:
    """Screened nuclear repulsion; coefficients are three (weight, decay) pairs in a row."""
    x = r / screening_length(z1, z2)
    phi = sum(coefficients[2 * k] * F.exp(-coefficients[2 * k + 1] * x) for k in range(3))
    return COULOMB * z1 * z2 * phi / r


def zbl_slope(r: Column, z1: Column, z2: Column, coefficients: Sequence[Column]) -> Column:
    a = screening_length(z1, z2)
    x = r / a
    phi = sum(coefficients[2 * k] * F.exp(-coefficients[2 * k + 1] * x) for k in range(3))
    slope = sum(-coefficients[2 * k + 1] * coefficients[2 * k] * F.exp(-coefficients[2 * k + 1] * x) for k in range(3))
    return COULOMB * z1 * z2 * (slope / (a * r) - phi / (r * r))


def cubic_at(knots: Column, pieces: Column, r: Column) -> tuple[Column, Column]:
    """Value and slope of a piecewise cubic: arrays of knots and of (a, b, c, d) per interval; 0 outside.

    The interval is the last whose left end is not behind r.
    """
    n = F.size(knots)
    at = F.least(F.greatest(F.size(F.filter(knots, lambda k: k <= r)), F.lit(1)), n - 1)
    x = r - F.element_at(knots, at)
    p = F.element_at(pieces, at)
    inside = (r >= F.element_at(knots, F.lit(1))) & (r <= F.element_at(knots, F.lit(-1)))
    value = p["a"] + x * (p["b"] + x * (p["c"] + x * p["d"]))
    slope = p["b"] + x * (2.0 * p["c"] + 3.0 * x * p["d"])
    return F.when(inside, value).otherwise(F.lit(0.0)), F.when(inside, slope).otherwise(F.lit(0.0))
