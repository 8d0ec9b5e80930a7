"""Registry of named components: cutoffs, kernels, density functions, sparsifiers, rules, potentials, fits.

A builder takes the component's JSON object.  Those that are functions of
distance return Column expressions, so an added component stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column

from atomloom.functions import expr

_BUILDERS: dict[tuple[str, str], Callable[[dict], Any]] = {}


def register(family: str, name: str):
    def put(builder):
        _BUILDERS[family, name] = builder
        return builder

    return put


def build(family: str, spec: dict, default: str | None = None) -> Any:
    name = spec.get("type", default)
    if (family, name) not in _BUILDERS:
        # Files of other programs may have one letter, or how a fit is held, before a type's name.
        ends = [n for n in known(family) if str(name).endswith(n) and re.fullmatch("(in_ram_)?[a-z]?", str(name)[: -len(n)])]
        if not ends:
            raise ValueError(f"unknown {family} type {name!r}; known: {known(family)}")
        name = max(ends, key=len)
    return _BUILDERS[family, name](spec)


def known(family: str) -> list[str]:
    return sorted(n for f, n in _BUILDERS if f == family)


@dataclass(frozen=True)
class Radial:
    """A function of distance and its slope, as Column builders, and where it ends."""

    value: Callable[[Column], Column]
    slope: Callable[[Column], Column]
    cutoff: float
    spec: dict


@register("cutoff", "coscutoff")
def _cos(spec: dict) -> Radial:
    rc = float(spec["cutoff"])
    if "cutoff_transition_width" in spec:
        width = float(spec["cutoff_transition_width"])
    else:
        width = rc - float(spec["r_min"])
    clean = {"type": "coscutoff", "cutoff": rc, "cutoff_transition_width": width}
    return Radial(lambda r: expr.cos_cutoff(r, rc, width), lambda r: expr.cos_cutoff_slope(r, rc, width), rc, clean)


@register("cutoff", "perriot")
def _poly(spec: dict) -> Radial:
    rc = float(spec["cutoff"])
    r_min = float(spec["r_min"]) if "r_min" in spec else rc - float(spec["cutoff_transition_width"])
    clean = {"type": "perriot", "cutoff": rc, "r_min": r_min}
    return Radial(lambda r: expr.poly_cutoff(r, rc, r_min), lambda r: expr.poly_cutoff_slope(r, rc, r_min), rc, clean)


def _density_r_min(spec: dict) -> float:
    if "r_min" in spec:
        return float(spec["r_min"])
    return float(spec["cutoff"]) - float(spec["cutoff_transition_width"]) if "cutoff_transition_width" in spec else 0.0


@register("pair_function", "polycutoff")
def _poly_density(spec: dict) -> Radial:
    rc, r0, k, core = float(spec["cutoff"]), _density_r_min(spec), float(spec.get("prefactor", 1.0)), bool(spec.get("unit_core", False))
    clean = {"type": "polycutoff", "cutoff": rc, "r_min": r0, "prefactor": k} | ({"unit_core": True} if core else {})
    return Radial(lambda r: expr.poly_density(r, rc, r0, k, core), lambda r: expr.poly_density_slope(r, rc, r0, k), rc, clean)


@register("pair_function", "coscutoff")
def _cos_density(spec: dict) -> Radial:
    rc, r0, k, core = float(spec["cutoff"]), _density_r_min(spec), float(spec.get("prefactor", 1.0)), bool(spec.get("unit_core", False))
    clean = {"type": "coscutoff", "cutoff": rc, "r_min": r0, "prefactor": k} | ({"unit_core": True} if core else {})
    return Radial(lambda r: expr.cos_density(r, rc, r0, k, core), lambda r: expr.cos_density_slope(r, rc, r0, k), rc, clean)


@register("pair_function", "fsgen")
def _power_density(spec: dict) -> Radial:
    rc, n, k = float(spec["cutoff"]), float(spec.get("degree", 3.0)), float(spec.get("prefactor", 1.0))
    clean = {"type": "fsgen", "cutoff": rc, "degree": n, "prefactor": k}
    return Radial(lambda r: expr.power_density(r, rc, n, k), lambda r: expr.power_density_slope(r, rc, n, k), rc, clean)


@dataclass(frozen=True)
class Kernel:
    length: float
    energy: float

    def value(self, a, b) -> Column:
        return expr.se_kernel(a, b, self.length, self.energy)

    def slopes(self, a, b) -> list[Column]:
        return expr.se_kernel_slopes(a, b, self.length, self.energy)

    @property
    def spec(self) -> dict:
        return {"type": "squared_exp", "length_scale": self.length, "energy_scale": self.energy}


@register("kernel", "squared_exp")
def _se(spec: dict) -> Kernel:
    return Kernel(float(spec["length_scale"]), float(spec["energy_scale"]))
