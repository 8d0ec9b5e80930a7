"""Regularisation rules: how closely a fit has to follow each observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomloom.plans.registry import register


def _apply(structures: DataFrame, atoms: DataFrame, factor: Column, energy: float, force: float, virial: float) -> tuple[DataFrame, DataFrame]:
    """Inverse sigmas where there are none yet; energy and virial sigmas grow with the root of the number of atoms."""
    root = F.sqrt(F.col("n_atoms").cast("double"))
    with_factor = structures.withColumn("factor", factor)
    flat = 1.0 / (virial * F.col("factor") * root)
    tensor = F.array(*[F.array(flat, flat, flat)] * 3)
    s = with_factor.withColumns(
        {
            "energy_sigma_inv": F.coalesce("energy_sigma_inv", 1.0 / (energy * F.col("factor") * root)),
            "virial_sigmas_inv": F.coalesce("virial_sigmas_inv", tensor),
        }
    )
    a = atoms.join(with_factor.select("structure_id", "factor"), "structure_id")
    a = a.withColumns({c: F.coalesce(c, 1.0 / (force * F.col("factor"))) for c in ("sx", "sy", "sz")})
    return s.drop("factor"), a.drop("factor")


def simple_factor(config: Column, liquid: float = 10.0, short_range: float = 10.0, isolated: float = 0.001) -> Column:
    """The multiplier of a configuration's kind; the last rule that matches wins."""
    has = lambda *words: F.coalesce(sum((config.contains(w).cast("int") for w in words), F.lit(0)) > 0, F.lit(False))
    return (
        F.when(has("short", "traj", "low_volume", "dimer", "trimer"), F.lit(short_range))
        .when(has("liquid", "melt"), F.lit(liquid))
        .when(config == "isolated_atom", F.lit(isolated))
        .otherwise(F.lit(1.0))
    )


def keyword_factor(config: Column, factors: list[tuple[str, float]], default: float = 1.0) -> Column:
    """The multiplier of the first keyword that the configuration's name contains."""
    out = F.lit(float(default))
    for word, factor in reversed(factors):
        out = F.when(F.coalesce(config.contains(word), F.lit(False)), F.lit(float(factor))).otherwise(out)
    return out


@register("sigma_rules", "simple")
def simple(spec: dict):
    energy = float(spec["E_per_root_n_atoms"])
    force = float(spec.get("F_component", 50.0 * energy))
    virial = float(spec.get("virials", 100.0 * energy))
    factor = simple_factor(F.col("config_type"), float(spec.get("liquid", 10.0)), float(spec.get("short_range", 10.0)))
    return lambda structures, atoms: _apply(structures, atoms, factor, energy, force, virial)


@register("sigma_rules", "per_ct")
def per_keyword(spec: dict):
    rules = [(str(x["contains"]), float(x["multiplier"])) for x in spec["per_keyword"]]
    factor = keyword_factor(F.col("config_type"), rules)
    return lambda structures, atoms: _apply(structures, atoms, factor, float(spec["E"]), float(spec["F"]), float(spec["V"]))
