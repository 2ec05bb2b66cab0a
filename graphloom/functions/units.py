"""Unit normalisation as a small table joined to the values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Property, units, factor, offset, target unit. Unit None: any other unit.
RULES = [
    ("melting_point", ["°c", "degc", "c"], 1.0, 273.15, "K"),
    ("melting_point", ["k", "kelvin"], 1.0, 0.0, "K"),
    ("glass_transition_temperature", ["°c", "degc", "c"], 1.0, 273.15, "K"),
    ("glass_transition_temperature", ["k", "kelvin"], 1.0, 0.0, "K"),
    ("band_gap", ["ev"], 1.0, 0.0, "eV"),
    ("band_gap", ["mev"], 1e-3, 0.0, "eV"),
    ("conductivity", ["s/cm"], 100.0, 0.0, "S/m"),
    ("conductivity", ["s/m"], 1.0, 0.0, "S/m"),
    ("mobility", ["cm2/vs", "cm^2/vs", "cm²/vs"], 1e-4, 0.0, "m2/Vs"),
    ("mobility", ["m2/vs", "m^2/vs", "m²/vs"], 1.0, 0.0, "m2/Vs"),
    ("efficiency", ["%"], 1.0, 0.0, "%"),
    ("efficiency", None, 100.0, 0.0, "%"),
    ("thermal_conductivity", ["w/mk"], 1.0, 0.0, "W/mK"),
    ("thermal_conductivity", ["w/cmk"], 100.0, 0.0, "W/mK"),
    ("dielectric_constant", None, 1.0, 0.0, ""),
    ("density", ["g/cm3", "g/cm^3", "g/cm³"], 1000.0, 0.0, "kg/m3"),
    ("density", ["kg/m3", "kg/m^3", "kg/m³"], 1.0, 0.0, "kg/m3"),
    ("formation_energy", ["ev/atom"], 1.0, 0.0, "eV/atom"),
    ("formation_energy", ["mev/atom"], 1e-3, 0.0, "eV/atom"),
    ("energy_above_hull", ["ev/atom"], 1.0, 0.0, "eV/atom"),
    ("energy_above_hull", ["mev/atom"], 1e-3, 0.0, "eV/atom"),
    ("bulk_modulus", ["gpa"], 1.0, 0.0, "GPa"),
    ("bulk_modulus", ["mpa"], 1e-3, 0.0, "GPa"),
    ("shear_modulus", ["gpa"], 1.0, 0.0, "GPa"),
    ("shear_modulus", ["mpa"], 1e-3, 0.0, "GPa"),
    ("magnetic_moment", ["μb", "ub", "mu_b"], 1.0, 0.0, "μB"),
]
#: Plausible ranges of normalised values, ends included.
RANGES = {
    "efficiency": (0.0, 100.0),
    "density": (0.0, float("inf")),
    "band_gap": (0.0, 10.0),
    "formation_energy": (-10.0, 10.0),
    "bulk_modulus": (0.0, 1000.0),
    "shear_modulus": (0.0, 1000.0),
    "magnetic_moment": (0.0, 100.0),
    "energy_above_hull": (0.0, 5.0),
}


def normalize(rows: DataFrame) -> DataFrame:
    """``rows`` (property, raw_value, raw_unit, uncertainty) with normalised columns and a failure flag.

    Unknown properties pass through. A unit without a rule or a value out of range fails.
    """
    spark = rows.sparkSession
    flat = [(p, u, s, o, t) for p, units, s, o, t in RULES for u in (units or [None])]
    rules = F.broadcast(spark.createDataFrame(flat, "rule_property string, rule_unit string, factor double, shift double, target string"))
    named, other = rules.where("rule_unit is not null"), rules.where("rule_unit is null")
    other = other.selectExpr("rule_property as any_property", "factor as any_factor", "target as any_target")
    unit = F.lower(F.trim("raw_unit"))
    joined = rows.join(named, (F.col("property") == F.col("rule_property")) & (unit == F.col("rule_unit")), "left")
    joined = joined.join(F.broadcast(other), F.col("property") == F.col("any_property"), "left")
    known = F.col("property").isin(sorted({r[0] for r in RULES}))
    value, spread = F.expr("try_cast(raw_value as double)"), F.expr("try_cast(uncertainty as double)")
    factor = F.coalesce("factor", "any_factor", F.when(~known, F.lit(1.0)))
    scaled = F.round(value * factor + F.coalesce("shift", F.lit(0.0)), 6)
    fits = F.lit(True)
    for name, (low, high) in RANGES.items():
        fits = F.when(F.col("property") == name, scaled.between(low, high)).otherwise(fits)
    absent = F.col("raw_value").isNull()
    good = ~absent & F.coalesce(scaled.isNotNull() & fits, F.lit(False))
    return joined.select(
        *(rows[c] for c in rows.columns),
        F.when(good, scaled).alias("normalized_value"),
        F.when(good, F.coalesce("target", "any_target", "raw_unit")).alias("normalized_unit"),
        F.when(good, F.round(spread * factor, 6)).alias("uncertainty_value"),
        (~absent & ~good).alias("unit_conversion_failed"),
    )
