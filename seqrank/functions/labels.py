"""Affinity units and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gas constant in kcal/(mol K), temperature in K, antibody mass in Da.
GAS_CONSTANT = 8.314 / 4184
TEMPERATURE = 298.15
ANTIBODY_MASS = 150000.0

# Affinity columns in order of preference, with the kind of
# measurement and the factor to molar. The sources disagree by 1000 between
# micro- and nanogram readings; each keeps its own factor.
AFFINITY_SOURCES = (
    ("IC50 [ug/mL]", "surrogate_ic50", (1000 / 150000) * 1e-9),
    ("Affinity_Kd [nM]", "molar_direct", 1e-9),
    ("Affinity_Kd[nM]", "molar_direct", 1e-9),
    ("Affinity_Kd_nM", "molar_direct", 1e-9),
    ("Kd_nM", "molar_direct", 1e-9),
    ("Kd (nM)", "molar_direct", 1e-9),
    ("affinity(μg/mL)", "surrogate_elisa", 1e-6 / 150000),
    ("affinity(ng/mL)", "surrogate_elisa", 1e-9 / 150000),
)

# Factor to molar of each source profile.
PROFILE_FACTORS = {
    "kd_molar": 1.0,
    "kd_nm": 1e-9,
    "ic50_ug_ml": (1000 / 150000) * 1e-9,
    "elisa_ug_ml_trainer": 1e-6 / 150000,
    "elisa_ng_ml_trainer": 1e-9 / 150000,
    "elisa_ug_ml_table": 1 / (150 * 1e6),
    "ec50_table": (1e6 / 150000) * 1e-9,
}


def _number(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def kd_to_label(kd: Column, target: str = "pkd") -> Column:
    """Molar KD to ``pkd``, ``lnkd`` or ``kcal``; null unless KD > 0."""
    valid = F.when(kd > 0, kd)
    if target == "pkd":
        return -F.log10(valid)
    if target == "lnkd":
        return F.log(valid)
    if target == "kcal":
        return F.lit(GAS_CONSTANT * TEMPERATURE) * F.log(valid)
    raise ValueError(f"unknown target {target!r}")


def label_to_kd(label: Column, target: str = "pkd") -> Column:
    if target.lower() != "pkd":
        raise ValueError(f"no KD for target {target!r}")
    return F.pow(F.lit(10.0), -label)


def affinity_to_kd(value: Column, profile: str) -> Column:
    """Molar KD and nanomolar KD as a struct ``(kd_m, kd_nm)``."""
    molar = _number(value) * F.lit(PROFILE_FACTORS[profile])
    return F.struct(molar.alias("kd_m"), (molar * F.lit(1e9)).alias("kd_nm"))
