"""Column expressions of the comparison's statistics, and the same as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz-Stegun 7.1.26 for the normal distribution, Acklam's for its inverse.
CDF_P = 0.3275911
CDF_A = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)
PPF_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
PPF_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
PPF_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
PPF_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
PPF_LOW = 0.02425


def _horner(coefficients, x):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_cdf(z: Column) -> Column:
    """Normal distribution function."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(CDF_P) * x)
    erf = 1 - _horner([F.lit(c) for c in CDF_A], t) * t * F.exp(-x * x)
    return F.lit(0.5) * (1 + F.signum(z) * erf)


def norm_ppf(p: Column) -> Column:
    """Inverse of the normal distribution function, 0 < p < 1."""
    lits = lambda cs: [F.lit(c) for c in cs]

    def tail(q: Column) -> Column:
        return _horner(lits(PPF_C), q) / (_horner(lits(PPF_D), q) * q + 1)

    q = p - 0.5
    r = q * q
    middle = _horner(lits(PPF_A), r) * q / (_horner(lits(PPF_B), r) * r + 1)
    low, high = tail(F.sqrt(-2 * F.log(p))), -tail(F.sqrt(-2 * F.log(1 - p)))
    return F.when(p < PPF_LOW, low).when(p > 1 - PPF_LOW, high).otherwise(middle)


def family_alpha(z: Column) -> Column:
    """Two-sided error rate of a threshold."""
    return 2 * (1 - norm_cdf(z))


def sidak_z(z: Column, n: Column) -> Column:
    """Threshold at which n comparisons together err as often as one does at z."""
    alpha = 1 - F.pow(1 - family_alpha(z), 1.0 / F.greatest(n, F.lit(1)))
    return F.when(n <= 1, z).otherwise(norm_ppf(1 - alpha / 2))


def kish_n(sum_w: Column, sum_w2: Column) -> Column:
    """Effective number of events."""
    return F.when(sum_w2 > 0, sum_w * sum_w / sum_w2).otherwise(0.0)


def pooled_variance(sum_w: Column, sum_w2: Column, mean: Column, sum_sq: Column) -> Column:
    """Reliability-weighted sample variance from sufficient statistics; null under two effective events."""
    spare = sum_w - sum_w2 / sum_w
    value = F.greatest((sum_sq - sum_w * mean * mean) / spare, F.lit(0.0))
    return F.when((sum_w2 > 0) & (kish_n(sum_w, sum_w2) >= 2) & (spare > 0), value)


def _horner_sql(coefficients, x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def norm_cdf_sql(z: str) -> str:
    x, = (f"(abs({z}) / sqrt(2.0))",)
    t = f"(1.0 / (1.0 + {CDF_P} * {x}))"
    return f"(0.5 * (1 + sign({z}) * (1 - {_horner_sql(CDF_A, t)} * {t} * exp(-{x} * {x}))))"


def norm_ppf_sql(p: str) -> str:
    def tail(q: str) -> str:
        return f"({_horner_sql(PPF_C, q)} / ({_horner_sql(PPF_D, q)} * {q} + 1))"

    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    middle = f"({_horner_sql(PPF_A, r)} * {q} / ({_horner_sql(PPF_B, r)} * {r} + 1))"
    return f"(CASE WHEN {p} < {PPF_LOW} THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > 1 - {PPF_LOW} THEN -{tail(f'sqrt(-2 * ln(1 - {p}))')} ELSE {middle} END)"


def sidak_z_sql(z: str, n: str) -> str:
    alpha = f"(1 - pow(1 - 2 * (1 - {norm_cdf_sql(z)}), 1.0 / greatest({n}, 1)))"
    return f"(CASE WHEN {n} <= 1 THEN {z} ELSE {norm_ppf_sql(f'(1 - {alpha} / 2)')} END)"
