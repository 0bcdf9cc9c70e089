"""Column expressions shared by the operators. NULL is the only "missing"."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, functions as F

TRADING_DAYS = 252


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def change(now: Column, before: Column) -> Column:
    """Simple return between two prices."""
    return F.try_divide(now, before) - F.lit(1.0)


def truth(cond: Column) -> Column:
    """Three-valued condition to plain boolean."""
    return F.coalesce(cond, F.lit(False))


def crossed_up(a: Column, b: Column, a_prev: Column, b_prev: Column) -> Column:
    return truth((a > b) & (a_prev <= b_prev))


def crossed_down(a: Column, b: Column, a_prev: Column, b_prev: Column) -> Column:
    return truth((a < b) & (a_prev >= b_prev))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def norm_cdf(x: Column) -> Column:
    """Standard normal CDF by the Abramowitz-Stegun 7.1.26 erf polynomial."""
    # fixed values: published polynomial coefficients
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(x) / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * z)
    poly = F.lit(0.0)
    for coef in reversed(a):
        poly = (poly + F.lit(coef)) * t
    erf = F.lit(1.0) - poly * F.exp(-z * z)
    return F.lit(0.5) * (F.lit(1.0) + F.when(x < 0, -erf).otherwise(erf))


def norm_ppf(p: float) -> float:
    """Inverse normal CDF of a parameter, on the driver."""
    return NormalDist().inv_cdf(p)


# fixed values: prime modulus and multipliers of the integer mixing below
PRIME, MIX_I, MIX_SIM, MIX_SEED = 2147483647, 1103515245, 40503, 69621


def uniform(seed: int, sim: Column, i: Column) -> Column:
    """Deterministic draw in [0, 1) for (seed, sim, i), independent of partitioning.

    Two rounds of x -> x^5 modulo a prime (a bijection), in plain integer
    arithmetic, so any SQL engine can repeat it exactly.
    """
    x = F.pmod(i.cast("bigint") * MIX_I + sim.cast("bigint") * MIX_SIM + F.lit(seed * MIX_SEED + 1), F.lit(PRIME))
    for step in (12345, 67891):
        sq = F.pmod(x * x, F.lit(PRIME))
        x = F.pmod(F.pmod(F.pmod(sq * sq, F.lit(PRIME)) * x, F.lit(PRIME)) + step, F.lit(PRIME))
    return x.cast("double") / float(PRIME)


def gaussian(seed: int, sim: Column, i: Column) -> Column:
    """Box-Muller on two independent draws."""
    u1 = F.lit(1.0) - uniform(seed, sim, i)
    u2 = uniform(seed + 7919, sim, i)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def rounded(df, digits: int = 6):
    """Round every double column: the presentable form of a result."""
    kinds = dict(df.dtypes)
    return df.select(*[
        F.round(F.col(c), digits).alias(c) if kinds[c] == "double" else F.col(c)
        for c in df.columns
    ])
