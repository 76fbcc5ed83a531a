"""Rounding and stock formulas."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, places: int = 0) -> Column:
    """Half-to-even on the binary value, so 2.175 (stored just below) is 2.17."""
    if places == 0:
        return F.rint(x)
    scale = float(10 ** places)
    return F.rint(x * scale) / scale


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def eoq(demand: Column, ordering: Column, holding: Column) -> Column:
    ok = (demand > 0) & (ordering > 0) & (holding > 0)
    return F.when(ok, F.sqrt(2.0 * demand * ordering / holding)).otherwise(0.0)


def total_cost(demand: Column, ordering: Column, holding: Column, q: Column) -> Column:
    """Yearly ordering plus holding cost; NULL for an impossible quantity."""
    return F.when(q > 0, demand / q * ordering + q / 2.0 * holding)


def yeo_johnson(x: Column, lam: float) -> Column:
    pos = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    neg = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2.0 - lam)) - 1) / (2.0 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson_inverse(z: Column, lam: float) -> Column:
    pos = F.expm1(z) if lam == 0 else F.pow(F.greatest(z * lam + 1, F.lit(0.0)), F.lit(1.0 / lam)) - 1
    neg = 1 - F.exp(-z) if lam == 2 else 1 - F.pow(F.greatest(1 - (2.0 - lam) * z, F.lit(0.0)), F.lit(1.0 / (2.0 - lam)))
    return F.when(z >= 0, pos).otherwise(neg)


def quantile_of(sorted_values: Column, q: Column | float) -> Column:
    """Linear-interpolated quantile of a short, ascending, non-empty array."""
    q = F.lit(q) if isinstance(q, float) else q
    at = (F.size(sorted_values) - 1) * q
    lo = F.floor(at).cast("int")
    a = F.get(sorted_values, lo)
    b = F.coalesce(F.get(sorted_values, lo + 1), a)
    return a + (b - a) * (at - lo)


POISSON = np.array([0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676])  # steps of Poisson(1)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 well-spread bits of each number and a salt, for draws that don't depend on partitioning."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(salt & 0xFFFFFFFFFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
