"""p-values and critical values of the two-sample tests."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def kolmogorov_p(stat: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p of the two-sample KS statistic.

    Survival function of the Kolmogorov distribution at sqrt(n1 n2 / (n1 + n2)) * D.
    """
    lam = F.sqrt(n1.cast("double") * n2 / (n1 + n2)) * stat
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    # Below this point the alternating series has not converged and the value is 1 to 12 digits.
    # Without a statistic there is no p: least and greatest would pass over the null.
    within = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series))
    return F.when(lam < 0.2, F.lit(1.0)).when(lam.isNotNull(), within)


def kolmogorov_critical(p: float) -> float:
    """lambda with survival p, for 0 < p < 1."""
    low, high = 0.2, 10.0
    for _ in range(200):
        mid = (low + high) / 2
        sf = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * mid * mid) for k in range(1, 101))
        low, high = (mid, high) if sf > p else (low, mid)
    return (low + high) / 2


def rank_sum_z(u: Column, n1: Column, n2: Column) -> Column:
    """z of the smaller U under the normal approximation; no tie term, no continuity term."""
    mean = n1 * n2 / 2.0
    sd = F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0)
    return F.when(sd == 0, F.lit(0.0)).otherwise((u - mean) / sd)


def z_critical(p: float) -> float:
    """z such that the two-sided p of the smaller U is ``p``."""
    return NormalDist().inv_cdf(p / 2)


@F.pandas_udf(DoubleType())
def _two_sided(z):
    return 2 * z.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)) if v is not None else np.nan)


def two_sided_p(z: Column) -> Column:
    """2 * Phi(z); for report rows only, alarms compare z with ``z_critical``."""
    return _two_sided(z)
