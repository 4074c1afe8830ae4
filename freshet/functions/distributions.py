"""Distribution functions that numpy lacks: normal, Student t, chi-square, by series and continued
fractions of the incomplete gamma and beta functions."""

from __future__ import annotations

import math


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h, i = d, 0
    while True:
        i += 1
        an = -i * (i - a)
        b += 2
        d = 1 / _apart(an * d + b)
        c = _apart(b + an / c)
        h *= d * c
        if abs(d * c - 1) < 1e-16 or i > 10_000:
            return 1 - front * h


def _apart(x: float) -> float:
    return x if abs(x) > 1e-300 else 1e-300


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x >= (a + 1) / (a + b + 2):
        return 1 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / _apart(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / _apart(1 + top * d)
            c = _apart(1 + top / c)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) with df degrees of freedom."""
    return beta_i(df / 2, 0.5, df / (df + t * t))


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2)
