"""Closed-form statistics over a small frame of moments, as SQL select items.

``n`` is the number of values, ``g1`` and ``g2`` the biased skewness and excess kurtosis that
Spark's ``skewness`` and ``kurtosis`` return.  The lists are meant for ``selectExpr("*", *items)``:
later items use the names of earlier ones, so every intermediate value is computed once."""

from __future__ import annotations

import math
from statistics import NormalDist


def adjusted_skewness(n: str, g1: str) -> str:
    """Bias-corrected G1, defined from three values on."""
    return f"CASE WHEN {n} >= 3 THEN {g1} * sqrt(double({n}) * ({n} - 1)) / ({n} - 2) END"


def adjusted_kurtosis(n: str, g2: str) -> str:
    """Bias-corrected excess G2, from four values on; three values keep the biased form."""
    return (f"CASE WHEN {n} >= 4 THEN ((double({n}) + 1) * {g2} + 6) * ({n} - 1) / ((double({n}) - 2) * ({n} - 3))"
            f" WHEN {n} = 3 THEN {g2} END")


def skew_statistic(n: str, g1: str, out: str) -> list[str]:
    """D'Agostino's normal transform of the skewness, n >= 8."""
    return [f"CASE WHEN {n} >= 8 THEN double({n}) END AS _sn",
            f"{g1} * sqrt((_sn + 1) * (_sn + 3) / (6 * (_sn - 2))) AS _sy",
            "3 * (_sn * _sn + 27 * _sn - 70) * (_sn + 1) * (_sn + 3)"
            " / ((_sn - 2) * (_sn + 5) * (_sn + 7) * (_sn + 9)) AS _sb",
            "sqrt(2 * (_sb - 1)) - 1 AS _sw",
            "CASE WHEN _sy = 0 THEN 1D ELSE _sy END / sqrt(2 / (_sw - 1)) AS _sa",
            f"asinh(_sa) / sqrt(0.5D * ln(_sw)) AS {out}"]


def kurtosis_statistic(n: str, g2: str, out: str) -> list[str]:
    """Anscombe and Glynn's normal transform of the kurtosis, n >= 5."""
    return [f"CASE WHEN {n} >= 5 THEN double({n}) END AS _kn",
            f"({g2} + 3 - 3 * (_kn - 1) / (_kn + 1))"
            " / sqrt(24 * _kn * (_kn - 2) * (_kn - 3) / ((_kn + 1) * (_kn + 1) * (_kn + 3) * (_kn + 5))) AS _kx",
            "6 * (_kn * _kn - 5 * _kn + 2) / ((_kn + 7) * (_kn + 9))"
            " * sqrt(6 * (_kn + 3) * (_kn + 5) / (_kn * (_kn - 2) * (_kn - 3))) AS _ks",
            "6 + 8 / _ks * (2 / _ks + sqrt(1 + 4 / (_ks * _ks))) AS _ka",
            "nullif(1 + _kx * sqrt(2 / (_ka - 4)), 0D) AS _kq",
            "(1 - 2 / (9 * _ka) - signum(_kq) * cbrt((1 - 2 / _ka) / abs(_kq))) / sqrt(2 / (9 * _ka))"
            f" AS {out}"]


def omnibus_k2(n: str, g1: str, g2: str, out: str) -> list[str]:
    """D'Agostino-Pearson statistic for 20 values and more, NULL below."""
    return [*skew_statistic(n, g1, "_zs"), *kurtosis_statistic(n, g2, "_zk"),
            f"CASE WHEN {n} >= 20 THEN _zs * _zs + _zk * _zk END AS {out}"]


def _t_cdf(t: float, v: int) -> float:
    """Student t distribution function for whole degrees of freedom (finite series)."""
    theta = math.atan2(t, math.sqrt(v))
    cos2 = math.cos(theta) ** 2
    if v % 2:
        term, total = math.cos(theta), 0.0
        for k in range(1, (v - 1) // 2 + 1):
            total += term
            term *= cos2 * (2 * k) / (2 * k + 1)
        area = 2 / math.pi * (theta + math.sin(theta) * total)
    else:
        term, total = 1.0, 0.0
        for k in range(1, v // 2 + 1):
            total += term
            term *= cos2 * (2 * k - 1) / (2 * k)
        area = math.sin(theta) * total
    return 0.5 + area / 2


def t_quantile_value(p: float, v: int) -> float:
    """t quantile by bisection, for the few small degrees of freedom the series is too coarse for."""
    low, high = 0.0, 1e7
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_cdf(mid, v) < p else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, v: str, exact_until: int = 30) -> str:
    """Upper t quantile: exact for small ``v``, Cornish-Fisher series in 1/v above."""
    z = NormalDist().inv_cdf(p)
    g = [(z**3 + z) / 4,
         (5 * z**5 + 16 * z**3 + 3 * z) / 96,
         (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
         (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    series = " + ".join([f"{z!r}D"] + [f"{c!r}D / pow(double({v}), {k})" for k, c in enumerate(g, start=1)])
    small = " ".join(f"WHEN {v} = {k} THEN {t_quantile_value(p, k)!r}D" for k in range(1, exact_until + 1))
    return f"CASE {small} WHEN {v} > {exact_until} THEN {series} END"
