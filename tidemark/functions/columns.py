"""Scalar functions as Column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def sign_up(x: Column) -> Column:
    """1 or -1; zero counts as positive."""
    return F.when(x < 0, -1.0).otherwise(1.0)


def safe_div(a: Column, b: Column, otherwise: float = 0.0, least: float = 1e-10) -> Column:
    return F.when(F.abs(b) < least, F.lit(otherwise)).otherwise(a / b)


def normal_cdf(x: Column) -> Column:
    """By the five-term rational approximation of erf (Abramowitz and Stegun 7.1.26)."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + z * 0.3275911)
    # fixed values: the approximation's coefficients
    poly = ((((t * 1.061405429 - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return (F.lit(1.0) + sign_up(x) * (1 - poly * F.exp(-z * z))) * 0.5


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def entropy_confidence(up: Column, down: Column) -> Column:
    """1 - H / ln 3 of the three-way distribution (up, down, neither)."""
    flat = clamp(1 - up - down, 0.0, 1.0)
    h = sum((-(p * F.ln(p)) for p in (F.greatest(q, F.lit(1e-10)) for q in (up, down, flat))), F.lit(0.0))
    return clamp(1 - h / F.ln(F.lit(3.0)), 0.0, 1.0)


def regime(std: Column, edge: Column) -> Column:
    return F.when(std > 0.02, "high_vol").when(F.abs(edge) > 0.3, "trending").when(F.abs(edge) < 0.1, "consolidating").otherwise("mixed")


def risk_reward(entry: Column, stop: Column, target: Column) -> Column:
    return safe_div(F.abs(target - entry), F.abs(stop - entry))
