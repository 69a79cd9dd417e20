"""Tail probabilities, from survival functions of the JVM's math library: small tails keep their digits."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _math(spark: SparkSession):  # noqa: ANN202
    return spark._jvm.org.apache.commons.math3.special


def chi2_sf(spark: SparkSession, x: float, df: float) -> float:
    return float(_math(spark).Gamma.regularizedGammaQ(df / 2.0, x / 2.0))


def normal_two_sided(spark: SparkSession, z: float) -> float:
    return float(_math(spark).Erf.erfc(abs(z) / 2**0.5))


def normal_sf(spark: SparkSession, z: float) -> float:
    return 0.5 * float(_math(spark).Erf.erfc(z / 2**0.5))


def binomial_at_least(spark: SparkSession, bads: int, n: int, p: float) -> float:
    """The probability of so many bads or more."""
    return 1.0 if bads <= 0 else float(_math(spark).Beta.regularizedBeta(float(p), float(bads), float(n - bads + 1)))


def jeffreys(spark: SparkSession, bads: int, n: int, p: float) -> float:
    """The posterior probability that the true rate is at most p."""
    return float(_math(spark).Beta.regularizedBeta(float(p), bads + 0.5, n - bads + 0.5))


def student_two_sided(spark: SparkSession, t: float, dof: float) -> float:
    return float(_math(spark).Beta.regularizedBeta(dof / (dof + t * t), dof / 2.0, 0.5))


def f_sf(spark: SparkSession, f: float, d1: float, d2: float) -> float:
    return float(_math(spark).Beta.regularizedBeta(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0))
