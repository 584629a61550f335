"""Scores of measurements as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scoring model.
WEIGHTS = {"water": 0.35, "legal": 0.30, "trail": 0.20, "weather": 0.15, "slope": 0.10, "land_cover": 0.05, "drainage": 0.10, "shelter": 0.05, "view": 0.05}
FLOW = {"perennial": 1.0, "unknown": 0.8, "intermittent": 0.55}
FEATURE = {"stream": 1.0, "lake": 1.0, "spring": 1.0, "wetland": 0.5, "other": 0.7}
ACCESS = {"open": 100.0, "restricted": 45.0, "unknown": 40.0, "closed": 0.0}
GAP = {"1": 1.0, "2": 1.0, "3": 0.9, "4": 0.75, "": 0.85}
STRICTNESS = ["closed", "restricted", "unknown", "open"]
SLOPE = [(0, 100), (3, 100), (8, 50), (15, 10), (20, 0)]
VIEW = [(0, 40), (2, 55), (10, 70), (30, 80)]


def peak_curve(d: Column, ideal: float, at_zero: float, half: float) -> Column:
    """Rises linearly from at_zero to 100 at the ideal distance, then halves every half metres."""
    return F.when(d <= ideal, at_zero + (100 - at_zero) * d / ideal).otherwise(100 * F.pow(F.lit(0.5), (d - ideal) / half))


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between points, level beyond them."""
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return F.when(x.isNotNull(), out.otherwise(float(points[-1][1])))


def lookup(key: Column, values: dict[str, float], default: float) -> Column:
    return F.coalesce(F.create_map(*(F.lit(v) for kv in values.items() for v in kv))[key], F.lit(default))


def weather_score(rain: Column, wind: Column, low: Column) -> Column:
    rain, wind = F.coalesce(rain, F.lit(0.0)), F.coalesce(wind, F.lit(0.0))
    cold = F.when(low.isNull(), 0.0).otherwise(F.least(F.lit(30.0), F.greatest(F.lit(0.0), -low) * 3))
    return 100 - F.least(F.lit(40.0), rain * 4) - F.least(F.lit(30.0), F.greatest(F.lit(0.0), wind - 25)) - cold


def bands(x: Column, limits: list[tuple[float, str]], last: str) -> Column:
    """The label of the first limit that x is under; null stays null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for limit, label in limits:
        out = out.when(x < limit, label)
    return out.otherwise(last)


def sector(degrees: Column) -> Column:
    """One of eight directions."""
    names = F.array(*(F.lit(s) for s in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")))
    return F.element_at(names, (F.floor((F.pmod(degrees, F.lit(360.0)) + 22.5) / 45) % 8 + 1).cast("int"))


def grade(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, letter in ((90, "A"), (80, "B"), (70, "C"), (60, "D")):
        out = out.when(score >= least, letter)
    return out.otherwise("F")


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Equal-area conic metres (GRS80; parallels 29.5 and 45.5 N, origin 23 N 96 W), after Snyder's published formulas."""
    from math import asin, cos, log, radians, sin, sqrt  # noqa: F401

    a, e2 = 6378137.0, 0.00669438002290
    e = sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))
    m = lambda p: cos(p) / sqrt(1 - e2 * sin(p) ** 2)
    p1, p2, p0 = radians(29.5), radians(45.5), radians(23.0)
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(sin(p2)) - q(sin(p1)))
    c = m(p1) ** 2 + n * q(sin(p1))
    rho0 = a * sqrt(c - n * q(sin(p0))) / n
    s = F.sin(F.radians(lat))
    qc = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = a * F.sqrt(c - n * qc) / n
    theta = n * F.radians(lon + 96.0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def rounded(c: Column, places: int) -> Column:
    """c to so many places as SQL's round does for doubles: the product with a power of ten, half away from zero.

    F.round goes by the decimal digits of c instead, so that the double just under 125.65 becomes 125.6 there and 125.7 here.
    """
    power = F.lit(10.0**places)
    shifted = F.abs(c) * power
    whole = F.floor(shifted)
    return F.signum(c) * (whole + F.when(shifted - whole >= 0.5, 1).otherwise(0)) / power
