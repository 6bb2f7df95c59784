"""Small Column helpers.  Everything stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | str | float | int


def c(x: Number) -> Column:
    """A column by name, a literal, or the column itself, as double."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def rounded(x: Column, digits: int = 6) -> Column:
    """floor(x 10^d + 1/2) / 10^d: the same digits on every engine, unlike round()."""
    k = float(10**digits)
    return F.floor(x * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k)


def round_half_away(x: Column, digits: int = 2) -> Column:
    """Round half away from zero in binary arithmetic (1.005 gives 1.0)."""
    k = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def steps(x: Column, cuts: list[tuple[float, object]], rest: object, closed: bool = False) -> Column:
    """The value of the first cut x lies below (at or below, if closed)."""
    out = None
    for cut, value in cuts:
        test = (x <= F.lit(float(cut))) if closed else (x < F.lit(float(cut)))
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(rest))


def choose(x: Column, table: dict[object, object], rest: object) -> Column:
    """A look-up in a small fixed table."""
    out = None
    for key, value in table.items():
        out = F.when(x == F.lit(key), F.lit(value)) if out is None else out.when(x == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(rest))


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through points with ascending x; constant before the first, extended after the last."""
    out = F.when(x <= F.lit(float(points[0][0])), F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        slope = (y1 - y0) / (x1 - x0)
        part = F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit(slope)
        out = out.when(x <= F.lit(float(x1)), part) if (x1, y1) != points[-1] else out.otherwise(part)
    return out


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function (Abramowitz and Stegun 7.1.26; error below 1.5e-7)."""
    z = F.abs(x) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * z)
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    erf = F.lit(1.0) - poly * F.exp(-z * z)
    return F.lit(0.5) * (F.lit(1.0) + F.signum(x) * erf)
