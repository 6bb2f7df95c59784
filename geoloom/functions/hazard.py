"""Slopes, earthquakes, volcanoes and air pollution on columns."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import choose, clamp, steps

# fixed values: weights and limits of the six landslide memberships
WEIGHTS = {"slope": 0.25, "aspect": 0.10, "lithology": 0.20, "rain": 0.20, "fault": 0.10, "vegetation": 0.15}
LEVELS = [(0.15, "very_low"), (0.35, "low"), (0.55, "moderate"), (0.75, "high")]
SITE_FACTORS = {"I0": 0.72, "I1": 0.8, "II": 1.0, "III": 1.35, "IV": 1.8}


def rising(x: Column, a: float, b: float) -> Column:
    """0 up to a, 1 from b, a smooth step between."""
    t = clamp((x - a) / (b - a), 0, 1)
    return t * t * (3.0 - 2.0 * t)


def falling(x: Column, a: float, b: float) -> Column:
    return 1.0 - rising(x, a, b)


def landslide_score(slope: Column, aspect: Column, lithology: Column, rain: Column, fault_m: Column, ndvi: Column) -> Column:
    south = clamp((F.cos(F.radians(aspect) - pi) + 1.0) * 0.5, 0, 1)
    parts = {"slope": rising(slope, 15, 35), "aspect": south, "lithology": clamp(lithology, 0, 1), "rain": rising(rain, 100, 300), "fault": falling(fault_m, 200, 1000), "vegetation": falling(ndvi, 0.2, 0.6)}
    total = F.lit(0.0)
    for name, w in WEIGHTS.items():
        total = total + w * parts[name]
    return total


def risk_level(score: Column) -> Column:
    return steps(score, LEVELS, "very_high", closed=True)


def factor_of_safety(slope: Column, depth: Column, cohesion: Column, friction: Column, weight: Column, wet: Column) -> Column:
    """Infinite slope; 99 where nearly flat."""
    b = F.radians(slope)
    load = F.greatest(F.lit(1.0), weight) * depth
    driving = load * F.sin(b) * F.cos(b)
    normal = (load - clamp(wet, 0, 1) * 9.81 * depth) * F.cos(b) * F.cos(b)
    return F.when(driving < 1e-10, 99.0).otherwise((cohesion + normal * F.tan(F.radians(friction))) / driving)


def newmark_cm(slope: Column, safety: Column, pga: Column) -> Column:
    """Displacement once the shaking passes the critical acceleration, else 0."""
    critical = (safety - 1.0) * F.sin(F.radians(slope))
    moves = (critical > 0) & (pga > critical)
    return F.when(moves, F.pow(F.lit(10.0), 2.401 * F.log10(pga / F.when(moves, critical).otherwise(1.0)) - 0.603)).otherwise(0.0)


# --- shaking


def site_factor(site: Column) -> Column:
    return choose(site, SITE_FACTORS, 1.0)


def pga(magnitude: Column, km: Column, site: Column) -> Column:
    rock = F.exp(-2.0 + 0.8 * (magnitude - 6.0) - 1.5 * F.ln(F.greatest(F.lit(5.0), km) / 30.0))
    return F.when((magnitude <= 0) | (km < 0), 0.0).otherwise(clamp(rock * site_factor(site), 0.001, 2.0))


def pgv(acceleration: Column, site: Column) -> Column:
    return 120.0 * F.pow(acceleration, F.lit(0.6)) * site_factor(site)


def intensity(acceleration: Column) -> Column:
    return steps(acceleration, [(0.005, 5), (0.01, 6), (0.025, 7), (0.05, 8), (0.1, 9), (0.2, 10), (0.4, 11)], 12)


def spectral_acceleration(acceleration: Column, period: Column, damping: float = 0.05) -> Column:
    top = 2.5 * min(1.5, max(0.5, (0.05 / max(damping, 0.001)) ** 0.4 * 0.55 + 0.45))
    shape = F.when(period < 0.1, 1.0 + (top - 1.0) * period / 0.1).when(period <= 0.4, top).otherwise(top * 0.4 / period)
    return F.least(F.lit(5.0), acceleration * shape)


def rate_between(annual: Column, b: Column, m_min: Column, low: Column, high: Column) -> Column:
    """Yearly events between two magnitudes, exponentially fewer above m_min."""
    beta = b * log(10)
    return F.when(high <= F.greatest(low, m_min), 0.0).otherwise(annual * (F.exp(-beta * (F.greatest(low, m_min) - m_min)) - F.exp(-beta * (high - m_min))))


def exceedance(level: Column, median: Column, sigma: float = 0.7) -> Column:
    """The chance that shaking passes a level, with a close form of the normal distribution."""
    x = F.ln(level / median) / sigma
    return 0.5 * (1.0 - F.signum(x) * F.sqrt(1.0 - F.exp(-2.0 / pi * x * x)))


def poisson_chance(rate: Column, years: Column) -> Column:
    return 1.0 - F.exp(-rate * years)


def recurrence_years(rate: Column) -> Column:
    return F.when(rate > 0, 1.0 / rate)


# --- volcanoes


def volcanic_score(ash_mm: Column, on_lava: Column, km: Column) -> Column:
    ash = steps(ash_mm, [(1, 0), (10, 1), (100, 2)], 3, closed=True)
    near = steps(km, [(1, 3), (5, 2), (15, 1)], 0)
    return ash + F.when(on_lava, 4).otherwise(0) + near


def volcanic_level(score: Column) -> Column:
    return steps(score, [(1, "none"), (3, "low"), (5, "moderate"), (7, "high")], "extreme")


def settling_velocity(diameter: Column, density: Column, air: float = 1.2, viscosity: float = 1.8e-5) -> Column:
    """Stokes."""
    return (density - air) * 9.81 * diameter * diameter / (18 * viscosity)


# --- air

# fixed values: spread coefficients (y, z, and how z bends with distance) by stability class
SPREAD = {"A": (0.22, 0.20, 0.0, 0.0), "B": (0.16, 0.12, 0.0, 0.0), "C": (0.11, 0.08, 0.0002, 0.5), "D": (0.08, 0.06, 0.0015, 0.5), "E": (0.06, 0.03, 0.0003, 1.0), "F": (0.04, 0.016, 0.0003, 1.0)}


def plume_spread(x_m: Column, stability: Column) -> tuple[Column, Column]:
    """sigma y and sigma z in metres."""
    x = F.greatest(F.lit(0.001), x_m / 1000.0)
    pick = lambda i: choose(stability, {k: v[i] for k, v in SPREAD.items()}, None)
    return 1000.0 * pick(0) * x / F.sqrt(1.0 + 0.0001 * x), 1000.0 * pick(1) * x / F.pow(1.0 + pick(2) * x, pick(3))


def plume_ug_m3(rate_g_s: Column, wind: Column, height: Column, x: Column, y: Column, z: Column, stability: Column) -> Column:
    """Gaussian plume with reflection at the ground."""
    sy, sz = plume_spread(x, stability)
    bell = lambda d, s: F.exp(-d * d / (2.0 * s * s))
    return F.when(wind > 0, rate_g_s * 1e6 / (2 * pi * wind * sy * sz) * bell(y, sy) * (bell(z - height, sz) + bell(z + height, sz))).otherwise(0.0)


# fixed values: concentration and index at the limits of the classes
AQI = [(0.0, 0.0), (12.0, 50.0), (35.4, 100.0), (55.4, 150.0), (150.4, 250.0), (250.4, 300.0)]


def pm25_aqi(pm: Column) -> Column:
    """The index, cut to a whole number; classes are linear, the last rises by 200 over 250 at most... per its published code.

    Note the step at 150.4, where the index falls from 250 to 200."""
    out = None
    for (a, i), (b, j) in zip(AQI, AQI[1:]):
        low = 200.0 if a == 150.4 else i
        part = low + (pm - a) / (b - a) * ((300.0 if a == 150.4 else j) - low)
        out = F.when(pm <= b, part) if out is None else out.when(pm <= b, part)
    return F.floor(out.otherwise(300.0 + F.least(F.lit(200.0), (pm - 250.4) / 250.0 * 200.0))).cast("int")


def aqi_class(pm: Column) -> Column:
    return steps(pm, [(12.0, "good"), (35.4, "moderate"), (55.4, "sensitive"), (150.4, "unhealthy"), (250.4, "very_unhealthy")], "hazardous", closed=True)


def pm25_from_aod(aod: Column, ratio: float, humidity: float, season: Column) -> Column:
    return aod * ratio * humidity * choose(season, {"winter": 1.3, "spring": 1.1, "summer": 0.8}, 1.0)


def boundary_layer_m(wind: Column, roughness: Column, stability: Column) -> Column:
    base = choose(stability, {"A": 1400.0, "B": 1200.0, "C": 900.0, "D": 750.0, "E": 350.0}, 150.0)
    stirred = F.when(stability.isin("A", "B", "C", "D"), 1.0 + 0.1 * F.greatest(F.lit(0.0), wind - 3.0) / F.greatest(F.lit(1.0), wind)).otherwise(1.0)
    return clamp(base * stirred * (1.0 + 0.2 * clamp(roughness / 0.1, 0, 1)), 50, 2500)


def friction_velocity(wind: Column, roughness: Column, stability: Column) -> Column:
    psi = choose(stability, {"A": -2.0, "B": -2.0, "C": 0.0, "D": 0.0}, 2.0)
    return 0.4 * wind / F.greatest(F.lit(0.1), F.ln(10.0 / F.greatest(F.lit(0.001), roughness)) - psi)


def bulk_richardson(t_low: Column, t_high: Column, height: Column, wind: Column) -> Column:
    return F.when((height > 0) & (wind > 0), 9.81 / ((t_low + t_high) / 2.0 + 273.15) * (t_high - t_low) * height / (wind * wind + 0.01)).otherwise(0.0)


def stability_class(richardson: Column) -> Column:
    return steps(richardson, [(-0.4, "A"), (-0.2, "B"), (-0.05, "C"), (0.05, "D"), (0.2, "E")], "F")
