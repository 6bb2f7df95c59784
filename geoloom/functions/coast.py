"""Tides, currents, waves, storm surge and coastal carbon on columns."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import choose, steps

GRAVITY = 9.81
WATER_DENSITY = 1025.0
AIR_DENSITY = 1.225
EARTH_ROTATION = 7.2921e-5

# fixed values: degrees an hour of tidal constituents
CONSTITUENTS = {"M2": 28.984104, "S2": 30.0, "N2": 28.439730, "K1": 15.041069, "O1": 13.943036, "P1": 14.958931, "K2": 30.082138, "M4": 57.968208, "MS4": 58.984104}
# fixed values: tonnes of carbon a hectare above ground, below ground, in soil, and gained a year, by ecosystem
BLUE_CARBON = {"mangrove": (118.3, 26.7, 387.0, 1.48), "salt_marsh": (3.0, 10.2, 220.0, 1.19), "seagrass": (1.2, 4.8, 140.0, 0.65)}


def constituent_speed(name: Column) -> Column:
    return choose(name, CONSTITUENTS, 0.0)


def constituent_level(speed_deg_h: Column, amplitude: Column, phase_deg: Column, hours: Column) -> Column:
    """What one constituent adds to the level at a time."""
    return amplitude * F.cos(F.radians(speed_deg_h) * hours + F.radians(phase_deg))


def spring_range(m2: Column, s2: Column) -> Column:
    return m2 + s2


def neap_range(m2: Column, s2: Column) -> Column:
    return F.abs(m2 - s2)


def coriolis(lat: Column) -> Column:
    """The Coriolis parameter's size, never zero."""
    return 2.0 * EARTH_ROTATION * F.greatest(F.abs(F.sin(F.radians(lat))), F.lit(1e-10))


def wind_stress(speed: Column, drag: float = 0.0013) -> Column:
    return F.lit(AIR_DENSITY * drag) * speed * speed


def ekman_depth(lat: Column, viscosity: float = 0.1) -> Column:
    return F.sqrt(2.0 * viscosity / coriolis(lat))


def ekman_u(speed: Column, direction_deg: Column, lat: Column) -> Column:
    """Eastward transport, from the northward stress."""
    return wind_stress(speed) * F.cos(F.radians(direction_deg)) / (WATER_DENSITY * coriolis(lat))


def ekman_v(speed: Column, direction_deg: Column, lat: Column) -> Column:
    return -wind_stress(speed) * F.sin(F.radians(direction_deg)) / (WATER_DENSITY * coriolis(lat))


def ekman_surface_speed(speed: Column, lat: Column) -> Column:
    return 2.0**0.5 * wind_stress(speed) / (WATER_DENSITY * coriolis(lat) * ekman_depth(lat))


def geostrophic_u(slope_y: Column, lat: Column) -> Column:
    return -(GRAVITY / coriolis(lat)) * slope_y


def geostrophic_v(slope_x: Column, lat: Column) -> Column:
    return (GRAVITY / coriolis(lat)) * slope_x


def total_current(speed: Column, direction_deg: Column, slope_x: Column, slope_y: Column, lat: Column) -> Column:
    """Speed of wind-driven and geostrophic flow together."""
    u = ekman_u(speed, direction_deg, lat) + geostrophic_u(slope_y, lat)
    v = ekman_v(speed, direction_deg, lat) + geostrophic_v(slope_x, lat)
    return F.sqrt(u * u + v * v)


def southern_oscillation(anomaly: Column) -> Column:
    return -2.0 * anomaly


def deep_wavelength(period: Column) -> Column:
    return F.lit(GRAVITY / (2.0 * pi)) * period * period


def breaker_height(height: Column, period: Column) -> Column:
    return F.least(0.56 * height * F.pow(height / deep_wavelength(period), F.lit(-0.2)), 1.5 * height)


def _sinh(x: Column) -> Column:
    return (F.exp(x) - F.exp(-x)) / 2.0


def shoaling(period: Column, depth: Column) -> Column:
    """The ratio of wave height at a depth (half a metre or more) to that offshore, 2 at most."""
    l0, d = deep_wavelength(period), F.greatest(depth, F.lit(0.5))
    deep = 0.5 * l0 / period
    kh = 2.0 * pi * d / l0
    group = F.when(d >= l0 / 2.0, deep).otherwise(0.5 * (1.0 + 2.0 * kh / _sinh(2.0 * kh)) * F.sqrt(GRAVITY * d))
    return F.least(F.sqrt(deep / F.greatest(group, F.lit(0.01))), F.lit(2.0))


def shore_height(height: Column, period: Column, depth: Column) -> Column:
    """Wave height at the shore, nine tenths of the breaker's at most."""
    return F.least(height * shoaling(period, depth), 0.9 * breaker_height(height, period))


def wave_energy_flux(height: Column, period: Column, depth: Column) -> Column:
    """Watts a metre of crest."""
    l0 = deep_wavelength(period)
    speed = F.when(depth >= l0 / 2.0, l0 / period).otherwise(F.sqrt(GRAVITY * depth))
    kh = 2.0 * pi * depth / F.greatest(l0, F.lit(0.1))
    n = F.when(kh > 0.01, 0.5 * (1.0 + 2.0 * kh / _sinh(2.0 * kh))).otherwise(1.0)
    return F.lit(WATER_DENSITY * GRAVITY / 8.0) * height * height * n * speed


def iribarren(slope: Column, height: Column, period: Column) -> Column:
    return F.when(height > 0, slope / F.sqrt(height / deep_wavelength(period))).otherwise(0.0)


def wave_setup(height: Column, slope: Column) -> Column:
    return F.least(0.17 + 0.08 * slope, F.lit(0.25)) * height


def runup_holman(slope: Column, height: Column, period: Column, structure: bool = False) -> Column:
    return F.lit(0.20 if structure else 0.27) * slope * F.sqrt(height * deep_wavelength(period))


def runup_stockdon(slope: Column, height: Column, period: Column) -> Column:
    """The 2 % run-up; flat beaches by wave height and length alone."""
    size = F.sqrt(height * deep_wavelength(period))
    swash = F.sqrt(F.pow(0.75 * slope * size, F.lit(2.0)) + F.pow(0.06 * size, F.lit(2.0)))
    return F.when(iribarren(slope, height, period) < 0.3, 0.043 * size).otherwise(1.1 * (0.35 * slope * size + swash / 2.0))


def overtopping(slope: Column, height: Column, period: Column, freeboard: Column, vertical: bool = False) -> Column:
    """Litres a second and metre over a crest; null for no waves or outside the formula's range."""
    weir = 0.544 * GRAVITY**0.5 * F.pow(F.greatest(-freeboard, F.lit(0.001)), F.lit(1.5))
    if vertical:
        over = 0.047 * F.exp(-2.35 * freeboard / height)
    else:
        xi, rel = iribarren(slope, height, period), freeboard / height
        over = F.when((xi < 5.0) & (rel >= 0.1) & (rel <= xi), 0.067 / F.sqrt(F.greatest(slope, F.lit(0.01))) * xi * F.exp(-4.75 * rel / xi))
    return F.when(height > 0, F.when(freeboard <= 0, weir).otherwise(over) * 1000.0)


def overtopping_hazard(litres: Column) -> Column:
    return steps(litres, [(0.1, "very_low"), (1.0, "low"), (10.0, "moderate"), (50.0, "high")], "very_high")


def gradient_wind(km: Column, deficit_hpa: Column, rmax_km: Column, b: float = 1.3) -> Column:
    """Wind of a storm at a distance from its centre (Holland's profile)."""
    ratio = F.pow(rmax_km / km, F.lit(b))
    far = F.sqrt(b / AIR_DENSITY * deficit_hpa * 100.0 * ratio * F.exp(-ratio))
    return F.when(km < 0.1, F.sqrt(b / AIR_DENSITY * deficit_hpa * 100.0 * F.exp(F.lit(-1.0)))).otherwise(far)


def wind_setup(speed: Column, fetch_km: Column, depth: Column, drag: float = 0.0025) -> Column:
    """Rise of the water that wind drives over a fetch."""
    return F.lit(drag * AIR_DENSITY * 1000.0 / (WATER_DENSITY * GRAVITY)) * speed * speed * fetch_km / F.greatest(depth, F.lit(1.0))


def pressure_surge(deficit_hpa: Column) -> Column:
    """A centimetre for each hectopascal."""
    return 0.01 * deficit_hpa


def surge_risk(surge: Column) -> Column:
    return F.when(surge > 3.0, "very_high").when(surge > 1.5, "high").when(surge > 0.5, "moderate").otherwise("low")


def blue_carbon_stock(ecosystem: Column, area_ha: Column, soil_factor: Column) -> Column:
    """Tonnes of carbon dioxide held; null for other ecosystems."""
    out = F.lit(None).cast("double")
    for name, (above, below, soil, _) in BLUE_CARBON.items():
        out = F.when(ecosystem == name, (above + below + soil * soil_factor) * (44.0 / 12.0) * area_ha).otherwise(out)
    return out


def blue_carbon_gain(ecosystem: Column, area_ha: Column) -> Column:
    """Tonnes of carbon dioxide gained a year."""
    return choose(ecosystem, {k: v[3] for k, v in BLUE_CARBON.items()}, None) * (44.0 / 12.0) * area_ha
