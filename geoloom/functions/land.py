"""Coasts, energy, ecology, farming, cities, people and survey formulas on columns."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import choose, clamp, interpolate, steps

# --- coasts

# fixed values: metres of sea level by scenario
SEA_LEVEL = {"SSP1-1.9": [(2020, 0.06), (2050, 0.28), (2100, 0.41)], "SSP1-2.6": [(2020, 0.06), (2050, 0.32), (2100, 0.55)], "SSP2-4.5": [(2020, 0.06), (2050, 0.32), (2100, 0.62)], "SSP3-7.0": [(2020, 0.06), (2050, 0.34), (2100, 0.72)], "SSP5-8.5": [(2020, 0.06), (2050, 0.37), (2100, 0.88)]}


def sea_level(scenario: Column, year: Column) -> Column:
    out = None
    for name, points in SEA_LEVEL.items():
        value = interpolate(year.cast("double"), points)
        out = F.when(scenario == name, value) if out is None else out.when(scenario == name, value)
    return out.otherwise(interpolate(year.cast("double"), [(2020, 0.06), (2100, 0.62)]))


def vulnerability(landform: Column, change: Column, slope: Column, rise: Column, wave: Column, tide: Column) -> Column:
    """Coastal vulnerability index of six scores from 1 to 5."""
    scores = [
        landform,
        steps(change, [(-2, 5), (-1, 4), (1.0000000001, 3), (2, 2)], 1),
        F.when(slope > 12, 1).when(slope > 8, 2).when(slope > 4, 3).when(slope > 2, 4).otherwise(5),
        steps(rise, [(1.8, 1), (2.5, 2), (3.0, 3), (3.4, 4)], 5),
        steps(wave, [(0.55, 1), (0.85, 2), (1.05, 3), (1.25, 4)], 5),
        F.when(tide > 6, 1).when(tide > 4, 2).when(tide > 2, 3).when(tide > 1, 4).otherwise(5),
    ]
    product = F.lit(1.0)
    for s in scores:
        product = product * s
    return F.sqrt(product / 6.0)


def vulnerability_rank(index: Column) -> Column:
    return steps(index, [(5, "very_low"), (10, "low"), (20, "moderate"), (40, "high")], "very_high")


def recession_m(rise: Column, beach_slope_pct: Column) -> Column:
    """Bruun: rise by the tangent of the beach slope."""
    return F.when(beach_slope_pct > 0, rise / (beach_slope_pct / 100.0))


# --- energy


def air_density(altitude: Column) -> Column:
    return 1.225 * F.exp(-altitude / 8400.0)


def turbine_power_w(wind: Column, density: Column, radius: float = 40.0, rated_w: float = 2e6, cut_in: float = 4.0, rated: float = 15.0, cut_out: float = 25.0, cp: float = 0.47) -> Column:
    free = F.least(F.lit(rated_w), 0.5 * density * (pi * radius * radius * cp) * wind * wind * wind)
    return F.when((wind < cut_in) | (wind >= cut_out), 0.0).when(wind >= rated, rated_w).otherwise(free)


def shear_log(wind: Column, z_ref: Column, z_hub: Column, z0: Column) -> Column:
    return F.when((z_ref > 0) & (z_hub > 0) & (z0 > 0), wind * F.ln(z_hub / z0) / F.ln(z_ref / z0)).otherwise(wind)


def shear_power(wind: Column, z_ref: Column, z_hub: Column, alpha: float) -> Column:
    return F.when(z_ref > 0, wind * F.pow(z_hub / z_ref, F.lit(alpha))).otherwise(wind)


def jensen_wind(wind: Column, thrust: Column, radius: Column, distance: Column, k: float = 0.075) -> Column:
    """Wind behind a turbine."""
    shrink = radius / (radius + k * distance)
    return wind * F.greatest(F.lit(0.0), 1.0 - (1.0 - F.sqrt(1.0 - thrust)) * shrink * shrink)


def weibull_shape(mean: Column, std: Column) -> Column:
    return clamp(F.pow(std / F.greatest(F.lit(0.1), mean), F.lit(-1.086)), 1, 10)


def gamma_fn(x: Column) -> Column:
    """Gamma for x from 1 to 4 (Stirling's series after a shift by 8)."""
    y = x + 8.0
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) + 1.0 / (1260.0 * F.pow(y, F.lit(5.0)))
    shift = F.lit(1.0)
    for i in range(8):
        shift = shift * (x + float(i))
    return F.exp(series) / shift


def wind_power_density(shape: Column, scale: Column) -> Column:
    return 0.5 * 1.225 * scale * scale * scale * gamma_fn(1.0 + 3.0 / shape)


def reservoir_temperature(surface: Column, heat_flux: Column) -> Column:
    return surface + heat_flux / 1000.0 * 3000.0 / 2.5


def geothermal_mw(heat_flux: Column, area_km2: Column, surface: Column) -> Column:
    hot, cold = reservoir_temperature(surface, heat_flux) + 273.15, surface + 273.15
    carnot = F.when(hot > cold, 1.0 - cold / hot).otherwise(0.05)
    return heat_flux * 1e-3 * area_km2 * carnot * 0.12


# --- ecology


def habitat_quality(suitability: Column, degradation: Column, k: float = 0.5, z: float = 2.5) -> Column:
    dz = F.pow(degradation, F.lit(z))
    return F.when(degradation <= 0, 0.0).otherwise(suitability * (1.0 - dz / (dz + k**z)))


def shannon(share: Column) -> Column:
    """One class's part of the Shannon index."""
    return F.when(share > 0, -share * F.ln(share)).otherwise(0.0)


# --- farming

CROPS = {"wheat": (0.5, 1.8, 0.45, 0.85), "maize": (0.6, 2.5, 0.5, 1.0), "rice": (0.45, 1.9, 0.5, 1.1)}


def leaf_area(ndvi: Column, k: Column) -> Column:
    return F.when((ndvi > 0) & (ndvi < 1) & (k > 0), -F.ln(1.0 - ndvi) / k).otherwise(0.0)


def absorbed_share(lai: Column) -> Column:
    return F.when(lai <= 0, 0.0).otherwise(clamp(0.95 * (1.0 - F.exp(-0.6 * lai)), 0.0, 0.95))


def daily_npp(par: Column, ndvi: Column, crop: Column) -> Column:
    k, lue = choose(crop, {c: v[0] for c, v in CROPS.items()}, 0.5), choose(crop, {c: v[1] for c, v in CROPS.items()}, 1.8)
    return par * absorbed_share(leaf_area(ndvi, k)) * lue


def soil_class(organic: Column, ph: Column) -> Column:
    good, fit = organic >= 2.0, ph.between(5.5, 8.0)
    return F.when(good & fit, "good").when(good | fit, "fair").otherwise("poor")


def reference_et(tmax: Column, tmin: Column, latitude_rad: Column, month: Column) -> Column:
    """Hargreaves, from temperatures and extraterrestrial radiation."""
    day = month * 30.4 - 15.0
    decl = 0.4093 * F.sin(2 * pi * day / 365.0 - 1.39)
    sunset = F.acos(clamp(-F.tan(latitude_rad) * F.tan(decl), -1, 1))
    ra = 0.0820 * (1.0 + 0.033 * F.cos(2 * pi * day / 365.0)) * (sunset * F.sin(latitude_rad) * F.sin(decl) + F.cos(latitude_rad) * F.cos(decl) * F.sin(sunset)) * 11.574
    return F.greatest(F.lit(0.0), 0.0023 * ra * ((tmax + tmin) / 2.0 + 17.8) * F.sqrt(F.abs(tmax - tmin)))


def irrigation_mm(et0: Column, crop: Column, rain: Column) -> Column:
    return F.greatest(F.lit(0.0), et0 * choose(crop, {c: v[3] for c, v in CROPS.items()}, 0.85) - 0.8 * rain)


def erosion_class(loss: Column) -> Column:
    return steps(loss, [(2, "very_low"), (5, "low"), (10, "moderate"), (20, "high"), (50, "very_high")], "severe")


def soil_carbon_after(initial: Column, supply: Column, decay: Column, years: float = 20.0) -> Column:
    level = F.when(decay > 0, supply / F.when(decay > 0, decay).otherwise(1.0)).otherwise(initial)
    return level + (initial - level) * F.exp(-decay * years)


# --- cities


def floor_area_ratio(floor: Column, site: Column) -> Column:
    return F.when(site > 0, floor / site).otherwise(0.0)


def walking_minutes(metres: Column, kmh: float = 5.0) -> Column:
    return metres / 1000.0 / kmh * 60.0


def pipe_capacity_m3s(diameter: Column, slope: Column, manning: Column) -> Column:
    """A full round pipe by Manning."""
    area = pi * diameter * diameter / 4.0
    return F.when((diameter > 0) & (slope > 0) & (manning > 0), area * F.pow(diameter / 4.0, F.lit(2 / 3)) * F.sqrt(slope) / manning).otherwise(0.0)


# --- people


def dasymetric(total: Column, weight: Column, weights: Column) -> Column:
    return F.when(weights > 0, total * weight / weights).otherwise(0.0)


def wealth(night: Column, night_max: Column, built: Column, built_max: Column, road: Column, road_max: Column) -> Column:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return 100.0 * (0.5 * share(night, night_max) + 0.3 * share(built, built_max) + 0.2 * share(road, road_max))


def market_pull(people: Column, time: Column, decay: float) -> Column:
    """One place's part of the market potential; a place without travel time counts tenfold."""
    return F.when(time > 0, people / F.pow(time, F.lit(decay))).otherwise(10.0 * people)


# --- images


def radiance(dn: Column, gain: Column, bias: Column) -> Column:
    return gain * dn + bias


def reflectance(rad: Column, sun_elevation_deg: float, sun_distance: float, irradiance: float = 1536.0) -> Column:
    from math import radians, sin

    return rad * (pi * sun_distance * sun_distance / (irradiance * sin(radians(sun_elevation_deg))))


def los_displacement_mm(phase: Column, wavelength_cm: float) -> Column:
    return phase * (wavelength_cm * 10.0 / (4 * pi))


def wrapped(phase: Column) -> Column:
    """Into (-pi, pi]."""
    return phase - 2 * pi * F.ceil((phase - pi) / (2 * pi))


