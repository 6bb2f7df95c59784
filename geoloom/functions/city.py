"""Buildings, services, drainage, solar power and corridors on columns."""

from __future__ import annotations

from math import pi, radians, tan

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import choose, clamp, steps


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for no whole (floor area ratio, building density, green ratio, green per head)."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def average_height(far: Column, coverage: Column, floor_m: float = 3.0) -> Column:
    return F.when(coverage > 0, F.greatest(far / coverage * floor_m, F.lit(0.0))).otherwise(0.0)


def land_use(ndvi: Column, impervious: Column, water: float = 0.0, green: float = 0.2, low: float = 0.4, medium: float = 0.7) -> Column:
    """Land use from greenness and the sealed share, either of which may be null."""
    sealed = F.when(impervious <= green, "green_space").when(impervious <= low, "low_urban").when(impervious <= medium, "medium_urban").when(impervious.isNotNull(), "high_urban")
    return F.when(ndvi <= water, "water").when(impervious.isNotNull(), sealed).when(ndvi > 0.3, "green_space").otherwise("bare_soil")


def shadow_m(height: Column, sun_deg: float) -> Column:
    """Length of a shadow at an altitude of the sun."""
    return height / tan(radians(sun_deg))


def heat_island(impervious: Column, density: Column, green: Column, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> Column:
    return weights[0] * impervious + weights[1] * density + weights[2] * (1.0 - green)


def heat_island_risk(index: Column, high: float = 0.7, medium: float = 0.4) -> Column:
    return F.when(index >= high, "high").when(index >= medium, "medium").otherwise("low")


def roughness_length(height: Column, density: Column) -> Column:
    return 0.1 * height * F.least(density, F.lit(0.6))


def ventilation(height: Column, density: Column) -> Column:
    """From 1 (open) to 0 (densest) by the roughness length."""
    worst = 0.06 * height
    return F.when(worst > 0, clamp(1.0 - roughness_length(height, density) / worst, 0.0, 1.0)).otherwise(1.0)


def ventilation_quality(index: Column) -> Column:
    return F.when(index >= 0.7, "good").when(index >= 0.4, "fair").otherwise("poor")


def access_score(population: Column, green_ha: Column, stops: Column, schools: Column, hospitals: Column, shops: Column, area_km2: Column) -> Column:
    """Mean of five scores from 0 to 100, rounded half up: green space a head and four services a square kilometre."""
    scores = [ratio(green_ha * 10000.0, population) / 9.0, ratio(stops, area_km2) / 0.5, ratio(schools, area_km2) / 0.2, ratio(hospitals, area_km2) / 0.02, ratio(shops, area_km2) / 0.5]
    total = F.lit(0.0)
    for s in scores:
        total = total + F.least(s * 100.0, F.lit(100.0))
    return F.floor(total / 5.0 + 0.5)


def access_grade(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 60, "B").when(score >= 40, "C").when(score >= 20, "D").otherwise("F")


# fixed values: people a facility of each kind serves
PEOPLE_PER_FACILITY = {"school": 5000.0, "schools": 5000.0, "hospital": 50000.0, "hospitals": 50000.0, "grocery": 10000.0, "supermarket": 10000.0, "shop": 10000.0, "park": 5000.0, "parks": 5000.0, "green_space": 5000.0}


def facilities_needed(people_km2: Column, area_km2: Column, kind: Column) -> Column:
    return F.ceil(people_km2 * area_km2 / choose(F.lower(kind), PEOPLE_PER_FACILITY, 10000.0))


def facility_gap(people_km2: Column, area_km2: Column, kind: Column, existing: Column) -> Column:
    return F.greatest(facilities_needed(people_km2, area_km2, kind) - existing, F.lit(0))


# --- drainage


def inlet_capacity(kind: Column, grate_m2: Column, clogging: Column, head_m: float = 0.15) -> Column:
    coefficient = choose(F.lower(kind), {"curb_opening": 0.6, "grate": 0.5, "combination": 0.55}, 0.45)
    return F.greatest(coefficient * grate_m2 * (2.0 * 9.81 * head_m) ** 0.5 * (1.0 - clogging), F.lit(0.0))


def flood_depth_mm(runoff_m3: Column, capacity_m3s: Column, area_ha: Column, hours: Column) -> Column:
    """Depth of what the drains do not take."""
    excess = F.greatest(runoff_m3 - capacity_m3s * hours * 3600.0, F.lit(0.0))
    return F.when(area_ha > 0, excess / (area_ha * 10000.0) * 1000.0).otherwise(0.0)


def flood_risk(depth_mm: Column) -> Column:
    return steps(depth_mm, [(50.0, "Low"), (150.0, "Moderate"), (300.0, "High")], "Severe")


def drainage_use_pct(major_m3s: Column, minor_m3s: Column, runoff_m3: Column) -> Column:
    """Share of an hour's capacity of both systems, 100 at most."""
    volume = (major_m3s + minor_m3s) * 3600.0
    return F.when(volume > 1e-10, F.least(runoff_m3 / volume * 100.0, F.lit(100.0))).otherwise(100.0)


def drainage_status(major_m3s: Column, minor_m3s: Column, runoff_m3: Column) -> Column:
    excess = F.greatest(runoff_m3 - (major_m3s + minor_m3s) * 3600.0, F.lit(0.0))
    return F.when(excess <= 0, "adequate").when(excess < runoff_m3 * 0.3, "minor_exceedance").otherwise("major_exceedance")


# --- photovoltaics

# fixed values: heat loss of a module, constant and by wind, by mounting
MOUNTING = {"open_rack": (25.0, 6.84), "roof_mount": (25.0, 1.0), "insulated": (25.0, 0.0)}
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def cell_temperature(irradiance: Column, air: Column, wind: Column, mounting: str = "open_rack") -> Column:
    fixed, by_wind = MOUNTING.get(mounting, MOUNTING["open_rack"])
    return air + irradiance / (fixed + by_wind * wind)


def dc_power(irradiance: Column, capacity_kw: Column, cell: Column, percent_per_degree: float = -0.4) -> Column:
    return F.when(irradiance <= 0, 0.0).otherwise(irradiance / 1000.0 * capacity_kw * (1.0 + percent_per_degree / 100.0 * (cell - 25.0)))


def system_loss(*percents: float) -> float:
    """Losses one after the other, as a share."""
    left = 1.0
    for p in percents:
        left *= 1.0 - p / 100.0
    return 1.0 - left


def ac_energy_kwh(irradiance: Column, capacity_kw: Column, air: Column, wind: Column, hours: Column, inverter: float = 0.96, dc_ac: float = 1.2, loss_pct: float = 14.0, mounting: str = "open_rack") -> Column:
    """Energy over so many hours, cut at the inverter's size."""
    power = dc_power(irradiance, capacity_kw, cell_temperature(irradiance, air, wind, mounting)) * inverter
    return F.least(power, capacity_kw / dc_ac) * hours * (1.0 - loss_pct / 100.0)


def performance_ratio(annual_kwh: Column, capacity_kw: Column, poa_kwh_m2: Column) -> Column:
    return F.when((capacity_kw > 0) & (poa_kwh_m2 > 0), annual_kwh / capacity_kw / poa_kwh_m2).otherwise(0.0)


# --- corridors

# fixed values: cost of building through a land use class
LAND_USE_COST = {0: 10.0, 1: 15.0, 2: 20.0, 3: 25.0, 4: 60.0, 5: 90.0, 6: 100.0}


def land_use_cost(kind: Column) -> Column:
    return choose(kind, LAND_USE_COST, 50.0)


def slope_cost(degrees: Column) -> Column:
    return F.when(degrees < 5, 5.0).when(degrees < 10, degrees * 1.5).when(degrees < 20, degrees * 2.0).when(degrees < 30, degrees * 3.0).otherwise(100.0)


def proximity_cost(distance_m: Column, threshold_m: float) -> Column:
    return F.when(distance_m >= threshold_m, 0.0).otherwise((1.0 - distance_m / threshold_m) * 100.0)


# --- ecosystem services


def water_yield_m3(rain_mm: Column, loss_mm: Column, area_ha: Column) -> Column:
    return F.greatest(rain_mm - loss_mm, F.lit(0.0)) * area_ha * 10.0


def pipe_area(diameter: Column) -> Column:
    return pi / 4.0 * diameter * diameter
