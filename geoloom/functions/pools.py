"""Carbon pools, gases, and the climate of a month on columns."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import choose, clamp

CO2_PER_C = 44.0 / 12.0

# fixed values: wood density, expansion factor, carbon fraction, root, deadwood and litter ratios, litter turnover, deadwood decay
BIOMASS = {
    "tropical_moist": (0.60, 2.2, 0.47, 0.27, 0.12, 0.04, 0.6, 0.10),
    "temperate_coniferous": (0.45, 1.5, 0.47, 0.26, 0.18, 0.06, 0.4, 0.05),
    "temperate_broadleaf": (0.58, 2.0, 0.47, 0.24, 0.15, 0.05, 0.5, 0.07),
    "boreal": (0.40, 1.3, 0.47, 0.29, 0.25, 0.08, 0.3, 0.03),
}
# fixed values: land use, management and input factors of soil carbon
SOIL = {"native_forest": (1.0, 1.0, 1.0), "degraded_cropland": (0.80, 1.0, 0.95), "afforestation_cropland": (1.0, 1.0, 1.0), "deforestation_cropland": (0.80, 0.95, 0.92)}
# fixed values: per cent of uncertainty by pool
POOL_UNCERTAINTY = {"AGB": 30.0, "BGB": 30.0, "DW": 90.0, "LT": 60.0, "SOC": 50.0}
# fixed values: warming over 100 years, by assessment report
GWP = {
    "AR4": {"CO2": 1.0, "CH4": 25.0, "N2O": 298.0, "HFCs": 1600.0, "PFCs": 8300.0, "SF6": 22800.0, "NF3": 17200.0},
    "AR5": {"CO2": 1.0, "CH4": 28.0, "N2O": 265.0, "HFCs": 1400.0, "PFCs": 7400.0, "SF6": 23500.0, "NF3": 16100.0},
    "AR6": {"CO2": 1.0, "CH4": 27.0, "N2O": 273.0, "HFCs": 1500.0, "PFCs": 7800.0, "SF6": 24300.0, "NF3": 17400.0},
}
# fixed values: tonnes of carbon dioxide a megawatt hour
GRID_FACTOR = {"north": 0.7204, "cn-north": 0.7204, "east": 0.5850, "cn-east": 0.5850, "south": 0.3907, "cn-south": 0.3907}
GRID_DEFAULT = 0.5703


def biomass_param(zone: Column, i: int) -> Column:
    return choose(zone, {k: v[i] for k, v in BIOMASS.items()}, None)


def above_ground(zone: Column, stem_m3_ha: Column) -> Column:
    """Tonnes of carbon dioxide a hectare above ground."""
    return stem_m3_ha * biomass_param(zone, 0) * biomass_param(zone, 1) * biomass_param(zone, 2) * CO2_PER_C


def soil_carbon(use: Column, reference_tc: Column) -> Column:
    product = {k: v[0] * v[1] * v[2] for k, v in SOIL.items()}
    return reference_tc * choose(use, product, None) * CO2_PER_C


def pool_stocks(zone: Column, use: Column, stem_m3_ha: Column, reference_tc: Column) -> dict[str, Column]:
    """Tonnes of carbon dioxide a hectare in each of five pools."""
    above = above_ground(zone, stem_m3_ha)
    return {"AGB": above, "BGB": above * biomass_param(zone, 3), "DW": above * biomass_param(zone, 4), "LT": above * biomass_param(zone, 5), "SOC": soil_carbon(use, reference_tc)}


def decayed(stock: Column, input_yr: Column, rate: Column, years: Column) -> Column:
    """A pool after years of decay at a rate, with a yearly input (deadwood, litter)."""
    left = F.exp(-rate * years)
    return stock * left + input_yr * (1.0 - left) / rate


def soil_transition(start: Column, target: Column, rate: Column, years: Column) -> Column:
    return target - (target - start) * F.exp(-rate * years)


def gwp100(gas: Column, report: str = "AR6") -> Column:
    return choose(gas, GWP[report], None)


def gas_tco2e(kg: Column, gas: Column, report: str = "AR6") -> Column:
    return kg * gwp100(gas, report) / 1000.0


def grid_factor(region: Column) -> Column:
    return choose(F.lower(region), GRID_FACTOR, GRID_DEFAULT)


# --- climate

# fixed values: declination of the sun in the middle of each month
DECLINATION = (-23.4, -17.1, -7.9, 4.8, 14.5, 21.9, 23.4, 18.5, 8.9, -2.0, -12.8, -21.7)
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def daylight_term(lat: Column, month: Column) -> Column:
    """48 / pi times the sunset angle; twice the day length, as potential evaporation below takes it.  Months count from 0."""
    declination = choose(F.pmod(month, F.lit(12)), dict(enumerate(DECLINATION)), 0.0)
    angle = F.acos(clamp(-F.tan(F.radians(lat)) * F.tan(F.radians(declination)), -1.0, 1.0))
    return F.lit(24.0 / pi) * angle * 2.0


def day_length(lat: Column, month: Column) -> Column:
    """Hours between sunrise and sunset."""
    return daylight_term(lat, month) / 2.0


def thornthwaite(temp: Column, lat: Column, month: Column) -> Column:
    """Potential evaporation in mm a month, from the month's temperature alone; 0 in frost."""
    heat = 12.0 * F.pow(temp / 5.0, F.lit(1.514))
    power = 6.75e-7 * heat * heat * heat - 7.71e-5 * heat * heat + 1.79e-2 * heat + 0.49
    days = choose(F.least(month, F.lit(11)), {i: float(d) for i, d in enumerate(MONTH_DAYS)}, 30.0)
    wet = 16.0 * F.pow(10.0 * temp / F.greatest(heat, F.lit(1.0)), power) * (daylight_term(lat, month) / 12.0) * (days / 30.0)
    return F.when(temp <= 0, 0.0).otherwise(wet)


def delta_shift(observed: Column, past: Column, future: Column) -> Column:
    """Observed values moved by the model's change (temperature)."""
    return observed + (future - past)


def delta_scale(observed: Column, past: Column, future: Column) -> Column:
    """Observed values scaled by the model's change (rain); unchanged where the past has none."""
    return observed * F.when(past != 0, future / past).otherwise(1.0)


def rain_intensity(minutes: Column, a: float, b: float, c: float) -> Column:
    """mm an hour by duration: a / (t + b)^c."""
    return F.lit(a) / F.pow(minutes + b, F.lit(c))


def rain_depth(minutes: Column, a: float, b: float, c: float) -> Column:
    return rain_intensity(minutes, a, b, c) * minutes / 60.0


def return_period_scale(base: Column, target: Column, x: float, y: float) -> Column:
    """What a curve's `a` is multiplied by for another return period."""
    return (x + y * F.log(target)) / (x + y * F.log(base))
