"""Hydrology and groundwater formulas on columns."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import choose, clamp

# fixed values: curve numbers for soil groups A to D
CURVE_NUMBERS = {"forest": (30, 55, 70, 77), "grassland": (39, 61, 74, 80), "cropland": (67, 78, 85, 89), "built_up": (89, 92, 94, 95), "wetland": (85, 85, 85, 85)}


def curve_number(landuse: Column, soil_group: Column) -> Column:
    table = F.lit(None).cast("double")
    for use, values in CURVE_NUMBERS.items():
        table = F.when(landuse == use, choose(soil_group, dict(zip("ABCD", map(float, values))), None)).otherwise(table)
    return table


def wetness_adjusted(cn: Column, wetness: Column) -> Column:
    """A curve number for dry or wet antecedent moisture."""
    return clamp(F.when(wetness == "dry", cn / (2.3 - 0.013 * cn)).when(wetness == "wet", cn / (0.43 + 0.0057 * cn)).otherwise(cn), 0, 100)


def retention(cn: Column) -> Column:
    """Potential retention in mm; null (without bound) for a curve number of 0."""
    return F.when(cn >= 100, 0.0).when(cn > 0, 25400.0 / cn - 254.0)


def runoff_mm(rain: Column, cn: Column, initial: float = 0.2) -> Column:
    s = retention(cn)
    over = rain - F.greatest(F.lit(0.0), initial * s)
    return F.when(s.isNull() | (over <= 0) | (over + s <= 0), 0.0).otherwise(over * over / (over + s))


def sheet_flow_hours(length: Column, slope_pct: Column, manning: Column, rain_2yr: Column) -> Column:
    below = F.sqrt(rain_2yr) * F.pow(slope_pct / 100.0, F.lit(0.4))
    return F.when(below < 1e-10, 999.0).otherwise(0.007 * F.pow(manning * length, F.lit(0.8)) / below)


def shallow_flow_minutes(length: Column, slope_pct: Column, paved: Column) -> Column:
    v = F.when(paved, 6.1961).otherwise(4.9178) * F.sqrt(slope_pct / 100.0)
    return F.when(v < 1e-10, 999.0).otherwise(length / (60.0 * v))


def manning_velocity(slope: Column, area: Column, wetted: Column, manning: Column) -> Column:
    return F.pow(area / wetted, F.lit(2 / 3)) * F.sqrt(slope) / manning


def unit_peak(tc_hours: Column, storm: Column) -> Column:
    """Unit peak discharge by storm type I, II or III."""
    lt = F.ln(tc_hours)
    short = tc_hours <= 0.1
    ii = F.when(short, 68.0).otherwise(F.exp(2.535 - 0.686 * lt - 0.333 * lt * lt))
    i = F.when(short, 60.0).otherwise(20.0 / F.pow(tc_hours, F.lit(0.8)))
    iii = F.when(short, 72.0).otherwise(24.0 / F.pow(tc_hours, F.lit(0.75)))
    return F.when(storm == "I", i).when(storm == "III", iii).otherwise(ii)


def graphical_peak(runoff: Column, area_km2: Column, tc_hours: Column, storm: Column) -> Column:
    """Unit peak x area in square miles x runoff in cm (as the method's published code has it)."""
    return unit_peak(tc_hours, storm) * (area_km2 * 0.386102) * (runoff / 10.0)


def budyko_yield(rain: Column, pet: Column, awc: Column, z: float = 5.0) -> Column:
    """Annual water yield in mm with the Fu form of the Budyko curve."""
    omega = F.greatest(F.lit(1.0), z * awc / rain + 1.25)
    phi = pet / rain
    aet = F.when(phi <= 0, 0.0).otherwise(1.0 + phi - F.pow(1.0 + F.pow(phi, omega), 1.0 / omega))
    return F.when(rain <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (1.0 - clamp(aet, 0, 1)) * rain))


def rational_peak(c: Column, intensity: Column, area_ha: Column) -> Column:
    return F.least(F.lit(1e6), c * intensity * area_ha / 3.6)


def mixed_runoff_coefficient(impervious: Column, grass: Column, forest: Column) -> Column:
    return 0.9 * impervious + 0.25 * grass + 0.15 * forest


def ponding_area_m2(area_ha: Column, rain_mm: Column, safety: float = 1.2, depth: float = 0.3) -> Column:
    return F.least(area_ha * 10000.0, area_ha * 10000.0 * rain_mm / 1000.0 * safety / (depth * 1000.0))


def darcy(k: Column, head: Column, length: Column, area: Column) -> Column:
    """Discharge through a section."""
    return k * head / length * area


def well_function(u: Column, terms: int = 40) -> Column:
    """The exponential integral of Theis: its series (with factorials) below 1, a rational fit above."""
    total = F.lit(-0.5772156649015329) - F.ln(u)
    factor = 1.0
    for n in range(1, terms // 2 + 1):
        factor *= n
        total = total + ((-1.0) ** (n + 1) / (n * factor)) * F.pow(u, F.lit(float(n)))
    top = u * u + 2.334733 * u + 0.250621
    low = u * u + 3.330657 * u + 1.681534
    return F.when(u <= 0, None).when(u <= 1, total).otherwise(F.exp(-u) / u * top / low)


def theis_drawdown(t_day: Column, r_m: Column, transmissivity: Column, storativity: Column, rate: Column) -> Column:
    u = r_m * r_m * storativity / (4.0 * transmissivity * t_day)
    return F.when((t_day > 0) & (transmissivity > 0), rate / (4 * pi * transmissivity) * well_function(u)).otherwise(0.0)


def recharge_mm(rain: Column, et: Column, runoff_share: Column) -> Column:
    return F.greatest(F.lit(0.0), rain - et - rain * runoff_share)


def chloride_recharge_mm(rain: Column, cl_rain: Column, cl_ground: Column) -> Column:
    return F.when(cl_ground > 0, rain * cl_rain / cl_ground).otherwise(0.0)


def straight_line_transmissivity(rate: float, slope: Column) -> Column:
    """Cooper and Jacob: 2.3 / (4 pi) of the rate by the drawdown of a log cycle."""
    return 0.183 * rate / slope


def scs_recharge_m3(rain_m: Column, cn: Column, share: Column, area_m2: Column) -> Column:
    return (rain_m * 1000.0 - runoff_mm(rain_m * 1000.0, cn)) / 1000.0 * share * area_m2


def stream_exchange_m3s(aquifer_head: Column, stage: Column, k: Column, thickness: Column, bed_area: Column) -> Column:
    return k * (aquifer_head - stage) / thickness * bed_area


def scs_peak_m3s(area_km2: Column, tc_hours: Column, rain_excess_mm: Column, dt: float) -> Column:
    """Peak of the triangular unit hydrograph."""
    return 0.208 * area_km2 * rain_excess_mm / (dt / 2.0 + 0.6 * tc_hours)


def soil_loss(r: Column, k: Column, ls: Column, c: Column, p: Column) -> Column:
    return r * k * ls * c * p


def rain_erosivity(annual_mm: Column) -> Column:
    return F.when(annual_mm > 0, 0.0483 * F.pow(annual_mm, F.lit(1.61))).otherwise(0.0)


def fournier_erosivity(index: Column) -> Column:
    return F.greatest(F.lit(0.0), F.when(index < 55, 0.7397 * F.pow(index, F.lit(1.847))).otherwise(95.77 - 6.081 * index + 0.477 * index * index))


def epic_erodibility(sand: Column, silt: Column, clay: Column, organic: Column) -> Column:
    carbon = organic * 0.58
    rest = 1.0 - sand / 100.0
    texture = 0.2 + 0.3 * F.exp(-0.0256 * sand * (1.0 - silt / 100.0))
    mix = F.pow(silt / (clay + silt), F.lit(0.3))
    humus = 1.0 - 0.25 * carbon / (carbon + F.exp(3.72 - 2.95 * carbon))
    coarse = 1.0 - 0.7 * rest / (rest + F.exp(-5.51 + 22.9 * rest))
    return clamp(0.1317 * texture * mix * humus * coarse, 0.0, 0.7)


def slope_length_factor(slope_deg: Column, length_m: float) -> Column:
    pct = F.tan(F.radians(slope_deg)) * 100.0
    s = F.sin(F.radians(slope_deg))
    m = F.when(pct < 1, 0.2).when(pct < 3, 0.3).when(pct < 5, 0.4).otherwise(0.5)
    steep = F.when(pct < 9, 10.8 * s + 0.03).otherwise(16.8 * s - 0.5)
    return F.when(pct <= 0, 0.0).otherwise(F.pow(F.lit(length_m / 22.13), m) * steep)


def storm_sediment(runoff_m3: Column, peak_m3s: Column, k: Column, ls: Column, c: Column, p: Column) -> Column:
    """Tonnes of one storm by the modified equation."""
    return 11.8 * F.pow(runoff_m3 * peak_m3s, F.lit(0.56)) * k * ls * c * p


