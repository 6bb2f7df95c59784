"""Domain formulas as queries: each a projection of column expressions over a derived table."""

from __future__ import annotations

from collections.abc import Callable
from math import log10

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hazard, land, water
from ..functions.base import c, rounded
from ..operators import raster, stats
from . import fixtures as fx
from .catalog import query, r

#: A row of inputs for each part: keys of the raster with numbers in useful ranges, in SQL and as columns.
INPUTS = {
    "rain": ("10 + CAST(k * 37 % 200 AS DOUBLE)", lambda k: 10.0 + (k * 37 % 200).cast("double")),
    "cn": ("40 + CAST(k * 13 % 59 AS DOUBLE)", lambda k: 40.0 + (k * 13 % 59).cast("double")),
    "area": ("1 + CAST(k * 7 % 50 AS DOUBLE) / 2", lambda k: 1.0 + (k * 7 % 50).cast("double") / 2),
    "slope": ("1 + CAST(k * 11 % 430 AS DOUBLE) / 10", lambda k: 1.0 + (k * 11 % 430).cast("double") / 10),
    "aspect": ("CAST(k * 17 % 360 AS DOUBLE)", lambda k: (k * 17 % 360).cast("double")),
    "unit": ("CAST(k * 29 % 101 AS DOUBLE) / 100", lambda k: (k * 29 % 101).cast("double") / 100),
    "ndvi": ("CAST(k * 31 % 97 AS DOUBLE) / 100", lambda k: (k * 31 % 97).cast("double") / 100),
    "wind": ("1 + CAST(k * 19 % 290 AS DOUBLE) / 10", lambda k: 1.0 + (k * 19 % 290).cast("double") / 10),
    "km": ("1 + CAST(k * 23 % 300 AS DOUBLE)", lambda k: 1.0 + (k * 23 % 300).cast("double")),
    "mag": ("4 + CAST(k * 3 % 40 AS DOUBLE) / 10", lambda k: 4.0 + (k * 3 % 40).cast("double") / 10),
    "pm": ("CAST(k * 41 % 4000 AS DOUBLE) / 10", lambda k: (k * 41 % 4000).cast("double") / 10),
    "temp": ("CAST(k * 43 % 500 AS DOUBLE) / 10 - 10", lambda k: (k * 43 % 500).cast("double") / 10 - 10),
    "hours": ("0.05 + CAST(k * 5 % 60 AS DOUBLE) / 10", lambda k: 0.05 + (k * 5 % 60).cast("double") / 10),
}
FROM = "FROM (SELECT p_partkey AS id, k, " + ", ".join(f"{sql} AS {n}" for n, (sql, _) in INPUTS.items()) + ", SUBSTR('ABCDEF', CAST(1 + k % 6 AS INTEGER), 1) AS stability, CASE k % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'III' END AS site, CASE k % 3 WHEN 0 THEN 'dry' WHEN 1 THEN 'normal' ELSE 'wet' END AS wetness, CASE k % 4 WHEN 0 THEN 'wheat' WHEN 1 THEN 'maize' WHEN 2 THEN 'rice' ELSE 'other' END AS crop, CAST(2000 + k % 130 AS INTEGER) AS year, CASE k % 5 WHEN 0 THEN 'SSP1-1.9' WHEN 1 THEN 'SSP1-2.6' WHEN 2 THEN 'SSP2-4.5' WHEN 3 THEN 'SSP3-7.0' ELSE 'SSP5-8.5' END AS scenario FROM (SELECT p_partkey, p_partkey + 1 AS k FROM part))"


def inputs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") + 1
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
    return fx.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), k.alias("k"), *[f(k).alias(n) for n, (_, f) in INPUTS.items()],
        pick(6, *"ABCDEF").alias("stability"), pick(3, "I", "II", "III").alias("site"), pick(3, "dry", "normal", "wet").alias("wetness"), pick(4, "wheat", "maize", "rice", "other").alias("crop"),
        (k % 130 + 2000).cast("int").alias("year"), pick(5, "SSP1-1.9", "SSP1-2.6", "SSP2-4.5", "SSP3-7.0", "SSP5-8.5").alias("scenario"),
    )


def formulas(name: str, doc: str, items: dict[str, tuple[Callable[[], Column], str | None]], digits: int = 6) -> None:
    """A query of id and formulas; text results are compared as they are, numbers rounded."""
    sql = "SELECT id, " + ", ".join(f"{s if s and s.startswith('CASE') and n.endswith('_class') else r(s, digits)} AS {n}" for n, (_, s) in items.items() if s) + f" {FROM}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        cols = [f().alias(n) if n.endswith("_class") else rounded(f().cast("double"), digits).alias(n) for n, (f, _) in items.items()]
        return inputs(spark, d).select("id", *cols)

    run.__doc__ = doc
    query(name, sql if all(s for _, s in items.values()) else None)(run)


col = F.col
CNA = "LEAST(100, GREATEST(0, CASE wetness WHEN 'dry' THEN cn / (2.3 - 0.013 * cn) WHEN 'wet' THEN cn / (0.43 + 0.0057 * cn) ELSE cn END))"
S = "(25400 / cn - 254)"
formulas("scs_runoff", "Curve-number runoff.", {
    "cn_wet": (lambda: water.wetness_adjusted(col("cn"), col("wetness")), CNA),
    "retention": (lambda: water.retention(col("cn")), S),
    "runoff": (lambda: water.runoff_mm(col("rain"), col("cn")), f"CASE WHEN rain <= 0.2 * {S} THEN 0 ELSE POW(rain - 0.2 * {S}, 2) / (rain + 0.8 * {S}) END"),
})
UP = "CASE site WHEN 'I' THEN CASE WHEN hours <= 0.1 THEN 60 ELSE 20 / POW(hours, 0.8) END WHEN 'III' THEN CASE WHEN hours <= 0.1 THEN 72 ELSE 24 / POW(hours, 0.75) END ELSE CASE WHEN hours <= 0.1 THEN 68 ELSE EXP(2.535 - 0.686 * LN(hours) - 0.333 * LN(hours) * LN(hours)) END END"
formulas("storm_peaks", "Peak flow by the graphical and the rational method, ponding, flow times.", {
    "unit_peak": (lambda: water.unit_peak(col("hours"), col("site")), UP),
    "graphical": (lambda: water.graphical_peak(col("rain"), col("area"), col("hours"), col("site")), f"({UP}) * area * 0.386102 * rain / 10"),
    "rational": (lambda: water.rational_peak(col("unit"), col("rain"), col("area")), "LEAST(1e6, unit * rain * area / 3.6)"),
    "ponding": (lambda: water.ponding_area_m2(col("area"), col("rain")), "LEAST(area * 10000, area * 10 * rain * 1.2 / 300)"),
    "sheet": (lambda: water.sheet_flow_hours(col("km"), col("slope"), c(0.1), col("rain")), "0.007 * POW(0.1 * km, 0.8) / (SQRT(rain) * POW(slope / 100, 0.4))"),
    "shallow": (lambda: water.shallow_flow_minutes(col("km"), col("slope"), F.lit(True)), "km / (60 * 6.1961 * SQRT(slope / 100))"),
    "triangle": (lambda: water.scs_peak_m3s(col("area"), col("hours"), col("rain"), 1.0), "0.208 * area * rain / (0.5 + 0.6 * hours)"),
    "mixed": (lambda: water.mixed_runoff_coefficient(col("unit"), c(0.3), c(0.1)), "0.9 * unit + 0.075 + 0.015"),
}, 4)
OM = "GREATEST(1, 5 * 80 / (rain * 10) + 1.25)"
PHI = "(900 / (rain * 10))"
formulas("water_yield", "Budyko water yield.", {
    "yield_mm": (lambda: water.budyko_yield(col("rain") * 10.0, c(900.0), c(80.0)), f"GREATEST(0, (1 - LEAST(1, GREATEST(0, 1 + {PHI} - POW(1 + POW({PHI}, {OM}), 1 / {OM})))) * rain * 10)"),
}, 4)
formulas("groundwater", "Darcy flow, recharge, exchange with streams, Cooper and Jacob.", {
    "darcy": (lambda: water.darcy(c(0.001), col("slope"), col("km"), col("area")), "0.001 * slope / km * area"),
    "recharge": (lambda: water.recharge_mm(col("rain") * 5.0, c(300.0), col("unit")), "GREATEST(0, rain * 5 - 300 - rain * 5 * unit)"),
    "chloride": (lambda: water.chloride_recharge_mm(col("rain"), c(2.0), col("area")), "rain * 2 / area"),
    "exchange": (lambda: water.stream_exchange_m3s(col("rain"), c(50.0), c(0.0001), c(2.0), col("km")), "0.0001 * (rain - 50) / 2 * km"),
    "transmissivity": (lambda: water.straight_line_transmissivity(500.0, col("area")), "0.183 * 500 / area"),
})
U = "(POW(km, 2) * 0.0002 / (4 * 300 * (1 + hours)))"
W1 = "(-0.5772156649015329 - LN(u) + u - POW(u, 2) / 4 + POW(u, 3) / 18 - POW(u, 4) / 96 + POW(u, 5) / 600 - POW(u, 6) / 4320 + POW(u, 7) / 35280 - POW(u, 8) / 322560)"
formulas("theis", "Drawdown by Theis.", {"drawdown": (lambda: water.theis_drawdown(1.0 + col("hours"), col("km"), c(300.0), c(0.0002), c(800.0)), f"800 / (4 * PI() * 300) * {W1.replace('u', U)}")}, 5)
PCT = "(TAN(RADIANS(slope)) * 100)"
LS = f"POW(100 / 22.13, CASE WHEN {PCT} < 1 THEN 0.2 WHEN {PCT} < 3 THEN 0.3 WHEN {PCT} < 5 THEN 0.4 ELSE 0.5 END) * CASE WHEN {PCT} < 9 THEN 10.8 * SIN(RADIANS(slope)) + 0.03 ELSE 16.8 * SIN(RADIANS(slope)) - 0.5 END"
formulas("soil_loss", "Erosion factors and loss.", {
    "r": (lambda: water.rain_erosivity(col("rain") * 10.0), "0.0483 * POW(rain * 10, 1.61)"),
    "fournier": (lambda: water.fournier_erosivity(col("rain")), "GREATEST(0, CASE WHEN rain < 55 THEN 0.7397 * POW(rain, 1.847) ELSE 95.77 - 6.081 * rain + 0.477 * rain * rain END)"),
    "ls": (lambda: water.slope_length_factor(col("slope"), 100.0), LS),
    "loss": (lambda: water.soil_loss(c(300.0), c(0.03), water.slope_length_factor(col("slope"), 100.0), col("unit"), c(0.5)), f"300 * 0.03 * ({LS}) * unit * 0.5"),
    "loss_class": (lambda: land.erosion_class(col("slope")), "CASE WHEN slope < 2 THEN 'very_low' WHEN slope < 5 THEN 'low' WHEN slope < 10 THEN 'moderate' WHEN slope < 20 THEN 'high' WHEN slope < 50 THEN 'very_high' ELSE 'severe' END"),
    "storm": (lambda: water.storm_sediment(col("rain"), col("area"), c(0.03), c(1.2), col("unit"), c(1.0)), "11.8 * POW(rain * area, 0.56) * 0.03 * 1.2 * unit"),
}, 4)
formulas("erodibility", "Soil erodibility from texture.", {
    "k": (lambda: water.epic_erodibility(c(40.0), c(35.0), col("cn") / 4.0, c(2.0)), "LEAST(0.7, 0.1317 * (0.2 + 0.3 * EXP(-0.0256 * 40 * 0.65)) * POW(35 / (cn / 4 + 35), 0.3) * (1 - 0.25 * 1.16 / (1.16 + EXP(3.72 - 2.95 * 1.16))) * (1 - 0.7 * 0.6 / (0.6 + EXP(-5.51 + 22.9 * 0.6))))"),
})


def smooth(x: str, a: float, b: float) -> str:
    t = f"LEAST(1, GREATEST(0, ({x} - {float(a)}) / {float(b - a)}))"
    return f"({t} * {t} * (3 - 2 * {t}))"


SCORE = f"0.25 * {smooth('slope', 15, 35)} + 0.1 * (COS(RADIANS(aspect) - PI()) + 1) / 2 + 0.2 * unit + 0.2 * {smooth('rain', 100, 300)} + 0.1 * (1 - {smooth('(km * 5)', 200, 1000)}) + 0.15 * (1 - {smooth('ndvi', 0.2, 0.6)})"
formulas("landslide", "Susceptibility by weighted memberships.", {
    "score": (lambda: hazard.landslide_score(col("slope"), col("aspect"), col("unit"), col("rain"), col("km") * 5.0, col("ndvi")), SCORE),
    "level_class": (lambda: hazard.risk_level(col("unit")), "CASE WHEN unit <= 0.15 THEN 'very_low' WHEN unit <= 0.35 THEN 'low' WHEN unit <= 0.55 THEN 'moderate' WHEN unit <= 0.75 THEN 'high' ELSE 'very_high' END"),
})
FS = "((8 + (20 * 2 - unit * 9.81 * 2) * POW(COS(RADIANS(slope)), 2) * TAN(RADIANS(30))) / (20 * 2 * SIN(RADIANS(slope)) * COS(RADIANS(slope))))"
AC = f"(({FS} - 1) * SIN(RADIANS(slope)))"
formulas("slope_stability", "Factor of safety and Newmark displacement.", {
    "safety": (lambda: hazard.factor_of_safety(col("slope"), c(2.0), c(8.0), c(30.0), c(20.0), col("unit")), FS),
    "newmark": (lambda: hazard.newmark_cm(col("slope"), hazard.factor_of_safety(col("slope"), c(2.0), c(8.0), c(30.0), c(20.0), col("unit")), c(0.3)), f"CASE WHEN {AC} > 0 AND 0.3 > {AC} THEN POW(10, 2.401 * LOG10(0.3 / {AC}) - 0.603) ELSE 0 END"),
}, 4)
PGA = "LEAST(2, GREATEST(0.001, EXP(-2 + 0.8 * (mag - 6) - 1.5 * LN(GREATEST(5, km) / 30)) * CASE site WHEN 'III' THEN 1.35 ELSE 1 END))"
PGA = PGA.replace("CASE site WHEN 'III' THEN 1.35 ELSE 1 END", "CASE site WHEN 'III' THEN 1.35 WHEN 'II' THEN 1.0 ELSE 1.0 END")
formulas("ground_motion", "Acceleration, velocity, intensity and spectrum.", {
    "pga": (lambda: hazard.pga(col("mag"), col("km"), col("site")), PGA),
    "pgv": (lambda: hazard.pgv(col("unit"), col("site")), "120 * POW(unit, 0.6) * CASE site WHEN 'III' THEN 1.35 ELSE 1 END"),
    "intensity": (lambda: hazard.intensity(col("unit")), "CASE WHEN unit >= 0.4 THEN 12 WHEN unit >= 0.2 THEN 11 WHEN unit >= 0.1 THEN 10 WHEN unit >= 0.05 THEN 9 WHEN unit >= 0.025 THEN 8 WHEN unit >= 0.01 THEN 7 WHEN unit >= 0.005 THEN 6 ELSE 5 END"),
    "spectral": (lambda: hazard.spectral_acceleration(col("unit"), col("hours")), "LEAST(5, unit * CASE WHEN hours < 0.1 THEN 1 + 1.5 * hours / 0.1 WHEN hours <= 0.4 THEN 2.5 ELSE 1 / hours END)"),
    "poisson": (lambda: hazard.poisson_chance(col("unit"), c(5.0)), "1 - EXP(-unit * 5)"),
    "recurrence": (lambda: F.coalesce(hazard.recurrence_years(col("unit")), F.lit(-1.0)), "CASE WHEN unit > 0 THEN 1 / unit ELSE -1 END"),
})
SY = "(1000 * CASE stability WHEN 'A' THEN 0.22 WHEN 'B' THEN 0.16 WHEN 'C' THEN 0.11 WHEN 'D' THEN 0.08 WHEN 'E' THEN 0.06 ELSE 0.04 END * km / 10 / SQRT(1 + 0.0001 * km / 10))"
SZ = "(1000 * CASE stability WHEN 'A' THEN 0.2 WHEN 'B' THEN 0.12 WHEN 'C' THEN 0.08 / SQRT(1 + 0.0002 * km / 10) WHEN 'D' THEN 0.06 / SQRT(1 + 0.0015 * km / 10) WHEN 'E' THEN 0.03 / (1 + 0.0003 * km / 10) ELSE 0.016 / (1 + 0.0003 * km / 10) END * km / 10)"
formulas("plume", "Gaussian plume at the ground.", {
    "concentration": (lambda: hazard.plume_ug_m3(c(100.0), col("wind"), c(50.0), col("km") * 100.0, c(10.0), c(0.0), col("stability")), f"1e8 / (2 * PI() * wind * {SY} * {SZ}) * EXP(-100 / (2 * {SY} * {SY})) * 2 * EXP(-2500 / (2 * {SZ} * {SZ}))"),
}, 4)
formulas("air_quality", "Air quality index and aerosol to particles.", {
    "aqi": (lambda: hazard.pm25_aqi(col("pm")), "FLOOR(CASE WHEN pm <= 12 THEN pm / 12 * 50 WHEN pm <= 35.4 THEN 50 + (pm - 12) / (35.4 - 12) * 50 WHEN pm <= 55.4 THEN 100 + (pm - 35.4) / (55.4 - 35.4) * 50 WHEN pm <= 150.4 THEN 150 + (pm - 55.4) / (150.4 - 55.4) * 100 WHEN pm <= 250.4 THEN 200 + (pm - 150.4) / (250.4 - 150.4) * 100 ELSE 300 + LEAST(200, (pm - 250.4) / 250 * 200) END + 1e-9)"),
    "aqi_class": (lambda: hazard.aqi_class(col("pm")), "CASE WHEN pm <= 12 THEN 'good' WHEN pm <= 35.4 THEN 'moderate' WHEN pm <= 55.4 THEN 'sensitive' WHEN pm <= 150.4 THEN 'unhealthy' WHEN pm <= 250.4 THEN 'very_unhealthy' ELSE 'hazardous' END"),
    "aod": (lambda: hazard.pm25_from_aod(col("unit"), 60.0, 0.9, F.lit("winter")), "unit * 60 * 0.9 * 1.3"),
})
formulas("boundary_layer", "Mixing height, friction velocity, stability.", {
    "height": (lambda: hazard.boundary_layer_m(col("wind"), col("unit"), col("stability")), "LEAST(2500, GREATEST(50, CASE stability WHEN 'A' THEN 1400.0 WHEN 'B' THEN 1200 WHEN 'C' THEN 900 WHEN 'D' THEN 750 WHEN 'E' THEN 350 ELSE 150 END * CASE WHEN stability <= 'D' THEN 1 + 0.1 * GREATEST(0, wind - 3) / GREATEST(1, wind) ELSE 1 END * (1 + 0.2 * LEAST(1, unit / 0.1))))"),
    "friction": (lambda: hazard.friction_velocity(col("wind"), col("unit"), col("stability")), "0.4 * wind / GREATEST(0.1, LN(10 / GREATEST(0.001, unit)) - CASE WHEN stability <= 'B' THEN -2 WHEN stability <= 'D' THEN 0 ELSE 2 END)"),
    "richardson": (lambda: hazard.bulk_richardson(col("temp"), col("temp") + 2.0, c(10.0), col("wind")), "9.81 / (temp + 1 + 273.15) * 2 * 10 / (wind * wind + 0.01)"),
    "stability_class": (lambda: hazard.stability_class(col("unit") - 0.5), "CASE WHEN unit - 0.5 < -0.4 THEN 'A' WHEN unit - 0.5 < -0.2 THEN 'B' WHEN unit - 0.5 < -0.05 THEN 'C' WHEN unit - 0.5 < 0.05 THEN 'D' WHEN unit - 0.5 < 0.2 THEN 'E' ELSE 'F' END"),
}, 5)
VS = "(CASE WHEN pm <= 1 THEN 0 WHEN pm <= 10 THEN 1 WHEN pm <= 100 THEN 2 ELSE 3 END + CASE WHEN k % 7 = 0 THEN 4 ELSE 0 END + CASE WHEN km < 1 THEN 3 WHEN km < 5 THEN 2 WHEN km < 15 THEN 1 ELSE 0 END)"
formulas("volcanic_hazard", "Volcanic scores and settling of ash.", {
    "score": (lambda: hazard.volcanic_score(col("pm"), col("k") % 7 == 0, col("km")), VS),
    "level_class": (lambda: hazard.volcanic_level(hazard.volcanic_score(col("pm"), col("k") % 7 == 0, col("km"))), f"CASE WHEN {VS} < 1 THEN 'none' WHEN {VS} < 3 THEN 'low' WHEN {VS} < 5 THEN 'moderate' WHEN {VS} < 7 THEN 'high' ELSE 'extreme' END"),
    "settling": (lambda: hazard.settling_velocity(col("unit") * 1e-4, c(2500.0)), "(2500 - 1.2) * 9.81 * POW(unit * 1e-4, 2) / (18 * 1.8e-5)"),
})
CVI = "SQRT((1 + k % 5) * CASE WHEN temp < -2 THEN 5 WHEN temp < -1 THEN 4 WHEN temp <= 1 THEN 3 WHEN temp < 2 THEN 2 ELSE 1 END * CASE WHEN slope > 12 THEN 1 WHEN slope > 8 THEN 2 WHEN slope > 4 THEN 3 WHEN slope > 2 THEN 4 ELSE 5 END * CASE WHEN hours < 1.8 THEN 1 WHEN hours < 2.5 THEN 2 WHEN hours < 3 THEN 3 WHEN hours < 3.4 THEN 4 ELSE 5 END * CASE WHEN unit < 0.55 THEN 1 WHEN unit < 0.85 THEN 2 WHEN unit < 1.05 THEN 3 ELSE 4 END * CASE WHEN hours > 6 THEN 1 WHEN hours > 4 THEN 2 WHEN hours > 2 THEN 3 WHEN hours > 1 THEN 4 ELSE 5 END / 6.0)"


def _sea(points: list[tuple[int, float]]) -> str:
    (x0, y0), (x1, y1), (x2, y2) = points
    return f"CASE WHEN year <= {x0} THEN {y0} WHEN year <= {x1} THEN {y0} + (year - {x0}) * ({y1} - {y0}) / {x1 - x0}.0 ELSE {y1} + (year - {x1}) * ({y2} - {y1}) / {x2 - x1}.0 END"


formulas("coast", "Coastal vulnerability, sea level, recession.", {
    "cvi": (lambda: land.vulnerability(col("k") % 5 + 1, col("temp"), col("slope"), col("hours"), col("unit"), col("hours")), CVI),
    "sea_level": (lambda: land.sea_level(col("scenario"), col("year")), "CASE scenario " + " ".join(f"WHEN '{s}' THEN {_sea(p)}" for s, p in land.SEA_LEVEL.items()) + " END"),
    "recession": (lambda: land.recession_m(col("unit"), col("slope")), "unit / (slope / 100)"),
}, 5)
formulas("wind_energy", "Turbine power, shear, wake, density of air.", {
    "density": (lambda: land.air_density(col("km") * 10.0), "1.225 * EXP(-km * 10 / 8400)"),
    "power": (lambda: land.turbine_power_w(col("wind"), c(1.225)), "CASE WHEN wind < 4 OR wind >= 25 THEN 0 WHEN wind >= 15 THEN 2e6 ELSE LEAST(2e6, 0.5 * 1.225 * PI() * 1600 * 0.47 * POW(wind, 3)) END"),
    "log_wind": (lambda: land.shear_log(col("wind"), c(10.0), c(80.0), c(0.03)), "wind * LN(80 / 0.03) / LN(10 / 0.03)"),
    "power_wind": (lambda: land.shear_power(col("wind"), c(10.0), c(80.0), 0.14), "wind * POW(8, 0.14)"),
    "wake": (lambda: land.jensen_wind(col("wind"), c(0.8), c(40.0), col("km") * 10.0), "wind * (1 - (1 - SQRT(0.2)) * POW(40 / (40 + 0.075 * km * 10), 2))"),
}, 3)
TR = "(15 + cn * 2 / 1000 * 1200)"
formulas("geothermal", "Reservoir temperature and power.", {
    "reservoir": (lambda: land.reservoir_temperature(c(15.0), col("cn") * 2.0), TR),
    "power_mw": (lambda: land.geothermal_mw(col("cn") * 2.0, col("area"), c(15.0)), f"cn * 2e-3 * area * (1 - 288.15 / ({TR} + 273.15)) * 0.12"),
})
DECL = "(0.4093 * SIN(2 * PI() * 167.4 / 365 - 1.39))"  # the sun in June
SUNSET = f"ACOS(GREATEST(-1.0, LEAST(1.0, -TAN(0.6) * TAN({DECL}))))"
RA = f"(0.0820 * (1 + 0.033 * COS(2 * PI() * 167.4 / 365)) * ({SUNSET} * SIN(0.6) * SIN({DECL}) + COS(0.6) * COS({DECL}) * SIN({SUNSET})) * 11.574)"
LAI = "(CASE WHEN ndvi > 0 AND ndvi < 1 THEN -LN(1 - ndvi) / 0.5 ELSE 0 END)"
formulas("crops", "Leaf area, absorbed light, irrigation, soils.", {
    "lai": (lambda: land.leaf_area(col("ndvi"), c(0.5)), LAI),
    "fipar": (lambda: land.absorbed_share(land.leaf_area(col("ndvi"), c(0.5))), f"LEAST(0.95, 0.95 * (1 - EXP(-0.6 * {LAI})))"),
    "npp": (lambda: land.daily_npp(c(20.0), col("ndvi"), col("crop")), "20 * LEAST(0.95, 0.95 * (1 - EXP(-0.6 * CASE WHEN ndvi > 0 THEN -LN(1 - ndvi) / CASE crop WHEN 'maize' THEN 0.6 WHEN 'rice' THEN 0.45 ELSE 0.5 END ELSE 0 END))) * CASE crop WHEN 'maize' THEN 2.5 WHEN 'rice' THEN 1.9 ELSE 1.8 END"),
    "irrigation": (lambda: land.irrigation_mm(col("hours") * 10.0, col("crop"), col("unit")), "GREATEST(0, hours * 10 * CASE crop WHEN 'maize' THEN 1.0 WHEN 'rice' THEN 1.1 ELSE 0.85 END - 0.8 * unit)"),
    "soil_class": (lambda: land.soil_class(col("hours"), col("hours") + 3.0), "CASE WHEN hours >= 2 AND hours + 3 BETWEEN 5.5 AND 8 THEN 'good' WHEN hours >= 2 OR hours + 3 BETWEEN 5.5 AND 8 THEN 'fair' ELSE 'poor' END"),
    "soil_carbon": (lambda: land.soil_carbon_after(col("cn"), c(2.0), c(0.03)), "2 / 0.03 + (cn - 2 / 0.03) * EXP(-0.6)"),
    "et0": (lambda: land.reference_et(col("temp") + 10.0, col("temp"), c(0.6), c(6.0)), f"GREATEST(0.0, 0.0023 * {RA} * (temp + 5 + 17.8) * SQRT(10.0))"),
})
formulas("cities", "Density, walking time, pipes, market pull.", {
    "far": (lambda: land.floor_area_ratio(col("rain") * 100.0, col("area")), "rain * 100 / area"),
    "walk": (lambda: land.walking_minutes(col("km") * 10.0), "km / 100 / 5 * 60"),
    "pipe": (lambda: land.pipe_capacity_m3s(col("unit") + 0.1, c(0.01), c(0.013)), "PI() * POW(unit + 0.1, 2) / 4 * POW((unit + 0.1) / 4, 2.0 / 3) * 0.1 / 0.013"),
    "pull": (lambda: land.market_pull(col("rain"), col("unit"), 1.5), "CASE WHEN unit > 0 THEN rain / POW(unit, 1.5) ELSE 10 * rain END"),
}, 5)
formulas("images", "Radiance, reflectance, displacement, phase.", {
    "radiance": (lambda: land.radiance(col("rain"), c(0.05), c(-1.0)), "0.05 * rain - 1"),
    "reflectance": (lambda: land.reflectance(col("rain"), 45.0, 1.01), "rain * PI() * 1.01 * 1.01 / (1536 * SIN(RADIANS(45)))"),
    "displacement": (lambda: land.los_displacement_mm(col("unit"), 5.6), "unit * 56 / (4 * PI())"),
    "wrapped": (lambda: land.wrapped(col("hours") * 3.0), "hours * 3 - 2 * PI() * CEIL((hours * 3 - PI()) / (2 * PI()))"),
    "habitat": (lambda: land.habitat_quality(col("unit"), col("ndvi")), "CASE WHEN ndvi <= 0 THEN 0 ELSE unit * (1 - POW(ndvi, 2.5) / (POW(ndvi, 2.5) + POW(0.5, 2.5))) END"),
})


# --- formulas that need more than one row


@query("scs_assessment", f"SELECT cls, COUNT(*) AS cells, {r('AVG(cn)')} AS mean_cn, {r('AVG(CASE WHEN 90 <= 0.2 * (25400 / cn - 254) THEN 0 ELSE POW(90 - 0.2 * (25400 / cn - 254), 2) / (90 + 0.8 * (25400 / cn - 254)) END)')} AS runoff FROM (SELECT cls, CAST(CASE cls WHEN 'forest' THEN CASE CAST(id % 4 AS INTEGER) WHEN 0 THEN 30 WHEN 1 THEN 55 WHEN 2 THEN 70 ELSE 77 END WHEN 'grassland' THEN CASE CAST(id % 4 AS INTEGER) WHEN 0 THEN 39 WHEN 1 THEN 61 WHEN 2 THEN 74 ELSE 80 END WHEN 'cropland' THEN CASE CAST(id % 4 AS INTEGER) WHEN 0 THEN 67 WHEN 1 THEN 78 WHEN 2 THEN 85 ELSE 89 END WHEN 'built_up' THEN CASE CAST(id % 4 AS INTEGER) WHEN 0 THEN 89 WHEN 1 THEN 92 WHEN 2 THEN 94 ELSE 95 END ELSE 85 END AS DOUBLE) AS cn FROM g_points) GROUP BY cls", ("g_points",))
def scs_assessment(spark, d):
    p = fx.points(spark, d).withColumn("cn", water.curve_number(F.col("cls"), F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("id") % 4 + 1).cast("int"))))
    return p.groupBy("cls").agg(F.count("*").alias("cells"), rounded(F.avg("cn")).alias("mean_cn"), rounded(F.avg(water.runoff_mm(c(90.0), F.col("cn")))).alias("runoff"))


@query("weibull", f"SELECT {r('LEAST(10, GREATEST(1, POW(s / GREATEST(0.1, m), -1.086)))')} AS shape, {r('m')} AS mean FROM (SELECT AVG(wind) AS m, STDDEV_POP(wind) AS s {FROM})")
def weibull(spark, d):
    m = inputs(spark, d).agg(F.avg("wind").alias("m"), F.stddev_pop("wind").alias("s"))
    return m.select(rounded(land.weibull_shape(F.col("m"), F.col("s"))).alias("shape"), rounded(F.col("m")).alias("mean"))


@query("rank_sites", f"SELECT id, {r('power')} AS power FROM (SELECT id, cn * 2e-3 * area * (1 - 288.15 / ({TR} + 273.15)) * 0.12 AS power {FROM}) ORDER BY power DESC, id LIMIT 10")
def rank_sites(spark, d):
    p = inputs(spark, d).select("id", land.geothermal_mw(col("cn") * 2.0, col("area"), c(15.0)).alias("p"))
    return p.orderBy(F.col("p").desc(), "id").limit(10).select("id", rounded(F.col("p")).alias("power"))


@query("b_value", f"SELECT CAST(FLOOR((lon + 180) / 72) AS BIGINT) AS zone, {r(f'{log10(2.718281828459045)!r}::DOUBLE / (AVG(mag) - 3.0)')} AS b FROM g_quakes WHERE mag >= 3 GROUP BY 1", ("g_quakes",))
def b_value(spark, d):
    q = fx.quakes(spark, d).where("mag >= 3").groupBy(F.floor((F.col("lon") + 180) / 72).alias("zone"))
    return q.agg(rounded(F.lit(log10(2.718281828459045)) / (F.avg("mag") - 3.0)).alias("b"))


BINS = "src AS (SELECT s_suppkey AS id, CAST(s_suppkey * 7919 % 3400 AS DOUBLE) / 10 - 170 AS lon, CAST(s_suppkey * 104729 % 1600 AS DOUBLE) / 10 - 80 AS lat, 0.02 + CAST(s_suppkey % 7 AS DOUBLE) / 100 AS rate FROM supplier), site AS (SELECT n_nationkey AS sid, CAST(-170 + n_nationkey * 13 AS DOUBLE) AS slon, CAST(-60 + n_nationkey * 5 AS DOUBLE) AS slat FROM nation), bins AS (SELECT i, 4 + i * 0.1 AS m1, 4 + i * 0.1 + 0.1 AS m2 FROM (SELECT UNNEST(GENERATE_SERIES(0, 29)) AS i)), d AS (SELECT sid, id, rate, 2 * 6371 * ASIN(SQRT(LEAST(1, POW(SIN(RADIANS(lat - slat) / 2), 2) + COS(RADIANS(lat)) * COS(RADIANS(slat)) * POW(SIN(RADIANS(lon - slon) / 2), 2)))) AS km FROM src, site), m AS (SELECT sid, id, i, rate * (EXP(-LN(10) * (m1 - 4)) - EXP(-LN(10) * (m2 - 4))) AS rm, LN(0.05 / LEAST(2, GREATEST(0.001, EXP(-2 + 0.8 * ((m1 + m2) / 2 - 6) - 1.5 * LN(GREATEST(5, km) / 30))))) / 0.7 AS x FROM d, bins WHERE km <= 3000)"


def _rates(spark, d):
    k = F.col("s_suppkey")
    src = fx.table(spark, d, "supplier").select(k.alias("p_id"), ((k * 7919 % 3400).cast("double") / 10 - 170).alias("p_lon"), ((k * 104729 % 1600).cast("double") / 10 - 80).alias("p_lat"), (0.02 + (k % 7).cast("double") / 100).alias("rate"))
    n = F.col("n_nationkey")
    site = fx.table(spark, d, "nation").select(n.alias("o_id"), (n * 13 - 170).cast("double").alias("o_lon"), (n * 5 - 60).cast("double").alias("o_lat"))
    from ..operators.joins import within_radius

    met = within_radius(site, src, 3000.0).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(29))))
    m1 = F.lit(4.0) + F.col("i") * 0.1
    rate = hazard.rate_between(F.col("rate"), c(1.0), c(4.0), m1, m1 + 0.1)
    return met.select("o_id", "p_id", "km", (rate * hazard.exceedance(c(0.05), hazard.pga(m1 + 0.05, F.col("km"), F.lit("II")))).alias("v"))


@query("psha_rate", f"SELECT sid AS o_id, {r('SUM(rm * (1 - 0.5 * (1 + SIGN(x) * SQRT(1 - EXP(-2 / PI() * x * x)))))', 8)} AS rate FROM m GROUP BY sid", (), BINS)
def psha_rate(spark, d):
    return _rates(spark, d).groupBy("o_id").agg(rounded(F.sum("v"), 8).alias("rate"))


@query("deaggregation", f"SELECT o_id, CAST(FLOOR(km / 500) AS BIGINT) AS band, {r('SUM(v) / t', 5)} AS share FROM (SELECT m.sid AS o_id, d.km, rm * (1 - 0.5 * (1 + SIGN(x) * SQRT(1 - EXP(-2 / PI() * x * x)))) AS v, SUM(rm * (1 - 0.5 * (1 + SIGN(x) * SQRT(1 - EXP(-2 / PI() * x * x))))) OVER (PARTITION BY m.sid) AS t FROM m JOIN d ON d.sid = m.sid AND d.id = m.id) GROUP BY o_id, 2, t", (), BINS)
def deaggregation(spark, d):
    by = _rates(spark, d).groupBy("o_id", F.floor(F.col("km") / 500).alias("band")).agg(F.sum("v").alias("v"))
    return by.select("o_id", "band", rounded(F.col("v") / F.sum("v").over(Window.partitionBy("o_id")), 5).alias("share"))


@query("habitat_degradation", f"SELECT a.r, a.c, {r('SUM(EXP(-SQRT(POW(a.r - b.r, 2) + POW(a.c - b.c, 2)) / 2))')} AS degradation FROM g_raster a JOIN g_raster b ON ABS(a.r - b.r) <= 6 AND ABS(a.c - b.c) <= 6 AND POW(a.r - b.r, 2) + POW(a.c - b.c, 2) <= 36 WHERE b.lc1 = 0 GROUP BY a.r, a.c", ("g_raster",))
def habitat_degradation(spark, d):
    """Threat cells (class 0) spread to the cells within six, with exponential decay: a bounded stencil instead of all pairs."""
    g = fx.raster(spark, d)
    steps = [(a, b) for a in range(-6, 7) for b in range(-6, 7) if a * a + b * b <= 36]
    from math import exp, sqrt

    spread = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(exp(-sqrt(a * a + b * b) / 2)).alias("w")) for a, b in steps]))
    sent = g.where("lc1 = 0").select("r", "c", spread.alias("s")).select((F.col("r") + F.col("s.a")).alias("r"), (F.col("c") + F.col("s.b")).alias("c"), F.col("s.w").alias("w"))
    got = sent.groupBy("r", "c").agg(F.sum("w").alias("x"))
    return g.select("r", "c").join(got, ["r", "c"]).select("r", "c", rounded(F.col("x")).alias("degradation"))


TURB = "turb AS (SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 100 AS DOUBLE) * 50 AS x, CAST(s_suppkey * 61 % 100 AS DOUBLE) * 50 AS y FROM supplier)"


@query("wake_losses", f"SELECT id, {r('10 - LEAST(10.0, COALESCE(SQRT(SUM(d * d)), 0))')} AS wind FROM (SELECT a.id, 10 * (1 - SQRT(0.2)) * POW(40 / (40 + 0.075 * SQRT(POW(a.x - b.x, 2) + POW(a.y - b.y, 2))), 2) AS d FROM turb a LEFT JOIN turb b ON a.x > b.x AND a.x - b.x <= 1500 AND ABS(a.y - b.y) <= 0.5 * (a.x - b.x) AND SQRT(POW(a.x - b.x, 2) + POW(a.y - b.y, 2)) <= 1500) GROUP BY id", (), TURB)
def wake_losses(spark, d):
    """Root-sum-square deficits of the turbines upwind (west, in a cone) within 1500 m, by cells of that size."""
    k = F.col("s_suppkey")
    t = fx.table(spark, d, "supplier").select(k.alias("id"), ((k * 37 % 100).cast("double") * 50).alias("x"), ((k * 61 % 100).cast("double") * 50).alias("y"))
    cell = lambda v: F.floor(v / 1500.0).cast("long")
    up = t.select(F.col("x").alias("ux"), F.col("y").alias("uy"), cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy"))
    here = t.withColumn("cx", F.explode(F.array(cell(F.col("x")) - 1, cell(F.col("x"))))).withColumn("cy", F.explode(F.array(cell(F.col("y")) - 1, cell(F.col("y")), cell(F.col("y")) + 1)))
    dx, dy = F.col("x") - F.col("ux"), F.col("y") - F.col("uy")
    dist = F.sqrt(dx * dx + dy * dy)
    met = here.join(up, ["cx", "cy"]).where((dx > 0) & (dist <= 1500) & (F.abs(dy) <= 0.5 * dx))
    loss = met.select("id", (10.0 - land.jensen_wind(c(10.0), c(0.8), c(40.0), dist)).alias("d")).groupBy("id").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("loss"))
    return t.join(loss, "id", "left").select("id", rounded(10.0 - F.least(F.lit(10.0), F.coalesce("loss", F.lit(0.0)))).alias("wind"))


@query("dasymetric", f"SELECT r, c, {r('10000.0 * z / SUM(z) OVER (PARTITION BY zone)')} AS people FROM g_raster", ("g_raster",))
def dasymetric(spark, d):
    g = fx.raster(spark, d)
    total = g.groupBy("zone").agg(F.sum("z").alias("t"))
    return g.join(total, "zone").select("r", "c", rounded(land.dasymetric(c(10000.0), F.col("z"), F.col("t"))).alias("people"))


@query("wealth_index", f"SELECT r, c, {r('100 * (0.5 * red / mr + 0.3 * nir / mn + 0.2 * z / mz)')} AS wealth FROM g_raster, (SELECT MAX(red) AS mr, MAX(nir) AS mn, MAX(z) AS mz FROM g_raster)", ("g_raster",))
def wealth_index(spark, d):
    g = fx.raster(spark, d)
    top = F.broadcast(g.agg(F.max("red").alias("mr"), F.max("nir").alias("mn"), F.max("z").alias("mz")))  # one row
    return g.crossJoin(top).select("r", "c", rounded(land.wealth(F.col("red"), F.col("mr"), F.col("nir"), F.col("mn"), F.col("z"), F.col("mz"))).alias("wealth"))


@query("diversity", f"SELECT zone, {r('-SUM(p * LN(p))')} AS shannon, {r('1 - SUM(p * p)')} AS simpson FROM (SELECT zone, lc1, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY zone) AS p FROM g_raster GROUP BY zone, lc1) GROUP BY zone", ("g_raster",))
def diversity(spark, d):
    n = fx.raster(spark, d).groupBy("zone", "lc1").agg(F.count("*").alias("n"))
    p = n.select("zone", (F.col("n") / F.sum("n").over(Window.partitionBy("zone"))).alias("p"))
    return p.groupBy("zone").agg(rounded(F.sum(land.shannon(F.col("p")))).alias("shannon"), rounded(1.0 - F.sum(F.col("p") * F.col("p"))).alias("simpson"))


@query("earthwork", f"SELECT zone, {r('SUM(GREATEST(0, z - 30)) * 100', 3)} AS cut, {r('SUM(GREATEST(0, 30 - z)) * 100', 3)} AS fill FROM g_raster GROUP BY zone", ("g_raster",))
def earthwork(spark, d):
    over = F.col("z") - 30.0
    return fx.raster(spark, d).groupBy("zone").agg(rounded(F.sum(F.greatest(F.lit(0.0), over)) * 100.0, 3).alias("cut"), rounded(F.sum(F.greatest(F.lit(0.0), -over)) * 100.0, 3).alias("fill"))


@query("network_adjustment", f"SELECT zone, {r('SUM(w * z) / SUM(w)')} AS height, {r('SQRT(SUM(w * z * z) / SUM(w) - POW(SUM(w * z) / SUM(w), 2))', 5)} AS rmse FROM (SELECT zone, z, CAST(1 + c % 3 AS DOUBLE) AS w FROM g_raster) GROUP BY zone", ("g_raster",))
def network_adjustment(spark, d):
    o = fx.raster(spark, d).select("zone", "z", (F.col("c") % 3 + 1).cast("double").alias("w")).groupBy("zone").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("x"), (F.sum(F.col("w") * F.col("z") * F.col("z")) / F.sum("w")).alias("q"))
    return o.select("zone", rounded(F.col("x")).alias("height"), rounded(F.sqrt(F.col("q") - F.col("x") * F.col("x")), 5).alias("rmse"))


@query("bathtub", f"SELECT COUNT(*) AS cells, {r('SUM(12.5 - z)', 4)} AS depth FROM g_raster WHERE z < 12.5", ("g_raster",))
def bathtub(spark, d):
    level = 12.0 + 1.0 / 2
    return fx.raster(spark, d).where(F.col("z") < level).agg(F.count("*").alias("cells"), rounded(F.sum(F.lit(level) - F.col("z")), 4).alias("depth"))


@query("dark_object", f"SELECT {r('AVG(red)')} AS haze FROM (SELECT red, ROW_NUMBER() OVER (ORDER BY red) AS k, COUNT(*) OVER () AS n FROM g_raster WHERE red IS NOT NULL) WHERE k <= FLOOR(n * 0.01)", ("g_raster",))
def dark_object(spark, d):
    """The mean of the darkest hundredth."""
    return stats.darkest_mean(fx.raster(spark, d).select(F.col("red").alias("v")), 0.01).select(rounded(F.col("haze")).alias("haze"))


@query("coherence", f"SELECT r, c, {r('SUM(red * nir) OVER w / SQRT(SUM(red * red) OVER w * SUM(nir * nir) OVER w)')} AS v FROM (SELECT r, c, COALESCE(red, 0.1) AS red, COALESCE(nir, 0.1) AS nir FROM g_raster) WINDOW w AS (ORDER BY r, c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", ("g_raster",))
def coherence(spark, d):
    """Windows run over the raster line after line, so they reach across the ends of lines."""
    g = fx.raster(spark, d).select("r", "c", F.coalesce("red", F.lit(0.1)).alias("master"), F.coalesce("nir", F.lit(0.1)).alias("slave"))
    return raster.coherence(g, 40, 2).select("r", "c", rounded(F.col("coherence")).alias("v"))


@query("seismic_cells", "SELECT z.zone_id, COUNT(*) AS n, MAX(mag) AS top FROM g_quakes q JOIN g_zones z ON q.lon >= z.x0 AND q.lon < z.x1 AND q.lat >= z.y0 AND q.lat < z.y1 GROUP BY z.zone_id", ("g_quakes", "g_zones"))
def seismic_cells(spark, d):
    from ..operators.joins import zone_join

    return zone_join(fx.quakes(spark, d), fx.zones(spark, d)).where("zone_id is not null").groupBy("zone_id").agg(F.count("*").alias("n"), F.max("mag").alias("top"))
