"""Forests, coasts, cities, carbon pools and climate as queries: formulas over a derived table, and operators over series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import city, coast, forest, pools
from ..functions.base import c, rounded
from ..operators import services
from . import fixtures as fx
from .catalog import query, r
from .domains import formulas



def pick(*names):
    """One of some names by k."""
    return F.element_at(F.array(*[F.lit(s) for s in names]), (F.col("k") % len(names) + 1).cast("int"))


#: A species' class heights and curve by k % 6, as the SQL below looks them up.
CLASS_SQL = "CASE k % 6 WHEN 0 THEN [20.0, 16.0, 12.0, 8.0, 5.0] WHEN 1 THEN [22.0, 17.5, 13.0, 9.0, 5.5] WHEN 2 THEN [25.0, 20.0, 15.0, 10.0, 6.0] WHEN 3 THEN [18.0, 14.0, 10.5, 7.0, 4.0] WHEN 4 THEN [28.0, 22.0, 16.0, 10.0, 6.0] ELSE [21.0, 17.0, 13.0, 9.0, 5.5] END"


def curve_sql(age: str) -> str:
    """Height of the species k % 6 at an age."""
    richards = [(0, 25.0, 0.15, 1.5), (1, 28.0, 0.12, 1.6), (3, 22.0, 0.10, 1.4), (4, 35.0, 0.18, 1.3), (5, 26.0, 0.14, 1.5)]
    return "CASE k % 6 " + " ".join(f"WHEN {i} THEN {a} * POW(1 - EXP(-{b} * {age}), {p})" for i, a, b, p in richards) + f" ELSE 30.0 / (1 + 8.0 * EXP(-0.25 * {age})) END"


class_i = "CAST(CASE site WHEN 'I' THEN 1 WHEN 'II' THEN 2 ELSE 3 END AS INTEGER)"
nearest = f"LIST_TRANSFORM({CLASS_SQL}, lambda h: ABS(area - ({curve_sql('km')}) * h / ({curve_sql('20.0')})))"
formulas(
    "forest_growth",
    "Six growth curves, stand biomass, site index and class.",
    {
        "richards": (lambda: forest.tree_height("richards", c("km"), 25.0, 0.04, 0.9), "25.0 * POW(1 - EXP(-0.04 * km), 0.9) + 1.3"),
        "logistic": (lambda: forest.tree_height("logistic", c("km"), 25.0, 6.0, 0.08), "25.0 / (1 + 6.0 * EXP(-0.08 * km)) + 1.3"),
        "korf": (lambda: forest.tree_height("korf", c("km"), 30.0, 8.0, 0.7), "30.0 * EXP(-8.0 * POW(km, -0.7)) + 1.3"),
        "gompertz": (lambda: forest.tree_height("gompertz", c("km"), 24.0, 3.0, 0.05), "24.0 * EXP(-3.0 * EXP(-0.05 * km)) + 1.3"),
        "weibull": (lambda: forest.tree_height("weibull", c("km"), 22.0, 0.01, 1.2), "22.0 * (1 - EXP(-0.01 * POW(km, 1.2))) + 1.3"),
        "schumacher": (lambda: forest.tree_height("schumacher", c("km"), 28.0, 9.0, 0.0), "28.0 * EXP(-9.0 / km) + 1.3"),
        "biomass": (lambda: forest.stand_biomass(c("km"), c("rain") * 10, 220.0, 0.02, 0.8, 1.1), "CASE WHEN POW(rain * 10 / 1000, 0.8) * km * 0.02 < 1e-16 THEN 0 ELSE 220.0 * POW(1 - EXP(-0.02 * POW(rain * 10 / 1000, 0.8) * km), 1.1) END"),
        "site_index": (lambda: forest.site_index(pick(*forest.SPECIES), F.col("site"), c("km")), f"CASE WHEN km = 20 THEN ({CLASS_SQL})[{class_i}] ELSE ({curve_sql('km')}) * ({CLASS_SQL})[{class_i}] / ({curve_sql('20.0')}) END"),
        "height_class": (lambda: forest.site_class_of(pick(*forest.SPECIES), c("area"), c("km")), f"CASE LIST_POSITION({nearest}, LIST_MIN({nearest})) WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' ELSE 'V' END"),
        "productivity": (lambda: forest.site_productivity(c("area"), c("km")), "area / km"),
    },
)
cut_share = "GREATEST(0.0, LEAST(100.0, slope * 3)) / 100"
formulas(
    "forest_harvest",
    "Harvests, yields and sinks.",
    {
        "retained": (lambda: forest.selective_retained(c("area"), c("slope") * 3), f"area - area * {cut_share}"),
        "volume": (lambda: forest.clearcut_volume(c("area"), c("rain")), "area * rain"),
        "removal": (lambda: forest.shelterwood_removal(F.when(F.col("site") == "I", "prep").when(F.col("site") == "II", "Establishment").otherwise("final")), "CASE site WHEN 'I' THEN 0.3 WHEN 'II' THEN 0.4 ELSE 1.0 END"),
        "net": (lambda: forest.harvest_carbon_net(c("area"), c("rain"), c("slope") * 3, c("wind"), c("km")), f"wind * area * km - rain * area * {cut_share}"),
        "payback": (lambda: forest.harvest_payback_years(c("area"), c("rain"), c("slope") * 3, c("wind")), f"rain * area * {cut_share} / (wind * area)"),
        "yield": (lambda: forest.sustainable_yield(c("area"), c("rain"), c("km"), c("wind")), "LEAST(area * rain / km, area * wind)"),
        "sink": (lambda: forest.annual_sink((c("ndvi") - 0.5) * c("rain"), c("wind")), "-((ndvi - 0.5) * rain) * (1.5 * 0.45 * 1.25 * 0.47) * (44.0 / 12.0) / GREATEST(wind, 1.0)"),
        "grade_class": (lambda: forest.sink_grade((0.3 - c("ndvi")) * 120), "CASE WHEN (0.3 - ndvi) * 120 < -50 THEN 'excellent' WHEN (0.3 - ndvi) * 120 < -10 THEN 'good' WHEN (0.3 - ndvi) * 120 < 0 THEN 'weak' ELSE 'source' END"),
        "potential": (lambda: forest.sink_potential(c("wind"), c("area")), "GREATEST(wind - area, 0.0) * (0.47 * 44.0 / 12.0)"),
    },
)

cor = "(2 * 7.2921e-5 * GREATEST(ABS(SIN(RADIANS(slope * 1.9))), 1e-10))"
stress = "(1.225 * 0.0013 * wind * wind)"
ek_u = f"{stress} * COS(RADIANS(aspect)) / (1025.0 * {cor})"
ek_v = f"-{stress} * SIN(RADIANS(aspect)) / (1025.0 * {cor})"
tide = " + ".join(f"{a} * COS(RADIANS({s}) * km + RADIANS({p}))" for s, a, p in ((28.984104, 1.2, 30.0), (15.041069, 0.3, 110.0)))
formulas(
    "ocean_currents",
    "Tide levels, Ekman and geostrophic flow.",
    {
        "level": (lambda: coast.constituent_level(coast.constituent_speed(F.lit("M2")), F.lit(1.2), F.lit(30.0), c("km")) + coast.constituent_level(coast.constituent_speed(F.lit("K1")), F.lit(0.3), F.lit(110.0), c("km")), tide),
        "spring": (lambda: coast.spring_range(c("unit"), c("ndvi")), "unit + ndvi"),
        "neap": (lambda: coast.neap_range(c("unit"), c("ndvi")), "ABS(unit - ndvi)"),
        "depth": (lambda: coast.ekman_depth(c("slope") * 1.9), f"SQRT(2 * 0.1 / {cor})"),
        "transport_u": (lambda: coast.ekman_u(c("wind"), c("aspect"), c("slope") * 1.9), ek_u),
        "transport_v": (lambda: coast.ekman_v(c("wind"), c("aspect"), c("slope") * 1.9), ek_v),
        "surface_speed": (lambda: coast.ekman_surface_speed(c("wind"), c("slope") * 1.9), f"SQRT(2.0) * {stress} / (1025.0 * {cor} * SQRT(2 * 0.1 / {cor}))"),
        "current": (lambda: coast.total_current(c("wind"), c("aspect"), c("unit") * 1e-6, c("ndvi") * 1e-6, c("slope") * 1.9), f"SQRT(POW({ek_u} - 9.81 / {cor} * ndvi * 1e-6, 2) + POW({ek_v} + 9.81 / {cor} * unit * 1e-6, 2))"),
        "soi": (lambda: coast.southern_oscillation(c("temp")), "-2 * temp"),
    },
)
l0 = "(9.81 * hours * hours * 4 / (2 * PI()))"  # periods are twice `hours`
hb = f"LEAST(0.56 * area * POW(area / {l0}, -0.2), 1.5 * area)"
dep = "GREATEST(wind, 0.5)"
sinh = lambda x: f"((EXP({x}) - EXP(-({x}))) / 2)"
cg = f"CASE WHEN {dep} >= {l0} / 2 THEN 0.5 * {l0} / (2 * hours) ELSE 0.5 * (1 + 2 * (2 * PI() * {dep} / {l0}) / {sinh(f'2 * (2 * PI() * {dep} / {l0})')}) * SQRT(9.81 * {dep}) END"
xi = f"(unit / SQRT(area / {l0}))"
size = f"SQRT(area * {l0})"
lf = "(9.81 * POW(2 * hours + 3, 2) / (2 * PI()))"
kh = f"(2 * PI() * wind / GREATEST({lf}, 0.1))"
flux = f"1025.0 * 9.81 / 8 * area * area * CASE WHEN {kh} > 0.01 THEN 0.5 * (1 + 2 * {kh} / {sinh(f'2 * {kh}')}) ELSE 1 END * CASE WHEN wind >= {lf} / 2 THEN {lf} / (2 * hours + 3) ELSE SQRT(9.81 * wind) END"
formulas(
    "waves",
    "Breaking, shoaling, run-up and overtopping.",
    {
        "breaker": (lambda: coast.breaker_height(c("area"), c("hours") * 2), hb),
        "shore": (lambda: coast.shore_height(c("area"), c("hours") * 2, c("wind")), f"LEAST(area * LEAST(SQRT(0.5 * {l0} / (2 * hours) / GREATEST({cg}, 0.01)), 2.0), 0.9 * {hb})"),
        "flux": (lambda: coast.wave_energy_flux(c("area"), c("hours") * 2 + 3, c("wind")), flux),
        "setup": (lambda: coast.wave_setup(c("area"), c("unit")), "LEAST(0.17 + 0.08 * unit, 0.25) * area"),
        "iribarren": (lambda: coast.iribarren(c("unit"), c("area"), c("hours") * 2), xi),
        "holman": (lambda: coast.runup_holman(c("unit"), c("area"), c("hours") * 2), f"0.27 * unit * {size}"),
        "stockdon": (lambda: coast.runup_stockdon(c("unit"), c("area"), c("hours") * 2), f"CASE WHEN {xi} < 0.3 THEN 0.043 * {size} ELSE 1.1 * (0.35 * unit * {size} + SQRT(POW(0.75 * unit * {size}, 2) + POW(0.06 * {size}, 2)) / 2) END"),
        "wall": (lambda: coast.overtopping(c("unit"), c("area"), c("hours") * 2, c("temp") / 4, True), "1000 * CASE WHEN temp / 4 <= 0 THEN 0.544 * SQRT(9.81) * POW(GREATEST(-(temp / 4), 0.001), 1.5) ELSE 0.047 * EXP(-2.35 * (temp / 4) / area) END"),
        "hazard_class": (lambda: coast.overtopping_hazard(c("pm")), "CASE WHEN pm < 0.1 THEN 'very_low' WHEN pm < 1 THEN 'low' WHEN pm < 10 THEN 'moderate' WHEN pm < 50 THEN 'high' ELSE 'very_high' END"),
    },
    digits=4,
)
hol = "POW(40.0 / km, 1.3)"
gw = f"SQRT(1.3 / 1.225 * rain * 100 * {hol} * EXP(-{hol}))"
formulas(
    "storm_surge",
    "Storm winds, surge, and carbon in coastal ecosystems.",
    {
        "wind_ms": (lambda: coast.gradient_wind(c("km"), c("rain"), F.lit(40.0)), gw),
        "setup": (lambda: coast.wind_setup(coast.gradient_wind(c("km"), c("rain"), F.lit(40.0)), F.least(c("km"), F.lit(100.0)), c("wind")), f"0.0025 * 1.225 * POW({gw}, 2) * LEAST(km, 100.0) * 1000 / (1025.0 * 9.81 * GREATEST(wind, 1.0))"),
        "pressure": (lambda: coast.pressure_surge(c("rain")), "rain * 0.01"),
        "risk_class": (lambda: coast.surge_risk(c("hours")), "CASE WHEN hours > 3 THEN 'very_high' WHEN hours > 1.5 THEN 'high' WHEN hours > 0.5 THEN 'moderate' ELSE 'low' END"),
        "stock": (lambda: coast.blue_carbon_stock(pick(*coast.BLUE_CARBON), c("area"), c("unit")), "CASE k % 3 WHEN 0 THEN 118.3 + 26.7 + 387.0 * unit WHEN 1 THEN 3.0 + 10.2 + 220.0 * unit ELSE 1.2 + 4.8 + 140.0 * unit END * 44.0 / 12.0 * area"),
        "gain": (lambda: coast.blue_carbon_gain(pick(*coast.BLUE_CARBON), c("area")), "CASE k % 3 WHEN 0 THEN 1.48 WHEN 1 THEN 1.19 ELSE 0.65 END * 44.0 / 12.0 * area"),
    },
    digits=4,
)

vent = "GREATEST(0.0, LEAST(1.0, 1 - 0.1 * area * LEAST(unit, 0.6) / (0.06 * area)))"
score = "FLOOR((LEAST(area * 10000 / (rain * 100) / 9 * 100, 100.0) + LEAST(wind / km / 0.5 * 100, 100.0) + LEAST(unit * 10 / km / 0.2 * 100, 100.0) + LEAST(ndvi / km / 0.02 * 100, 100.0) + LEAST(slope / km / 0.5 * 100, 100.0)) / 5 + 0.5)"
serves = "CASE k % 5 WHEN 0 THEN 5000.0 WHEN 1 THEN 50000.0 WHEN 2 THEN 10000.0 WHEN 3 THEN 5000.0 ELSE 10000.0 END"
formulas(
    "city_form",
    "Buildings, shade, heat and services.",
    {
        "height": (lambda: city.average_height(c("area"), c("unit")), "CASE WHEN unit > 0 THEN GREATEST(area / unit * 3.0, 0.0) ELSE 0 END"),
        "use_class": (lambda: city.land_use(c("ndvi"), F.when(F.col("k") % 7 != 0, c("unit"))), "CASE WHEN ndvi <= 0 THEN 'water' WHEN k % 7 <> 0 THEN CASE WHEN unit <= 0.2 THEN 'green_space' WHEN unit <= 0.4 THEN 'low_urban' WHEN unit <= 0.7 THEN 'medium_urban' ELSE 'high_urban' END WHEN ndvi > 0.3 THEN 'green_space' ELSE 'bare_soil' END"),
        "shadow": (lambda: city.shadow_m(c("area"), 26.5), "area / TAN(RADIANS(26.5))"),
        "heat": (lambda: city.heat_island(c("unit"), c("ndvi"), c("unit") * 0.5), "0.4 * unit + 0.3 * ndvi + 0.3 * (1 - unit * 0.5)"),
        "heat_class": (lambda: city.heat_island_risk(c("unit")), "CASE WHEN unit >= 0.7 THEN 'high' WHEN unit >= 0.4 THEN 'medium' ELSE 'low' END"),
        "ventilation": (lambda: city.ventilation(c("area"), c("unit")), vent),
        "air_class": (lambda: city.ventilation_quality(c("ndvi")), "CASE WHEN ndvi >= 0.7 THEN 'good' WHEN ndvi >= 0.4 THEN 'fair' ELSE 'poor' END"),
        "access": (lambda: city.access_score(c("rain") * 100, c("area"), c("wind"), c("unit") * 10, c("ndvi"), c("slope"), c("km")), score),
        "access_class": (lambda: city.access_grade(c("unit") * 100), "CASE WHEN unit * 100 >= 80 THEN 'A' WHEN unit * 100 >= 60 THEN 'B' WHEN unit * 100 >= 40 THEN 'C' WHEN unit * 100 >= 20 THEN 'D' ELSE 'F' END"),
        "needed": (lambda: city.facilities_needed(c("rain") * 10, c("area"), pick("school", "Hospital", "shop", "park", "other")), f"CEIL(rain * 10 * area / {serves})"),
        "gap": (lambda: city.facility_gap(c("rain") * 10, c("area"), pick("school", "Hospital", "shop", "park", "other"), F.lit(1)), f"GREATEST(CEIL(rain * 10 * area / {serves}) - 1, 0)"),
    },
)
flood = "CASE WHEN area > 0 THEN GREATEST(rain * 1000 - unit * 4 * 3600, 0.0) / (area * 10000) * 1000 ELSE 0 END"
formulas(
    "city_drainage",
    "Inlets, flooding and two drainage systems.",
    {
        "inlet": (lambda: city.inlet_capacity(pick("curb_opening", "grate", "combination", "area"), c("area"), c("unit")), "GREATEST(CASE k % 4 WHEN 0 THEN 0.6 WHEN 1 THEN 0.5 WHEN 2 THEN 0.55 ELSE 0.45 END * area * SQRT(2 * 9.81 * 0.15) * (1 - unit), 0.0)"),
        "flood_mm": (lambda: city.flood_depth_mm(c("rain") * 1000, c("unit"), c("area"), F.lit(4.0)), flood),
        "flood_class": (lambda: city.flood_risk(c("rain") * 2), "CASE WHEN rain * 2 < 50 THEN 'Low' WHEN rain * 2 < 150 THEN 'Moderate' WHEN rain * 2 < 300 THEN 'High' ELSE 'Severe' END"),
        "use_pct": (lambda: city.drainage_use_pct(c("unit"), c("ndvi"), c("rain") * 20), "CASE WHEN (unit + ndvi) * 3600 > 1e-10 THEN LEAST(rain * 20 / ((unit + ndvi) * 3600) * 100, 100.0) ELSE 100 END"),
        "system_class": (lambda: city.drainage_status(c("unit"), c("ndvi"), c("rain") * 20), "CASE WHEN GREATEST(rain * 20 - (unit + ndvi) * 3600, 0.0) <= 0 THEN 'adequate' WHEN GREATEST(rain * 20 - (unit + ndvi) * 3600, 0.0) < rain * 20 * 0.3 THEN 'minor_exceedance' ELSE 'major_exceedance' END"),
        "yield_m3": (lambda: city.water_yield_m3(c("rain"), c("cn"), c("area")), "GREATEST(rain - cn, 0.0) * area * 10"),
    },
)
cell = "temp + pm * 2 / (25 + 6.84 * wind)"
dc = f"CASE WHEN pm <= 0 THEN 0 ELSE pm * 2 / 1000 * area * (1 - 0.4 / 100 * ({cell} - 25)) END"
formulas(
    "solar_power",
    "Module temperature, power and energy; costs of a corridor.",
    {
        "cell": (lambda: city.cell_temperature(c("pm") * 2, c("temp"), c("wind")), cell),
        "roof": (lambda: city.cell_temperature(c("pm") * 2, c("temp"), c("wind"), "roof_mount"), "temp + pm * 2 / (25 + wind)"),
        "dc_kw": (lambda: city.dc_power(c("pm") * 2, c("area"), city.cell_temperature(c("pm") * 2, c("temp"), c("wind"))), dc),
        "kwh": (lambda: city.ac_energy_kwh(c("pm") * 2, c("area"), c("temp"), c("wind"), F.lit(720.0)), f"LEAST({dc} * 0.96, area / 1.2) * 720 * 0.86"),
        "loss": (lambda: F.lit(city.system_loss(2, 3, 0, 2, 2, 0.5, 1.5, 1, 0, 3)) + c("unit") * 0, "1 - 0.98 * 0.97 * 0.98 * 0.98 * 0.995 * 0.985 * 0.99 * 0.97 + unit * 0"),
        "ratio": (lambda: city.performance_ratio(c("rain") * 10, c("area"), c("pm")), "CASE WHEN pm > 0 THEN rain * 10 / area / pm ELSE 0 END"),
        "use_cost": (lambda: city.land_use_cost((F.col("k") % 9).cast("int")), "CASE k % 9 WHEN 0 THEN 10 WHEN 1 THEN 15 WHEN 2 THEN 20 WHEN 3 THEN 25 WHEN 4 THEN 60 WHEN 5 THEN 90 WHEN 6 THEN 100 ELSE 50 END"),
        "slope_cost": (lambda: city.slope_cost(c("slope")), "CASE WHEN slope < 5 THEN 5 WHEN slope < 10 THEN slope * 1.5 WHEN slope < 20 THEN slope * 2 WHEN slope < 30 THEN slope * 3 ELSE 100 END"),
        "near_cost": (lambda: city.proximity_cost(c("km"), 200.0), "CASE WHEN km >= 200 THEN 0 ELSE (1 - km / 200) * 100 END"),
    },
)

zone = "CASE k % 4 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} ELSE {3} END".format
agb = f"rain * ({zone('0.6 * 2.2 * 0.47', '0.45 * 1.5 * 0.47', '0.58 * 2.0 * 0.47', '0.4 * 1.3 * 0.47')}) * 44.0 / 12.0"
soc = f"cn * ({zone('1.0', '0.8 * 0.95', '1.0', '0.8 * 0.95 * 0.92')}) * 44.0 / 12.0"
formulas(
    "carbon_pools",
    "Five pools by zone and land use, their change, gases and grids.",
    {
        **{name.lower(): (lambda name=name: pools.pool_stocks(pick(*pools.BIOMASS), pick(*pools.SOIL), c("rain"), c("cn"))[name], sql) for name, sql in (("AGB", agb), ("BGB", f"{agb} * ({zone(0.27, 0.26, 0.24, 0.29)})"), ("DW", f"{agb} * ({zone(0.12, 0.18, 0.15, 0.25)})"), ("LT", f"{agb} * ({zone(0.04, 0.06, 0.05, 0.08)})"), ("SOC", soc))},
        "deadwood": (lambda: pools.decayed(c("rain"), c("area"), F.lit(0.07), c("wind")), "rain * EXP(-0.07 * wind) + area * (1 - EXP(-0.07 * wind)) / 0.07"),
        "transition": (lambda: pools.soil_transition(c("cn"), c("rain"), F.lit(0.05), c("wind")), "rain - (rain - cn) * EXP(-0.05 * wind)"),
        "ar6": (lambda: pools.gas_tco2e(c("km"), pick(*pools.GWP["AR6"])), "km * CASE k % 7 WHEN 0 THEN 1 WHEN 1 THEN 27 WHEN 2 THEN 273 WHEN 3 THEN 1500 WHEN 4 THEN 7800 WHEN 5 THEN 24300 ELSE 17400 END / 1000"),
        "ar4": (lambda: pools.gas_tco2e(c("km"), pick(*pools.GWP["AR6"]), "AR4"), "km * CASE k % 7 WHEN 0 THEN 1 WHEN 1 THEN 25 WHEN 2 THEN 298 WHEN 3 THEN 1600 WHEN 4 THEN 8300 WHEN 5 THEN 22800 ELSE 17200 END / 1000"),
        "grid": (lambda: pools.grid_factor(pick("North", "cn-east", "south", "west")), zone(0.7204, 0.5850, 0.3907, 0.5703)),
    },
)
decl = "CASE k % 12 WHEN 0 THEN -23.4 WHEN 1 THEN -17.1 WHEN 2 THEN -7.9 WHEN 3 THEN 4.8 WHEN 4 THEN 14.5 WHEN 5 THEN 21.9 WHEN 6 THEN 23.4 WHEN 7 THEN 18.5 WHEN 8 THEN 8.9 WHEN 9 THEN -2.0 WHEN 10 THEN -12.8 ELSE -21.7 END"
light = f"(24 / PI() * ACOS(GREATEST(-1.0, LEAST(1.0, -TAN(RADIANS(slope)) * TAN(RADIANS({decl}))))))"
days = "CASE k % 12 WHEN 1 THEN 28 WHEN 3 THEN 30 WHEN 5 THEN 30 WHEN 8 THEN 30 WHEN 10 THEN 30 ELSE 31 END"
heat = "(12 * POW(GREATEST(temp, 0.0) / 5, 1.514))"
formulas(
    "climate_month",
    "Day length, potential evaporation, downscaling and rain curves.",
    {
        "daylight": (lambda: pools.day_length(c("slope"), F.col("k") % 12), light),
        "evaporation": (lambda: pools.thornthwaite(c("temp"), c("slope"), F.col("k") % 12), f"CASE WHEN temp <= 0 THEN 0 ELSE 16 * POW(10 * temp / GREATEST({heat}, 1.0), 6.75e-7 * POW({heat}, 3) - 7.71e-5 * POW({heat}, 2) + 1.79e-2 * {heat} + 0.49) * (2 * {light} / 12) * ({days} / 30.0) END"),
        "warmer": (lambda: pools.delta_shift(c("temp"), c("wind"), c("area")), "temp + area - wind"),
        "wetter": (lambda: pools.delta_scale(c("rain"), c("pm"), c("km")), "rain * CASE WHEN pm <> 0 THEN km / pm ELSE 1 END"),
        "intensity": (lambda: pools.rain_intensity(c("km"), 1000.0, 10.0, 0.8), "1000.0 / POW(km + 10.0, 0.8)"),
        "depth_mm": (lambda: pools.rain_depth(c("km"), 1000.0, 10.0, 0.8), "1000.0 / POW(km + 10.0, 0.8) * km / 60"),
        "period": (lambda: pools.return_period_scale(F.lit(10.0), c("km"), 1.0, 0.4), "(1 + 0.4 * LN(km)) / (1 + 0.4 * LN(10.0))"),
    },
    digits=4,
)

# --- operators over tables

TIDES = [("M2", 1.2, 30.0), ("S2", 0.4, 75.0), ("K1", 0.3, 110.0), ("O1", 0.2, 10.0)]
tide_sql = " + ".join(f"{a} * COS(RADIANS({coast.CONSTITUENTS[n]}) * (12 + i * 0.5) + RADIANS({p}))" for n, a, p in TIDES)


@query("tide_table", f"SELECT i, {r('12 + i * 0.5')} AS hours, {r(tide_sql)} AS level FROM (SELECT UNNEST(RANGE(0, 200)) AS i)")
def tide_table(spark, d):
    constituents = spark.createDataFrame(TIDES, "name string, amplitude double, phase double")
    out = services.tide_levels(constituents, start=12.0, step=0.5, n=200)
    return out.select("i", rounded(F.col("hours")).alias("hours"), rounded(F.col("level")).alias("level"))


@query(
    "site_classes",
    f"""SELECT cls, COUNT(*) AS n, {r("AVG(h) * 1.05")} AS asymptote FROM (SELECT h, LEAST(CAST(FLOOR((h - lo) / CASE WHEN hi > lo THEN (hi - lo) / 5 ELSE 1 END) AS INTEGER), 4) + 1 AS cls FROM (SELECT s_acctbal / 100 AS h FROM supplier), (SELECT MIN(s_acctbal / 100) AS lo, MAX(s_acctbal / 100) AS hi FROM supplier)) GROUP BY cls""",
)
def site_classes(spark, d):
    plots = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("plot_id"), (F.col("s_acctbal") / 100).alias("height"))
    out = services.site_classes(plots, 5).groupBy("cls").agg(F.count("*").alias("n"), F.first("asymptote").alias("asymptote"))
    return out.select("cls", "n", rounded(F.col("asymptote")).alias("asymptote"))


IDF = "SELECT 5.0 * (1 + k) AS minutes, 1000.0 / POW(5.0 * (1 + k) + 12.3, 0.75) * (1 + 0.02 * SIN(k)) AS intensity FROM (SELECT UNNEST(RANGE(0, 24)) AS k)"


@query(
    "rain_curve_fit",
    f"""SELECT {r("b", 4)} AS b, {r("EXP(my + cc * mx)", 3)} AS a, {r("cc")} AS c FROM (SELECT b, AVG(x) AS mx, AVG(y) AS my, -REGR_SLOPE(y, x) AS cc, REGR_R2(y, x) AS r2
 FROM (SELECT g.i * 0.1 AS b, LN(minutes + g.i * 0.1) AS x, LN(intensity) AS y FROM ({IDF}), (SELECT UNNEST(RANGE(0, 500)) AS i) g) GROUP BY b ORDER BY FLOOR(r2 * 1e12) DESC, b LIMIT 1)""",
)
def rain_curve_fit(spark, d):
    k = F.col("id").cast("double")
    minutes = 5.0 * (1 + k)
    storms = spark.range(24).select(minutes.alias("minutes"), (1000.0 / F.pow(minutes + 12.3, F.lit(0.75)) * (1 + 0.02 * F.sin(k))).alias("intensity"))
    out = services.rain_curve(storms)
    return out.select(rounded(F.col("b"), 4).alias("b"), rounded(F.col("a"), 3).alias("a"), rounded(F.col("c")).alias("c"))


@query(
    "quantile_mapping",
    """WITH obs AS (SELECT o_totalprice AS v, ROW_NUMBER() OVER (ORDER BY o_totalprice) - 1 AS i, COUNT(*) OVER () AS n FROM orders WHERE o_orderpriority = '1-URGENT'),
hist AS (SELECT o_totalprice AS v, COUNT(*) OVER () AS n FROM orders WHERE o_orderpriority = '2-HIGH'), n AS (SELECT (SELECT COUNT(*) FROM hist) AS nh, (SELECT COUNT(*) FROM obs) AS no),
place AS (SELECT p.o_orderkey AS id, (SELECT COUNT(*) FROM hist WHERE hist.v < p.o_totalprice) AS pos FROM orders p WHERE p.o_orderpriority = '5-LOW' AND p.o_orderkey % 20 = 0)
SELECT id, obs.v AS corrected FROM place, n, obs WHERE obs.i = LEAST(CAST(FLOOR(LEAST(pos, nh - 1)::DOUBLE / GREATEST(nh - 1, 1) * (no - 1) + 0.5) AS BIGINT), no - 1)""",
)
def quantile_mapping(spark, d):
    orders = fx.table(spark, d, "orders")
    of = lambda p: orders.where(F.col("o_orderpriority") == p).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return services.quantile_mapping(of("1-URGENT").select("v"), of("2-HIGH").select("v"), of("5-LOW").where("id % 20 = 0"))


@query(
    "recreation",
    f"""SELECT zone, {r("CASE WHEN n > 1 THEN GREATEST(0.0, LEAST(1.0, h / LN(n))) ELSE 0 END * 0.8")} AS recreation FROM (SELECT zone, COUNT(*) AS n, -SUM(p * LN(p)) AS h
 FROM (SELECT zone, lc0, COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY zone) AS p FROM g_raster GROUP BY zone, lc0) GROUP BY zone)""",
    ("g_raster",),
)
def recreation(spark, d):
    out = services.recreation(fx.raster(spark, d).select("zone", F.col("lc0").alias("cls")), 0.8)
    return out.select("zone", rounded(F.col("recreation")).alias("recreation"))


@query(
    "carbon_storage",
    f"""SELECT lc0 AS cls, COUNT(*) AS cells, {r("COUNT(*) * 0.09 * MAX(p.a + p.b + p.s + p.d)")} AS stored FROM g_raster JOIN (VALUES (0, 30.0, 8.0, 60.0, 3.0), (1, 90.0, 25.0, 80.0, 9.0), (2, 5.0, 2.0, 40.0, 0.5), (3, 0.0, 0.0, 10.0, 0.0)) AS p(cls, a, b, s, d) ON lc0 = p.cls GROUP BY lc0""",
    ("g_raster",),
)
def carbon_storage(spark, d):
    table = spark.createDataFrame([(0, 30.0, 8.0, 60.0, 3.0), (1, 90.0, 25.0, 80.0, 9.0), (2, 5.0, 2.0, 40.0, 0.5), (3, 0.0, 0.0, 10.0, 0.0)], "cls int, above double, below double, soil double, dead double")
    out = services.carbon_storage(fx.raster(spark, d).select(F.col("lc0").alias("cls")), table, cell_ha=0.09)
    return out.select("cls", "cells", rounded(F.col("stored")).alias("stored"))


@query(
    "pv_year",
    f"""SELECT {r("SUM(e)", 3)} AS kwh, {r("SUM(e) / (5.0 * 8760)")} AS capacity_factor FROM (SELECT LEAST(g / 1000 * 5.0 * (1 - 0.4 / 100 * (t + g / (25 + 6.84 * w) - 25)) * 0.96, 5.0 / 1.2) * d * 24 * 0.86 AS e
 FROM (SELECT m, 120.0 + 15 * m AS g, 5.0 + 2 * m AS t, 2.0 + m % 4 AS w, CASE m WHEN 1 THEN 28 WHEN 3 THEN 30 WHEN 5 THEN 30 WHEN 8 THEN 30 WHEN 10 THEN 30 ELSE 31 END AS d FROM (SELECT UNNEST(RANGE(0, 12)) AS m)))""",
)
def pv_year(spark, d):
    months = spark.range(12).select(F.col("id").cast("int").alias("month"), (120.0 + 15 * F.col("id")).alias("irradiance"), (5.0 + 2 * F.col("id")).alias("air"), (2.0 + F.col("id") % 4).alias("wind"))
    out = services.pv_year(months, 5.0)
    return out.select(rounded(F.col("kwh"), 3).alias("kwh"), rounded(F.col("capacity_factor")).alias("capacity_factor"))
