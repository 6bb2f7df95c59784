"""Carbon accounting: factor joins, two-level aggregation, pools and scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import choose, round_half_away
from ..registry import operator

CO2_PER_C = 44.0 / 12.0
# fixed values: net calorific value, carbon content, oxidation rate of fuels
FUELS = {
    "RawCoal": (20.908, 26.37, 0.94), "CleanedCoal": (26.344, 25.41, 0.94), "Coke": (28.435, 29.42, 0.94), "CrudeOil": (41.816, 20.08, 0.98), "Gasoline": (43.070, 18.90, 0.98),
    "Diesel": (42.652, 20.20, 0.98), "FuelOil": (41.816, 21.10, 0.98), "LPG": (50.179, 17.20, 0.98), "NaturalGas": (389.31, 15.32, 0.99), "CokeOvenGas": (167.26, 13.58, 0.99),
    "BlastFurnaceGas": (33.35, 70.80, 0.99), "Biomass": (17.460, 27.30, 0.90), "OtherFuel": (20.0, 20.0, 0.95),
}
# fixed values: warming potentials over 100 years by assessment report
GWP = {
    "AR4": {"CO2": 1.0, "CH4": 25.0, "N2O": 298.0, "HFCs": 1600.0, "PFCs": 8300.0, "SF6": 22800.0, "NF3": 17200.0},
    "AR5": {"CO2": 1.0, "CH4": 28.0, "N2O": 265.0, "HFCs": 1400.0, "PFCs": 7400.0, "SF6": 23500.0, "NF3": 16100.0},
    "AR6": {"CO2": 1.0, "CH4": 27.0, "N2O": 273.0, "HFCs": 1500.0, "PFCs": 7800.0, "SF6": 24300.0, "NF3": 17400.0},
}


def warming(gas: Column, report: str = "AR6") -> Column:
    return choose(gas, GWP[report], None)


def fuel_co2(fuel: Column, quantity: Column, ncv: Column | None = None, carbon: Column | None = None, oxidation: Column | None = None) -> Column:
    """Tonnes of CO2 of a fuel; given values come before the fuel's own."""
    own = [choose(fuel, {k: v[i] for k, v in FUELS.items()}, None) for i in range(3)]
    given = [own[i] if x is None else F.coalesce(x, own[i]) for i, x in enumerate((ncv, carbon, oxidation))]
    return quantity * given[0] * given[1] * given[2] / 1000.0 * CO2_PER_C


def landcover_class(props: Column) -> Column:
    """The class a feature's properties name."""
    return F.lower(F.coalesce(props["class"], props["category"], props["landcover"], props["landuse"], F.lit("unknown")))


@operator("carbon")
def class_emissions(features: DataFrame) -> DataFrame:
    """Emissions by class of features with a factor (cls, area_ha, factor_value): area, emission and uncertainty rounded half away, the number
    of features, and the rank by size of the emission."""
    from pyspark.sql import Window

    known = features.where("factor_value is not null and area_ha > 0")
    by = known.groupBy(F.lower("cls").alias("cls"), "factor_value").agg(F.sum("area_ha").alias("a"), F.count("*").alias("features"))
    out = by.select("cls", "features", "factor_value", round_half_away(F.col("a")).alias("area_ha"), round_half_away(F.col("a") * F.col("factor_value")).alias("emission"))
    # one row for each class: the ranking window is over classes, not features
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.abs("emission").desc(), "cls")))


@operator("carbon")
def report_totals(classes: DataFrame) -> DataFrame:
    """Sums of the rounded class values, rounded again, and the root of the summed squares of the class uncertainties, if there are any."""
    pct = F.col("uncertainty_pct") if "uncertainty_pct" in classes.columns else F.lit(None).cast("double")
    part = round_half_away(F.abs("emission") * pct / 100.0)
    total = classes.withColumn("u", part).agg(F.sum("area_ha").alias("area"), F.sum("emission").alias("emission"), F.sum("features").alias("features"), F.sum(F.col("u") * F.col("u")).alias("u2"))
    return total.select(round_half_away(F.col("area")).alias("area_ha"), round_half_away(F.col("emission")).alias("emission"), "features", F.when(F.col("u2") > 0, round_half_away(F.sqrt("u2"))).alias("uncertainty"))


@operator("carbon")
def gas_breakdown(contributions: DataFrame) -> DataFrame:
    """CO2, CH4, N2O and all other gases of (cls, gas, tco2e), by class."""
    one = lambda g: F.sum(F.when(F.col("gas") == g, F.col("tco2e")).otherwise(0.0))
    return contributions.groupBy("cls").agg(one("CO2").alias("co2"), one("CH4").alias("ch4"), one("N2O").alias("n2o"), F.sum(F.when(~F.col("gas").isin("CO2", "CH4", "N2O"), F.col("tco2e")).otherwise(0.0)).alias("other"))


@operator("carbon")
def scope_totals(rows: DataFrame) -> DataFrame:
    """Emissions by scope; without a scope they count for scope1."""
    return rows.groupBy(F.coalesce("scope", F.lit("scope1")).alias("scope")).agg(F.sum("tco2e").alias("tco2e"), F.count("*").alias("n"))


@operator("carbon")
def activity_emissions(activities: DataFrame) -> DataFrame:
    """CO2 of fuel uses (fuel_type, quantity) by fuel."""
    return activities.groupBy("fuel_type").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("n")).withColumn("tco2", fuel_co2(F.col("fuel_type"), F.col("quantity")))


# --- pools


def pool_after(stock: Column, supply: Column, rate: Column, years: Column) -> Column:
    """First-order decay with a steady supply (dead wood, litter)."""
    left = F.exp(-rate * years)
    return stock * left + supply * (1.0 - left) / rate


def soil_transition(start: Column, target: Column, years: Column, rate: float = 0.05) -> Column:
    return target - (target - start) * F.exp(-rate * years)


def soil_stock(reference: Column, use: Column, management: Column, supply: Column) -> Column:
    """t CO2e per hectare from the reference stock and its three factors."""
    return reference * use * management * supply * CO2_PER_C


def biomass_stock(volume: Column, density: float, expansion: float, root_shoot: float, carbon: float = 0.47) -> Column:
    """t CO2e per hectare above and below ground from stem volume."""
    return volume * density * expansion * (1.0 + root_shoot) * carbon * CO2_PER_C


@operator("carbon")
def land_budget(zones: DataFrame, covers: DataFrame, factors: DataFrame, year: int) -> DataFrame:
    """Net emission, sources and sinks of each zone from its covers (zone_id, category, area_ha) with the year's factors; covers without factor
    count as skipped."""
    valid = factors.where((F.col("valid_from_year") <= year) & (F.col("valid_to_year").isNull() | (F.col("valid_to_year") >= year))).select("category", "factor_value")
    flow = F.col("area_ha") * F.col("factor_value")
    out = covers.join(valid, "category", "left").groupBy("zone_id").agg(F.coalesce(F.sum(flow), F.lit(0.0)).alias("net"), F.coalesce(F.sum(F.when(flow > 0, flow)), F.lit(0.0)).alias("sources"), F.coalesce(F.sum(F.when(flow < 0, flow)), F.lit(0.0)).alias("sinks"), F.sum(F.when(F.col("factor_value").isNull(), 1).otherwise(0)).alias("skipped"))
    return zones.select("zone_id", "zone_name").join(out, "zone_id", "left").na.fill(0)


def discounted(amount: Column, rate: Column, years: Column) -> Column:
    return amount / F.pow(1.0 + rate, years)
