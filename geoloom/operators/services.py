"""Operators of forests, coasts, climate and ecosystem services."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import city, coast
from ..registry import operator
from ..session import cut
from .stats import ranked


@operator("coast")
def tide_levels(constituents: DataFrame, start: float = 0.0, step: float = 1.0, n: int = 24) -> DataFrame:
    """i, hours, level at n times, from constituents (name, amplitude, phase); those with unknown names have speed 0."""
    times = constituents.sparkSession.range(n).select(F.col("id").alias("i"), (F.lit(start) + F.col("id") * F.lit(step)).alias("hours"))
    level = coast.constituent_level(coast.constituent_speed(F.col("name")), F.col("amplitude"), F.col("phase"), F.col("hours"))
    # a handful of constituents for every time
    return times.crossJoin(F.broadcast(constituents.limit(64))).groupBy("i", "hours").agg(F.sum(level).alias("level"))


@operator("forest")
def site_classes(plots: DataFrame, n: int = 5) -> DataFrame:
    """plots (height) with cls from 1 to n, equal steps from the lowest to the highest, and the class's asymptote (1.05 times
    its mean height)."""
    ends = plots.agg(F.min("height").alias("__lo"), F.max("height").alias("__hi"))
    width = F.when(F.col("__hi") > F.col("__lo"), (F.col("__hi") - F.col("__lo")) / n).otherwise(1.0)
    cls = F.least(F.floor((F.col("height") - F.col("__lo")) / width).cast("int"), F.lit(n - 1)) + 1
    classed = plots.crossJoin(F.broadcast(ends)).withColumn("cls", cls).drop("__lo", "__hi")
    means = classed.groupBy("cls").agg((F.avg("height") * 1.05).alias("asymptote"))
    return classed.join(F.broadcast(means), "cls")  # n rows


@operator("climate")
def rain_curve(storms: DataFrame, step: float = 0.1, n: int = 500) -> DataFrame:
    """a, b, c of intensity = a / (minutes + b)^c: for each of n values of b a least-squares line in logarithms, of which the one
    with the highest r2 (12 digits; ties to the least b) counts.  One row; none for fewer than three storms."""
    rows = storms.where("minutes >= 0 and intensity > 0")
    grid = storms.sparkSession.range(n).select((F.col("id") * F.lit(step)).alias("b"))
    x, y = F.log(F.col("minutes") + F.col("b")), F.log("intensity")
    fits = rows.crossJoin(F.broadcast(grid)).where(F.col("minutes") + F.col("b") > 0).groupBy("b").agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (-F.regr_slope(y, x)).alias("c"), F.regr_r2(y, x).alias("r2"))
    best = fits.where("n >= 3 and r2 is not null").agg(F.max_by(F.struct(F.exp(F.col("my") + F.col("c") * F.col("mx")).alias("a"), "b", "c"), F.struct(F.floor(F.col("r2") * 1e12), -F.col("b"))).alias("f"))
    return best.where("f is not null").select("f.*")


@operator("climate")
def quantile_mapping(observed: DataFrame, past: DataFrame, future: DataFrame) -> DataFrame:
    """id and corrected: each future value (id, v) as the observed value (v) at its place among the past ones (v).  Values beyond
    the past's last have the last place."""
    obs, hist = ranked(observed), ranked(past)
    n_obs, n_hist = observed.where("v is not null").count(), past.where("v is not null").count()
    if not n_obs or not n_hist:
        return future.limit(0).select("id", F.lit(None).cast("double").alias("corrected"))
    # the place of a value: how many past values are smaller, by one sort of both tables in ranges
    both = hist.select("v", "times", F.lit(None).cast("long").alias("id")).unionByName(future.where("v is not null").select("v", F.lit(0).cast("long").alias("times"), F.col("id").cast("long").alias("id")))
    dealt = cut(both.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.sum("times").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    smaller = F.sum("times").over(Window.partitionBy("part").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("times").over(Window.partitionBy("part", "v"))
    placed = dealt.join(F.broadcast(parts.select("part", "before")), "part").withColumn("pos", F.col("before") + smaller).where("id is not null")
    share = F.least(F.col("pos"), F.lit(n_hist - 1)).cast("double") / max(n_hist - 1, 1)
    placed = placed.withColumn("at", F.least(F.floor(share * (n_obs - 1) + 0.5).cast("long"), F.lit(n_obs - 1)))
    wanted = placed.select("at").distinct()
    # each wanted place lies in the run of one observed value: both are merged by place in ranges
    marks = obs.select(F.col("place").alias("at"), F.col("v").alias("corrected")).unionByName(wanted.withColumn("corrected", F.lit(None).cast("double")))
    marks = cut(marks.repartitionByRange("at").withColumn("part", F.spark_partition_id()))
    last = marks.groupBy("part").agg(F.max_by("corrected", F.when(F.col("corrected").isNotNull(), F.col("at"))).alias("last"))
    carried = last.withColumn("carried", F.last("last", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each range
    here = F.last("corrected", True).over(Window.partitionBy("part").orderBy("at", F.col("corrected").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = marks.join(F.broadcast(carried.select("part", "carried")), "part").withColumn("found", F.coalesce(here, F.col("carried")))
    found = filled.where("corrected is null").select("at", F.col("found").alias("corrected"))
    return placed.join(found, "at").select("id", "corrected")


@operator("ecology")
def recreation(cells: DataFrame, access: float = 1.0) -> DataFrame:
    """zone and recreation: the evenness of land cover classes (cls) in a zone, from 0 to 1, times how accessible it is."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("zone"))
    counts = cells.groupBy("zone", "cls").agg(F.count("*").cast("double").alias("n")).withColumn("p", share)
    out = counts.groupBy("zone").agg(F.count("*").alias("k"), (-F.sum(F.col("p") * F.log("p"))).alias("h"))
    even = F.when(F.col("k") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("h") / F.log(F.col("k").cast("double"))))).otherwise(0.0)
    return out.select("zone", (even * access).alias("recreation"))


@operator("ecology")
def carbon_storage(cells: DataFrame, pools: DataFrame, cell_ha: float = 1.0) -> DataFrame:
    """cls, cells and stored: carbon in four pools (above, below, soil, dead; a hectare) by land cover class; classes without
    pools are left out."""
    counts = cells.groupBy("cls").agg(F.count("*").alias("cells"))
    total = F.col("above") + F.col("below") + F.col("soil") + F.col("dead")
    return counts.join(pools, "cls").select("cls", "cells", (F.col("cells") * cell_ha * total).alias("stored"))


@operator("energy")
def pv_year(months: DataFrame, capacity_kw: float, mounting: str = "open_rack", inverter: float = 0.96, dc_ac: float = 1.2, loss_pct: float = 14.0) -> DataFrame:
    """kwh and capacity_factor of a year of months (month from 0, irradiance, air, wind)."""
    days = F.element_at(F.array(*[F.lit(float(x)) for x in city.MONTH_DAYS]), F.col("month") + 1)
    kwh = city.ac_energy_kwh(F.col("irradiance"), F.lit(float(capacity_kw)), F.col("air"), F.col("wind"), days * 24.0, inverter, dc_ac, loss_pct, mounting)
    return months.agg(F.sum(kwh).alias("kwh")).withColumn("capacity_factor", F.col("kwh") / (capacity_kw * 8760.0))
