"""Forest growth, sites, harvests and stocks on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import choose, clamp

BREAST_HEIGHT = 1.3
#: Carbon to carbon dioxide, by mass.
CO2_PER_C = 44.0 / 12.0

# fixed values: heights of site classes I to V at 20 years, growth curve and its parameters, by species
SPECIES = {
    "pinus_massoniana": ((20.0, 16.0, 12.0, 8.0, 5.0), "richards", (25.0, 0.15, 1.5)),
    "cunninghamia": ((22.0, 17.5, 13.0, 9.0, 5.5), "richards", (28.0, 0.12, 1.6)),
    "eucalyptus": ((25.0, 20.0, 15.0, 10.0, 6.0), "logistic", (30.0, 8.0, 0.25)),
    "quercus": ((18.0, 14.0, 10.5, 7.0, 4.0), "richards", (22.0, 0.10, 1.4)),
    "poplar": ((28.0, 22.0, 16.0, 10.0, 6.0), "richards", (35.0, 0.18, 1.3)),
    "larix": ((21.0, 17.0, 13.0, 9.0, 5.5), "richards", (26.0, 0.14, 1.5)),
}
SITE_CLASSES = ("I", "II", "III", "IV", "V")

#: Growth curves of age t with three parameters, above breast height.
CURVES = {
    "richards": lambda t, a, b, c: a * F.pow(1.0 - F.exp(-b * t), c),
    "logistic": lambda t, a, b, c: a / (1.0 + b * F.exp(-c * t)),
    "korf": lambda t, a, b, c: a * F.exp(-b * F.pow(t, -c)),
    "gompertz": lambda t, a, b, c: a * F.exp(-b * F.exp(-c * t)),
    "weibull": lambda t, a, b, c: a * (1.0 - F.exp(-b * F.pow(t, c))),
    "schumacher": lambda t, a, b, c: a * F.exp(-b / t),
}


def _lits(values) -> list[Column]:
    return [v if isinstance(v, Column) else F.lit(float(v)) for v in values]


def tree_height(model: str, age: Column, a, b, c) -> Column:
    """Height in metres at an age in years."""
    return CURVES[model](age, *_lits((a, b, c))) + F.lit(BREAST_HEIGHT)


def stand_biomass(age: Column, sdi: Column, a: float, b: float, c: float, d: float) -> Column:
    """Biomass of a stand of a density index; 0 where nothing has grown."""
    grown = F.pow(sdi / 1000.0, F.lit(c)) * age
    return F.when(grown * b < 1e-16, 0.0).otherwise(F.lit(a) * F.pow(1.0 - F.exp(-b * grown), F.lit(d)))


def site_curve(model: str, age: Column, a, b, c) -> Column:
    """The dominant height at an age, 0 before growth begins."""
    a, b, c = _lits((a, b, c))
    return F.when((age <= 0) | (a <= 0), 0.0).otherwise(CURVES[model](age, a, b, c))


def site_index(species: Column, site_class: Column, base_age: Column) -> Column:
    """The height of a site class at a base age: the table's at 20 years, else along the species' curve; 0 for other
    species, class III for other classes."""
    out = F.lit(0.0)
    for name, (heights, model, params) in SPECIES.items():
        at_20 = choose(F.upper(site_class), dict(zip(SITE_CLASSES, heights)), heights[2])
        moved = site_curve(model, base_age, *params) * (at_20 / site_curve(model, F.lit(20.0), *params))
        out = F.when(F.lower(species) == name, F.when(base_age == 20, at_20).otherwise(moved)).otherwise(out)
    return out


def site_class_of(species: Column, height: Column, age: Column) -> Column:
    """The class whose height at this age is nearest (ties to the better class); null for other species."""
    out = F.lit(None).cast("string")
    for name, (heights, model, params) in SPECIES.items():
        here, at_20 = site_curve(model, age, *params), site_curve(model, F.lit(20.0), *params)
        far = [F.struct(F.abs(height - here * (F.lit(h) / at_20)).alias("far"), F.lit(i).alias("i")) for i, h in enumerate(heights)]
        best = F.element_at(F.array(*[F.lit(x) for x in SITE_CLASSES]), F.array_min(F.array(*far))["i"] + 1)
        out = F.when(F.lower(species) == name, best).otherwise(out)
    return out


def site_productivity(index_m: Column, rotation: Column) -> Column:
    return F.when(rotation == 0, 0.0).otherwise(index_m / rotation)


def share(intensity_pct: Column) -> Column:
    return clamp(intensity_pct, 0.0, 100.0) / 100.0


def selective_retained(basal_area: Column, intensity_pct: Column) -> Column:
    """Basal area that a selective harvest leaves."""
    return basal_area - basal_area * share(intensity_pct)


def clearcut_volume(area_ha: Column, volume_ha: Column) -> Column:
    return area_ha * volume_ha


def shelterwood_removal(phase: Column) -> Column:
    """The share of the volume that a phase removes."""
    return choose(F.lower(phase), {"preparatory": 0.30, "prep": 0.30, "establishment": 0.40, "est": 0.40, "removal": 1.0, "final": 1.0}, 0.0)


def harvest_carbon_loss(area_ha: Column, stock_ha: Column, intensity_pct: Column) -> Column:
    return stock_ha * area_ha * share(intensity_pct)


def harvest_carbon_net(area_ha: Column, stock_ha: Column, intensity_pct: Column, regrowth_ha_yr: Column, years: Column) -> Column:
    """Regrowth over the years less what the harvest takes; a sink if not negative."""
    return regrowth_ha_yr * area_ha * years - harvest_carbon_loss(area_ha, stock_ha, intensity_pct)


def harvest_payback_years(area_ha: Column, stock_ha: Column, intensity_pct: Column, regrowth_ha_yr: Column) -> Column:
    """Years until regrowth makes up for the harvest; -1 if it never does."""
    return F.when(regrowth_ha_yr * area_ha > 0, harvest_carbon_loss(area_ha, stock_ha, intensity_pct) / (regrowth_ha_yr * area_ha)).otherwise(-1.0)


def sustainable_yield(area_ha: Column, volume_ha: Column, rotation: Column, growth_ha_yr: Column) -> Column:
    """The lesser of the yield by area and the yield by growth."""
    grown = area_ha * growth_ha_yr
    return F.when(rotation == 0, grown).otherwise(F.least(area_ha * volume_ha / rotation, grown))


def volume_to_carbon(volume_m3: Column, expansion: float = 1.5, density: float = 0.45, root_shoot: float = 0.25, fraction: float = 0.47) -> Column:
    """Tonnes of carbon in so much stem volume, with branches and roots."""
    return volume_m3 * (expansion * density * (1.0 + root_shoot) * fraction)


def annual_sink(volume_change_m3: Column, years: Column) -> Column:
    """Tonnes of carbon dioxide a year; negative for a sink."""
    return -volume_to_carbon(volume_change_m3) * CO2_PER_C / F.greatest(years, F.lit(1.0))


def sink_grade(sink: Column) -> Column:
    return F.when(sink < -50, "excellent").when(sink < -10, "good").when(sink < 0, "weak").otherwise("source")


def sink_potential(potential_t_ha: Column, realized_t_ha: Column, fraction: float = 0.47) -> Column:
    """Carbon dioxide that the gap between possible and realised growth could hold."""
    return F.greatest(potential_t_ha - realized_t_ha, F.lit(0.0)) * (fraction * CO2_PER_C)
