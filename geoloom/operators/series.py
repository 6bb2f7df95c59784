"""Time series (sid, t, v): trends, breaks, decomposition, recursions.

Pairwise tests run per series in Arrow batches, in blocks so that a long series needs memory in proportion to its length;
recursions fold over the sorted array of a series; everything else is windows partitioned by series.
"""

from __future__ import annotations

from math import erfc, exp, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import operator

TIE = 1e-10
_BLOCK = 512


def _pair_sign_sum(v: np.ndarray) -> int:
    total = 0
    for a in range(0, len(v), _BLOCK):
        part = v[a : a + _BLOCK]
        total += int(np.triu(np.sign(part[None] - part[:, None]), 1).sum())
        rest = v[a + _BLOCK :]
        if len(rest):
            total += int((np.searchsorted(np.sort(rest), part, "left") * -1 + (len(rest) - np.searchsorted(np.sort(rest), part, "right"))).sum())
    return total


def _variance(v: np.ndarray) -> float:
    n = len(v)
    ordered = np.sort(v)
    starts = np.flatnonzero(np.r_[True, np.diff(ordered) >= TIE])
    t = np.diff(np.r_[starts, n]).astype(float)
    return (n * (n - 1) * (2 * n + 5) - (t * (t - 1) * (2 * t + 5)).sum()) / 18.0


def _p_value(s: float, variance: float) -> float:
    z = 0.0 if s == 0 or variance <= 0 else (s - np.sign(s)) / sqrt(variance)
    return erfc(abs(z) / sqrt(2))


def kendall(v: np.ndarray) -> tuple[float, float, int]:
    """tau, p and S of Mann-Kendall; (0, 1, 0) for fewer than three values."""
    n = len(v)
    if n < 3:
        return 0.0, 1.0, 0
    s = _pair_sign_sum(v)
    return s / (n * (n - 1) / 2), _p_value(s, _variance(v)), s


def _slopes(v: np.ndarray, block: int = 1 << 20):
    """The slopes of all pairs, some at a time."""
    n, held, size = len(v), [], 0
    for k in range(1, n):
        held.append((v[k:] - v[:-k]) / k)
        size += n - k
        if size >= block or k == n - 1:
            yield np.concatenate(held)
            held, size = [], 0


def sen(v: np.ndarray, most: int = 1 << 20) -> float:
    """The upper median of the slopes of all pairs, exactly: they are counted in steps between bounds until at most `most` are left
    between the bounds, so memory does not grow with the number of pairs."""
    n = len(v)
    if n < 2:
        return 0.0
    at = n * (n - 1) // 2 // 2
    if n * (n - 1) // 2 <= most:
        slopes = np.concatenate(list(_slopes(v)))
        return float(np.partition(slopes, at)[at])
    low, high = min(s.min() for s in _slopes(v)), max(s.max() for s in _slopes(v))
    steps = 1 << 16
    while True:
        edges = np.linspace(low, high, steps + 1)
        below, counts = 0, np.zeros(steps, np.int64)
        for s in _slopes(v):
            below += int((s < low).sum())
            s = s[(s >= low) & (s <= high)]
            counts += np.bincount(np.clip(np.searchsorted(edges, s, "right") - 1, 0, steps - 1), minlength=steps)
        step = int(np.searchsorted(np.cumsum(counts), at - below, "right"))
        new_low, new_high = edges[step], edges[step + 1]
        if counts[step] <= most or (new_low, new_high) == (low, high) or new_low == new_high:
            break
        low, high = new_low, new_high
    below, held = 0, []
    for s in _slopes(v):
        below += int((s < new_low).sum())
        held.append(s[(s >= new_low) & (s <= new_high)])
    rest = np.concatenate(held)
    return float(np.partition(rest, at - below)[at - below])


def pettitt(v: np.ndarray) -> tuple[int, float, float]:
    """(first place of the largest |U|, |U|, p); U_t is a running sum of twice the mean ranks."""
    n = len(v)
    if n < 3:
        return 0, 0.0, 1.0
    ordered = np.sort(v)
    twice_rank = np.searchsorted(ordered, v, "left") + np.searchsorted(ordered, v, "right") + 1
    u = np.abs(np.cumsum(twice_rank - (n + 1))[: n - 1]).astype(float)
    at = int(u.argmax())
    return (at + 1 if u[at] > 0 else 0), float(u[at]), min(1.0, 2 * exp(-6 * u[at] ** 2 / (n**3 + n**2)))


def _per_series(series: DataFrame, f, schema: str) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        return f(g["sid"].iloc[0], g["t"].to_numpy(), g["v"].to_numpy(float))

    return series.where("v is not null and not isnan(v)").select("sid", "t", "v").groupBy("sid").applyInPandas(run, schema)


@operator("series")
def trend(series: DataFrame) -> DataFrame:
    """n, Mann-Kendall S, tau and p, Sen's slope, and the least-squares line on 0..n-1 with its r2."""

    def one(sid, t, v):
        n = len(v)
        tau, p, s = kendall(v)
        x = np.arange(n)
        sxx = ((x - x.mean()) ** 2).sum()
        slope = ((x - x.mean()) * (v - v.mean())).sum() / max(sxx, TIE) if n > 1 else 0.0
        base = v.mean() - slope * x.mean()
        left = ((v - base - slope * x) ** 2).sum()
        r2 = 1 - left / max(((v - v.mean()) ** 2).sum(), TIE) if n > 1 else 0.0
        return pd.DataFrame([(sid, n, s, tau, p, sen(v), slope, base, r2)], columns=["sid", "n", "s", "tau", "p", "sen_slope", "slope", "intercept", "r2"])

    return _per_series(series, one, "sid string, n long, s long, tau double, p double, sen_slope double, slope double, intercept double, r2 double")


@operator("series")
def change_point(series: DataFrame) -> DataFrame:
    """Pettitt's break: its place, |U|, p, and the means before and after."""

    def one(sid, t, v):
        at, u, p = pettitt(v)
        before = v[:at].mean() if at else 0.0
        return pd.DataFrame([(sid, at, u, p, before, v[at:].mean())], columns=["sid", "break_at", "u", "p", "mean_before", "mean_after"])

    return _per_series(series, one, "sid string, break_at long, u double, p double, mean_before double, mean_after double")


@operator("series")
def seasonal_trend(series: DataFrame, period: int = 12) -> DataFrame:
    """Mann-Kendall over seasons: sums of S and variance of the values at equal places in the period."""

    def one(sid, t, v):
        n = len(v)
        seasons = [v[k::period] for k in range(min(period, n))]
        used = [x for x in seasons if len(x) >= 2]
        if n < 2 * period or not used:
            return pd.DataFrame([(sid, 0, 0.0, 1.0)], columns=["sid", "s", "tau", "p"])
        s = sum(_pair_sign_sum(x) for x in used)
        pairs = sum(len(x) * (len(x) - 1) / 2 for x in used)
        return pd.DataFrame([(sid, s, s / pairs, _p_value(s, sum(_variance(x) for x in used)))], columns=["sid", "s", "tau", "p"])

    return _per_series(series, one, "sid string, s long, tau double, p double")


@operator("series")
def breaks(series: DataFrame, period: int = 12, most: int = 5) -> DataFrame:
    """Breaks of the season-smoothed series, by recursive Pettitt tests on parts of six values or more."""

    def one(sid, t, v):
        n, half = len(v), period // 2
        if period and n >= 2 * period:
            sums = np.concatenate([[0.0], np.cumsum(v)])
            a, b = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
            v = (sums[b] - sums[a]) / (b - a)
        found: list[int] = []
        todo = [(0, n)]
        while todo and len(found) < most:
            a, b = todo.pop(0)
            if b - a < 6:
                continue
            at, _, p = pettitt(v[a:b])
            if p < 0.05 and 1 < at < b - a - 1:
                found.append(a + at)
                todo = [(a, a + at), (a + at, b), *todo]
        # typed, as a frame without rows has no values to take types from
        return pd.DataFrame({"sid": pd.Series([sid] * len(found), dtype=object), "break_at": np.array(sorted(found), np.int64)})

    return _per_series(series, one, "sid string, break_at long")


def _order() -> Window:
    return Window.partitionBy("sid").orderBy("t")


@operator("series")
def decompose(series: DataFrame, period: int = 12) -> DataFrame:
    """Additive parts by window: centred mean over period // 2 values to either side (shorter at the ends), the mean of what is left by place in
    the period less its overall mean, and the rest.  Series shorter than two periods have no seasonal part."""
    half = period // 2
    w = _order()
    out = series.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("sid")))
    out = out.withColumn("trend", F.avg("v").over(w.rowsBetween(-half, half))).withColumn("d", F.col("v") - F.col("trend"))
    out = out.withColumn("raw", F.avg("d").over(Window.partitionBy("sid", F.col("i") % period)))
    centred = F.col("raw") - F.avg("raw").over(Window.partitionBy("sid"))
    out = out.withColumn("seasonal", F.when(F.col("n") >= 2 * period, centred).otherwise(0.0))
    return out.select("sid", "t", "v", "trend", "seasonal", (F.col("v") - F.col("trend") - F.col("seasonal")).alias("rest"))


@operator("series")
def rolling(series: DataFrame, size: int, how: str = "sum") -> DataFrame:
    """Trailing sum or mean of `size` values; the mean is over fewer at the start, the sum null there."""
    w = _order().rowsBetween(-(size - 1), 0)
    if how == "mean":
        return series.select("sid", "t", "v", F.avg("v").over(w).alias("rolled"))
    return series.select("sid", "t", "v", F.when(F.count("*").over(w) == size, F.sum("v").over(w)).alias("rolled"))


@operator("series")
def phases(series: DataFrame, warm: float = 0.5, cold: float = -0.5, run: int = 5) -> DataFrame:
    """The trailing 3-value mean and the phase it is in: warm or cold from the run-th value in a row beyond the limits, else neutral."""
    w = _order()
    out = rolling(series, 3, "mean")
    kind = F.when(F.col("rolled") >= warm, 1).when(F.col("rolled") <= cold, -1).otherwise(0)
    out = out.withColumn("kind", kind).withColumn("new", (F.col("kind") != F.lag("kind", 1, 9).over(w)).cast("int")).withColumn("island", F.sum("new").over(w))
    place = F.row_number().over(Window.partitionBy("sid", "island").orderBy("t"))
    phase = F.when((place >= run) & (F.col("kind") == 1), "warm").when((place >= run) & (F.col("kind") == -1), "cold").otherwise("neutral")
    return out.select("sid", "t", "rolled", phase.alias("phase"))


@operator("series")
def spi(series: DataFrame, size: int = 3) -> DataFrame:
    """Standardised precipitation: trailing sums of `size`, fitted per series by a gamma distribution (Thom's estimate, with the share of zero
    sums), as a normal deviate; null in the first size - 1 places."""

    def one(sid, t, v):
        sums = np.convolve(v, np.ones(size), "valid") if len(v) >= size else np.empty(0)
        out = np.full(len(v), np.nan)
        wet = sums[sums > 0]
        if len(wet) >= 3 and wet.std() > 0:
            a = np.log(wet.mean()) - np.log(wet).mean()
            shape = (1 + sqrt(1 + 4 * a / 3)) / (4 * a)
            dry = 1 - len(wet) / len(sums)
            for k, s in enumerate(sums):
                p = dry + (1 - dry) * gamma_cdf(shape, s / (wet.mean() / shape)) if s > 0 else dry
                out[k + size - 1] = normal_quantile(min(max(p, 1e-6), 1 - 1e-6))
        return pd.DataFrame({"sid": sid, "t": t, "spi": out})

    return _per_series(series, one, "sid string, t int, spi double").withColumn("spi", F.when(~F.isnan("spi"), F.col("spi")))


@operator("series")
def spei(series: DataFrame, size: int = 3) -> DataFrame:
    """Standardised water balance (v = precipitation - evapotranspiration): trailing sums under a log-logistic distribution by probability-weighted
    moments, as a normal deviate."""
    from math import gamma as g

    def one(sid, t, v):
        sums = np.convolve(v, np.ones(size), "valid") if len(v) >= size else np.empty(0)
        out = np.full(len(v), np.nan)
        n = len(sums)
        if n >= 4 and sums.std() > 0:
            x = np.sort(sums)
            f = (np.arange(1, n + 1) - 0.35) / n
            w0, w1, w2 = (((1 - f) ** k * x).mean() for k in range(3))
            beta = (2 * w1 - w0) / (6 * w1 - w0 - 6 * w2)
            if 1 < beta:
                alpha = (w0 - 2 * w1) * beta / (g(1 + 1 / beta) * g(1 - 1 / beta))
                low = w0 - alpha * g(1 + 1 / beta) * g(1 - 1 / beta)
                for k, s in enumerate(sums):
                    p = 1 / (1 + (alpha / (s - low)) ** beta) if s > low and alpha > 0 else 1e-6
                    out[k + size - 1] = normal_quantile(min(max(p, 1e-6), 1 - 1e-6))
        return pd.DataFrame({"sid": sid, "t": t, "spei": out})

    return _per_series(series, one, "sid string, t int, spei double").withColumn("spei", F.when(~F.isnan("spei"), F.col("spei")))


def gamma_cdf(shape: float, x: float) -> float:
    """Regularised lower incomplete gamma function: series below shape + 1, continued fraction above."""
    from math import lgamma, log

    if x <= 0:
        return 0.0
    front = exp(shape * log(x) - x - lgamma(shape))
    if x < shape + 1:
        term = total = 1 / shape
        k = shape
        while abs(term) > 1e-14 * abs(total):
            k += 1
            term *= x / k
            total += term
        return front * total
    b, c = x + 1 - shape, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - shape)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return 1 - front * h


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


# --- recursions: a fold over the sorted values of a series


def _sorted(series: DataFrame, *cols: str) -> DataFrame:
    return series.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("t", *cols))).alias("xs"))


def _fold(series: DataFrame, start: Column, step, names: list[str], cols: tuple[str, ...] = ("v",), run: int = 256) -> DataFrame:
    """Rows (sid, t, names...) of a recursion: step(state, x, i) gives the next state, a struct with those names.  The values are
    folded in runs that carry the state on, so that no long array grows value by value."""
    kind = "array<struct<t:int," + ",".join(f"{n}:double" for n in names) + ">>"
    none = F.array().cast(kind)

    def inner(acc: Column, first: Column) -> Column:
        def add(a: Column, x: Column) -> Column:
            new = step(a["s"], x, first - 1 + F.size(a["out"]))
            row = F.struct(x["t"].cast("int").alias("t"), *[new[n].alias(n) for n in names])
            return F.struct(new.alias("s"), F.concat(a["out"], F.array(row)).alias("out"))

        done = F.aggregate(F.slice("xs", first, run), F.struct(acc["s"].alias("s"), none.alias("out")), add)
        return F.transform(F.array(done), lambda d: F.struct(d["s"].alias("s"), F.concat(acc["out"], d["out"]).alias("out")))[0]

    firsts = F.sequence(F.lit(1), F.greatest(F.size("xs"), F.lit(1)), F.lit(run))
    folded = F.aggregate(firsts, F.struct(start.alias("s"), none.alias("out")), inner, lambda acc: acc["out"])
    return _sorted(series, *cols).select("sid", F.explode(folded).alias("o")).select("sid", "o.*")


@operator("series")
def autoregression(series: DataFrame, keep: float = 0.8) -> DataFrame:
    """x_t = v_t + keep x_{t-1} (a drought index is this with anomalies and 0.8)."""
    return _fold(series, F.struct(F.lit(0.0).alias("x")), lambda s, x, i: F.struct((x["v"] + keep * s["x"]).alias("x")), ["x"])


def muskingum_weights(k: float, x: float, dt: float) -> tuple[float, float, float]:
    d = 2 * k * (1 - x) + dt
    return (dt - 2 * k * x) / d, (dt + 2 * k * x) / d, (2 * k * (1 - x) - dt) / d


@operator("series")
def muskingum(series: DataFrame, k: float = 12.0, x: float = 0.2, dt: float = 6.0) -> DataFrame:
    """Channel routing of inflows v: outflow, the first equal to the inflow, never negative."""
    a, b, c = muskingum_weights(k, x, dt)
    start = F.struct(F.lit(0.0).alias("outflow"), F.lit(0.0).alias("inflow"))

    def step(s: Column, row: Column, i: Column) -> Column:
        out = F.when(i == 0, row["v"]).otherwise(F.greatest(F.lit(0.0), a * row["v"] + b * s["inflow"] + c * s["outflow"]))
        return F.struct(out.alias("outflow"), row["v"].alias("inflow"))

    return _fold(series, start, step, ["outflow"])


@operator("series")
def linear_reservoir(series: DataFrame, k: float = 4.0, dt: float = 1.0) -> DataFrame:
    """o_t = c v_t + (1 - c) o_{t-1} with c = 2 dt / (2 k + dt)."""
    c = 2 * dt / (2 * k + dt)
    return _fold(series, F.struct(F.lit(0.0).alias("outflow")), lambda s, x, i: F.struct((c * x["v"] + (1 - c) * s["outflow"]).alias("outflow")), ["outflow"])


@operator("series")
def snowpack(series: DataFrame, t_rain: float = 1.0, t_base: float = 0.0, degree_day: float = 3.0, refreeze: float = 0.05, holds: float = 0.05) -> DataFrame:
    """Degree-day snow of days (temp, precip): rain, snow, melt, refrozen, outflow and the pack after the day."""
    start = F.struct(*[F.lit(0.0).alias(n) for n in ("rain", "snow", "melt", "frozen", "outflow", "swe")])

    def step(s: Column, d: Column, i: Column) -> Column:
        warm = d["temp"] >= t_rain
        rain, snow = F.when(warm, d["precip"]).otherwise(0.0), F.when(warm, 0.0).otherwise(d["precip"])
        swe = s["swe"] + snow
        melt = F.least(F.greatest(F.lit(0.0), degree_day * (d["temp"] - t_base)), swe)
        frozen = F.when(d["temp"] < t_base, F.least(refreeze * (t_base - d["temp"]), swe * holds)).otherwise(0.0)
        left = swe + frozen - melt
        out = F.greatest(F.lit(0.0), rain + melt - left * holds)
        return F.struct(rain.alias("rain"), snow.alias("snow"), melt.alias("melt"), frozen.alias("frozen"), out.alias("outflow"), left.alias("swe"))

    return _fold(series, start, step, ["rain", "snow", "melt", "frozen", "outflow", "swe"], ("temp", "precip"))


@operator("series")
def convolve(series: DataFrame, ordinates: list) -> DataFrame:
    """The response to v under unit-hydrograph ordinates: each value spreads over the following places, then sums."""
    w = _order()
    rows = series.withColumn("i", F.row_number().over(w) - 1)
    spread = rows.select("sid", "i", "v", F.posexplode(F.array(*[F.lit(float(u)) for u in ordinates])).alias("k", "u"))
    return spread.groupBy("sid", (F.col("i") + F.col("k")).alias("step")).agg(F.sum(F.col("v") * F.col("u")).alias("flow"))


# --- stacks of rasters (r, c, year, z)


@operator("series")
def pixel_slope(stack: DataFrame) -> DataFrame:
    """Least-squares slope of z by year for each cell; null if a year has no data."""
    complete = F.count("z") == F.count("*")
    return stack.groupBy("r", "c").agg(F.when(complete, F.regr_slope(F.col("z"), F.col("year").cast("double"))).alias("slope"))


@operator("series")
def pixel_trend(stack: DataFrame, least: int = 4) -> DataFrame:
    """Mann-Kendall tau of each cell over the years, on its sorted array; null if a year has no data or there are fewer than `least`."""
    xs = stack.groupBy("r", "c").agg(F.array_sort(F.collect_list(F.struct("year", "z"))).alias("xs"), (F.count("z") == F.count("*")).alias("full"))
    n = F.size("xs")
    each = F.transform("xs", lambda a, i: F.aggregate(F.slice("xs", i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(0.0), lambda s, b: s + F.signum(b["z"] - a["z"])))
    s = F.aggregate(each, F.lit(0.0), lambda a, v: a + v)
    return xs.select("r", "c", F.when(F.col("full") & (n >= least), s / (n * (n - 1) / 2)).alias("tau"))


@operator("series")
def change_detection(stack: DataFrame, before: int, after: int, limit: float) -> DataFrame:
    """The difference of two years where it is beyond the limit, else 0: -1, 0, 1 and the change; null without data."""
    both = stack.where(F.col("year").isin(before, after)).groupBy("r", "c").agg(F.max(F.when(F.col("year") == before, F.col("z"))).alias("a"), F.max(F.when(F.col("year") == after, F.col("z"))).alias("b"))
    d = F.col("b") - F.col("a")
    return both.select("r", "c", d.alias("change"), F.when(d.isNotNull(), F.when(F.abs(d) > limit, F.signum(d)).otherwise(0.0)).cast("int").alias("kind"))


@operator("series")
def yearly_stats(stack: DataFrame) -> DataFrame:
    return stack.groupBy("year").agg(F.avg("z").alias("mean"), F.count("z").alias("valid"))


def water_level(prediction: list[tuple[float, float, float]], t: Column) -> Column:
    """A tide: the sum of amplitude cos(speed t + phase)."""
    total = F.lit(0.0)
    for amplitude, speed, phase in prediction:
        total = total + amplitude * F.cos(speed * t + phase)
    return total


