"""Spatial statistics on sparse weights: edges (i, j, w) instead of N x N matrices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.base import normal_cdf
from ..registry import operator
from ..session import cut

ROOK = [(-1, 0), (1, 0), (0, -1), (0, 1)]
QUEEN = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def grid_weights(cells: DataFrame, steps: list[tuple[int, int]], with_self: bool = False) -> DataFrame:
    """Edges (r, c, nr, nc, w = 1) between cells that exist."""
    steps = steps + [(0, 0)] * with_self
    around = F.explode(F.array(*[F.struct((F.col("r") + a).alias("nr"), (F.col("c") + b).alias("nc")) for a, b in steps]))
    out = cells.select("r", "c", around.alias("n")).select("r", "c", "n.*")
    return out.join(cells.select(F.col("r").alias("nr"), F.col("c").alias("nc")), ["nr", "nc"], "left_semi").withColumn("w", F.lit(1.0))


@operator("stats")
def morans_i(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Moran's I of values (i, v) under edges (i, j, w), with its expectation, variance under normality (Cliff and Ord), z and
    two-sided p: one row, null statistics where the values or the weights are constant or empty."""
    stats = values.agg(F.count("*").cast("double").alias("n"), F.avg("v").alias("mean"), F.sum(F.col("v") * F.col("v")).alias("sq"))
    mean = F.broadcast(stats)  # one row
    dev = values.crossJoin(mean).select("i", (F.col("v") - F.col("mean")).alias("d"))
    left = edges.join(dev.withColumnRenamed("d", "di"), "i")
    both = left.join(dev.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    num = both.agg(F.sum(F.col("w") * F.col("di") * F.col("dj")).alias("num"), F.sum("w").alias("s0"))
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("wb"))
    s1 = edges.join(back, ["i", "j"], "full").agg((0.5 * F.sum((F.coalesce("w", F.lit(0.0)) + F.coalesce("wb", F.lit(0.0))) * (F.coalesce("w", F.lit(0.0)) + F.coalesce("wb", F.lit(0.0))))).alias("s1"))
    ends = edges.select("i", "w").unionByName(edges.select(F.col("j").alias("i"), "w")).groupBy("i").agg(F.sum("w").alias("t"))
    s2 = ends.agg(F.sum(F.col("t") * F.col("t")).alias("s2"))
    sse = dev.agg(F.sum(F.col("d") * F.col("d")).alias("sse"))
    one = stats.crossJoin(num).crossJoin(s1).crossJoin(s2).crossJoin(sse)  # five tables of one row
    n, s0 = F.col("n"), F.col("s0")
    i = F.when((F.col("sse") > 0) & (s0 > 0), n / s0 * F.col("num") / F.col("sse"))
    expected = -1.0 / (n - 1.0)
    variance = (n * n * F.col("s1") - n * F.col("s2") + 3.0 * s0 * s0) / ((n * n - 1.0) * s0 * s0) - expected * expected
    z = F.when(F.col("variance") > 0, (F.col("i") - F.col("expected")) / F.sqrt("variance"))
    out = one.select(n.cast("long").alias("n"), i.alias("i"), expected.alias("expected"), variance.alias("variance"), s0.alias("weight_sum"))
    return out.withColumn("z", z).withColumn("p", 2.0 * (1.0 - normal_cdf(F.abs("z"))))


@operator("stats")
def getis_ord(values: DataFrame, edges: DataFrame, confidence: float = 0.05) -> DataFrame:
    """Gi* of each value (i, v) under edges (i, j, w): z, p and whether it is a hot or cold spot; z 0 without weights."""
    cut = 2.5758 if confidence <= 0.01 else 1.96 if confidence <= 0.05 or confidence > 0.1 else 1.6449
    one = F.broadcast(values.agg(F.count("*").cast("double").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")))
    local = edges.join(values.select(F.col("i").alias("j"), "v"), "j").groupBy("i").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * F.col("v")).alias("swx"), F.count("*").alias("neighbours"))
    out = values.select("i", "v").join(local, "i", "left").crossJoin(one)
    spread = F.col("std") * F.sqrt(F.greatest(F.lit(0.0), (F.col("n") * F.col("sw2") - F.col("sw") * F.col("sw")) / (F.col("n") - 1.0)))
    z = F.when(spread > 0, (F.col("swx") - F.col("mean") * F.col("sw")) / spread).otherwise(0.0)
    out = out.withColumn("z", z)
    p = 2.0 * (1.0 - normal_cdf(F.abs("z")))
    return out.select("i", "z", p.alias("p"), (F.col("z") >= cut).alias("hot"), (F.col("z") <= -cut).alias("cold"), F.coalesce("swx", F.lit(0.0)).alias("local_sum"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


@operator("stats")
def ols(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """Least squares of y on x: n, slope, intercept, r2, rmse and the standard errors (null for fewer than 3 pairs); pairs with a
    null or non-finite part are left out."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    rows = pairs.where(finite("x") & finite("y"))
    g = rows.groupBy(by) if by else rows.groupBy()
    s = g.agg(F.count("*").cast("double").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_sxx(F.col("y"), F.col("x")).alias("sxx"), F.regr_sxy(F.col("y"), F.col("x")).alias("sxy"), F.regr_syy(F.col("y"), F.col("x")).alias("syy"))
    s = s.withColumn("slope", F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx"))).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    s = s.withColumn("sse", F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy")))
    s = s.withColumn("rmse", F.when(F.col("n") > 2, F.sqrt(F.col("sse") / (F.col("n") - 2.0))))
    keep = ([by] if by else []) + ["n", "slope", "intercept"]
    return s.select(*keep, F.when(F.col("syy") > 0, 1.0 - F.col("sse") / F.col("syy")).alias("r2"), "rmse", (F.col("rmse") / F.sqrt("sxx")).alias("se_slope"), (F.col("rmse") * F.sqrt(1.0 / F.col("n") + F.col("mx") * F.col("mx") / F.col("sxx"))).alias("se_intercept"))


def predict(x: Column, slope: Column, intercept: Column) -> Column:
    return intercept + slope * x


def ranked(values: DataFrame) -> DataFrame:
    """v, times and place: each distinct value (v) with how often it comes, and the place of its first one among the sorted values,
    from 0.  Equal values are counted first, and ranges of values are sorted apart, in a table that is written once."""
    counted = values.where("v is not null").groupBy("v").agg(F.count("*").alias("times"))
    dealt = cut(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.sum("times").alias("s"))  # a row for each range
    before = F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("times").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.join(F.broadcast(parts), "part").select("v", "times", (F.col("before") + F.coalesce(inside, F.lit(0))).alias("place"))


@operator("stats")
def quantile_breaks(values: DataFrame, k: int = 5) -> DataFrame:
    """The k - 1 values at places round(i n / k) of the sorted values (v); no rows for fewer than k values.  Nothing is sorted in one task."""
    n = values.where("v is not null").count()
    if n < k or k < 2:
        return values.sparkSession.createDataFrame([], "i int, value double")
    places = values.sparkSession.createDataFrame([(i, min(int(i * n / k + 0.5), n - 1)) for i in range(1, k)], "i int, at long")
    met = ranked(values).join(F.broadcast(places), (F.col("at") >= F.col("place")) & (F.col("at") < F.col("place") + F.col("times")))
    return met.select("i", F.col("v").cast("double").alias("value"))


@operator("stats")
def darkest_mean(values: DataFrame, share: float = 0.01) -> DataFrame:
    """haze: the mean of the lowest share of the values (v), rounded down to whole values; null for none."""
    want = int(values.where("v is not null").count() * share)
    took = F.least(F.col("times"), F.lit(want) - F.col("place"))
    return ranked(values).where(F.col("place") < want).agg((F.sum(F.col("v") * took) / F.sum(took)).alias("haze"))


@operator("stats")
def equal_interval_breaks(values: DataFrame, k: int = 5) -> DataFrame:
    """The k - 1 inner limits of equal steps from the least to the greatest value."""
    ends = values.agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a is not null")
    i = F.explode(F.sequence(F.lit(1), F.lit(k - 1)))
    return ends.withColumn("i", i).select("i", (F.col("a") + F.col("i") * (F.col("b") - F.col("a")) / float(k)).alias("value"))


def _next_class(best: np.ndarray, cost: Callable) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least best[i] + cost(i, j) over i < j, and the first such i.  As that i never falls when j grows, all
    middles of a level are searched at once between the places of their neighbours."""
    m = len(best) - 1
    new, cut_at = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
    todo = np.array([[1, m, 0, m - 1]]) if m else np.empty((0, 4), int)
    while len(todo):
        low, high, first, last = todo.T
        mid = (low + high) // 2
        last_here = np.minimum(last, mid - 1)
        size = last_here - first + 1
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        i = np.repeat(first - start, size) + np.arange(int(size.sum()))
        total = best[i] + cost(i, np.repeat(mid, size))
        least = np.minimum.reduceat(total, start)
        hit = np.flatnonzero(total == np.repeat(least, size))
        at = i[hit[np.searchsorted(hit, start)]]
        new[mid], cut_at[mid] = least, at
        halves = np.concatenate([np.stack([low, mid - 1, first, at], 1), np.stack([mid + 1, high, at, last], 1)])
        todo = halves[halves[:, 0] <= halves[:, 1]]
    return new, cut_at


@operator("stats")
def jenks_breaks(values: DataFrame, k: int = 5, bins: int = 0) -> DataFrame:
    """Natural breaks: the k classes of the sorted values with the least squared deviations, and the goodness of fit.  Exact, over all
    distinct values, which are counted first and of which the driver holds four numbers each; with `bins` over that many equal steps instead."""
    rows = values.where("v is not null").withColumn("g", F.col("v"))
    if bins:
        a, b = rows.agg(F.min("v"), F.max("v")).first()
        step = (b - a) / bins if a is not None and b > a else 1.0
        rows = rows.withColumn("g", F.least(F.lit(bins - 1), F.floor((F.col("v") - F.lit(a)) / step)))
    got = rows.groupBy("g").agg(F.count("*").cast("double").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.max("v").alias("top")).toPandas().sort_values("g")
    n, s, q, top = (np.concatenate([[0.0], np.cumsum(got[c])]) if c != "top" else got[c].to_numpy() for c in ("n", "s", "q", "top"))
    m = len(top)
    if not m:
        return values.sparkSession.createDataFrame([], "i int, value double, gvf double")
    k = min(k, m)
    cost = lambda i, j: (q[j] - q[i]) - (s[j] - s[i]) ** 2 / np.maximum(n[j] - n[i], 1)
    best = cost(np.zeros(m + 1, int), np.arange(m + 1))
    back = []
    for _ in range(1, k):
        best, cut_at = _next_class(best, cost)
        back.append(cut_at)
    ends, j = [], m
    for cut_at in reversed(back):
        j = int(cut_at[j])
        ends.append(j)
    whole = cost(0, m)
    fit = 1.0 - best[m] / whole if whole > 0 else 1.0
    breaks = [float(top[e - 1]) for e in reversed(ends) if e > 0]
    return values.sparkSession.createDataFrame([(i + 1, v, float(fit)) for i, v in enumerate(breaks)], "i int, value double, gvf double")


def classify(v: Column, breaks: list[float]) -> Column:
    """The number of the first break at or above v; the last class beyond."""
    out = None
    for i, b in enumerate(breaks):
        out = F.when(v <= b, i) if out is None else out.when(v <= b, i)
    return out.otherwise(len(breaks)) if out is not None else F.lit(0)


@operator("stats")
def kmeans(rows: DataFrame, k: int, rounds: int = 50, seed: int = 42, tolerance: float = 1e-6) -> DataFrame:
    """id and cluster (0..k-1) of rows (id, features array<double>), by Lloyd's algorithm from k-means++ starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.select("id", array_to_vector(F.col("features").cast("array<double>")).alias("x"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, tol=tolerance, featuresCol="x", predictionCol="cluster", initMode="k-means||").fit(data)
    return model.transform(data).select("id", "cluster")


@operator("stats")
def kernel_density(points: DataFrame, cols: int, rows: int, box: list, bandwidth: float) -> DataFrame:
    """Gaussian density (r, c, density) of points (x, y) at cell centres, cut off at three bandwidths; only cells that points reach."""
    x0, y0, x1, y1 = box
    w, h = (x1 - x0) / cols, (y1 - y0) / rows
    reach_x, reach_y = int(3 * bandwidth / w) + 1, int(3 * bandwidth / h) + 1
    # points of one cell offset meet the same cells: the cell is exploded, not searched
    p = points.select("x", "y", F.floor((F.col("x") - x0) / w).alias("pc"), F.floor((F.col("y") - y0) / h).alias("pr"))
    p = p.withColumn("c", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pc") - reach_x), F.least(F.lit(cols - 1), F.col("pc") + reach_x)))) if cols else p
    p = p.where((F.col("c") >= 0) & (F.col("c") < cols))
    p = p.withColumn("r", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pr") - reach_y), F.least(F.lit(rows - 1), F.col("pr") + reach_y)))).where((F.col("r") >= 0) & (F.col("r") < rows))
    dx, dy = x0 + (F.col("c") + 0.5) * w - F.col("x"), y0 + (F.col("r") + 0.5) * h - F.col("y")
    d2 = dx * dx + dy * dy
    near = p.where(d2 <= (3 * bandwidth) ** 2)
    return near.groupBy("r", "c").agg(F.sum(F.exp(-0.5 * d2 / (bandwidth * bandwidth)) / (2 * 3.141592653589793 * bandwidth * bandwidth)).alias("density"))


def silverman(points: DataFrame) -> float:
    """Silverman's bandwidth of points (x, y): one aggregate row."""
    n, sx, sy = points.agg(F.count("*"), F.stddev_pop("x"), F.stddev_pop("y")).first()
    sigma = max(min(sx or 0.0, sy or 0.0), 0.001)
    return (4 * sigma**5 / (3 * n)) ** 0.2 if n else sigma


@operator("stats")
def line_density(lines: DataFrame, cols: int, rows: int, box: list) -> DataFrame:
    """Length of segments (x1, y1, x2, y2) in each cell (r, c) of a grid, by cell area; only cells that segments meet."""
    x0, y0, x1, y1 = box
    w, h = (x1 - x0) / cols, (y1 - y0) / rows
    at = lambda v, low, step, n: F.greatest(F.lit(-1), F.least(F.lit(n), F.floor((v - low) / step))).cast("long")
    span = lambda a, b, low, step, n: F.sequence(F.greatest(F.lit(0).cast("long"), F.least(at(F.col(a), low, step, n), at(F.col(b), low, step, n))), F.least(F.lit(n - 1).cast("long"), F.greatest(at(F.col(a), low, step, n), at(F.col(b), low, step, n))))
    meets = (F.greatest("x1", "x2") >= x0) & (F.least("x1", "x2") <= x1) & (F.greatest("y1", "y2") >= y0) & (F.least("y1", "y2") <= y1)
    cells = lines.where(meets).withColumn("c", F.explode(span("x1", "x2", x0, w, cols))).withColumn("r", F.explode(span("y1", "y2", y0, h, rows)))
    bx, by = x0 + F.col("c") * w, y0 + F.col("r") * h
    cells = cells.withColumn("len", geometry.segment_in_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), bx, by, bx + w, by + h)).where("len > 0")
    return cells.groupBy("r", "c").agg((F.sum("len") / (w * h)).alias("density"))


@operator("stats")
def idw_grid(points: DataFrame, cols: int, rows: int, box: list, power: float = 2.0, radius: float = 10.0, least: int = 1) -> DataFrame:
    """Inverse distance weights at cell centres (rows from the top): r, c, z and how many points (x, y, z) within the radius took part; a
    point on the centre decides alone (the least z of several).  Cells with fewer than `least` points have no row."""
    x0, y0, x1, y1 = box
    w, h = (x1 - x0) / cols, (y1 - y0) / rows
    p = points.where("z is not null")
    c0, c1 = F.ceil((F.col("x") - radius - x0) / w - 0.5), F.floor((F.col("x") + radius - x0) / w - 0.5)
    r0, r1 = F.ceil((y1 - F.col("y") - radius) / h - 0.5), F.floor((y1 - F.col("y") + radius) / h - 0.5)
    p = p.withColumns({"c0": F.greatest(F.lit(0), c0), "c1": F.least(F.lit(cols - 1), c1), "r0": F.greatest(F.lit(0), r0), "r1": F.least(F.lit(rows - 1), r1)}).where("c0 <= c1 and r0 <= r1")
    p = p.withColumn("c", F.explode(F.sequence("c0", "c1"))).withColumn("r", F.explode(F.sequence("r0", "r1")))
    dx, dy = x0 + (F.col("c") + 0.5) * w - F.col("x"), y1 - (F.col("r") + 0.5) * h - F.col("y")
    p = p.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= radius)
    on = F.col("d") < 1e-12
    g = p.groupBy("r", "c").agg(F.min(F.when(on, F.col("z"))).alias("exact"), F.sum(F.when(~on, F.col("z") / F.pow("d", F.lit(power)))).alias("s"), F.sum(F.when(~on, 1.0 / F.pow("d", F.lit(power)))).alias("sw"), F.count("*").alias("n"))
    return g.where((F.col("n") >= least) | F.col("exact").isNotNull()).select("r", "c", F.coalesce("exact", F.col("s") / F.col("sw")).alias("z"), "n")


@operator("stats")
def semivariogram(points: DataFrame, lag: float, lags: int) -> DataFrame:
    """Half the mean squared difference of pairs of points (id, x, y, z) by distance class: bin, pairs, mean distance, gamma.  Pairs are
    found through cells as wide as the longest distance, each once."""
    reach = lag * lags
    cell = lambda v: F.floor(F.col(v) / reach).cast("long")
    p = points.where("z is not null").withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    a = p.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "x", "y", "z")], F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"), "cy")
    a = a.withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
    dx, dy = F.col("a_x") - F.col("x"), F.col("a_y") - F.col("y")
    pairs = a.join(p, ["cx", "cy"]).where("a_id < id").withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") < reach)
    return pairs.groupBy(F.floor(F.col("d") / lag).cast("int").alias("bin")).agg(F.count("*").alias("pairs"), F.avg("d").alias("distance"), (F.avg((F.col("a_z") - F.col("z")) * (F.col("a_z") - F.col("z"))) / 2.0).alias("gamma"))


def variogram_model(h: Column, model: str, nugget: float, sill: float, reach: float) -> Column:
    """Spherical, exponential or gaussian semivariance at distance h."""
    s = h / reach
    if model == "spherical":
        shape = F.when(s < 1.0, 1.5 * s - 0.5 * s * s * s).otherwise(1.0)
    else:
        shape = 1.0 - F.exp(-3.0 * (s if model == "exponential" else s * s))
    return F.when(h <= 0, 0.0).otherwise(nugget + (sill - nugget) * shape)


@operator("stats")
def kriging(targets: DataFrame, points: DataFrame, model: str, nugget: float, sill: float, reach: float, neighbours: int = 12) -> DataFrame:
    """Ordinary kriging of targets (q_id, q_x, q_y) from their nearest points (p_id, p_x, p_y, z): q_id, z and its variance.  Neighbours come
    from the kNN join; each target's small system is solved on its own."""
    import numpy as np
    import pandas as pd

    from .joins import knn

    near = knn(targets, points.select("p_id", "p_x", "p_y"), neighbours).join(points.select("p_id", "p_x", "p_y", "z"), "p_id").join(targets, "q_id")

    def gamma(h: np.ndarray) -> np.ndarray:
        s = h / reach
        shape = np.where(s < 1, 1.5 * s - 0.5 * s**3, 1.0) if model == "spherical" else 1 - np.exp(-3 * (s if model == "exponential" else s * s))
        return np.where(h <= 0, 0.0, nugget + (sill - nugget) * shape)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("p_id")
        xy, q = g[["p_x", "p_y"]].to_numpy(), g[["q_x", "q_y"]].to_numpy()[0]
        n = len(g)
        a = np.ones((n + 1, n + 1))
        a[n, n] = 0
        a[:n, :n] = gamma(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)))
        b = np.append(gamma(np.sqrt(((xy - q) ** 2).sum(1))), 1.0)
        w = np.linalg.lstsq(a, b, rcond=None)[0]
        return pd.DataFrame({"q_id": [g["q_id"].iloc[0]], "z": [float(w[:n] @ g["z"].to_numpy())], "variance": [max(0.0, float(w @ b))]})

    return near.groupBy("q_id").applyInPandas(solve, "q_id long, z double, variance double")


@operator("stats")
def transition_matrix(pairs: DataFrame, classes: int) -> DataFrame:
    """from_class, to_class, p over all classes: the share of cells (a, b) that went from one to the other; a class without cells stays."""
    counts = pairs.where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    rows = counts.groupBy("a").agg(F.sum("n").alias("total"))
    every = pairs.sparkSession.range(classes * classes).select((F.floor(F.col("id") / classes)).cast("int").alias("a"), (F.col("id") % classes).cast("int").alias("b"))
    out = every.join(counts, ["a", "b"], "left").join(rows, "a", "left")
    p = F.when(F.col("total").isNull(), F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)).otherwise(F.coalesce("n", F.lit(0)) / F.col("total"))
    return out.select(F.col("a").alias("from_class"), F.col("b").alias("to_class"), p.alias("p"))


@operator("stats")
def information_value(cells: DataFrame) -> DataFrame:
    """factor, class, cells, events and ln(density in the class / density overall) of cells (factor, class, event 0/1); -5 without events."""
    n = cells.groupBy("factor", "class").agg(F.count("*").cast("double").alias("cells"), F.sum("event").cast("double").alias("events"))
    w = Window.partitionBy("factor")
    total, hit = F.sum("cells").over(w), F.sum("events").over(w)
    value = F.when((F.col("events") > 0) & (hit > 0), F.greatest(F.lit(-5.0), F.ln((F.col("events") / F.col("cells")) / (hit / total)))).otherwise(-5.0)
    return n.select("factor", "class", "cells", "events", value.alias("value"))


@operator("stats")
def monte_carlo(items: DataFrame, runs: int = 1000, spread: float = 0.2, seed: int = 42) -> DataFrame:
    """The total of items (activity, factor) with every factor moved by up to +-spread, over so many runs: mean, median (upper), p5, p95,
    population deviation and variation.  Draws are hashes of run and item, so a run is the same wherever its rows lie."""
    drawn = items.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    u = F.pmod(F.xxhash64(F.lit(seed), "run", "item"), F.lit(1 << 30)) / float(1 << 30)
    totals = drawn.groupBy("run").agg(F.sum(F.col("activity") * F.col("factor") * (1.0 + spread * (2.0 * u - 1.0))).alias("total"))
    s = totals.agg(F.avg("total").alias("mean"), F.stddev_pop("total").alias("std"), F.array_sort(F.collect_list("total")).alias("sorted"))  # `runs` numbers
    pick = lambda share: F.element_at("sorted", F.least(F.lit(runs), F.floor(F.lit(share * runs)).cast("int") + 1))
    return s.select("mean", pick(0.5).alias("median"), pick(0.05).alias("p5"), pick(0.95).alias("p95"), "std", (F.col("std") / F.abs("mean")).alias("cv"))
