"""Scores of risk surfaces against events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geopulse.functions.grid import GridSpec
from geopulse.operators.surface import slice_top, whole


def cell_counts(points: DataFrame, grid: GridSpec) -> DataFrame:
    """(gx, gy, count) of the cells with events, also those off the grid."""
    return grid.with_cells(points).groupBy("gx", "gy").agg(F.count("*").alias("count"))


def with_counts(surface: DataFrame, points: DataFrame, grid: GridSpec) -> DataFrame:
    """Valid cells with their number of events."""
    joined = surface.where("valid").join(cell_counts(points, grid), ["gx", "gy"], "left")
    return joined.select("gx", "gy", "risk", F.coalesce("count", F.lit(0)).alias("count"))


def hit_counts(surface: DataFrame, points: DataFrame, grid: GridSpec, coverages: list[int]) -> DataFrame:
    """(coverage, hits, total) for each percentage; events off the grid count in the total only."""
    ranked = slice_top(surface, 1.0).select("gx", "gy", "rank", "n_cells").join(cell_counts(points, grid), ["gx", "gy"], "left")
    levels = ranked.select("rank", "n_cells", F.coalesce("count", F.lit(0)).alias("count"), F.explode(F.array(*map(F.lit, coverages))).alias("coverage"))
    inside = F.col("rank") <= F.floor(F.col("n_cells") * (F.col("coverage") / 100))
    hits = levels.groupBy("coverage").agg(F.sum(F.when(inside, F.col("count")).otherwise(0)).alias("hits"))
    return hits.join(F.broadcast(points.agg(F.count("*").alias("total"))))


def hit_rates(surface: DataFrame, points: DataFrame, grid: GridSpec, coverages: list[int]) -> DataFrame:
    """(coverage, rate): the fraction of all events in the slice, -1 without events."""
    rate = F.when(F.col("total") == 0, -1.0).otherwise(F.try_divide("hits", "total"))
    return hit_counts(surface, points, grid, coverages).select("coverage", rate.alias("rate"))


def maximum_hit_rates(grid: GridSpec, points: DataFrame, coverages: list[int]) -> DataFrame:
    """Hit rates of the best surface: the events' own counts."""
    from geopulse.operators.hotspot import count_grid

    return hit_rates(count_grid(points, grid), points, grid, coverages)


def inverse_hit_rates(surface: DataFrame, points: DataFrame, grid: GridSpec) -> DataFrame:
    """(hit_percent, coverage_percent) for each level of risk with events."""
    levels = with_counts(surface, points, grid).groupBy("risk").agg(F.count("*").alias("cells"), F.sum("count").alias("hits"))
    w = whole().orderBy(F.desc("risk")).rowsBetween(W.unboundedPreceding, 0)
    run = levels.select("hits", F.sum("hits").over(w).alias("h"), F.sum("cells").over(w).alias("c"), F.sum("cells").over(whole()).alias("n"))
    n_events = points.agg(F.count("*").alias("total"))
    return run.where("hits > 0").join(F.broadcast(n_events)).select((F.col("h") * 100 / F.col("total")).alias("hit_percent"), (F.col("c") * 100 / F.col("n")).alias("coverage_percent"))


def _within(surface: DataFrame, points: DataFrame, grid: GridSpec) -> DataFrame:
    """Events with their cell's row; an event without a valid cell is an error."""
    cells = surface.where("valid").withColumn("known", F.lit(True))
    joined = grid.with_cells(points).join(cells, ["gx", "gy"], "left")
    return joined.withColumn("risk", F.when(F.col("known"), F.col("risk")).otherwise(F.raise_error(F.lit("an event lies outside the valid cells"))))


def log_likelihood(surface: DataFrame, points: DataFrame, grid: GridSpec, minimum: float = 1e-9) -> DataFrame:
    """Mean ln of the risk at the events; risks that aren't positive count as ``minimum``."""
    risk = F.when(F.col("risk") > 0, F.col("risk")).otherwise(minimum)
    return _within(surface, points, grid).agg(F.avg(F.ln(risk)).alias("likelihood"))


def _fractions(surface: DataFrame, points: DataFrame, grid: GridSpec) -> DataFrame:
    """Valid cells with u, the cell's fraction of the events in valid cells, and p, its risk."""
    return with_counts(surface, points, grid).select("gx", "gy", F.col("risk").alias("p"), (F.col("count") / F.sum("count").over(whole())).alias("u"))


def brier(surface: DataFrame, points: DataFrame, grid: GridSpec) -> DataFrame:
    """(brier, skill)."""
    area = grid.xsize * grid.ysize
    f = _fractions(surface, points, grid)
    return f.agg(
        (F.sum(F.expr("(u - p) * (u - p)")) / (F.count("*") * area)).alias("brier"),
        (2 * F.sum(F.expr("p * u")) / (F.sum(F.expr("u * u")) + F.sum(F.expr("p * p")))).alias("skill"),
    )


def kl_term(u: Column, p: Column) -> Column:
    """u ln(u / p), with the penalty u (ln u + 20) where p isn't positive; 0 for u = 0."""
    safe = lambda c: F.when(c > 0, c)
    return F.when(u <= 0, 0.0).when(p <= 0, u * (F.ln(safe(u)) + 20)).otherwise(u * F.ln(safe(u) / safe(p)))


def kl(surface: DataFrame, points: DataFrame, grid: GridSpec) -> DataFrame:
    u, p = F.col("u"), F.col("p")
    terms = kl_term(u, p) + kl_term(1 - u, 1 - p)
    return _fractions(surface, points, grid).agg((F.sum(terms) / (F.count("*") * grid.xsize * grid.ysize)).alias("kl"))


def moving_windows(surface: DataFrame, points: DataFrame, grid: GridSpec, size: int) -> DataFrame:
    """Sums of u and p and the number of valid cells in each size x size window, each divided by its total."""
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    spread = _fractions(surface, points, grid).select("*", F.explode(steps).alias("dx")).select("*", F.explode(steps).alias("dy"))
    at = spread.select((F.col("gx") - F.col("dx")).alias("gx"), (F.col("gy") - F.col("dy")).alias("gy"), "u", "p")
    inside = at.where(F.col("gx").between(0, grid.xextent - size) & F.col("gy").between(0, grid.yextent - size))
    sums = inside.groupBy("gx", "gy").agg(F.sum("u").alias("u"), F.sum("p").alias("p"), F.count("*").cast("double").alias("c"))
    return sums.select("gx", "gy", *((F.col(x) / F.sum(x).over(whole())).alias(x) for x in "upc"))


def multiscale_brier(surface: DataFrame, points: DataFrame, grid: GridSpec, size: int) -> DataFrame:
    area = grid.xsize * grid.ysize
    w = moving_windows(surface, points, grid, size)
    brier_, skill = F.sum(F.expr("(u - p) * (u - p) * c")), F.sum(F.expr("c * (u * u + p * p)"))
    return w.agg((brier_ / area).alias("brier"), (2 * F.sum(F.expr("c * u * p")) / skill).alias("skill"))


def multiscale_kl(surface: DataFrame, points: DataFrame, grid: GridSpec, size: int) -> DataFrame:
    u, p = F.col("u"), F.col("p")
    terms = (kl_term(u, p) + kl_term(1 - u, 1 - p)) * F.col("c")
    return moving_windows(surface, points, grid, size).agg((F.sum(terms) / (grid.xsize * grid.ysize)).alias("kl"))


def ranking(surface: DataFrame, points: DataFrame, grid: GridSpec) -> DataFrame:
    """(event_id, percentile): the fraction of valid cells with at most the risk of the event's cell."""
    ranks = surface.where("valid").select("gx", "gy", F.cume_dist().over(whole().orderBy("risk")).alias("percentile"))
    return grid.with_cells(points).join(ranks, ["gx", "gy"]).select("event_id", "percentile")


def bayes_predictive(surface: DataFrame, points: DataFrame, grid: GridSpec, bias: float = 10, lower: float = 1e-10) -> DataFrame:
    """Sum of w (ln w + ln bias - ln alpha) with w = (alpha + count) / (bias + n)."""
    c = with_counts(surface, points, grid)
    prior = c.select("count", (F.col("risk") / F.sum("risk").over(whole()) * bias).alias("a0"), F.sum("count").over(whole()).alias("n"))
    prior = prior.select("count", "n", F.when(F.col("a0") <= 0, lower).otherwise(F.col("a0")).alias("alpha"))
    w = (F.col("alpha") + F.col("count")) / (bias + F.col("n"))
    return prior.agg(F.sum(w * (F.ln(w) + F.ln(F.lit(float(bias))) - F.ln("alpha"))).alias("score"))


def digamma(x: Column) -> Column:
    """psi(x) for x > 0: the recurrence up to x + 6, then the asymptotic series."""
    below = sum((1 / (x + k) for k in range(1, 6)), 1 / x)
    y = x + 6
    y2 = y * y
    series = F.ln(y) - 1 / (2 * y) - 1 / (12 * y2) + 1 / (120 * y2 * y2) - 1 / (252 * y2 * y2 * y2) + 1 / (240 * y2 * y2 * y2 * y2)
    return series - below


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0: Stirling's series at x + 8."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.91893853320467274178 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - sum((F.ln(x + k) for k in range(1, 8)), F.ln(x))


def bayes_dirichlet(surface: DataFrame, points: DataFrame, grid: GridSpec, bias: float = 10, lower: float = 1e-10) -> DataFrame:
    """Divergence of the posterior from the Dirichlet prior of the risks."""
    c = with_counts(surface, points, grid)
    prior = c.select("count", (F.col("risk") / F.sum("risk").over(whole()) * bias).alias("a0"))
    prior = prior.select("count", F.when(F.col("a0") <= 0, lower).otherwise(F.col("a0")).alias("a"))
    prior = prior.withColumn("b", F.col("a") + F.col("count"))
    s = prior.agg(
        F.sum("a").alias("sa"),
        F.sum("b").alias("sb"),
        F.sum(log_gamma(F.col("a")) - log_gamma(F.col("b")) + F.col("count") * digamma(F.col("b"))).alias("t"),
    )
    return s.select((log_gamma(F.col("sb")) - log_gamma(F.col("sa")) + F.col("t") - (F.col("sb") - F.col("sa")) * digamma(F.col("sb"))).alias("score"))


def poisson_crps(surface: DataFrame, points: DataFrame, grid: GridSpec) -> DataFrame:
    """Sum over cells of the continuous ranked probability score of a Poisson count with mean risk * events.

    Each cell's distribution function is summed to ten standard deviations above its count and mean.
    """
    c = with_counts(surface, points, grid).select("gx", "gy", "count", (F.col("risk") * F.sum("count").over(whole())).alias("mean"))
    most = F.greatest("count", "mean")
    each = c.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(most + 10 * F.sqrt(most) + 30).cast("long"))).alias("k"))
    log_p = F.when(F.col("mean") > 0, F.col("k") * F.ln(F.when(F.col("mean") > 0, F.col("mean"))) - F.col("mean") - log_gamma(F.col("k") + 1.0))
    p = F.coalesce(F.exp(log_p), F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    w = W.partitionBy("gx", "gy").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    cdf = each.select("count", "k", F.sum(p).over(w).alias("f"))
    term = F.when(F.col("k") < F.col("count"), F.col("f") * F.col("f")).otherwise((1 - F.col("f")) * (1 - F.col("f")))
    return cdf.agg(F.sum(term).alias("crps"))


def beta_posterior(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Beta(hits, misses) of the summed counts for each key: a, b, mean and sd."""
    s = counts.groupBy(*keys).agg(F.sum("hits").alias("a"), F.sum(F.col("total") - F.col("hits")).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")  # their products are too large for a long
    n = a + b
    sd = F.sqrt(a * b / (n * n * (n + 1)))
    return s.select("*", F.try_divide("a", n).alias("mean"), sd.alias("sd"))


def means_against_maximum(posterior: DataFrame, keys: list[str]) -> DataFrame:
    """mean over the greatest mean of the key; 0 where that is 0."""
    top = F.max("mean").over(W.partitionBy(*keys))
    return posterior.withColumn("relative", F.when(top == 0, 0.0).otherwise(F.col("mean") / top))


def parse_prediction_key(key: str) -> tuple[str, dict]:
    """("Name", {"a": 1, "b": "D(e=f)"}) of "Name(a=1, b=D(e=f))"; commas in brackets don't separate."""
    name, _, rest = key.partition("(")
    parts, depth, start = [], 0, 0
    body = rest[:-1] if rest.endswith(")") else rest
    for i, c in enumerate(body):
        depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(c, 0)
        if c == "," and not depth:
            parts.append(body[start:i])
            start = i + 1
    parts.append(body[start:])
    out = {}
    for part in filter(None, map(str.strip, parts)):
        k, _, v = part.partition("=")
        for kind in (int, float, str):
            try:
                out[k.strip()] = kind(v.strip())
                break
            except ValueError:
                continue
    return name.strip(), out


def kde_score(surface: DataFrame, points: DataFrame, grid: GridSpec, bandwidth: float) -> DataFrame:
    """Squared error, times the cell area, of the surface against the normalised edge-corrected KDE of the events at the cells' centres."""
    from geopulse.operators.hotspot import edge_corrected_kde

    truth = edge_corrected_kde(points, surface, grid, bandwidth).select("gx", "gy", (F.col("risk") / F.sum("risk").over(whole())).alias("q"))
    joined = surface.where("valid").join(truth, ["gx", "gy"])
    return joined.agg((F.sum((F.col("risk") - F.col("q")) ** 2) * (grid.xsize * grid.ysize)).alias("score"))
