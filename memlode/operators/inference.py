"""Inference for clustered, weighted and randomised comparisons.

Draws are rows: a bootstrap or a re-randomisation is an equi-join and an aggregate, never a collected sample.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memlode.operators.stats import counted_below, uniform
from memlode.session import Scratch


def cluster_sums(rows: DataFrame, cluster: str, value: str, *by: str) -> DataFrame:
    """(by..., cluster, total, n, mean) of the values of each cluster."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(cluster).alias("cluster")).agg(F.sum(value).alias("total"), F.count("*").alias("n"), F.avg(value).alias("mean"))


def resamples(clusters: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """``draws`` resamples of whole clusters with replacement: the rows of ``clusters`` with column draw, as often as
    they were drawn.  All clusters of one id (of both arms, say) are drawn together.

    Each draw has as many places as there are clusters, and a hash of seed, draw and place says who takes it.
    Draws and clusters meet by number in a merge join, for clusters grow with the rows and are no broadcast.
    """
    numbered = counted_below(clusters.select("cluster").distinct(), "cluster").select(F.col("cluster").alias("drawn"), F.col("n_below").alias("number"))
    own = Scratch(clusters.sparkSession).keep(clusters.join(numbered.hint("merge"), F.col("drawn") == F.col("cluster")).drop("drawn"))
    size = numbered.agg(F.count("*").alias("size"))
    places = clusters.sparkSession.range(draws).select(F.col("id").alias("draw")).crossJoin(F.broadcast(size)).where("size > 0")
    places = places.select("draw", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size"))).alias("place"))
    taken = places.select("draw", F.floor(uniform(F.lit(seed), F.col("draw"), F.col("place")) * F.col("size")).alias("number"))
    times = taken.repartition("number").groupBy("draw", "number").agg(F.count("*").alias("times"))
    return times.join(own.hint("merge"), "number").drop("number")


def stratified_resamples(clusters: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """As ``resamples``, of clusters (stratum, cluster, ...), drawing in each stratum as many of its clusters as it has."""
    numbered = counted_below(clusters.select(F.struct("stratum", "cluster").alias("at")).distinct(), "at").select("at.stratum", "at.cluster", "n_below")
    sizes = Scratch(clusters.sparkSession).keep(numbered.groupBy("stratum").agg(F.count("*").alias("size"), F.min("n_below").alias("base")))
    at = F.col("s_").eqNullSafe(F.col("stratum")) & F.col("c_").eqNullSafe(F.col("cluster"))
    own = Scratch(clusters.sparkSession).keep(clusters.join(numbered.select(F.col("stratum").alias("s_"), F.col("cluster").alias("c_"), "n_below").hint("merge"), at).drop("s_", "c_"))
    places = sizes.select("stratum", "size", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw"))
    places = places.repartition(max(1, min(draws, 200)), "stratum", "draw")  # else one task makes all places
    places = places.select("stratum", "size", "base", "draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size"))).alias("place"))
    # the stratum's first number stands for it in the hash, so strata draw apart
    taken = places.select("draw", (F.col("base") + F.floor(uniform(F.lit(seed).cast("long"), F.col("base"), F.col("draw"), F.col("place")) * F.col("size"))).alias("n_below"))
    times = taken.repartition("n_below").groupBy("draw", "n_below").agg(F.count("*").alias("times"))
    return times.join(own.hint("merge"), "n_below").drop("n_below")


def interval(draws: DataFrame, value: str, level: float = 0.95, *by: str) -> DataFrame:
    """lo, hi, p (share of draws at or below zero, one added above and below) and n, the draws, dropped where null.

    The ends are the order statistics next outside the tails.
    """
    tail = (1 - level) / 2
    n = F.count(value)
    low, high = F.floor(tail * (n - 1)), F.ceil((1 - tail) * (n - 1))
    listed = F.sort_array(F.collect_list(value))  # one number a draw
    g = draws.groupBy(*by).agg(listed.alias("v"), low.alias("a"), high.alias("b"), n.alias("n"), ((1 + F.count(F.when(F.col(value) <= 0, 1))) / (1 + n)).alias("p"), F.count(F.when(F.col(value).isNull(), 1)).alias("dropped"))
    return g.select(*by, F.get("v", F.col("a").cast("int")).alias("lo"), F.get("v", F.col("b").cast("int")).alias("hi"), "p", "n", "dropped")


def mean_of_means(rows: DataFrame, cluster: str, value: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """estimate (mean of the clusters' means), its bootstrap interval and one-sided p."""
    c = cluster_sums(rows, cluster, value)
    each = resamples(c, draws, seed).groupBy("draw").agg((F.sum(F.col("mean") * F.col("times")) / F.sum("times")).alias("v"))
    return c.agg(F.avg("mean").alias("estimate"), F.count("*").alias("clusters")).crossJoin(F.broadcast(interval(each, "v")))


def ratios(rows: DataFrame, cluster: str, arm: str, num: str, den: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(arm, estimate, lo, hi, ...): sum(num) / sum(den) of each arm under whole-cluster resampling.

    A draw in which an arm has no denominator is dropped and counted.
    """
    c = rows.groupBy(F.col(arm).alias("arm"), F.col(cluster).alias("cluster")).agg(F.sum(num).alias("x"), F.sum(den).alias("y"))
    both = resamples(c, draws, seed).groupBy("arm", "draw").agg((F.sum(F.col("x") * F.col("times")) / F.nullif(F.sum(F.col("y") * F.col("times")), F.lit(0))).alias("v"))
    own = c.groupBy("arm").agg((F.sum("x") / F.nullif(F.sum("y"), F.lit(0))).alias("estimate"))
    return own.join(interval(both, "v", 0.95, "arm"), "arm")


def stratified_ratio(rows: DataFrame, stratum: str, cluster: str, num: str, den: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """One row: sum(num) / sum(den) with its interval from whole clusters resampled within strata; draws without a
    denominator are dropped and counted.  A cluster in two strata is two clusters."""
    c = Scratch(rows.sparkSession).keep(rows.groupBy(F.col(stratum).alias("stratum"), F.col(cluster).alias("cluster")).agg(F.sum(num).alias("x"), F.sum(den).alias("y")))
    each = stratified_resamples(c, draws, seed).groupBy("draw").agg((F.sum(F.col("x") * F.col("times")) / F.nullif(F.sum(F.col("y") * F.col("times")), F.lit(0))).alias("v"))
    return c.agg((F.sum("x") / F.nullif(F.sum("y"), F.lit(0))).alias("estimate"), F.countDistinct("stratum").alias("strata"), F.count("*").alias("clusters")).crossJoin(F.broadcast(interval(each, "v")))


def ratio_difference(rows: DataFrame, cluster: str, arm: str, num: str, den: str, treated: str, control: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """One row: the difference of the two arms' ratios of sums, with its whole-cluster bootstrap interval."""
    part = lambda c, a, w: F.sum(F.when(F.col("arm") == a, F.col(c) * w))
    ratio = lambda a, w: part("x", a, w) / F.nullif(part("y", a, w), F.lit(0))
    c = rows.groupBy(F.col(arm).alias("arm"), F.col(cluster).alias("cluster")).agg(F.sum(num).alias("x"), F.sum(den).alias("y"))
    each = resamples(c, draws, seed).groupBy("draw").agg((ratio(treated, F.col("times")) - ratio(control, F.col("times"))).alias("v"))
    return c.agg((ratio(treated, F.lit(1)) - ratio(control, F.lit(1))).alias("estimate")).crossJoin(F.broadcast(interval(each, "v")))


def robust_mean(rows: DataFrame, cluster: str, value: str, z: float = 1.96) -> DataFrame:
    """mean, its cluster-robust standard error (with the small-sample factor of the number of clusters) and interval."""
    c = cluster_sums(rows, cluster, value)
    # the sum of squared cluster residuals, from sums alone: no second pass for the mean
    a = c.agg(F.sum("total").alias("t"), F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("total") * F.col("total")).alias("tt"), F.sum(F.col("total") * F.col("n")).alias("tn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    m = F.col("t") / F.col("n")
    squares = F.greatest(F.lit(0.0), F.col("tt") - 2 * m * F.col("tn") + m * m * F.col("nn"))
    se = F.sqrt(squares / (F.col("n") * F.col("n")) * F.when(F.col("g") > 1, F.col("g") / (F.col("g") - 1)).otherwise(1.0))
    return a.select(m.alias("mean"), se.alias("se"), (m - z * se).alias("lo"), (m + z * se).alias("hi"), F.col("g").alias("clusters"))


def weighted_rate(rows: DataFrame, by: list[str], census: Column, sampled: Column, hit: Column) -> DataFrame:
    """Horvitz-Thompson rate of ``hit``: rows of the census count once, sampled rows of the others for as many as one
    of them stands for over the whole table, rows of neither not at all."""
    share = rows.agg((F.count(F.when(~census, 1)) / F.nullif(F.count(F.when(~census & sampled, 1)), F.lit(0))).alias("stands_for"))
    w = F.when(census, 1.0).when(sampled, F.coalesce("stands_for", F.lit(1.0))).otherwise(0.0)
    own = rows.crossJoin(F.broadcast(share)).withColumn("w_", w)
    return own.groupBy(*by).agg(F.sum("w_").alias("opportunities"), F.sum(F.when(hit, F.col("w_")).otherwise(0.0)).alias("hits")).withColumn("rate", F.col("hits") / F.nullif(F.col("opportunities"), F.lit(0.0)))


def rerandomised(units: DataFrame, value: str, arm: str, block: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """(d, p, draws): the difference in means and the share of assignments drawn from the design that are as extreme.

    The design deals arms within blocks: every draw keeps each block's numbers of treated and control units and
    permutes them by a hash.  Units are rows (unit, value, arm, block) with arms treatment and control.
    """
    u = units.select("unit", F.col(value).alias("v_"), (F.col(arm) == "treatment").alias("t_"), F.col(block).alias("b_"))
    gap = lambda t: F.avg(F.when(t, F.col("v_"))) - F.avg(F.when(~t, F.col("v_")))
    sizes = u.groupBy(F.col("b_").alias("of_")).agg(F.count(F.when(F.col("t_"), 1)).alias("n_t"))
    rows = u.join(F.broadcast(sizes), F.col("b_").eqNullSafe(F.col("of_"))).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    w = W.partitionBy("draw", "b_").orderBy(F.xxhash64(F.lit(seed), "draw", "unit"), "unit")
    each = rows.withColumn("t2", F.row_number().over(w) <= F.col("n_t")).groupBy("draw").agg(gap(F.col("t2")).alias("r"))
    seen = u.agg(gap(F.col("t_")).alias("d"))
    return each.crossJoin(F.broadcast(seen)).where("r is not null").groupBy("d").agg(F.avg((F.abs("r") >= F.abs("d") - 1e-12).cast("double")).alias("p"), F.count("*").alias("draws"))


def tost(k: int, n: int, centre: float = 0.5, margin: float = 0.1, alpha: float = 0.05) -> tuple[bool, float, float]:
    """Exact equivalence test of k of n against a proportion: whether both one-sided tests reject, and their p values."""
    def mass(p: float, xs: range) -> float:
        if p <= 0 or p >= 1:
            return float((0 if p <= 0 else n) in xs)
        logs = (math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p) for x in xs)
        return min(1.0, math.fsum(map(math.exp, logs)))

    above, below = mass(centre - margin, range(k, n + 1)), mass(centre + margin, range(0, k + 1))
    return above < alpha and below < alpha, above, below


def partial_correlation(rows: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """First-order partial correlation of x and y given z, over rows that have all three."""
    r = rows.dropna(subset=[x, y, z]).agg(F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"))
    rest = F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return r.select("xy", "xz", "yz", ((F.col("xy") - F.col("xz") * F.col("yz")) / F.nullif(rest, F.lit(0.0))).alias("partial"))


def washout_sensitivity(rows: DataFrame, hours: str, hit: Column, cuts: list[float]) -> DataFrame:
    """(washout, n, hits, rate): the rate of ``hit`` among rows at least ``washout`` hours into their epoch, for each cut."""
    own = rows.select(F.col(hours).alias("h_"), hit.alias("hit_")).withColumn("washout", F.explode(F.array(*[F.lit(float(c)) for c in cuts])))
    g = own.where("h_ >= washout").groupBy("washout").agg(F.count("*").alias("n"), F.count(F.when(F.col("hit_"), 1)).alias("hits"))
    return g.withColumn("rate", F.col("hits") / F.col("n"))


def carry_over(rows: DataFrame, by: str, hours: str, share: float = 0.95) -> DataFrame:
    """The hours after which a group's effects have ended for a share of its rows, by linear interpolation."""
    return rows.groupBy(by).agg(F.percentile(hours, F.lit(share)).alias("carry_over"), F.count(hours).alias("n"))
