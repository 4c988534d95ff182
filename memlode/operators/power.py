"""The least effect a clustered trial can detect, by simulation from pilot units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlode.operators.stats import counted_below, uniform
from memlode.session import Scratch


def _two(values: Column, first: Column, second: Column) -> list[Column]:
    """Two members of an array, drawn without replacement by two uniform numbers."""
    n = F.size(values)
    i, j = F.floor(first * n).cast("int"), F.floor(second * (n - 1)).cast("int")
    return [F.get(values, i), F.get(values, j + (j >= i).cast("int"))]


def power_curve(pilot: DataFrame, distance: Callable[[Column, Column], Column], sizes: list[int], grid: list[float], sims: int = 200, draws: int = 1000, alpha: float = 0.0125, seed: int = 0) -> DataFrame:
    """(q, mean_delta, power) for each q of ``grid``: trials of clusters with ``sizes`` units, simulated ``sims`` times.

    ``pilot`` is (unit, values): two replicas or more a unit, in an array whose order is part of the seed; units with
    fewer, and a null unit, are left out, and fewer than two units are an error.  A simulated unit takes a pilot unit at random, and two replicas
    of it for each of three arms; with probability q the second arm's come from another unit.  Its delta is the mean
    distance between the first two arms less the mean distance within the three.  A trial's estimate is the mean of its
    clusters' means; it detects the effect if the share of ``draws`` resamples of its clusters at or below zero (one
    added above and below) is under ``alpha``.

    Simulated units are rows and a trial a row of one mean a cluster; hashes say every draw, the same ones for each q, so the
    curve is smooth in q and reruns agree.  Clusters without units are left out.
    """
    scratch = Scratch(pilot.sparkSession)
    whole = scratch.keep(pilot.where(F.col("unit").isNotNull() & (F.size("values") >= 2)).select("unit", "values"))
    number = counted_below(whole, "unit").select("unit", F.col("n_below").alias("number"))
    units = scratch.keep(whole.join(number, "unit").select("number", "values"))
    n = units.count()
    if n < 2:
        raise ValueError("a power curve needs two pilot units or more")
    units = scratch.broadcast_if_small(units)
    trials = pilot.sparkSession.range(len(grid) * sims).select(F.get(F.array(*[F.lit(float(q)) for q in grid]), (F.col("id") / sims).cast("int")).alias("q"), (F.col("id") % sims).alias("sim"))
    slots = trials.select("q", "sim", F.posexplode(F.array(*[F.lit(s) for s in sizes if s > 0])).alias("cluster", "size"))
    slots = slots.select("q", "sim", F.col("cluster").cast("long").alias("cluster"), "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size").cast("long"))).alias("place"))
    u = lambda k: uniform(F.lit(seed).cast("long"), F.col("sim"), F.col("cluster"), F.col("place"), F.lit(k).cast("long"))
    base, other = F.floor(u(0) * n), F.floor(u(1) * (n - 1))
    drawn = slots.withColumns({"base": base, "other": other + (other >= base).cast("long"), "moved": u(2) < F.col("q")})
    drawn = drawn.withColumn("second", F.when(F.col("moved"), F.col("other")).otherwise(F.col("base")))
    own = drawn.join(units.select(F.col("number").alias("base"), F.col("values").alias("a_")), "base").join(units.select(F.col("number").alias("second"), F.col("values").alias("b_")), "second")
    one, two, three = _two(F.col("a_"), u(3), u(4)), _two(F.col("b_"), u(5), u(6)), _two(F.col("a_"), u(7), u(8))
    between = sum((distance(x, y) for x in one for y in two), F.lit(0.0)) / 4
    within = (distance(*one) + distance(*two) + distance(*three)) / 3
    means = own.groupBy("q", "sim", "cluster").agg((F.sum(between - within) / F.count("*")).alias("mean"))
    by = means.groupBy("q", "sim").agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "mean"))), lambda c: c.mean).alias("means"))
    g = F.size("means")
    pick = lambda draw, place: F.get("means", F.floor(uniform(F.lit(seed).cast("long"), F.col("sim"), draw, place) * g).cast("int"))
    total = lambda draw: F.aggregate(F.sequence(F.lit(1).cast("long"), g.cast("long")), F.lit(0.0), lambda s, place: s + pick(draw, place))
    low = F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long")), F.lit(0), lambda s, draw: s + (total(draw) <= 0).cast("int"))
    estimate = F.aggregate("means", F.lit(0.0), lambda s, m: s + m) / g
    tried = by.select("q", estimate.alias("delta"), ((1 + low) / (1 + draws)).alias("p"))
    return tried.groupBy("q").agg(F.avg("delta").alias("mean_delta"), F.avg((F.col("p") < alpha).cast("double")).alias("power"))


def least_detectable(curve: DataFrame, power: float = 0.8) -> DataFrame:
    """One row, effect: the least mean delta that a curve detects with ``power``; null if it detects none."""
    return curve.agg(F.min(F.when(F.col("power") >= power, F.col("mean_delta"))).alias("effect"))
