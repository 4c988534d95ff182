"""Analytics on event and telemetry tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memlode.session import Scratch


def hourly(events: DataFrame, value: str = "latency_ms", hour: str = "1 hour", by: tuple = ()) -> DataFrame:
    """Count and nearest-rank percentiles of each tumbling hour (and of each group ``by``)."""
    pct = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return events.groupBy(*by, F.window("ts", hour).alias("w")).agg(F.count("*").alias("n"), *pct).select(*by, F.col("w.start").alias("hour"), "n", *["p50", "p95", "p99"])


def filled_hours(buckets: DataFrame, by: tuple = ()) -> DataFrame:
    """The buckets with empty hours between the first and the last (of each group) as rows of count 0."""
    span = buckets.groupBy(*by).agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a is not null")
    hours = span.select(*by, F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("hour"))
    return hours.join(buckets, [*by, "hour"], "left").fillna(0, ["n"])


def interpolated(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, population deviation and interpolated percentiles of a value."""
    p = [F.expr(f"percentile({value}, {q})").alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75, 0.95)]
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), *p)


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value at offset count / 2 of each group in order: the least one with more than half of the rows at or below it.

    Counts of values combine map-side; no group's rows are gathered.
    """
    return rows.groupBy(*by).agg(F.expr(f"percentile_disc(0.5000000000001) WITHIN GROUP (ORDER BY {value})").alias("median"))


def shares(rows: DataFrame, by: str) -> DataFrame:
    """Count of each group and its percentage of all rows."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select(by, "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


def cut_off_pct(hits: DataFrame, flag: Column, ranks=(1, 3, 10)) -> DataFrame:
    """Percentage of flagged hits at several rank cut-offs; null where no hit is."""
    pct = [F.round(100.0 * F.sum(F.when((F.col("rank") <= k) & flag, 1).when(F.col("rank") <= k, 0)) / F.nullif(F.sum(F.when(F.col("rank") <= k, 1)), F.lit(0)), 2).alias(f"pct_top{k}") for k in ranks]
    return hits.agg(*pct)


def matrix(pairs: DataFrame, row: str, col: str) -> DataFrame:
    """Cell counts with their percentage of the row."""
    cells = pairs.groupBy(row, col).agg(F.count("*").alias("n"))
    return cells.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy(row)), 2))


def win_loss(runs: DataFrame) -> DataFrame:
    """Hourly wins, regressions and neutral runs of a feature, with mean and variance over the others."""
    d = F.when(F.col("baseline") == 0, None).otherwise(100.0 * (F.col("shadow") - F.col("baseline")) / F.col("baseline"))
    kind = F.when(F.coalesce(F.abs("delta") < 1.0, F.lit(True)), "neutral").when(F.col("delta") > 0, "win").otherwise("regression")
    rows = runs.withColumn("delta", d).withColumn("kind", kind)
    own = F.when(F.col("kind") != "neutral", F.col("delta"))
    n = F.count(own)
    mean = F.sum(own) / n
    return rows.groupBy("feature", F.date_trunc("hour", F.col("ts")).alias("hour")).agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("win", "regression", "neutral")],
        F.round(mean, 6).alias("mean"), F.round(F.sum(own * own) / n - mean * mean, 4).alias("variance"),
    )


def cumulative_buckets(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Histogram with cumulative buckets and the +Inf bucket, sum and count, as one row a bound."""
    agg = rows.agg(*[F.count(F.when(F.col(value) <= b, 1)).alias(str(i)) for i, b in enumerate(bounds)], F.count(value).alias("all"), F.sum(value).alias("sum"))
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(str(i)).alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n"))]
    return agg.select(F.explode(F.array(*pairs)).alias("p"), "sum").select("p.le", "p.n", "sum")


def capped_labels(rows: DataFrame, label: str, allowed: list[str], cap: int) -> DataFrame:
    """Labels off the allow-list become 'other'; the series of later labels beyond ``cap`` (by first seen) are dropped."""
    named = rows.withColumn("label", F.when(F.col(label).isin(*allowed), F.col(label)).otherwise("other"))
    first = named.groupBy("label").agg(F.min("ts").alias("t"), F.count("*").alias("n"))
    return first.withColumn("order", F.row_number().over(W.orderBy("t", "label"))).where(F.col("order") <= cap)


def exposition(metrics: list[tuple[str, dict, float]]) -> str:
    """Prometheus text of (name, labels, value), in order."""
    esc = lambda v: str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    out = []
    for name, labels, value in metrics:
        tags = ",".join(f'{k}="{esc(v)}"' for k, v in sorted(labels.items()))
        out.append(f"{name}{{{tags}}} {value:g}" if tags else f"{name} {value:g}")
    return "\n".join(out) + "\n"


def as_of_join(left: DataFrame, right: DataFrame, key: str, value: str, slice_seconds: int = 6 * 3600) -> DataFrame:
    """Each row of left (key, ts) with the latest ``value`` of right (key, ts) at or before it; ties count.

    A sort of the union by key and time instead of a range join, within slices of time, so a key with
    most of the rows is many tasks' work.  What a slice starts with is the last value of the slices
    before it: a window over one row a key and slice.
    """
    slice_of = lambda ts: F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (slice_seconds * 1_000_000))
    cut = right.withColumn("slice_", slice_of("ts"))
    last = cut.where(F.col(value).isNotNull()).groupBy(key, "slice_").agg(F.max(F.struct("ts", value)).alias("m"))
    spots = left.select(key, slice_of("ts").alias("slice_")).distinct().join(last, [key, "slice_"], "full").select(key, "slice_", F.col(f"m.{value}").alias("own_"))
    earlier = F.last("own_", ignorenulls=True).over(W.partitionBy(key).orderBy("slice_").rowsBetween(W.unboundedPreceding, -1))
    carried = spots.withColumn("carried_", earlier).select(key, "slice_", "carried_")
    both = left.withColumns({"side": F.lit(1), value: F.lit(None).cast(right.schema[value].dataType)}).select(key, "ts", "side", "id", value)
    both = both.unionByName(right.select(key, "ts", F.lit(0).alias("side"), F.lit(None).cast(left.schema["id"].dataType).alias("id"), value))
    both = both.withColumn("slice_", slice_of("ts"))
    w = W.partitionBy(key, "slice_").orderBy("ts", "side", value).rowsBetween(W.unboundedPreceding, 0)
    own = both.withColumn("near_", F.last(value, ignorenulls=True).over(w)).where("side = 1")
    return own.join(carried, [key, "slice_"], "left").select("id", key, "ts", F.coalesce("near_", "carried_").alias(value))


#: Values of one side that are met by each of the other in turn: as many as Parquet packs together, so that the
#: stored values repeat byte for byte.
RUN = 504


def looked_up(left: DataFrame, right: DataFrame, on: str, found: DataFrame, key: str, other: str, value: str, rows: int = 1 << 22, block: int = 1 << 20) -> DataFrame:
    """(``key``, ``other``, ``value``): all pairs of ``left`` (key, on) and ``right`` (other, on) that share ``on``, with
    the value of ``found`` (key, on, other, value; one row a pair) or null.

    A key's found values travel with it as a map, which holds no more than the key has pairs, so no pair is
    shuffled: ``left`` is dealt into tasks of about ``rows`` pairs, ``right`` sent in blocks of at most about ``block`` rows.

    The pairs leave in an order that takes little room: a task has the keys of an ``on`` or few, and each of them meets the
    same ``RUN`` others before the next ones.  The order comes from a sort of one row a key and run, never of the pairs.
    """
    scratch = Scratch(left.sparkSession)
    sizes = scratch.keep(left.groupBy(on).agg(F.count("*").alias("n_")).join(right.groupBy(on).agg(F.count("*").alias("m_")), on))
    pairs, n, most = sizes.agg(F.coalesce(F.sum(F.col("n_").cast("double") * F.col("m_")), F.lit(0.0)), F.coalesce(F.sum("m_"), F.lit(0)), F.coalesce(F.max("m_"), F.lit(0))).first()
    sizes, band = scratch.broadcast_if_small(sizes), min(block, 1 << 16)
    times = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("times_"))
    copies = F.expr("explode(sequence(1L, times_))").alias("copy_")  # equal rows are dealt out, too

    maps = found.groupBy(key, on).agg(F.map_from_entries(F.collect_list(F.struct(other, value))).alias("found_"))
    own = times(left, key, on).join(maps, [key, on], "left").join(sizes, on).select(on, key, "found_", "n_", "m_", copies)
    own = own.withColumn("group_", F.pmod(F.xxhash64(key, "copy_"), F.ceil(F.col("n_").cast("double") * F.col("m_") / rows)))
    own = own.select(on, key, "found_", "group_").repartition(max(1, math.ceil(pairs / rows)), on, "group_")

    met = times(right, on, other).join(sizes, on).select(on, other, "m_", copies)
    met = met.groupBy(on, F.pmod(F.xxhash64(other, "copy_"), F.ceil(F.col("m_") / band)).alias("band_")).agg(F.sort_array(F.collect_list(F.struct(other)))[other].alias("all_"))
    low, high = F.col("run_")[0], F.element_at("run_", -1)
    out, blocks = None, max(1, math.ceil(n / block))
    for i in range(blocks):
        part = met if blocks == 1 else met.where(F.pmod(F.xxhash64(on, "band_"), F.lit(blocks)) == i)
        part = part.select(on, "band_", "all_", F.expr(f"explode(sequence(1, size(all_), {RUN}))").alias("at_")).withColumn("run_", F.slice("all_", F.col("at_"), F.lit(RUN))).drop("all_")
        each = own.join(F.broadcast(part), on)
        if most > RUN:  # else each key meets one run
            each = each.withColumn("found_", F.map_filter("found_", lambda k, _: (k <= high) & (low.isNull() | (k >= low)))).sortWithinPartitions(on, "band_", "at_", key)
        each = each.select(key, "found_", F.explode("run_").alias(other)).select(key, other, F.try_element_at("found_", F.col(other)).alias(value))
        out = each if out is None else out.unionAll(each)
    return out


def epochs(ts: Column, hour: int = 9) -> Column:
    """Start of the 24 h window that begins at ``hour`` UTC."""
    return F.date_trunc("day", ts - F.expr(f"interval {hour} hours")) + F.expr(f"interval {hour} hours")


def gap_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def drift(rows: DataFrame, value: str, by: list[str], limit: float = 0.1) -> DataFrame:
    """pass, fail or skip of each value against the one before it: a change beyond ``limit`` fails."""
    before = F.lag(value).over(W.partitionBy(*by).orderBy("ts"))
    change = (F.col(value) - before) / before
    return rows.withColumn("change", F.round(change, 6)).withColumn("status", F.when(before.isNull(), "BASELINE_ONLY").when(before == 0, "SKIP").when(F.abs(change) > limit, "FAIL").otherwise("PASS"))


def cost_rollup(calls: DataFrame, by: str, price: dict[str, float]) -> DataFrame:
    """Cost (tokens x price / 1e6, 6 places), calls and success rate of each provider."""
    table = F.create_map(*[F.lit(x) for kv in price.items() for x in kv])
    cost = F.col("tokens") * F.coalesce(F.element_at(table, F.col(by)), F.lit(0.0)) / 1e6
    return calls.groupBy(by).agg(F.round(F.sum(cost), 6).alias("cost"), F.count("*").alias("calls"), F.round(F.avg(1.0 - F.col("failed")), 6).alias("success"))


def over_cap(calls: DataFrame, cost: Column, cap: float) -> DataFrame:
    """Calls by which the day's running cost exceeds the cap."""
    day = F.to_date("ts")
    run = F.sum(F.round(cost, 6)).over(W.partitionBy(day).orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0))
    return calls.withColumn("running", F.round(run, 4)).where(F.col("running") > cap)
