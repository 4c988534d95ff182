"""Queries on telemetry: the cross-agent suite, buckets, percentiles, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memlode.operators import telemetry as O
from memlode.plans.base import Registry, chunks, telemetry
from memlode.session import Scratch, table

R = Registry()
query = R.query


@query("""SELECT date_trunc('hour', ts) AS hour, count(*) AS n, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99 FROM @telemetry GROUP BY 1""")
def hourly_buckets(spark, sf_dir):
    return O.hourly(telemetry(spark, sf_dir))


@query("""WITH b AS (SELECT agent, feature, date_trunc('hour', ts) AS hour, count(*) AS n FROM @telemetry WHERE failed = 1 GROUP BY 1, 2, 3),
h AS (SELECT agent, feature, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM b GROUP BY 1, 2) SELECT h.agent, h.feature, h.hour, coalesce(n, 0) AS n FROM h LEFT JOIN b ON b.hour = h.hour AND b.agent = h.agent AND b.feature = h.feature""")
def hourly_gap_fill(spark, sf_dir):
    """Failures of each agent and feature by hour, with the hours without any between the first and the last."""
    by = ("agent", "feature")
    return O.filled_hours(O.hourly(telemetry(spark, sf_dir).where("failed = 1"), by=by).select(*by, "hour", "n"), by)


@query("""SELECT feature, round(avg(latency_ms), 6) AS mean, round(stddev_pop(latency_ms), 6) AS std, round(quantile_cont(latency_ms, 0.25), 6) AS p25, round(quantile_cont(latency_ms, 0.5), 6) AS p50,
round(quantile_cont(latency_ms, 0.75), 6) AS p75, round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM @telemetry GROUP BY 1""")
def latency_stats(spark, sf_dir):
    out = O.interpolated(telemetry(spark, sf_dir), ["feature"], "latency_ms")
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p25", "p50", "p75", "p95")])


@query("""SELECT feature, v[CAST(len(v) // 2 + 1 AS BIGINT)] AS median FROM (SELECT feature, list_sort(list(latency_ms)) AS v FROM @telemetry GROUP BY 1)""")
def upper_median(spark, sf_dir):
    return O.upper_median(telemetry(spark, sf_dir), ["feature"], "latency_ms")


@query("SELECT round(least(latency_ms, 10), 1) AS bin, count(*) AS n FROM @telemetry GROUP BY 1")
def latency_histogram(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy(F.round(F.least("latency_ms", F.lit(10.0)), 1).alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT le, n, round(s, 4) AS sum FROM (SELECT [count(*) FILTER (WHERE latency_ms <= 1), count(*) FILTER (WHERE latency_ms <= 10), count(*) FILTER (WHERE latency_ms <= 50), count(*) FILTER (WHERE latency_ms <= 100), count(*)] AS ns, sum(latency_ms) AS s FROM @telemetry), (SELECT unnest(range(1, 6)) AS i), LATERAL (SELECT ns[i] AS n, ['1.0', '10.0', '50.0', '100.0', '+Inf'][i] AS le)""")
def cumulative_buckets(spark, sf_dir):
    return O.cumulative_buckets(telemetry(spark, sf_dir), "latency_ms", [1.0, 10.0, 50.0, 100.0]).select("le", "n", F.round("sum", 4).alias("sum"))


OWNER = "CASE WHEN source_file IN ('src0', 'src1', 'src2') THEN 'ada' WHEN source_file IN ('src3', 'src4', 'src5') THEN 'bel' WHEN source_file LIKE 'src1%' THEN 'cai' ELSE 'shared' END"


def owned(spark, sf_dir):
    s = F.col("source_file")
    own = F.when(s.isin("src0", "src1", "src2"), "ada").when(s.isin("src3", "src4", "src5"), "bel").when(s.like("src1%"), "cai").otherwise("shared")
    return chunks(spark, sf_dir).select("id", own.alias("owner"))


@query(f"SELECT owner, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 2) AS pct FROM (SELECT {OWNER} AS owner FROM @chunks) GROUP BY 1")
def owner_shares(spark, sf_dir):
    return O.shares(owned(spark, sf_dir), "owner")


#: hits: what each telemetry row retrieved; three chunk ids derived from the row stand for the logged list.
HITS = f"""(SELECT t.id AS query_id, t.agent, p.rank, c.owner FROM @telemetry t, (SELECT unnest([1, 2, 3]) AS rank) p
LEFT JOIN (SELECT id, {OWNER} AS owner FROM @chunks) c ON c.id = (t.id * p.rank + t.user_id) % 1200)"""


def hits(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    ids = F.array(*[(F.col("id") * r + F.col("user_id")) % 1200 for r in (1, 2, 3)])
    rows = t.select(F.col("id").alias("query_id"), "agent", F.posexplode(ids).alias("pos", "chunk_id")).withColumn("rank", F.col("pos") + 1)
    own = owned(spark, sf_dir).withColumnRenamed("id", "chunk_id")
    return rows.join(own, "chunk_id", "left").withColumn("owner", F.coalesce("owner", F.lit("other")))


CROSS = "coalesce(owner, 'other') NOT IN ('shared', 'other') AND agent <> coalesce(owner, 'other')"


@query(f"""SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE rank <= 1 AND {CROSS}) / nullif(count(*) FILTER (WHERE rank <= 1), 0), 2) AS pct_top1,
round(100.0::DOUBLE * count(*) FILTER (WHERE rank <= 3 AND {CROSS}) / nullif(count(*) FILTER (WHERE rank <= 3), 0), 2) AS pct_top3,
round(100.0::DOUBLE * count(*) FILTER (WHERE rank <= 10 AND {CROSS}) / nullif(count(*) FILTER (WHERE rank <= 10), 0), 2) AS pct_top10 FROM {HITS}""")
def cross_hit_rate(spark, sf_dir):
    flag = ~F.col("owner").isin("shared", "other") & (F.col("agent") != F.col("owner"))
    return O.cut_off_pct(hits(spark, sf_dir), flag)


MATRIX = f"SELECT agent, coalesce(owner, 'other') AS owner, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY agent), 2) AS pct FROM {HITS} GROUP BY 1, 2"


@query(MATRIX)
def retrieval_matrix(spark, sf_dir):
    return O.matrix(hits(spark, sf_dir), "agent", "owner")


@query(f"""WITH m AS ({MATRIX}) SELECT agent, owner, n, pct, CASE WHEN pct >= 30 THEN 'DOMINANT' WHEN pct >= 10 THEN 'SIGNIFICANT' ELSE 'MINOR' END AS band FROM m WHERE agent <> owner ORDER BY n DESC, agent, owner LIMIT 10""")
def top_flows(spark, sf_dir):
    m = O.matrix(hits(spark, sf_dir), "agent", "owner").where("agent <> owner")
    band = F.when(F.col("pct") >= 30, "DOMINANT").when(F.col("pct") >= 10, "SIGNIFICANT").otherwise("MINOR")
    return m.withColumn("band", band).orderBy(F.desc("n"), "agent", "owner").limit(10)


@query(f"""SELECT owner, round(avg(CASE WHEN found THEN r END), 6) AS mean_rank, min(r) AS best, max(r) AS worst, round(100.0::DOUBLE * count(*) FILTER (WHERE found) / count(*), 2) AS found_pct
FROM (SELECT owner, CAST(rank AS INTEGER) AS r, query_id % 3 = 0 AS found FROM {HITS} WHERE owner IS NOT NULL) GROUP BY 1""")
def rank_when_found(spark, sf_dir):
    h = hits(spark, sf_dir).where("owner <> 'other'").withColumn("found", F.col("query_id") % 3 == 0)
    return h.groupBy("owner").agg(
        F.round(F.avg(F.when(F.col("found"), F.col("rank"))), 6).alias("mean_rank"), F.min("rank").alias("best"), F.max("rank").alias("worst"),
        F.round(100.0 * F.count(F.when(F.col("found"), 1)) / F.count("*"), 2).alias("found_pct"),
    )


@query(f"""WITH s AS (SELECT agent, count(DISTINCT owner) AS owners FROM {HITS} GROUP BY 1) SELECT count(*) AS agents, count(*) FILTER (WHERE owners > 1) AS shared, count(*) FILTER (WHERE owners <= 1) AS isolated FROM s""")
def reachability(spark, sf_dir):
    s = hits(spark, sf_dir).groupBy("agent").agg(F.countDistinct(F.when(F.col("owner") != "other", F.col("owner"))).alias("owners"))
    return s.agg(F.count("*").alias("agents"), F.count(F.when(F.col("owners") > 1, 1)).alias("shared"), F.count(F.when(F.col("owners") <= 1, 1)).alias("isolated"))


@query("""WITH r AS (SELECT feature, ts, latency_ms AS baseline, latency_ms * (1 + (id % 7 - 3) / 50.0::DOUBLE) AS shadow FROM @telemetry),
d AS (SELECT *, CASE WHEN baseline <> 0 THEN 100.0 * (shadow - baseline) / baseline END AS delta FROM r),
k AS (SELECT *, CASE WHEN coalesce(abs(delta) < 1.0, true) THEN 'neutral' WHEN delta > 0 THEN 'win' ELSE 'regression' END AS kind FROM d)
SELECT feature, date_trunc('hour', ts) AS hour, count(*) FILTER (WHERE kind = 'win') AS win, count(*) FILTER (WHERE kind = 'regression') AS regression, count(*) FILTER (WHERE kind = 'neutral') AS neutral,
round(avg(delta) FILTER (WHERE kind <> 'neutral'), 6) AS mean, round(avg(delta * delta) FILTER (WHERE kind <> 'neutral') - pow(avg(delta) FILTER (WHERE kind <> 'neutral'), 2), 4) AS variance FROM k GROUP BY 1, 2""")
def shadow_win_loss(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return O.win_loss(t.select("feature", "ts", F.col("latency_ms").alias("baseline"), (F.col("latency_ms") * (1 + (F.col("id") % 7 - 3) / F.lit(50.0))).alias("shadow")))


@query("""SELECT feature, round(sum(result_count * CASE feature WHEN 'click' THEN 3.0 WHEN 'view' THEN 0.5 ELSE 1.0 END::DOUBLE / 1e6), 6) AS cost, count(*) AS calls, round(avg(1.0::DOUBLE - failed), 6) AS success FROM @telemetry GROUP BY 1""")
def cost_rollup(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumnRenamed("result_count", "tokens")
    price = dict.fromkeys([r.feature for r in t.select("feature").distinct().collect()], 1.0) | {"click": 3.0, "view": 0.5}
    return O.cost_rollup(t, "feature", price)


@query("""WITH r AS (SELECT id, CAST(ts AS DATE) AS day, round(sum(round(result_count * 0.001::DOUBLE, 6)) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 4) AS running FROM @telemetry)
SELECT id, day, running FROM r WHERE running > 5""")
def daily_cost_cap(spark, sf_dir):
    out = O.over_cap(telemetry(spark, sf_dir), F.col("result_count") * 0.001, 5.0)
    return out.select("id", F.to_date("ts").alias("day"), "running")


@query("""SELECT s.status, count(t.id) AS n FROM (SELECT unnest(['ok', 'failed', 'running']) AS status) s LEFT JOIN @telemetry t ON s.status = CASE WHEN t.failed = 1 THEN 'failed' ELSE 'ok' END GROUP BY 1""")
def status_counts(spark, sf_dir):
    t = telemetry(spark, sf_dir).groupBy(F.when(F.col("failed") == 1, "failed").otherwise("ok").alias("status")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([("ok",), ("failed",), ("running",)], "status string").join(t, "status", "left").fillna(0, ["n"])


@query("""SELECT agent, count(*) AS n, CASE WHEN sum(failed) / count(*)::DOUBLE > 0.07 THEN 'red' WHEN sum(failed) / count(*)::DOUBLE > 0.05 THEN 'yellow' ELSE 'green' END AS light FROM @telemetry GROUP BY 1""")
def health_lights(spark, sf_dir):
    rate = F.sum("failed") / F.count("*")
    return telemetry(spark, sf_dir).groupBy("agent").agg(F.count("*").alias("n"), F.when(rate > 0.07, "red").when(rate > 0.05, "yellow").otherwise("green").alias("light"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, feature, sum(latency_ms) AS v FROM @telemetry GROUP BY 1, 2), l AS (SELECT *, lag(v) OVER (PARTITION BY feature ORDER BY day) AS b FROM d)
SELECT feature, day AS ts, round((v - b) / b, 6) AS change, CASE WHEN b IS NULL THEN 'BASELINE_ONLY' WHEN b = 0 THEN 'SKIP' WHEN abs((v - b) / b) > 0.1 THEN 'FAIL' ELSE 'PASS' END AS status FROM l""")
def daily_drift(spark, sf_dir):
    d = telemetry(spark, sf_dir).groupBy(F.to_date("ts").alias("ts"), "feature").agg(F.sum("latency_ms").alias("v"))
    return O.drift(d, "v", ["feature"]).select("feature", "ts", "change", "status")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM @telemetry GROUP BY 1) SELECT day, n, coalesce(n - lag(n) OVER (ORDER BY day), 0) AS delta FROM d""")
def snapshot_delta(spark, sf_dir):
    d = telemetry(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return d.withColumn("delta", F.coalesce(F.col("n") - F.lag("n").over(W.orderBy("day")), F.lit(0)))  # one row a day


@query("""SELECT user_id, CAST(date_trunc('day', ts - INTERVAL 9 HOUR) + INTERVAL 9 HOUR AS TIMESTAMP) AS epoch, count(*) AS n, round(greatest(1 / 60.0::DOUBLE, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6), 6) AS hours FROM @telemetry GROUP BY 1, 2""")
def epoch_sessions(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    hours = F.greatest(F.lit(1 / 60.0), (us(F.max("ts")) - us(F.min("ts"))) / F.lit(3600e6))
    return t.groupBy("user_id", O.epochs(F.col("ts")).alias("epoch")).agg(F.count("*").alias("n"), F.round(hours, 6).alias("hours"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM @telemetry),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def gap_sessions(spark, sf_dir):
    return O.gap_sessions(telemetry(spark, sf_dir))


@query("""WITH m AS (SELECT id, agent, ts FROM @telemetry WHERE failed = 0), b AS (SELECT agent, ts, id AS brief FROM @telemetry WHERE failed = 1),
j AS (SELECT m.id, m.agent, m.ts, b.brief, row_number() OVER (PARTITION BY m.id ORDER BY b.ts DESC, b.brief DESC) AS n FROM m LEFT JOIN b ON b.agent = m.agent AND b.ts <= m.ts)
SELECT id, agent, ts, coalesce(brief, -1) AS brief FROM j WHERE n = 1""")
def as_of_join(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return O.as_of_join(t.where("failed = 0").select("id", "agent", "ts"), t.where("failed = 1").select("agent", "ts", F.col("id").alias("brief")), "agent", "brief").fillna(-1, ["brief"])


@query("""WITH l AS (SELECT CASE WHEN feature IN ('click', 'view') THEN feature ELSE 'other' END AS label, min(ts) AS t, count(*) AS n FROM @telemetry GROUP BY 1)
SELECT label, n, CAST("order" AS INTEGER) AS "order" FROM (SELECT *, row_number() OVER (ORDER BY t, label) AS "order" FROM l) WHERE "order" <= 2""")
def label_cap(spark, sf_dir):
    return O.capped_labels(telemetry(spark, sf_dir), "feature", ["click", "view"], 2).select("label", "n", "order")


@query("""SELECT user_id, id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM @telemetry WHERE failed = 1) WHERE n = 1""")
def first_failure(spark, sf_dir):
    first = telemetry(spark, sf_dir).where("failed = 1").groupBy("user_id").agg(F.min(F.struct("ts", "id")).alias("m"))
    return first.select("user_id", "m.id", "m.ts")


@query("""WITH p AS (SELECT o_custkey AS agent, l_suppkey AS id, max(o_orderdate) AS served_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT c_custkey AS agent, s_suppkey AS id, served_at FROM customer JOIN supplier ON s_nationkey = c_nationkey LEFT JOIN p ON p.agent = c_custkey AND p.id = s_suppkey""")
def last_served(spark, sf_dir):
    """Correlated maximum as a pre-aggregate; the pairs are the result's own size and are not shuffled."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agent"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    asked = o.join(c.distinct(), F.col("o_custkey") == F.col("agent")).select("agent", "nation", "o_orderkey", "o_orderdate")
    scratch = Scratch(spark)
    lines = li.join(scratch.broadcast_if_small(scratch.keep(s.distinct())), F.col("l_suppkey") == F.col("id")).select("id", F.col("nation").alias("of_"), "l_orderkey")
    served = asked.join(lines, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("of_") == F.col("nation"))).groupBy("agent", "nation", "id").agg(F.max("o_orderdate").alias("served_at"))
    return O.looked_up(c, s, "nation", served, "agent", "id", "served_at")
