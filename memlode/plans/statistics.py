"""Queries of trial and batch statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memlode.operators import stats as S
from memlode.operators import telemetry as O
from memlode.plans.base import Registry, telemetry
from memlode.session import table

R = Registry()
query = R.query


def rounded(df, *names, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


BATCH = "(SELECT l_linenumber AS batch, l_quantity AS x FROM lineitem)"
TPOINT = "CASE WHEN n - 1 > 120 THEN 1.96 END"


#: Two-sided points of Student's t for n values, as a table the SQL joins.
TPOINTS = "(VALUES " + ", ".join(f"({n}, {S.t95(n)}::DOUBLE)" for n in range(2, 122)) + ") AS tp(k, t)"


@query(f"""WITH g AS (SELECT s_nationkey AS batch, count(*) AS n, avg(s_acctbal) AS mean, stddev_samp(s_acctbal) AS sd FROM supplier GROUP BY 1), t AS (SELECT g.*, CASE WHEN n < 2 THEN NULL ELSE coalesce(t, 1.96::DOUBLE) END AS t FROM g LEFT JOIN {TPOINTS} ON k = n)
SELECT batch, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - t * sd / sqrt(n), 6) AS lo, round(mean + t * sd / sqrt(n), 6) AS hi FROM t""")
def batch_mean_ci(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("batch"), F.col("s_acctbal").alias("x"))
    return rounded(S.mean_ci(s, ["batch"], "x"), "mean", "sd", "lo", "hi").select("batch", "n", "mean", "sd", "lo", "hi")


@query("""WITH g AS (SELECT c_mktsegment AS metric, count(*) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd FROM customer GROUP BY 1), b AS (SELECT c_mktsegment AS metric, avg(c_acctbal) - 400 AS base FROM customer WHERE c_mktsegment <> (SELECT min(c_mktsegment) FROM customer) GROUP BY 1)
SELECT metric, CASE WHEN base IS NULL THEN 'NO_BASELINE' WHEN mean - base > 50 AND mean - 1.96 * sd / sqrt(n) - base > 50 THEN 'PASS' ELSE 'FAIL' END AS gate FROM g LEFT JOIN b USING (metric)""")
def ship_gate(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("metric"), F.col("c_acctbal").alias("x"))
    first = c.agg(F.min("metric").alias("first"))
    base = c.join(F.broadcast(first), F.col("metric") != F.col("first")).groupBy("metric").agg((F.avg("x") - 400).alias("base"))
    return S.ship_gate(S.mean_ci(c, ["metric"], "x"), base, ["metric"], 50.0).select("metric", "gate")


@query("""WITH g AS (SELECT l_shipdate >= TIMESTAMP '1995-01-01' AS late, count(*)::DOUBLE AS n, count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE AS k FROM lineitem GROUP BY 1)
SELECT late, round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS lo, round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS hi FROM g""")
def wilson_interval(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")).alias("late")).agg(F.count("*").cast("double").alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).cast("double").alias("k"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return g.select("late", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("""WITH g AS (SELECT o_custkey, count(*)::DOUBLE AS m, sum(o_totalprice / 1000) AS s, sum(pow(o_totalprice / 1000, 2)) AS q FROM orders GROUP BY 1), a AS (SELECT count(*) AS k, sum(m) AS n, sum(m * m) AS mm, sum(s) AS t, sum(q) AS q, sum(s * s / m) AS b FROM g),
w AS (SELECT k, n, (b - t * t / n) / (k - 1) AS msb, (q - b) / (n - k) AS msw, (n - mm / n) / (k - 1) AS m0 FROM a) SELECT k, CAST(n AS BIGINT) AS n, round((msb - msw) / (msb + (m0 - 1) * msw), 6) AS icc FROM w""")
def intraclass_correlation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("x", F.col("o_totalprice") / 1000)
    return rounded(S.icc(o, "o_custkey", "x"), "icc")


@query("""WITH v AS (SELECT l_orderkey AS e, l_linenumber AS p, max(l_returnflag = 'R') AS f FROM lineitem GROUP BY 1, 2), g AS (SELECT e, count(*) AS n, count(*) FILTER (WHERE f) AS bad FROM v GROUP BY 1)
SELECT e AS episode_id, CASE WHEN n < 3 THEN 'unknown' WHEN 2 * bad > n THEN 'failure' ELSE 'not_failure' END AS verdict FROM g""")
def majority_verdict(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("panelist"), (F.col("l_returnflag") == "R").alias("failure"))
    return S.majority(v).select("episode_id", "verdict")


@query("""WITH g AS (SELECT avg((a = b)::INT) AS po, avg(a::INT) AS pa, avg(b::INT) AS pb FROM (SELECT l_returnflag = 'R' AS a, l_quantity > 25 AS b FROM lineitem)) SELECT round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM g""")
def cohens_kappa(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("a"), (F.col("l_quantity") > 25).alias("b"))
    return rounded(S.kappa(li, "a", "b"), "kappa")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def pearson(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(latency_ms) AS y FROM @telemetry GROUP BY 1), x AS (SELECT day, datediff('day', (SELECT min(day) FROM d), day)::DOUBLE AS x, y FROM d)
SELECT day, round(y - (SELECT regr_intercept(y, x) FROM x) - (SELECT regr_slope(y, x) FROM x) * x, 4) AS residual FROM x""")
def study_day_residuals(spark, sf_dir):
    d = telemetry(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.sum("latency_ms").alias("y"))
    d = d.crossJoin(F.broadcast(d.agg(F.min("day").alias("first")))).withColumn("x", F.datediff("day", "first").cast("double"))
    return rounded(S.residuals(d, "x", "y").select("day", "residual"), "residual", places=4)


@query("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT round(corr(a::DOUBLE, b::DOUBLE), 6) AS rho FROM r""")
def spearman(spark, sf_dir):
    return rounded(S.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice"), "rho")


def itt_units(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumn("epoch", O.epochs(F.col("ts")))
    hours = F.greatest(F.lit(1 / 60.0), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(3600e6))
    span = t.groupBy("epoch", "user_id").agg(hours.alias("h")).groupBy("epoch").agg(F.sum("h").alias("hours"))
    first = F.min(F.when(F.col("failed") == 1, F.col("epoch"))).over(W.partitionBy("user_id"))
    old = t.withColumn("first", first).where("first is not null and first <= epoch - interval 24 hours and unix_micros(cast(ts as timestamp)) - unix_micros(cast(epoch as timestamp)) >= 7200000000")
    o = old.groupBy("epoch").agg(F.sum(F.when(F.col("failed") == 1, 1.0).otherwise(2.0)).alias("opp"), F.sum(F.when(F.col("failed") == 1, 1.0).otherwise(0.0)).alias("rep"))
    arm = F.when(F.dayofyear("epoch") % 2 == 0, "treatment").otherwise("control")
    return span.join(o, "epoch", "left").fillna(0.0, ["opp", "rep"]).withColumn("arm", arm)


ITT = """t AS (SELECT *, CAST(date_trunc('day', ts - INTERVAL 9 HOUR) + INTERVAL 9 HOUR AS TIMESTAMP) AS epoch FROM @telemetry), h AS (SELECT epoch, sum(h) AS hours FROM (SELECT epoch, user_id, greatest(1 / 60.0::DOUBLE, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6) AS h FROM t GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT *, min(CASE WHEN failed = 1 THEN epoch END) OVER (PARTITION BY user_id) AS first FROM t), o AS (SELECT epoch, sum(CASE WHEN failed = 1 THEN 1.0::DOUBLE ELSE 2.0 END) AS opp, sum(failed)::DOUBLE AS rep FROM f WHERE first <= epoch - INTERVAL 24 HOUR AND ts - epoch >= INTERVAL 2 HOUR GROUP BY 1),
u AS (SELECT h.epoch, hours, coalesce(opp, 0) AS opp, coalesce(rep, 0) AS rep, CASE WHEN dayofyear(h.epoch) % 2 = 0 THEN 'treatment' ELSE 'control' END AS arm FROM h LEFT JOIN o ON o.epoch = h.epoch)"""


@query(f"WITH {ITT} SELECT arm, count(*) AS epochs, round(sum(rep) / sum(hours), 6) AS density, round(sum(opp) / sum(hours), 6) AS opp_rate, round(sum(rep) / nullif(sum(opp), 0), 6) AS proportion FROM u GROUP BY 1")
def itt_by_arm(spark, sf_dir):
    g = itt_units(spark, sf_dir).groupBy("arm").agg(F.count("*").alias("epochs"), (F.sum("rep") / F.sum("hours")).alias("density"), (F.sum("opp") / F.sum("hours")).alias("opp_rate"), (F.sum("rep") / F.nullif(F.sum("opp"), F.lit(0.0))).alias("proportion"))
    return rounded(g, "density", "opp_rate", "proportion")


@query("""WITH c AS (SELECT o_orderpriority AS sig, o_custkey AS k, count(*) AS n, avg(o_totalprice) AS cost FROM orders GROUP BY 1, 2 HAVING count(*) >= 2) SELECT sig, k, round(cost - min(cost) OVER (PARTITION BY sig), 4) AS regret FROM c""")
def task_regret(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("sig"), F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("cost")).where("n >= 2")
    return c.select("sig", "k", F.round(F.col("cost") - F.min("cost").over(W.partitionBy("sig")), 4).alias("regret"))


@query("""SELECT count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b FROM (SELECT l_quantity > 25 AS a, l_discount > 0.05 AS b FROM lineitem)""")
def mcnemar_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 25).alias("a"), (F.col("l_discount") > 0.05).alias("b"))
    return li.agg(F.count(F.when(F.col("a") & ~F.col("b"), 1)).alias("only_a"), F.count(F.when(F.col("b") & ~F.col("a"), 1)).alias("only_b"))


@query("""WITH t AS (SELECT s_name AS name, round((s_suppkey % 97 + 1) / 2000.0::DOUBLE, 6) AS p FROM supplier), r AS (SELECT *, least(1.0::DOUBLE, p * ((SELECT count(*) FROM t) - row_number() OVER (ORDER BY p, name) + 1)) AS raw FROM t)
SELECT name, p, round(max(raw) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM r""")
def holm_adjusted(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.round((F.col("s_suppkey") % 97 + 1) / 2000.0, 6).alias("p"))
    return rounded(S.holm(t), "adjusted")


@query("""WITH t AS (SELECT conv_id, turn, role, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role))
SELECT conv_id, turn AS asked, next_turn AS answered FROM t WHERE role = 'user' AND next_role = 'assistant'""")
def call_pairs(spark, sf_dir):
    """Every question with the answer that directly follows it."""
    w = W.partitionBy("conv_id").orderBy("turn", "role")
    t = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").select("conv_id", "turn", "role", F.lead("turn").over(w).alias("answered"), F.lead("role").over(w).alias("next"))
    return t.where("role = 'user' AND next = 'assistant'").select("conv_id", F.col("turn").alias("asked"), "answered")


@query("""WITH u AS (SELECT p_partkey AS id, md5('7:' || p_partkey) AS h, p_brand FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY h, id) AS n FROM u) SELECT id, p_brand FROM r WHERE n <= 5""")
def stratified_sample(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.md5(F.concat(F.lit("7:"), F.col("p_partkey").cast("string"))).alias("h"))
    return p.withColumn("n", F.row_number().over(W.partitionBy("p_brand").orderBy("h", "id"))).where("n <= 5").select("id", "p_brand")
