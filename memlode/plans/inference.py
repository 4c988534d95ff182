"""Queries of clustered, weighted and randomised comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memlode.operators import inference as I
from memlode.operators import ranking
from memlode.plans.base import Registry, chunks, telemetry
from memlode.session import table

R = Registry()
query = R.query


def rounded(df, *names, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


def lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("cluster"), F.when(F.col("l_linestatus") == "F", "treatment").otherwise("control").alias("arm"), (F.col("l_returnflag") == "R").cast("double").alias("hit"), F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"), F.col("l_tax").cast("double").alias("t"))


@query()
def cluster_bootstrap(spark, sf_dir):
    """Whole clusters drawn with replacement; a test holds the draws against plain Python."""
    return rounded(I.ratios(lines(spark, sf_dir), "cluster", "arm", "hit", "q", 200), "estimate", "lo", "hi", "p")


@query()
def bootstrap_difference(spark, sf_dir):
    return rounded(I.ratio_difference(lines(spark, sf_dir), "cluster", "arm", "hit", "q", "treatment", "control", 200), "estimate", "lo", "hi", "p")


@query()
def cluster_means(spark, sf_dir):
    return rounded(I.mean_of_means(lines(spark, sf_dir), "cluster", "hit", 200), "estimate", "lo", "hi", "p")


@query("""WITH v AS (SELECT l_suppkey AS c, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS x FROM lineitem), m AS (SELECT avg(x) AS m, count(*)::DOUBLE AS n FROM v), g AS (SELECT c, sum(x - m.m) AS e FROM v, m GROUP BY c),
s AS (SELECT sqrt(sum(e * e) / (max(m.n) * max(m.n)) * (count(*)::DOUBLE / (count(*) - 1))) AS se, count(*) AS clusters, max(m.m) AS mean FROM g, m) SELECT round(mean, 6) AS mean, round(se, 6) AS se, round(mean - 1.96 * se, 6) AS lo, round(mean + 1.96 * se, 6) AS hi, clusters FROM s""")
def cluster_robust_mean(spark, sf_dir):
    return rounded(I.robust_mean(lines(spark, sf_dir), "cluster", "hit"), "mean", "se", "lo", "hi")


@query("""WITH e AS (SELECT *, failed = 1 AS census, id % 10 = 0 AS drawn FROM @telemetry), s AS (SELECT count(*) FILTER (WHERE NOT census)::DOUBLE / count(*) FILTER (WHERE NOT census AND drawn) AS w FROM e),
w AS (SELECT agent, latency_ms > 50 AS hit, CASE WHEN census THEN 1.0::DOUBLE WHEN drawn THEN s.w ELSE 0 END AS w FROM e, s)
SELECT agent, round(sum(w), 6) AS opportunities, round(sum(CASE WHEN hit THEN w ELSE 0 END), 6) AS hits, round(sum(CASE WHEN hit THEN w ELSE 0 END) / sum(w), 6) AS rate FROM w GROUP BY 1""")
def sampled_rate(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return rounded(I.weighted_rate(t, ["agent"], F.col("failed") == 1, F.col("id") % 10 == 0, F.col("latency_ms") > 50), "opportunities", "hits", "rate")


def units(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    arm = F.when(F.crc32(F.col("s_suppkey").cast("string")) % 2 == 0, "treatment").otherwise("control")
    return s.select(F.col("s_suppkey").alias("unit"), F.col("s_acctbal").cast("double").alias("y"), arm.alias("arm"), (F.col("s_nationkey") % 5).alias("block"))


@query()
def permutation_test(spark, sf_dir):
    """Arms dealt anew within blocks, as the design does; a test holds it against every assignment of a small one."""
    return rounded(I.rerandomised(units(spark, sf_dir), "y", "arm", "block", 500), "d", "p")


@query("""WITH r AS (SELECT corr(l_quantity::DOUBLE, l_discount::DOUBLE) AS xy, corr(l_quantity::DOUBLE, l_tax::DOUBLE) AS xz, corr(l_discount::DOUBLE, l_tax::DOUBLE) AS yz FROM lineitem)
SELECT round(xy, 6) AS xy, round(xz, 6) AS xz, round(yz, 6) AS yz, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM r""")
def partial_correlation(spark, sf_dir):
    return rounded(I.partial_correlation(lines(spark, sf_dir), "q", "d", "t"), "xy", "xz", "yz", "partial")


@query("""WITH w AS (SELECT unnest([0.0::DOUBLE, 6.0, 12.0, 18.0]) AS washout), e AS (SELECT extract('hour' FROM ts) AS h, failed FROM @telemetry)
SELECT washout, count(*) AS n, count(*) FILTER (WHERE failed = 1) AS hits, round(count(*) FILTER (WHERE failed = 1)::DOUBLE / count(*), 6) AS rate FROM e JOIN w ON h >= washout GROUP BY 1""")
def washout_sensitivity(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumn("h", F.hour("ts"))
    return rounded(I.washout_sensitivity(t, "h", F.col("failed") == 1, [0.0, 6.0, 12.0, 18.0]), "rate")


@query("SELECT agent, round(quantile_cont(latency_ms, 0.95), 6) AS carry_over, count(*) AS n FROM @telemetry GROUP BY 1")
def carry_over(spark, sf_dir):
    return rounded(I.carry_over(telemetry(spark, sf_dir), "agent", "latency_ms"), "carry_over")


@query("""WITH s AS (SELECT id, source_file, last_accessed_at, pain, row_number() OVER (PARTITION BY source_file ORDER BY last_accessed_at ASC NULLS FIRST, pain DESC NULLS LAST, id) AS place FROM @chunks) SELECT id, source_file, place FROM s WHERE place <= 8""")
def least_recently_served(spark, sf_dir):
    """Never served first, then the longest unserved; equal ones by weight."""
    return ranking.coverage_order(chunks(spark, sf_dir), "source_file", "last_accessed_at", "pain").where("place <= 8").select("id", "source_file", "place")


@query("""WITH a AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS store, source_file, row_number() OVER (PARTITION BY source_file, id % 2 ORDER BY access_count DESC, id) AS n FROM @chunks), k AS (SELECT source_file, store, id, 1.0::DOUBLE / (60 + n) AS s FROM a WHERE n <= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY round(s, 9) DESC, store, id) AS rank FROM k) SELECT source_file AS query_id, store, id, rank FROM r WHERE rank <= 5""")
def cross_store(spark, sf_dir):
    """The hits of two stores in one list, each with its store."""
    w = W.partitionBy("source_file").orderBy(F.desc("access_count"), "id")
    hits = lambda k: chunks(spark, sf_dir).where(F.col("id") % 2 == k).select(F.col("source_file").alias("query_id"), "id", F.row_number().over(w).alias("rank")).where("rank <= 10")
    return ranking.merged_stores({"a": hits(0), "b": hits(1)}, 5).select("query_id", "store", "id", "rank")
