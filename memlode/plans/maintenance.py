"""Queries of maintenance, audit and briefs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memlode.operators import maintenance as O
from memlode.operators import ranking
from memlode.plans.base import Registry, chunks, telemetry
from memlode.plans.retrieval import SALIENCE, as_of
from memlode.session import Scratch, table

R = Registry()
query = R.query


@query("""WITH r AS (SELECT (user_id * 7 + event_id) % 1000 AS id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1) SELECT c.id, access_count + coalesce(n, 0) AS access_count, greatest(last_accessed_at, last) AS last_accessed_at FROM @chunks c LEFT JOIN r ON r.id = c.id""")
def access_tracking(spark, sf_dir):
    reads = telemetry(spark, sf_dir).select(((F.col("user_id") * 7 + F.col("id")) % 1000).alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return O.access_counts(chunks(spark, sf_dir), reads).select("id", "access_count", "last_accessed_at")


@query("SELECT min(id) AS id, source_file, chunk_type, count(*) AS n, min(source_date) AS first_date, max(source_date) AS last_date FROM @chunks GROUP BY 2, 3 HAVING count(*) >= 3")
def compacted(spark, sf_dir):
    return O.compacted(chunks(spark, sf_dir))


@query("""WITH o AS (SELECT c_name AS f, md5(c_mktsegment) AS h FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_name AS f, md5(CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE c_mktsegment END) AS h FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(o.f, n.f) AS source_file, CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'delete' WHEN o.h = n.h THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n ON o.f = n.f""")
def reindex_plan(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("source_file"), F.md5("c_mktsegment").alias("fp"))
    new = c.where("c_custkey % 5 <> 0").select(F.col("c_name").alias("source_file"), F.md5(F.when(F.col("c_custkey") % 4 == 0, "x").otherwise(F.col("c_mktsegment"))).alias("fp"))
    return O.reindex_plan(old, new)


@query("""WITH m AS (SELECT event_id % 1000 AS id, ts, CASE event_id % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'refuted' ELSE 'stale' END AS mark, CASE WHEN event_id % 5 = 0 THEN event_id % 900 END AS superseded_by FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, mark DESC) AS n FROM m WHERE superseded_by IS NULL OR superseded_by <> id)
SELECT c.id, CASE mark WHEN 'canonical' THEN 1.0::DOUBLE WHEN 'refuted' THEN 0.05 ELSE confidence END AS confidence, coalesce(mark = 'stale', false) AS stale FROM @chunks c LEFT JOIN l ON l.id = c.id AND n = 1""")
def confidence_marks(spark, sf_dir):
    e = telemetry(spark, sf_dir)
    k = F.col("id") % 3
    marks = e.select((F.col("id") % 1000).alias("id"), "ts", F.when(k == 0, "canonical").when(k == 1, "refuted").otherwise("stale").alias("mark"), F.when(F.col("id") % 5 == 0, F.col("id") % 900).alias("superseded_by"))
    return O.marked(chunks(spark, sf_dir), marks).select("id", "confidence", "stale")


@query("""WITH RECURSIVE e AS (SELECT agent, id, id // 1000 AS block, sha256('{"agent":"' || agent || '","feature":"' || feature || '","id":' || id || '}') AS h FROM @telemetry),
b AS (SELECT agent, block, min(id) AS first_id, max(id) AS last_id, count(*) AS n, sha256(string_agg(h, '' ORDER BY id)) AS digest FROM e GROUP BY 1, 2),
o AS (SELECT *, coalesce(lag(last_id) OVER w, -1) AS previous_last, row_number() OVER w AS k FROM b WINDOW w AS (PARTITION BY agent ORDER BY block)),
c AS (SELECT *, sha256('|' || digest) AS chain FROM o WHERE k = 1 UNION ALL SELECT o.*, sha256(c.chain || '|' || o.digest) FROM o JOIN c ON o.agent = c.agent AND o.k = c.k + 1)
SELECT agent, CAST(block AS BIGINT) AS block, first_id, last_id, n, previous_last, digest, chain FROM c""")
def audit_checkpoints(spark, sf_dir):
    c = O.checkpoints(telemetry(spark, sf_dir).select("agent", "feature", "id"), "agent")
    return c.select("agent", "block", "first_id", "last_id", "n", F.coalesce("previous_last", F.lit(-1)).alias("previous_last"), "digest", "chain")


@query("""SELECT (SELECT count(*) FROM lineitem l LEFT JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL) AS orphans, (SELECT count(*) FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_custkey IS NULL) AS dangling, (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders) AS doubled""")
def schema_invariants(spark, sf_dir):
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    a = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("orphans"))
    b = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("dangling"))
    return a.crossJoin(b).crossJoin(o.agg((F.count("*") - F.countDistinct("o_orderkey")).alias("doubled")))


LINE = "trim(regexp_replace(regexp_replace(coalesce(list_filter(string_split(chunk_text, chr(10)), lambda x: length(trim(x)) > 0)[1], ''), '<[^>]*>', '', 'g'), '^[#>*\\-\\s]+', ''))"


@query(f"""WITH b AS (SELECT id, source_file AS title, {LINE} AS l, datediff('day', source_date, CAST(@as_of AS DATE)) AS age, {SALIENCE} AS s FROM @chunks)
SELECT id, title, CASE WHEN length(l) > 140 THEN left(l, 139) || '…' ELSE l END AS line, CAST(age AS INTEGER) AS age, CAST(ceil(length(CASE WHEN length(l) > 140 THEN left(l, 139) || '…' ELSE l END) / 4.0) AS BIGINT) AS tokens, round(s, 6) AS salience FROM b""")
def brief_rows(spark, sf_dir):
    b = O.brief(chunks(spark, sf_dir), ranking.salience(as_of()), as_of())
    return b.withColumn("salience", F.round("salience", 6))


@query(f"""WITH s AS (SELECT id, source_file, round({SALIENCE}, 6) AS s, length(chunk_text) AS cost FROM @chunks), r AS (SELECT *, sum(cost) OVER (PARTITION BY source_file ORDER BY s DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM s)
SELECT id, source_file, CAST(running AS BIGINT) AS running FROM r WHERE running <= 8000""")
def token_budget(spark, sf_dir):
    c = chunks(spark, sf_dir).select("id", "source_file", F.round(ranking.salience(as_of()), 6).alias("s"), F.length("chunk_text").alias("cost"))
    return O.within_budget(c, "source_file", [F.desc("s"), "id"], "cost", 8000).select("id", "source_file", "running")


@query("""WITH c AS (SELECT conv_id, turn, role, length(text) AS cost FROM conversations), r AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(cost) OVER (PARTITION BY conv_id) AS total FROM c)
SELECT conv_id, turn FROM r WHERE before < 0.5::DOUBLE * total""")
def recent_share(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("cost"))
    return O.through_share(c, "conv_id", [F.desc("turn"), "role"], "cost", 0.5).select("conv_id", "turn")


@query("""WITH s AS (SELECT user_id % 100 AS id, count(*) AS n FROM @telemetry GROUP BY 1) SELECT c.id, round(CASE WHEN coalesce(pain, 0.2) >= 0.9 THEN 0.0::DOUBLE ELSE least(0.15::DOUBLE, 0.05 * ln(1 + coalesce(n, 0))) END, 6) AS penalty FROM @chunks c LEFT JOIN s ON s.id = c.id""")
def novelty_penalty(spark, sf_dir):
    s = telemetry(spark, sf_dir).groupBy((F.col("user_id") % 100).alias("id")).agg(F.count("*").alias("n"))
    c = chunks(spark, sf_dir).join(s, "id", "left")
    return c.select("id", F.round(O.novelty(F.coalesce("n", F.lit(0)), F.coalesce("pain", F.lit(0.2))), 6).alias("penalty"))


@query("""WITH s AS (SELECT user_id AS id, max(result_count % 5) AS sev FROM @telemetry WHERE ts <= TIMESTAMP '2024-01-29' GROUP BY 1) SELECT id, round(0.043 * CASE sev WHEN 1 THEN 0.25::DOUBLE WHEN 2 THEN 0.5 WHEN 3 THEN 0.75 WHEN 4 THEN 1.0 ELSE 0 END, 6) AS boost FROM s""")
def outcome_boost(spark, sf_dir):
    t = telemetry(spark, sf_dir).where(F.col("ts") <= F.lit("2024-01-29").cast("timestamp"))
    s = t.groupBy(F.col("user_id").alias("id")).agg(F.max(F.col("result_count") % 5).alias("sev"))
    return s.select("id", F.round(O.outcome_boost(F.col("sev")), 6).alias("boost"))


@query("""SELECT source_file, arg_min(id, [sha256('bar|' || source_file || '|' || id), lpad(CAST(id AS VARCHAR), 20, '0')]) AS id FROM @chunks GROUP BY 1""")
def designated(spark, sf_dir):
    return O.designated(chunks(spark, sf_dir), "source_file", "bar")


@query("""WITH a AS (SELECT c_nationkey AS k, list_distinct(list(c_custkey)) AS a FROM customer WHERE c_acctbal > 2000 GROUP BY 1), b AS (SELECT c_nationkey AS k, list_distinct(list(c_custkey)) AS b FROM customer WHERE c_acctbal < 6000 GROUP BY 1),
j AS (SELECT k, coalesce(a, []) AS a, coalesce(b, []) AS b FROM a FULL JOIN b USING (k)), n AS (SELECT k, len(list_intersect(a, b)) AS i, len(a) AS na, len(b) AS nb FROM j)
SELECT k, CAST(nb - i AS INTEGER) AS enter, CAST(na - i AS INTEGER) AS leave, round(i / (na + nb - i)::DOUBLE, 6) AS jaccard FROM n""")
def served_churn(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), "c_acctbal")
    return O.churn(c.where("c_acctbal > 2000"), c.where("c_acctbal < 6000"), "k")


@query("SELECT id, feature, ts FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY ts DESC, id DESC) AS n FROM @telemetry) WHERE n <= 10")
def latest_runs(spark, sf_dir):
    w = W.partitionBy("feature").orderBy(F.desc("ts"), F.desc("id"))
    return telemetry(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 10").select("id", "feature", "ts")


@query("SELECT 'customer' AS name, count(*) AS n, true AS whole FROM customer UNION ALL SELECT 'orders', count(*), true FROM orders UNION ALL SELECT 'events', count(*), true FROM events")
def archive_manifest(spark, sf_dir):
    """Tables written as a bundle and read back against its manifest: rows, and whether every file has a digest."""
    names = ("customer", "orders", "events")
    path = Scratch(spark).place()
    own = {t: table(spark, sf_dir, t) for t in names}
    manifest = O.write_bundle(own, path)
    back = O.read_bundle(spark, path, {n: df.schema for n, df in own.items()})
    out = None
    for n in names:
        files = manifest.where(F.col("file").startswith(f"{n}/")).agg(F.every(F.length("sha256") == 64).alias("whole"))
        one = back[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n").crossJoin(files)
        out = one if out is None else out.union(one)
    return out


@query()
def attribution(spark, sf_dir):
    """Which items a message used, by token overlap in its conversation; held against plain Python in tests."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("msg_id"), F.col("conv_id").alias("grp"), "text", "role")
    items = c.where("role = 'user'").select(F.col("msg_id").alias("item_id"), "grp", "text")
    return O.attributed(c.where("role = 'assistant'"), items, least=0.05, common=0.5)
