"""Queries of rewrites, imports, series, events and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlode.operators import lifecycle as O
from memlode.plans.base import Registry, chunks, relations, telemetry
from memlode.session import table

R = Registry()
query = R.query

LINE = "trim(regexp_replace(regexp_replace(coalesce(list_filter(string_split(chunk_text, chr(10)), lambda x: length(trim(x)) > 0)[1], ''), '<[^>]*>', '', 'g'), '^[#>*\\-\\s]+', ''))"


@query(f"""WITH g AS (SELECT source_file, chunk_type, count(*) AS n, min(id) AS low, max(source_date) AS newest FROM @chunks GROUP BY 1, 2 HAVING count(*) >= 3),
l AS (SELECT c.source_file, c.chunk_type, c.id, {LINE} AS l, row_number() OVER (PARTITION BY c.source_file, c.chunk_type ORDER BY c.id) AS k FROM @chunks c),
t AS (SELECT source_file, chunk_type, string_agg(CASE WHEN length(l) > 140 THEN left(l, 139) || '…' ELSE l END, chr(10) ORDER BY k) AS t FROM l WHERE k <= 20 GROUP BY 1, 2)
SELECT low AS id, newest AS source_date, sha256('[' || n || ' rows]' || chr(10) || t) AS text_sha256 FROM g JOIN t USING (source_file, chunk_type)
UNION ALL SELECT c.id, c.source_date, sha256(c.chunk_text) FROM @chunks c LEFT JOIN g USING (source_file, chunk_type) WHERE g.n IS NULL""")
def compacted_store(spark, sf_dir):
    return O.compact(chunks(spark, sf_dir)).select("id", "source_date", F.sha2("chunk_text", 256).alias("text_sha256"))


def files(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("source_file"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("text"))
    fresh = c.where("id % 12 <> 0").withColumn("text", F.when(F.col("id") % 5 == 0, "changed").otherwise(F.col("text")))
    return c.withColumn("fp", F.md5("text")), fresh.withColumn("id", F.col("id") + 1_000_000).withColumn("fp", F.md5("text"))


@query("""SELECT c_custkey + CASE WHEN c_custkey % 5 = 0 AND c_mktsegment <> 'changed' THEN 1000000 ELSE 0 END AS id, c_name AS source_file, CASE WHEN c_custkey % 5 = 0 THEN 'changed' ELSE c_mktsegment END AS text FROM customer WHERE c_custkey % 12 <> 0""")
def reindexed_store(spark, sf_dir):
    """Kept, changed and vanished files after a reindex."""
    return O.reindexed(*files(spark, sf_dir)).select("id", "source_file", "text")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'new' WHEN s_suppkey % 4 = 0 OR s_suppkey % 5 = 0 THEN 'conflict' ELSE 'same' END AS outcome,
CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 20 = 0 THEN 'name,nation' WHEN s_suppkey % 4 = 0 THEN 'name' WHEN s_suppkey % 5 = 0 THEN 'nation' END AS differs FROM supplier""")
def import_conflicts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    new = s.withColumns({"name": F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("name")), "nation": F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("nation"))})
    out = O.import_report(s.where("id % 3 <> 0"), new, ["id"], ["name", "nation"])
    return out.select("id", "outcome", F.array_join("differs", ",").alias("differs"))


@query("SELECT c_custkey, c_name FROM customer")
def sealed_bundle(spark, sf_dir):
    """Rows encrypted with authenticated data and opened again."""
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    key = b"0123456789abcdef"
    return O.opened(O.sealed(own, key, "customers/1"), key, "customers/1", "c_custkey long, c_name string")


@query("""WITH r AS (SELECT source_file AS file, row_number() OVER (PARTITION BY sha256(chunk_text) ORDER BY id) > 1 AS again FROM @chunks), g AS (SELECT file, count(*) AS n, count(*) FILTER (WHERE again) AS extra FROM r GROUP BY 1)
SELECT file, n, extra FROM g WHERE extra > 0 ORDER BY extra DESC, file LIMIT 20""")
def duplicate_files(spark, sf_dir):
    return O.duplicate_files(chunks(spark, sf_dir), "chunk_text", "source_file")


@query("""SELECT CASE WHEN provenance_kind IN ('llm') THEN provenance_kind END AS kind, count(*) AS n, round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS std FROM @chunks GROUP BY 1""")
def provenance_counts(spark, sf_dir):
    out = O.provenance_counts(chunks(spark, sf_dir), ("llm",))
    return out.select("kind", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("""WITH m AS (SELECT max(ts) AS now FROM @telemetry), r AS (SELECT feature AS provider, result_count / 1000.0::DOUBLE AS c, 1.0::DOUBLE - failed AS ok FROM @telemetry, m WHERE ts >= now - INTERVAL 24 HOUR)
SELECT provider, round(sum(c), 4) AS usd, count(*) AS calls, round(avg(ok), 6) AS success FROM r GROUP BY 1 UNION ALL SELECT NULL, round(coalesce(sum(c), 0), 4), count(*), round(coalesce(avg(ok), 1), 6) FROM r""")
def recent_costs(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    now = t.agg(F.max("ts").alias("now_"))
    own = t.crossJoin(F.broadcast(now))
    out = O.recent_costs(own, F.col("now_").cast("timestamp"), "feature", F.col("result_count") / 1000.0, F.col("failed") == 0)
    return out.select("provider", F.round("usd", 4).alias("usd"), "calls", F.round("success", 6).alias("success"))


@query("""WITH d AS (SELECT feature, CAST(date_trunc('day', ts) AS DATE) AS day, sum(latency_ms) AS total FROM @telemetry GROUP BY 1, 2), l AS (SELECT *, lag(total) OVER w AS previous, lag(day) OVER w AS previous_day FROM d WINDOW w AS (PARTITION BY feature ORDER BY day))
SELECT feature, day, previous_day, round((total - previous) / abs(previous) * 100, 4) AS change_pct FROM l WHERE abs((total - previous) / abs(previous) * 100) > 5""")
def step_changes(spark, sf_dir):
    d = telemetry(spark, sf_dir).groupBy("feature", F.to_date("ts").alias("day")).agg(F.sum("latency_ms").alias("total"))
    return O.step_changes(d, "feature", "day", "total", 5.0).select("feature", "day", "previous_day", F.round("change_pct", 4).alias("change_pct"))


@query("""WITH p AS (SELECT id, ts, 'm' || (id % 3) AS metric, CASE WHEN feature IN ('click', 'view') THEN feature ELSE 'other' END AS feature, agent FROM @telemetry), s AS (SELECT metric, feature, agent, min(ts) AS t FROM p GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY t, feature, agent) AS k FROM s) SELECT p.id, p.metric, p.feature, p.agent FROM p JOIN k ON k.metric = p.metric AND k.feature = p.feature AND k.agent = p.agent WHERE k <= 5""")
def guarded_series(spark, sf_dir):
    t = telemetry(spark, sf_dir).select("id", "ts", F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("metric"), "feature", "agent", F.col("user_id").cast("string").alias("user"))
    return O.guarded_series(t, ["feature", "agent", "user"], {"feature": ["click", "view"]}, ["user"], 5).select("id", "metric", "feature", "agent")


@query("""WITH e AS (SELECT p_partkey AS id, p_name AS name, CASE p_partkey % 4 WHEN 0 THEN 'project' WHEN 1 THEN 'decision' WHEN 2 THEN 'preference' ELSE 'person' END AS entity_type, p_size AS mentions, CASE WHEN p_partkey % 8 = 0 THEN 'closed' END AS status, DATE '2025-01-15' - CAST(p_partkey % 60 AS INT) AS seen FROM part),
u AS (SELECT 'top' AS part, 20 AS most, * FROM e UNION ALL SELECT 'projects', 15, * FROM e WHERE entity_type = 'project' AND status IS NULL UNION ALL SELECT 'decisions', 20, * FROM e WHERE entity_type = 'decision' AND seen >= DATE '2025-01-15' - 30
  UNION ALL SELECT 'preferences', 20, * FROM e WHERE entity_type = 'preference'), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY mentions DESC, id) AS place FROM u)
SELECT part, CAST(place AS INTEGER) AS place, id, name, entity_type FROM r WHERE place <= most""")
def profile(spark, sf_dir):
    """The four parts of a profile: each a top list."""
    i = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("project", "decision", "preference", "person"))), (i % 4 + 1).cast("int"))
    e = table(spark, sf_dir, "part").select(i.alias("id"), F.col("p_name").alias("name"), kind.alias("entity_type"), F.col("p_size").alias("mentions"), F.when(i % 8 == 0, "closed").alias("status"), F.date_sub(F.lit("2025-01-15").cast("date"), (i % 60).cast("int")).alias("last_seen"))
    return O.profile(e, F.lit("2025-01-15").cast("timestamp"))


@query("""SELECT event_id AS op_id, event_type AS op_type, 'success' AS status, round(value, 6) AS duration_ms FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 0""")
def typed_events(spark, sf_dir):
    """Completed operations from a bus of several kinds; events without a required field are left out."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 2 == 0, "success")
    body = F.to_json(F.struct(F.col("event_id").alias("op_id"), F.col("event_type").alias("op_type"), status.alias("status"), F.col("value").alias("duration_ms"), F.lit(1).alias("ts")))
    bus = e.select(F.when(F.col("event_id") % 3 == 0, "op_audit.completed").otherwise("chunk.deleted").alias("kind"), body.alias("payload"))
    return O.typed_events(bus, "op_audit.completed").select("op_id", "op_type", "status", F.round("duration_ms", 6).alias("duration_ms"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS k FROM conversations), f AS (SELECT conv_id, 0::BIGINT AS k, 0::BIGINT AS used, ''::VARCHAR AS kept FROM (SELECT DISTINCT conv_id FROM t)
UNION ALL SELECT f.conv_id, t.k, CASE WHEN used < 380 AND used + length(text) <= 400 THEN used + length(text) ELSE used END, CASE WHEN used < 380 AND used + length(text) <= 400 THEN CASE WHEN used = 0 AND kept = '' THEN text ELSE kept || chr(10) || text END ELSE kept END FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1),
l AS (SELECT conv_id, arg_max(kept, k) AS kept FROM f GROUP BY 1) SELECT l.conv_id, sha256(CASE WHEN kept <> '' THEN kept ELSE left(t.text, 400) END) AS filled_sha256 FROM l JOIN t ON t.conv_id = l.conv_id AND t.k = 1""")
def filled_budget(spark, sf_dir):
    """The turns of a conversation that fit 400 characters, skipping those that do not."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: s.text).alias("texts"))
    return c.select("conv_id", F.sha2(O.filled_budget(F.col("texts"), F.lit(400), joiner="\n"), 256).alias("filled_sha256"))


@query("""WITH e AS (SELECT l_orderkey AS k, list(l_partkey % 10 ORDER BY l_linenumber, l_partkey % 10) AS got, list_distinct(list(l_suppkey % 10)) AS gold FROM lineitem GROUP BY 1), f AS (SELECT k, gold, len(list_filter(got[1:3], lambda x: list_contains(gold, x))) AS n FROM e)
SELECT k, CAST(n > 0 AS INTEGER) AS hit, round(n / len(gold)::DOUBLE, 6) AS recall FROM f""")
def evidence_scores(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    e = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 10).alias("p")))), lambda s: s.p).alias("got"), F.collect_set(F.col("l_suppkey") % 10).alias("gold"))
    hit, recall = O.evidence_scores(F.col("got"), F.col("gold"), 3)
    return e.select("k", hit, F.round(recall, 6).alias("recall"))


@query("""SELECT p_partkey AS id, 'supersedes' AS relation, p_brand AS target FROM part UNION ALL SELECT p_partkey, 'is_agent_of', 'a' || p_size FROM part UNION ALL SELECT p_partkey, 'is_agent_of', 'b' FROM part UNION ALL SELECT p_partkey, 'caused_by', 'x' FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'caused_by', 'y: z' FROM part WHERE p_partkey % 2 = 0""")
def stated_relations(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lines = ["---\ntitle: t\nsupersedes: '", F.col("p_brand"), "'\nagent: [a", F.col("p_size").cast("string"), ', "b", ]\nresolves:\ncaused_by:\n', F.when(F.col("p_partkey") % 2 == 0, '  - x\n\n  - "y: z"\n').otherwise(""), "other: q\n---\nreferences: no"]
    text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    return O.stated_relations(p.select(F.col("p_partkey").alias("id"), text.alias("text")))


@query("""WITH k AS (SELECT id, source_id, predicate, target_id FROM @relations WHERE superseded_by IS NULL AND confidence >= 0.5 AND predicate NOT IN ('returned_to')) SELECT source_id, predicate, count(DISTINCT target_id) AS targets FROM k GROUP BY 1, 2 HAVING count(DISTINCT target_id) > 1""")
def conflicts_without(spark, sf_dir):
    """Conflicts with predicates on a block list left out."""
    from memlode.operators import knowledge

    return knowledge.conflicts(relations(spark, sf_dir), blocked=["returned_to"]).select("source_id", "predicate", "targets")
