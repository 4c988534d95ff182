"""Queries of extraction routing, audits of references, placebo arms and resampling designs."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlode.functions import text as T
from memlode.operators import dictionary, exposure, extraction, inference, knowledge, power, stats
from memlode.plans.base import Registry, chunks, relations
from memlode.plans.inference import rounded
from memlode.session import table

R = Registry()
query = R.query

# words of the documents themselves become links and code references: those of seven letters before a full stop, of four before a comma
LINKED, CODED = " ([a-z]{7})\\.", " ([a-z]{4}),"


@query(f"""WITH c AS (SELECT id, section, CASE access_count % 3 WHEN 0 THEN 'conversation' WHEN 1 THEN 'spec' END AS kind, source_file, coalesce(chunk_text, '') AS t FROM @chunks),
n AS (SELECT id, section, kind, CAST(len(list_distinct(regexp_extract_all(t, '{LINKED}', 1))) AS BIGINT) AS n_links, CASE WHEN section = 'frontmatter' THEN CASE WHEN coalesce(source_file, '') = '' THEN 1 ELSE 2 END ELSE 0 END AS n_stated,
  CAST(len(list_distinct(regexp_extract_all(t, '{CODED}', 1))) AS BIGINT) AS n_code FROM c), f AS (SELECT *, n_links + n_stated + n_code AS n, section IS NOT NULL AS structured FROM n)
SELECT id, n_links, CAST(n_stated AS BIGINT) AS n_stated, n_code, CASE WHEN n > 0 AND structured AND kind IS DISTINCT FROM 'conversation' THEN 'regex_only' WHEN n = 0 THEN 'gemini_only_after_regex_zero' WHEN structured THEN 'regex_primary_gemini_secondary' ELSE 'gemini_only' END AS method,
n > 0 AND structured AND kind IS DISTINCT FROM 'conversation' AS skipped FROM f""")
def extraction_routes(spark, sf_dir):
    """Documents whose own words stand as links and code references: what patterns find and who reads the text."""
    c = chunks(spark, sf_dir)
    text = F.regexp_replace(F.regexp_replace(F.coalesce("chunk_text", F.lit("")), LINKED, " [[projects/$1]]."), CODED, " src/$1.py:12,")
    block = F.concat(F.lit("---\nagent: ["), F.coalesce("source_file", F.lit("")), F.lit(", 'b c']\ntitle: x\n---\n"))
    rows = c.select("id", "section", F.when(F.col("access_count") % 3 == 0, "conversation").when(F.col("access_count") % 3 == 1, "spec").alias("kind"), F.when(F.col("section") == "frontmatter", F.concat(block, text)).otherwise(text).alias("text"))
    return extraction.routed(rows).select("id", "n_links", "n_stated", "n_code", "method", "skipped")


@query("""WITH r AS (SELECT id, 's' || source_id AS source, CASE WHEN id % 2 = 0 THEN 'T' ELSE 't' END || target_id AS target, predicate AS relation, CASE method WHEN 'regex' THEN 0 ELSE 1 END AS turn FROM @relations WHERE method <> 'manual')
SELECT source, target, relation, CASE turn WHEN 0 THEN 'regex' ELSE 'gemini' END AS method FROM r QUALIFY row_number() OVER (PARTITION BY lower(source), lower(target), lower(relation) ORDER BY turn, id) = 1""")
def merged_relations(spark, sf_dir):
    """Relations that patterns found and those that a model found, each once, patterns first."""
    target = F.concat(F.when(F.col("id") % 2 == 0, "T").otherwise("t"), F.col("target_id").cast("string"))
    r = relations(spark, sf_dir).select(F.concat(F.lit("s"), F.col("source_id").cast("string")).alias("source"), target.alias("target"), F.col("predicate").alias("relation"), F.col("id").alias("place"), "method")
    return extraction.merged(r.where("method = 'regex'"), r.where("method = 'llm'"))


@query("""WITH r AS (SELECT l_orderkey AS audit_id, l_orderkey * 10 + l_linenumber AS id, l_returnflag = 'R' AS returned FROM lineitem), l AS (SELECT audit_id, id, bool_and(returned) OVER (PARTITION BY id) AS gone FROM r), g AS (SELECT audit_id, max(id) AS last, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE gone), '') AS missing, arg_max(gone, id) AS last_gone FROM l GROUP BY 1),
a AS (SELECT o_orderkey AS audit_id, o_orderkey % 5 <> 0 AS well_formed, NOT coalesce(c_acctbal > 0, false) AS missing_subject, CASE WHEN o_orderkey % 5 <> 0 THEN coalesce(missing, '') ELSE '' END AS missing_targets, o_orderkey % 3 = 0 AND coalesce(last_gone, false) AS missing_picked
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN g ON g.audit_id = o_orderkey WHERE g.audit_id IS NOT NULL)
SELECT *, NOT missing_subject AND NOT missing_picked AND missing_targets = '' AS valid FROM a""")
def audit_references(spark, sf_dir):
    """Audit rows that name the lines of an order as JSON, against the lines still there; a fifth is quoted and so is no list of ids."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag")
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    o = table(spark, sf_dir, "orders").join(g, F.col("o_orderkey") == F.col("l_orderkey"))
    json = F.when(F.col("o_orderkey") % 5 == 0, F.to_json(F.col("ids").cast("array<string>"))).otherwise(F.to_json("ids"))
    a = o.select(F.col("o_orderkey").alias("audit_id"), F.col("o_custkey").alias("subject_id"), knowledge.reference_ids(json).alias("targets"), F.when(F.col("o_orderkey") % 3 == 0, F.array_max("ids")).alias("picked_id"))
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    out = knowledge.audit_references(a, li.where("l_returnflag <> 'R'"), known)
    formed = a.select(F.col("audit_id").alias("a_"), F.col("targets").isNotNull().alias("well_formed"))
    return out.join(formed, F.col("audit_id") == F.col("a_")).select("audit_id", "well_formed", "missing_subject", F.array_join("missing_targets", ",").alias("missing_targets"), "missing_picked", "valid")


@query("""WITH m AS (SELECT doc_id AS msg_id, coalesce(lang, '') AS grp, doc_id % 1000 AS t, lower(text) AS text FROM documents), k AS (SELECT generate_series AS k FROM generate_series(0, 39)),
s AS (SELECT DISTINCT k, item_id, lower(text) AS line FROM k, benchmark WHERE item_id % 8 = k % 8 OR item_id % 5 = k % 7), c AS (SELECT m.*, (t - 10) // 25 AS cur FROM m WHERE t >= 10),
i AS (SELECT item_id, any_value(line) AS line, min(k) AS first, list(k) AS ks FROM s GROUP BY 1), p AS (SELECT grp, CASE WHEN list_contains(ks, cur) THEN 'exposed' WHEN first < cur THEN 'past' ELSE 'future' END AS arm, length(line) >= 25 AND contains(text, trim(line)) AS hit FROM c, i),
g AS (SELECT DISTINCT grp FROM p), a AS (SELECT unnest(['exposed', 'past', 'future']) AS arm) SELECT g.grp, a.arm, count(p.arm) AS pairs, count(*) FILTER (WHERE p.hit) AS hits FROM g CROSS JOIN a LEFT JOIN p ON p.grp = g.grp AND p.arm = a.arm GROUP BY 1, 2""")
def placebo_arms(spark, sf_dir):
    """Documents as messages of their language, which is shown forty briefs of benchmark items: items taken up when shown, before and after."""
    at = lambda s: F.timestamp_seconds(F.lit(1_704_067_200) + s)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"), F.coalesce("lang", F.lit("")).alias("grp"), at(F.col("doc_id") % 1000).alias("ts"), "text")
    b = table(spark, sf_dir, "benchmark").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39)))).where("item_id % 8 = k % 8 or item_id % 5 = k % 7")
    shown = d.select("grp").distinct().join(F.broadcast(b.select(F.col("k").alias("brief_id"), at(F.col("k") * 25 + 10).alias("ts"), "item_id")))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lit(1).alias("grp"), F.col("text").alias("one_liner"), F.lit("").alias("stem"))
    hits = dictionary.strictly_attributed(d.select("msg_id", F.lit(1).alias("grp"), "text"), items)
    return exposure.placebo_arms(d.select("msg_id", "grp", "ts"), shown, hits)


@query()
def stratified_bootstrap(spark, sf_dir):
    """Share of returned lines, suppliers resampled within line status; a test holds the draws against plain Python."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("stratum"), F.col("l_suppkey").alias("cluster"), (F.col("l_returnflag") == "R").cast("double").alias("x"), F.lit(1.0).alias("y"))
    return rounded(inference.stratified_ratio(li, "stratum", "cluster", "x", "y", 200), "estimate", "lo", "hi", "p")


@query()
def simulated_power(spark, sf_dir):
    """Four parts next to each other as a pilot unit, price and size of each as a replica; a test holds the whole simulation against plain Python."""
    parts = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 4).alias("unit")).agg(F.array_sort(F.collect_list(F.col("p_retailprice") + F.col("p_size"))).alias("values"))
    curve = power.power_curve(parts, lambda a, b: F.abs(a - b), [4] * 12, [0.0, 0.1, 0.25, 0.5, 1.0], sims=25, draws=200)
    effect = power.least_detectable(curve)
    return rounded(curve.join(F.broadcast(effect)), "mean_delta", "power", "effect")


@query("""WITH e AS (SELECT l_partkey AS sig, l_returnflag <> 'R' AS ok, l_extendedprice AS price, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS quantity FROM lineitem),
b AS (SELECT sig, min(price) FILTER (WHERE ok) AS p, min(quantity) FILTER (WHERE ok) AS q FROM e GROUP BY 1 HAVING count(*) FILTER (WHERE ok) >= 5)
SELECT sig, price, quantity, round(CASE WHEN price > p THEN price - p ELSE 0 END, 4) AS regret_price, round(CASE WHEN quantity IS NULL OR q IS NULL THEN NULL WHEN quantity > q THEN quantity - q ELSE 0 END, 4) AS regret_quantity FROM e JOIN b USING (sig)""")
def signature_regret(spark, sf_dir):
    """Lines as episodes of their part: what each cost beyond the part's cheapest line that was not returned."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sig"), (F.col("l_returnflag") != "R").alias("ok"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"))
    return rounded(stats.regrets(e, "sig", F.col("ok"), ["price", "quantity"]).drop("ok"), "regret_price", "regret_quantity", places=4)


WORDS = "list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}_]+'), lambda x: length(x) >= 4))"


@query(f"""WITH w AS (SELECT conv_id, turn, {WORDS} AS t FROM conversations), p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.t, b.t)) AS shared, least(len(a.t), len(b.t)) AS small FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN small >= 3 THEN shared / small::DOUBLE ELSE 0 END, 6) AS share, small >= 3 AND shared / small::DOUBLE >= 0.6 AS same FROM p""")
def turn_containment(spark, sf_dir):
    """Share of the shorter turn's longer words that the next turn has too; from 0.6 on they say the same."""
    words = F.array_distinct(F.filter(T.tokens(F.col("text")), lambda x: F.length(x) >= 4))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("a"))
    both = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    share = both.select("conv_id", "turn", T.containment(F.col("a"), F.col("b")).alias("share"))
    return share.select("conv_id", "turn", F.round("share", 6).alias("share"), (F.col("share") >= 0.6).alias("same"))
