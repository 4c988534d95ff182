"""Queries of retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memlode.functions import text as T
from memlode.operators import ranking as R_
from memlode.operators import stats, temporal
from memlode.plans.base import AS_OF, Registry, chunks, relations, texts
from memlode.session import Scratch, table

R = Registry()
query = R.query


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def today():
    return as_of().cast("date")


def items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def toks(col: str) -> str:
    return f"list_filter(regexp_split_to_array(strip_accents(lower({col})), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"


BM25 = f"""
d AS (SELECT id, {toks('chunk_text')} AS t FROM @chunks),
q AS (SELECT DISTINCT item_id AS query_id, unnest({toks('text')}) AS term FROM benchmark),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term),
hits AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM p JOIN dfs USING (term) JOIN q USING (term), st GROUP BY query_id, id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM hits)"""


@query(f"WITH {BM25} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def bm25_top10(spark, sf_dir):
    return R_.bm25_top(texts(spark, sf_dir), items(spark, sf_dir), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


FTS = f"""
d AS (SELECT id, {toks('chunk_text')} AS t, {toks('source_file')} AS f, {toks('chunk_type')} AS y FROM @chunks),
q AS (SELECT DISTINCT item_id AS query_id, unnest({toks('text')}) AS term FROM benchmark),
st AS (SELECT count(*) AS n, avg(len(t) + len(f) + len(y)) AS avgdl FROM d),
r AS (SELECT id, dl, unnest(t) AS term, CAST(1.0 AS DOUBLE) AS w FROM (SELECT *, len(t) + len(f) + len(y) AS dl FROM d)
  UNION ALL SELECT id, dl, unnest(f), 0.5 FROM (SELECT *, len(t) + len(f) + len(y) AS dl FROM d)
  UNION ALL SELECT id, dl, unnest(y), 0.5 FROM (SELECT *, len(t) + len(f) + len(y) AS dl FROM d)),
p AS (SELECT id, term, dl, sum(w) AS tf FROM r WHERE term IN (SELECT term FROM q) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term),
hits AS (SELECT query_id, id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS hit
  FROM p JOIN dfs USING (term) JOIN q USING (term), st GROUP BY query_id, id),
need AS (SELECT query_id, count(*) AS need FROM q GROUP BY query_id),
top20 AS (SELECT * FROM (SELECT h.query_id, h.id, h.score, row_number() OVER (PARTITION BY h.query_id ORDER BY round(score, 6) DESC, h.id) AS rank
  FROM hits h JOIN need ON h.query_id = need.query_id AND hit = need) WHERE rank <= 20)"""
FIELDS = {"chunk_text": 1.0, "source_file": 0.5, "chunk_type": 0.5}


def fts(spark, sf_dir, k1=1.2, b=0.75):
    return R_.bm25_top(texts(spark, sf_dir), items(spark, sf_dir), 20, k1, b, "fts5", FIELDS, match_all=True)


@query(f"WITH {FTS} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top20")
def fts_match_all(spark, sf_dir):
    return fts(spark, sf_dir).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


SECTION_SQL = "CASE section WHEN 'compiled' THEN 1.0::DOUBLE WHEN 'frontmatter' THEN 0.5 WHEN 'timeline' THEN -0.2 ELSE coalesce(section_boost - 1, 0) END"
SOURCE_SQL = """CASE WHEN section IS NOT NULL THEN 0.0::DOUBLE ELSE CASE source_type WHEN 'entity' THEN 1.0 WHEN 'lesson' THEN 0.8 WHEN 'external' THEN -0.2 WHEN 'ocr-cache' THEN -0.3 ELSE 0.0 END END"""
TYPES_SQL = "chunk_type IN ('decision', 'lesson', 'person', 'project', 'pending')"


@query(f"""WITH {FTS}, b AS (SELECT query_id, t.id, rank, floor(round(score, 6) * (1 + CASE WHEN {TYPES_SQL} THEN 1.0::DOUBLE ELSE 0 END
  + CASE WHEN source_date >= CAST(@as_of AS DATE) - 7 THEN 0.5::DOUBLE ELSE 0 END + {SOURCE_SQL} + {SECTION_SQL}) * 100 + 0.5) / 100 AS score
  FROM top20 t JOIN @chunks c ON t.id = c.id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS pos FROM b)
SELECT query_id, id, score, CAST(pos AS INTEGER) AS pos FROM o WHERE pos <= 10""")
def fts_boosted(spark, sf_dir):
    hits = fts(spark, sf_dir).withColumn("score", F.round("score", 6)).join(chunks(spark, sf_dir), "id")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    out = R_.boosted(hits, "fts", today()).withColumn("pos", F.row_number().over(w)).where("pos <= 10")
    return out.select("query_id", "id", "score", "pos")


@query(f"""WITH {FTS}, b AS (SELECT query_id, t.id, floor(round(score, 6) * CASE WHEN {TYPES_SQL} THEN 2.0::DOUBLE ELSE 1 END
  * CASE WHEN source_date >= CAST(@as_of AS DATE) - 7 THEN 1.5::DOUBLE ELSE 1 END * CASE section WHEN 'compiled' THEN 2.0::DOUBLE WHEN 'frontmatter' THEN 1.5 WHEN 'timeline' THEN 0.8 ELSE 1 END * 100 + 0.5) / 100 AS score
  FROM top20 t JOIN @chunks c ON t.id = c.id) SELECT query_id, id, score FROM b""")
def fts_multiplicative(spark, sf_dir):
    hits = fts(spark, sf_dir).withColumn("score", F.round("score", 6)).join(chunks(spark, sf_dir), "id")
    return R_.multiplicative(hits, today()).select("query_id", "id", "score")


@query(f"WITH {FTS} SELECT query_id, t.id, round(round(score, 6) * coalesce(pain, 0.2), 6) AS score FROM top20 t JOIN @chunks c ON t.id = c.id")
def pain_composite(spark, sf_dir):
    hits = fts(spark, sf_dir).join(chunks(spark, sf_dir).select("id", "pain"), "id")
    return hits.select("query_id", "id", F.round(F.round("score", 6) * F.coalesce("pain", F.lit(0.2)), 6).alias("score"))


COS = """SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS cos
  FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0"""


def vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return e, e.where("id % 100 = 0").withColumnRenamed("id", "query_id")


@query(f"""WITH s AS ({COS}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC, id) AS rank FROM s)
SELECT query_id, id, round(cos, 6) AS cos, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def knn_cosine(spark, sf_dir):
    return R_.knn(*vectors(spark, sf_dir), 10).select("query_id", "id", F.round("cos", 6).alias("cos"), "rank")


@query(f"""WITH s AS ({COS}), r AS (SELECT *, 1 - cos AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC, id) AS rank FROM s),
t AS (SELECT *, max(distance) OVER (PARTITION BY query_id) AS most FROM r WHERE rank <= 40)
SELECT query_id, id, round(CASE WHEN most > 0 THEN (1 - distance / most) * 10 ELSE 10 END, 6) AS score FROM t""")
def semantic_scored(spark, sf_dir):
    near = R_.knn(*vectors(spark, sf_dir), 40).withColumn("distance", 1 - F.col("cos"))
    return R_.semantic_scores(near).select("query_id", "id", F.round("score", 6).alias("score"))


LEGS = f"""{BM25}, legs AS (SELECT query_id, 'fts' AS leg, rank - 1 AS rank0, id FROM ranked WHERE rank <= 10
  UNION ALL SELECT query_id, 'semantic', row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC, id) - 1, id FROM
    (SELECT b.item_id AS query_id, c.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS cos FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings c)),
keyed AS (SELECT query_id, leg, rank0, l.id, c.source_file || '::' || left(c.chunk_text, 50) AS key FROM legs l JOIN @chunks c ON c.id = l.id WHERE leg = 'fts' OR rank0 < 10),
fused AS (SELECT query_id, key, sum(1.0::DOUBLE / (60 + rank0 + 1)) AS rrf, min(id) AS id,
  CASE WHEN bool_or(leg = 'semantic') AND bool_or(leg = 'fts') THEN 'hybrid' WHEN bool_or(leg = 'semantic') THEN 'semantic' ELSE 'fts' END AS match_type FROM keyed GROUP BY query_id, key)"""


def legs(spark, sf_dir):
    full = R_.bm25_top(texts(spark, sf_dir), items(spark, sf_dir), 10).select("query_id", F.lit("fts").alias("leg"), (F.col("rank") - 1).alias("rank0"), "id")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = items(spark, sf_dir).join(e, F.col("query_id") == F.col("id")).select("query_id", "vec")
    near = R_.knn(e, q, 10).select("query_id", F.lit("semantic").alias("leg"), (F.col("rank") - 1).alias("rank0"), "id")
    key = F.concat(F.col("source_file"), F.lit("::"), F.substring("chunk_text", 1, 50)).alias("key")
    return full.union(near).join(chunks(spark, sf_dir).select("id", key), "id").select("query_id", "leg", "rank0", "id", "key")


@query(f"WITH {LEGS} SELECT query_id, id, match_type, floor(rrf * 1000 * 100 + 0.5) / 100 AS score FROM fused")
def rrf_fusion(spark, sf_dir):
    return R_.rrf(legs(spark, sf_dir)).select("query_id", "id", "match_type", "score")


def pool(spark, sf_dir, limit=5):
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 9)), "id")
    best = R_.rrf(legs(spark, sf_dir)).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= max(3 * limit, 15))
    return best.join(chunks(spark, sf_dir).select("id", "source_file", "chunk_type", "section", "chunk_text"), "id")


@query()
def hybrid_search(spark, sf_dir):
    """Both legs, fusion, pool and the four dedup layers; an ordered greedy step, so no SQL."""
    own = pool(spark, sf_dir).select("query_id", "id", "pos", "score", "match_type", "source_file", "chunk_type", "section", "chunk_text")
    return R_.deduped(own, 5).select("query_id", "id", "pos", "score", "match_type")


@query("""WITH r AS (SELECT id, chunk_text, source_file, row_number() OVER (PARTITION BY source_file ORDER BY access_count DESC, id) AS n FROM @chunks)
SELECT id, source_file, CAST(n AS INTEGER) AS n FROM r WHERE n <= 3""")
def file_cap(spark, sf_dir):
    w = W.partitionBy("source_file").orderBy(F.desc("access_count"), "id")
    return chunks(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 3").select("id", "source_file", "n")


RETAIN = "coalesce(retention_days, CASE chunk_type WHEN 'feedback' THEN 0 WHEN 'person' THEN 0 WHEN 'lesson' THEN 180 WHEN 'decision' THEN 365 WHEN 'project' THEN 365 WHEN 'team' THEN 120 WHEN 'daily' THEN 90 WHEN 'pending' THEN 30 WHEN 'graph_node' THEN 60 ELSE 90 END)"
AGE = "(epoch_us(@as_of) - epoch_us(coalesce(last_accessed_at, CAST(source_date AS TIMESTAMP), created_at))) / 86400e6"
RECENCY = f"CASE WHEN {RETAIN} <= 0 THEN 1.0::DOUBLE WHEN {AGE} <= 0 THEN 1.0 ELSE pow(2.0::DOUBLE, -({AGE}) / {RETAIN}) END"
IMPORT = "coalesce(importance, CASE chunk_type WHEN 'decision' THEN 0.95::DOUBLE WHEN 'lesson' THEN 0.90 WHEN 'person' THEN 0.85 WHEN 'project' THEN 0.80 WHEN 'pending' THEN 0.75 WHEN 'feedback' THEN 0.70 WHEN 'team' THEN 0.60 WHEN 'daily' THEN 0.50 WHEN 'graph_node' THEN 0.45 ELSE 0.40 END)"
ACCESS = "CASE WHEN access_count > 0 THEN least(1.0::DOUBLE, ln(1 + access_count::DOUBLE) / ln(1000)) ELSE 0.0 END"
SALIENCE = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.55 * {IMPORT} + 0.15 * {RECENCY} + 0.10 * coalesce(pain, 0.2) + 0.20 * {ACCESS}))"
CLASS = "CASE WHEN s >= 0.7 THEN 'promote' WHEN s >= 0.4 THEN 'retain' WHEN s >= 0.15 THEN 'review' ELSE 'archive' END"


@query(f"SELECT id, round(s, 6) AS salience, {CLASS} AS class FROM (SELECT id, {SALIENCE} AS s FROM @chunks)")
def salience_v2(spark, sf_dir):
    out = chunks(spark, sf_dir).select("id", R_.salience(as_of()).alias("s"))
    return out.select("id", F.round("s", 6).alias("salience"), R_.salience_class(F.col("s")).alias("class"))


@query(f"SELECT {CLASS} AS class, count(*) AS n, round(avg(s), 6) AS mean FROM (SELECT {RECENCY} * coalesce(pain, 0.2) * {IMPORT} AS s FROM @chunks) GROUP BY 1")
def salience_product_classes(spark, sf_dir):
    out = chunks(spark, sf_dir).select(R_.salience_product(as_of()).alias("s"))
    return out.groupBy(R_.salience_class(F.col("s")).alias("class")).agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean"))


@query(f"""WITH a AS (SELECT {SALIENCE} AS s, {SALIENCE.replace(RETAIN, f"(2 * {RETAIN})")} AS s2 FROM @chunks)
SELECT {CLASS} AS before, {CLASS.replace('s >=', 's2 >=')} AS after, count(*) AS n FROM a GROUP BY 1, 2""")
def retention_sensitivity(spark, sf_dir):
    s, s2 = R_.salience(as_of()), R_.salience(as_of(), 2 * R_.retention())
    out = chunks(spark, sf_dir).select(R_.salience_class(s).alias("before"), R_.salience_class(s2).alias("after"))
    return out.groupBy("before", "after").agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT id, {SALIENCE} AS s FROM @chunks)
SELECT id, round((rank() OVER (ORDER BY round(s, 9)) - 1) / (count(*) OVER ())::DOUBLE, 6) AS pct FROM a""")
def salience_percent_rank(spark, sf_dir):
    s = chunks(spark, sf_dir).select("id", F.round(R_.salience(as_of()), 9).alias("s"))
    below = stats.counted_below(s, "s").select("s", F.col("n_below").alias("below"))
    total = s.agg(F.count("*").alias("total"))
    return s.join(below, "s").crossJoin(F.broadcast(total)).select("id", F.round(F.col("below") / F.col("total"), 6).alias("pct"))


@query("""SELECT id, least(1.0::DOUBLE, base + CASE WHEN regexp_matches(lower(chunk_text), '\\b(incident|incidente|outage|breach|critical|emergency|p0)\\b') THEN 0.5 ELSE 0 END) AS pain
FROM (SELECT id, chunk_text, CASE chunk_type WHEN 'feedback' THEN 0.3::DOUBLE WHEN 'lesson' THEN 0.4 WHEN 'pending' THEN 0.5 WHEN 'decision' THEN 0.3 WHEN 'project' THEN 0.3 ELSE 0.2 END AS base FROM @chunks)""")
def inferred_pain(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", R_.inferred_pain(F.col("chunk_text")).alias("pain"))


@query(f"""WITH a AS (SELECT id, {SALIENCE} AS s, coalesce(confidence, 0.8) AS c, superseded_by FROM @chunks)
SELECT id, round(least(1.5::DOUBLE, greatest(0.3::DOUBLE, s * c * CASE WHEN superseded_by IS NOT NULL THEN 0.5 ELSE 1 END)), 6) AS ranked,
round(least(1.5::DOUBLE, greatest(0.3::DOUBLE, s * c * CASE WHEN superseded_by IS NOT NULL THEN 0.5 ELSE 1 END)) - s, 6) AS shadow_delta FROM a WHERE c >= 0.3""")
def confidence_ranking(spark, sf_dir):
    c = chunks(spark, sf_dir).where(F.coalesce("confidence", F.lit(0.8)) >= 0.3).withColumn("s", R_.salience(as_of()))
    r = R_.confidence_ranked(F.col("s"))
    return c.select("id", F.round(r, 6).alias("ranked"), F.round(r - F.col("s"), 6).alias("shadow_delta"))


@query("""SELECT id FROM @chunks WHERE coalesce(confidence, 0.8) >= 0.5 AND superseded_by IS NULL AND NOT (coalesce(provenance_kind, '') = 'user-marked' AND coalesce(confidence, 0.8) < 0.3)""")
def confidence_filter(spark, sf_dir):
    return temporal.confidence_filter(chunks(spark, sf_dir), 0.5).select("id")


@query("SELECT id FROM @chunks WHERE (created_at IS NULL OR created_at <= TIMESTAMP '2024-07-01') AND (deleted_at IS NULL OR deleted_at > TIMESTAMP '2024-07-01')")
def as_of_filter(spark, sf_dir):
    return temporal.as_of(chunks(spark, sf_dir), F.lit("2024-07-01").cast("timestamp")).select("id")


@query("SELECT id FROM @chunks WHERE created_at > TIMESTAMP '2024-11-01' OR coalesce(updated_at, created_at) > TIMESTAMP '2024-11-01'")
def changed_since(spark, sf_dir):
    return temporal.changed_since(chunks(spark, sf_dir), F.lit("2024-11-01").cast("timestamp")).select("id")


@query("SELECT id FROM @chunks WHERE (importance >= 0.7 OR pain >= 0.7) AND (epoch_us(@as_of) - epoch_us(created_at)) / 86400e6 <= 90")
def fresh_candidates(spark, sf_dir):
    return temporal.fresh(chunks(spark, sf_dir), as_of(), 90).select("id")


@query("SELECT id FROM @chunks WHERE source_file LIKE 'src1%' OR source_file LIKE 'src\\_%' ESCAPE '\\'")
def scope_filter(spark, sf_dir):
    return temporal.in_scope(chunks(spark, sf_dir), ["src1", "src_"]).select("id")


INTENT_TEXT = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'order placed ' || strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'orders of ' || lower(strftime(o_orderdate, '%B')) || ' ' || strftime(o_orderdate, '%Y')
  WHEN 2 THEN 'orders in december' WHEN 3 THEN 'when did it ship?' WHEN 4 THEN 'orders 2021' ELSE 'plain order' END AS text, o_orderdate FROM orders"""


@query(f"""WITH t AS ({INTENT_TEXT})
SELECT id, CASE id % 6 WHEN 0 THEN 'iso_date' WHEN 1 THEN 'month_year' WHEN 2 THEN 'month_year' WHEN 3 THEN 'adverbial' WHEN 4 THEN 'year' END AS signal,
CAST(CASE id % 6 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN date_trunc('month', o_orderdate) WHEN 2 THEN DATE '2024-12-01' WHEN 4 THEN DATE '2021-01-01' END AS DATE) AS range_start,
CAST(CASE id % 6 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN last_day(o_orderdate) WHEN 2 THEN DATE '2024-12-31' WHEN 4 THEN DATE '2021-12-31' END AS DATE) AS range_end FROM t""")
def temporal_intent(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = F.col("o_orderkey") % 6
    d = F.col("o_orderdate")
    text = F.when(m == 0, F.concat(F.lit("order placed "), F.date_format(d, "yyyy-MM-dd"))).when(m == 1, F.concat(F.lit("orders of "), F.lower(F.date_format(d, "MMMM")), F.lit(" "), F.date_format(d, "yyyy")))
    text = text.when(m == 2, "orders in december").when(m == 3, "when did it ship?").when(m == 4, "orders 2021").otherwise("plain order")
    return temporal.intent(o.select(F.col("o_orderkey").alias("id"), text.alias("text")), as_of()).select("id", "signal", "range_start", "range_end")


@query(f"""WITH {BM25}, t AS (SELECT query_id, r.id, rank, score, source_date FROM ranked r JOIN @chunks c ON c.id = r.id WHERE rank <= 30),
s AS (SELECT *, CASE WHEN rank <= 20 THEN round(score, 6) + 10 * 0.5 * exp(-pow(datediff('day', DATE '2024-06-15', source_date), 2) / (2 * 900.0)) ELSE round(score, 6) END AS v FROM t)
SELECT query_id, id, round(v, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 20 THEN 0 ELSE 1 END, CASE WHEN rank <= 20 THEN round(v, 6) END DESC, rank) AS INTEGER) AS rank FROM s""")
def temporal_rerank(spark, sf_dir):
    hits = R_.bm25_top(texts(spark, sf_dir), items(spark, sf_dir), 30).withColumn("score", F.round("score", 6))
    own = hits.join(chunks(spark, sf_dir).select("id", "source_date"), "id").withColumn("anchor", F.lit("2024-06-15").cast("date"))
    return temporal.rerank(own).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {BM25}, t AS (SELECT query_id, r.id, rank, round(score, 6) AS score, source_date FROM ranked r JOIN @chunks c ON c.id = r.id WHERE rank <= 5),
m AS (SELECT query_id, list_sort(list(source_date)) AS ds, max(score) FILTER (WHERE rank = 1) AS top1, max(score) FILTER (WHERE rank = 2) AS top2 FROM t GROUP BY query_id)
SELECT query_id, ds[CAST(len(ds) // 2 + 1 AS BIGINT)] AS anchor, round(greatest(0.1, top1 - coalesce(top2, 0)), 6) AS gap FROM m""")
def temporal_anchor(spark, sf_dir):
    hits = R_.bm25_top(texts(spark, sf_dir), items(spark, sf_dir), 5).withColumn("score", F.round("score", 6))
    return temporal.inferred_anchor(hits.join(chunks(spark, sf_dir).select("id", "source_date"), "id"))


VARIANT = """hits2 AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))) AS score FROM p JOIN dfs USING (term) JOIN q USING (term), st GROUP BY query_id, id),
ranked2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM hits2)"""


@query(f"WITH {BM25}, {VARIANT} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked2 WHERE rank <= 10")
def bm25_variant(spark, sf_dir):
    """The other published parameters: k1 0.9, b 0.4."""
    return R_.bm25_top(texts(spark, sf_dir), items(spark, sf_dir), 10, 0.9, 0.4).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {BM25}, {VARIANT} SELECT query_id, id, round(sum(1.0::DOUBLE / (61 + rank0)), 9) AS rrf FROM (SELECT query_id, rank - 1 AS rank0, id FROM ranked WHERE rank <= 10 UNION ALL SELECT query_id, rank - 1, id FROM ranked2 WHERE rank <= 10) GROUP BY ALL""")
def multi_query_rrf(spark, sf_dir):
    """Two lists for a query, fused."""
    legs = [R_.bm25_top(texts(spark, sf_dir), items(spark, sf_dir), 10, *p).select("query_id", (F.col("rank") - 1).alias("rank0"), "id") for p in ((1.5, 0.75), (0.9, 0.4))]
    return legs[0].union(legs[1]).groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (61 + F.col("rank0"))), 9).alias("rrf"))


@query(f"""WITH {BM25}, t AS (SELECT query_id, r.id, rank, round(score, 6) AS score, source_date FROM ranked r JOIN @chunks c ON c.id = r.id WHERE rank <= 10),
m AS (SELECT query_id, list_sort(list(source_date) FILTER (WHERE rank <= 5)) AS ds, max(score) FILTER (WHERE rank = 1) AS top1, max(score) FILTER (WHERE rank = 2) AS top2 FROM t GROUP BY query_id),
a AS (SELECT query_id, ds[CAST(len(ds) // 2 + 1 AS BIGINT)] AS anchor, round(greatest(0.1, top1 - coalesce(top2, 0)), 6) AS gap FROM m)
SELECT query_id, id, round(score + gap * 0.5::DOUBLE * exp(-pow(date_diff('day', anchor, source_date), 2) / 1800) * 2 * 0.8, 6) AS score FROM t JOIN a USING (query_id)""")
def temporal_gap_bump(spark, sf_dir):
    """Hits near the date their own best hits suggest gain by the gap of the first two scores."""
    hits = R_.bm25_top(texts(spark, sf_dir), items(spark, sf_dir), 10).withColumn("score", F.round("score", 6)).join(chunks(spark, sf_dir).select("id", "source_date"), "id")
    own = hits.join(temporal.inferred_anchor(hits), "query_id")
    near = temporal.proximity(F.col("source_date"), F.col("anchor"))
    return own.select("query_id", "id", F.round(temporal.gap_bump(F.col("score"), F.col("gap"), near, F.lit(0.8)), 6).alias("score"))


@query(f"""WITH {BM25}, a AS (SELECT query_id, id, rank FROM ranked WHERE rank <= 5), b AS (SELECT query_id, c.id, row_number() OVER (PARTITION BY query_id ORDER BY access_count DESC, c.id) AS rank
  FROM ranked r JOIN @chunks c ON c.id = r.id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY access_count DESC, c.id) <= 5),
u AS (SELECT query_id, id, min(p) AS place FROM (SELECT query_id, id, rank * 2 AS p FROM a UNION ALL SELECT query_id, id, rank * 2 + 1 FROM b) GROUP BY ALL)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INTEGER) AS rank FROM u""")
def interleaved(spark, sf_dir):
    hits = Scratch(spark).keep(R_.bm25_top(texts(spark, sf_dir), items(spark, sf_dir), 5, most="access_count"))  # read for either leg
    return R_.interleave(hits.where("leg = 'score'"), hits.where("leg = 'most'"))


@query("""WITH t AS (SELECT c_custkey AS id, c_name || ' ships from ' || n.n_name || ' to ' || m.n_name AS text FROM customer JOIN nation n ON n.n_nationkey = c_nationkey JOIN nation m ON m.n_nationkey = (c_custkey % 25))
SELECT id, CAST(len(list_distinct(regexp_extract_all(list_reduce(list_prepend(lower(text), (SELECT list(lower(n_name) ORDER BY length(n_name) DESC, lower(n_name)) FROM nation)),
  lambda a, n: replace(a, n, chr(1) || md5(n))), chr(1) || '([0-9a-f]{32})', 1))) AS INTEGER) AS n FROM t""")
def query_entities(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    names = [r.n_name for r in n.select("n_name").distinct().collect()]
    a, b = n.select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("n1")), n.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("n2"))
    t = c.join(F.broadcast(a), F.col("c_nationkey") == F.col("k1")).join(F.broadcast(b), F.col("c_custkey") % 25 == F.col("k2"))
    text = F.concat("c_name", F.lit(" ships from "), "n1", F.lit(" to "), "n2")
    return t.select(F.col("c_custkey").alias("id"), R_.count_entities(text, names).alias("n"))


@query(f"""WITH {BM25}, f AS (SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10)
SELECT query_id, f.id, round(score * CASE WHEN 2 * n >= 3 THEN 1.4::DOUBLE WHEN n = 0 THEN 0.75 ELSE 1 END, 6) AS score FROM f JOIN (SELECT id, contains(lower(chunk_text), 'the')::INT + contains(lower(chunk_text), 'der')::INT + contains(lower(chunk_text), 'que')::INT AS n FROM @chunks) c ON c.id = f.id""")
def focus_boost(spark, sf_dir):
    hits = R_.bm25_top(texts(spark, sf_dir), items(spark, sf_dir), 10).withColumn("score", F.round("score", 6))
    own = hits.join(chunks(spark, sf_dir).select("id", "chunk_text"), "id")
    return temporal.focus(own, ["the", "der", "que"]).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {BM25}, f AS (SELECT query_id, r.id, rank, c.chunk_text, md5(c.chunk_text) AS h FROM ranked r JOIN @chunks c ON c.id = r.id WHERE rank <= 16),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, h ORDER BY rank) AS n FROM f)
SELECT query_id, id, 'chunk_' || row_number() OVER (PARTITION BY query_id ORDER BY rank) AS marker FROM u WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 8""")
def answer_context(spark, sf_dir):
    hits = R_.bm25_top(texts(spark, sf_dir), items(spark, sf_dir), 16).join(chunks(spark, sf_dir).select("id", "chunk_text"), "id")
    return temporal.answer_context(hits, 8).select("query_id", "id", "marker")


@query("""WITH w AS (SELECT source_id AS id, least(0.3::DOUBLE, sum(CASE method WHEN 'manual' THEN 0.1 WHEN 'llm' THEN 0.04 ELSE 0 END)) AS plus FROM @relations GROUP BY 1)
SELECT p_partkey AS id, round(p_size * (1 + coalesce(plus, 0)), 6) AS score FROM part LEFT JOIN w ON id = p_partkey""")
def reason_boost(spark, sf_dir):
    """Scores rise with the weights of what points at a hit, by 0.3 at most."""
    hits = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"))
    reasons = relations(spark, sf_dir).select(F.col("source_id").alias("id"), F.col("method").alias("reason"))
    return temporal.reason_boost(hits, reasons, {"manual": 0.1, "llm": 0.04}).select("id", F.round("score", 6).alias("score"))
