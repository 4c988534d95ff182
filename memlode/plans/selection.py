"""Queries of selection steps, query classification, protected reranking and near-duplicate joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlode.functions import text as T
from memlode.operators import ranking
from memlode.operators import selection as S
from memlode.operators import similarity
from memlode.plans.base import Registry, chunks, telemetry, texts
from memlode.plans.retrieval import BM25, as_of, items
from memlode.session import table

R = Registry()
query = R.query

SHINGLES = """w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM (SELECT min(doc_id) AS id, text FROM documents GROUP BY text)),
g AS (SELECT id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: list_aggregate(list_slice(w, i, i + 4), 'string_agg', ' '))) AS g FROM w WHERE len(w) > 0),
s AS (SELECT id, len(g) AS n, unnest(g) AS h FROM g), p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS same FROM s a JOIN s b ON a.h = b.h AND a.id < b.id GROUP BY ALL)"""


@query(f"WITH {SHINGLES} SELECT a, b, round(same / (na + nb - same)::DOUBLE, 6) AS jaccard FROM p WHERE same / (na + nb - same)::DOUBLE >= 0.8 - 1e-9")
def near_duplicate_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return similarity.near_duplicates(d)[1].select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents")
def near_duplicate_members(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return similarity.exact_members(d)


@query("""SELECT item_id AS id, CASE WHEN len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) > 10 THEN 1 ELSE 0 END AS long FROM benchmark""")
def long_questions(spark, sf_dir):
    n = F.size(F.array_remove(F.split(F.trim("text"), "\\s+"), ""))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.when(n > 10, 1).otherwise(0).alias("long"))


@query()
def multi_hop_class(spark, sf_dir):
    """Six weighted features of each question; unicode word boundaries, so no SQL."""
    score, hop = S.multi_hop(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), score.alias("score"), hop.alias("multi_hop"))


HITS = f"""{BM25}, h AS (SELECT query_id, r.id, rank, round(score, 6) AS score, section, coalesce(section IN ('compiled', 'frontmatter'), false) AS e, access_count AS s FROM ranked r JOIN @chunks c ON c.id = r.id WHERE rank <= 20)"""


def hits(spark, sf_dir):
    return ranking.bm25_top(texts(spark, sf_dir), items(spark, sf_dir), 20).join(chunks(spark, sf_dir).select("id", "section", "access_count"), "id")


@query(f"""WITH {HITS}, f AS (SELECT *, score * CASE section WHEN 'compiled' THEN 1.4::DOUBLE WHEN 'frontmatter' THEN 1.2 WHEN 'timeline' THEN 0.9 ELSE 1.0::DOUBLE END AS w FROM h)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY w DESC, rank) AS INTEGER) AS new_rank FROM f""")
def protected_rerank(spark, sf_dir):
    return S.protected(hits(spark, sf_dir), F.round("score", 6), "factor").select("query_id", "id", "new_rank")


@query(f"""WITH {HITS}, a AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM h WHERE NOT e), b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS n FROM h WHERE NOT e)
SELECT query_id, id, CAST(rank AS INTEGER) AS new_rank FROM a JOIN b USING (query_id, n) UNION ALL SELECT query_id, id, CAST(rank AS INTEGER) FROM h WHERE e""")
def protected_bypass(spark, sf_dir):
    """Entity rows stay where they are, the others share the free ranks."""
    return S.protected(hits(spark, sf_dir), F.col("access_count"), "bypass").select("query_id", "id", F.col("new_rank").cast("int").alias("new_rank"))


@query(f"""WITH {HITS}, t AS (SELECT *, e AND row_number() OVER (PARTITION BY query_id, e ORDER BY rank) <= 3 AS top FROM h)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN top THEN 0 ELSE 1 END, CASE WHEN top THEN rank END, s DESC, rank) AS INTEGER) AS new_rank FROM t""")
def protected_anchor(spark, sf_dir):
    """The first three entity rows on top, the rest by score."""
    return S.protected(hits(spark, sf_dir), F.col("access_count"), "anchor").select("query_id", "id", "new_rank")


@query(f"""WITH {BM25}, h AS (SELECT query_id, r.id, rank, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(b.text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')), list_filter(regexp_split_to_array(lower(c.chunk_text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) / len(list_distinct(list_filter(regexp_split_to_array(lower(b.text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')))::DOUBLE AS s
FROM ranked r JOIN @chunks c ON c.id = r.id JOIN benchmark b ON b.item_id = query_id WHERE rank <= 10)
SELECT query_id, id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, rank) AS INTEGER) AS new_rank FROM h""")
def lexical_rerank(spark, sf_dir):
    hits = ranking.bm25_top(texts(spark, sf_dir), items(spark, sf_dir), 10).drop("score")
    own = hits.join(chunks(spark, sf_dir).select("id", "chunk_text"), "id").join(items(spark, sf_dir), "query_id").withColumn("score", S.lexical_score(F.col("text"), F.col("chunk_text")))
    return S.reranked(own, F.round("score", 9)).select("query_id", "id", F.round("score", 6).alias("score"), "new_rank")


@query()
def brief_pick(spark, sf_dir):
    """Quotas, leftovers and near-duplicate rejection of a brief for each source: sequential, held against fixtures."""
    c = chunks(spark, sf_dir)
    rows = c.select(F.regexp_extract("source_file", "(\\d+)", 1).cast("long").alias("request"), (F.col("id") % 2).cast("int").alias("pool"), "id", F.round(ranking.salience(as_of()), 6).alias("score"), T.title_of(F.col("source_file")).alias("title"), T.first_line(F.col("chunk_text")).alias("line"))
    return S.briefs(rows)


@query("""SELECT id, CASE WHEN failed = 1 AND epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) > 6 * 3600000000 THEN 'crashed' WHEN failed = 1 THEN 'started' ELSE 'success' END AS status FROM @telemetry""")
def zombie_operations(spark, sf_dir):
    ops = telemetry(spark, sf_dir).select("id", F.when(F.col("failed") == 1, "started").otherwise("success").alias("status"), F.col("ts").cast("timestamp").alias("started_at"))
    return S.zombies(ops, F.lit("2024-01-31").cast("timestamp")).select("id", "status")


@query("""SELECT id, sha256(feature) AS query, sha256('s' || user_id) AS user FROM @telemetry""")
def read_audit(spark, sf_dir):
    reads = telemetry(spark, sf_dir).select("id", "ts", F.col("feature").alias("query"), F.col("user_id").alias("user"))
    return S.read_audit(reads, "s").select("id", "query", "user")


@query("SELECT id, extract('minute' FROM ts - INTERVAL 180 MINUTE) = 30 AS due FROM @telemetry")
def cron_due(spark, sf_dir):
    return telemetry(spark, sf_dir).select("id", S.cron_due(F.lit(30), F.lit(None), F.col("ts")).alias("due"))
