"""Queries of retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memlode.operators import metrics as M
from memlode.operators import ranking
from memlode.operators.dictionary import holders
from memlode.plans.base import Registry, chunks, texts
from memlode.plans.retrieval import BM25, items, vectors
from memlode.session import Scratch, table

R = Registry()
query = R.query

#: gold: the documents that hold a benchmark passage whole.
GOLD = "gold AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def gold(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return holders(d, b).distinct()


def scored(spark, sf_dir):
    """Metrics of each passage's search; the texts are searched for passages once."""
    g = Scratch(spark).keep(gold(spark, sf_dir))
    hits = ranking.bm25_top(texts(spark, sf_dir), items(spark, sf_dir), 10)
    ranked = hits.join(g.withColumn("is_gold", F.lit(True)), ["query_id", "id"], "left").select("query_id", "id", "rank", F.coalesce("is_gold", F.lit(False)).alias("is_gold"))
    counts = items(spark, sf_dir).select("query_id").join(g.groupBy("query_id").agg(F.count("*").alias("n_gold")), "query_id", "left").fillna(0, ["n_gold"])
    return M.per_query(ranked, counts)


SCORES = f"""{BM25}, {GOLD}, r AS (SELECT query_id, id, rank, (query_id, id) IN (SELECT (query_id, id) FROM gold) AS g FROM ranked WHERE rank <= 10),
n AS (SELECT item_id AS query_id, count(gold.id) AS n_gold FROM benchmark LEFT JOIN gold ON gold.query_id = item_id GROUP BY 1),
a AS (SELECT query_id, sum(CASE WHEN g THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (WHERE g) AS found, max(CASE WHEN g THEN 1.0::DOUBLE / rank END) AS rr, count(*) FILTER (WHERE g AND rank <= 5) AS p5 FROM r GROUP BY 1),
s AS (SELECT query_id, n_gold, CASE WHEN n_gold > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg,
  CASE WHEN n_gold > 0 THEN coalesce(found, 0) / n_gold::DOUBLE ELSE 0 END AS recall, CASE WHEN n_gold > 0 THEN coalesce(found, 0) / least(n_gold, 10)::DOUBLE ELSE 0 END AS recall_capped, coalesce(p5, 0) / 5::DOUBLE AS p5, coalesce(rr, 0)::DOUBLE AS mrr, CASE WHEN found > 0 THEN 1 ELSE 0 END AS hit FROM n LEFT JOIN a USING (query_id))"""


@query(f"WITH {SCORES} SELECT query_id, n_gold, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(recall_capped, 6) AS recall_capped, p5, round(mrr, 6) AS mrr, hit FROM s")
def passage_scores(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("query_id", "n_gold", *[F.round(c, 6).alias(c) for c in ("ndcg", "recall", "recall_capped")], "p5", F.round("mrr", 6).alias("mrr"), "hit")


@query(f"""WITH {SCORES} SELECT CASE WHEN n_gold = 0 THEN 'none' WHEN n_gold = 1 THEN 'one' ELSE 'many' END AS category, count(*) AS n, CASE WHEN count(*) FILTER (WHERE query_id % 10 <> 3) = 0 THEN 'SKIP' WHEN count(*) FILTER (WHERE query_id % 10 = 3) > 0 THEN 'PARTIAL' ELSE 'OK' END AS status,
round(avg(ndcg) FILTER (WHERE query_id % 10 <> 3), 6) AS ndcg, round(avg(mrr) FILTER (WHERE query_id % 10 <> 3), 6) AS mrr FROM s GROUP BY 1""")
def score_rollup(spark, sf_dir):
    s = scored(spark, sf_dir)
    kind = F.when(F.col("n_gold") == 0, "none").when(F.col("n_gold") == 1, "one").otherwise("many")
    return M.rollup(s.withColumns({"category": kind, "error": F.col("query_id") % 10 == 3}), ["category"], ["ndcg", "mrr"])


KNN10 = """s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, q.label = c.label AS g, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS cos, c.label AS l FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC, id) AS rank FROM s)"""


def class_ranked(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    near = ranking.knn(*vectors(spark, sf_dir), 10)
    q = e.select(F.col("id").alias("query_id"), F.col("label").alias("q_label"))
    return near.join(e, "id").join(q, "query_id").withColumn("is_gold", F.col("label") == F.col("q_label"))


@query(f"WITH {KNN10} SELECT query_id, round(count(*) FILTER (WHERE g AND rank <= 5) / 5::DOUBLE, 6) AS p5, round(sum(CASE WHEN g THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS dcg FROM k WHERE rank <= 10 GROUP BY 1")
def class_scores(spark, sf_dir):
    r = M.credited(class_ranked(spark, sf_dir))
    return r.groupBy("query_id").agg(F.round(F.sum(F.when(F.col("rank") <= 5, F.col("credit")).otherwise(0.0)) / 5, 6).alias("p5"), F.round(F.sum(F.col("credit") / F.log2(F.col("rank") + 1.0)), 6).alias("dcg"))


@query(f"""WITH {KNN10}, p AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY id) - 1 AS place FROM k WHERE rank <= 20)
SELECT query_id, round(sum(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0.5 END / (1 + 0.1 * place) / log2(rank + 1)) / sum(1 / (1 + 0.1 * place) / log2(place + 2)), 6) AS graded FROM p GROUP BY 1""")
def graded_scores(spark, sf_dir):
    near = ranking.knn(*vectors(spark, sf_dir), 20).withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("id")) - 1)
    return M.graded_ndcg(near).select("query_id", F.round("graded", 6).alias("graded"))


VARIANTS = "v AS (SELECT o_custkey AS query_id, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS variant, max(round(o_totalprice / 500000, 4)) AS score FROM orders GROUP BY 1, 2), b AS (SELECT query_id, variant, score - max(CASE WHEN variant = 'A' THEN score END) OVER (PARTITION BY query_id) AS delta FROM v)"


@query(f"WITH {VARIANTS}, a AS (SELECT variant, count(*) AS n, avg(delta) AS mean, count(*) FILTER (WHERE delta < -0.02) AS regressed FROM b WHERE variant <> 'A' GROUP BY 1) SELECT variant, n, round(mean, 6) AS mean, regressed, CASE WHEN n < 10 THEN 'INSUFFICIENT' WHEN mean >= 0.01 AND regressed * 4 <= n THEN 'SHIP' WHEN mean < 0 THEN 'REJECT' ELSE 'HOLD' END AS verdict FROM a")
def variant_verdict(spark, sf_dir):
    v = F.when(F.col("o_orderkey") % 3 == 0, "A").when(F.col("o_orderkey") % 3 == 1, "B").otherwise("C")
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("query_id"), v.alias("variant")).agg(F.max(F.round(F.col("o_totalprice") / 500000, 4)).alias("score"))
    return M.verdict(M.against_first(s, "score"))


PLACES = "x AS (SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS ra, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rb FROM orders)"


def places(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderdate")
    a = o.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("o_totalprice"), "id")))
    b = o.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("o_orderdate", "id")))
    return a.where("rank <= 10"), b.where("rank <= 10")


@query(f"WITH {PLACES}, d AS (SELECT query_id, least(ra, 11) - least(rb, 11) AS d FROM x WHERE ra <= 10 OR rb <= 10) SELECT query_id, CAST(least(100, sum(abs(d))) AS BIGINT) AS moved FROM d GROUP BY 1")
def rank_difference(spark, sf_dir):
    return M.rank_delta(*places(spark, sf_dir))


@query(f"WITH {PLACES} SELECT query_id, id, CAST(ra - rb AS INTEGER) AS lift FROM x WHERE ra <= 10 AND rb <= 10")
def rerank_lift(spark, sf_dir):
    return M.lift(*places(spark, sf_dir)).select("query_id", "id", "lift")


QA = """t AS (SELECT conv_id, turn, lower(text) AS p, lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role)) AS g FROM conversations),
w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(p, '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS p, list_filter(regexp_split_to_array(regexp_replace(g, '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS g FROM t WHERE g IS NOT NULL),
c AS (SELECT conv_id, turn, len(p) AS np, len(g) AS ng, list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))) AS same, p = g AS em FROM w)"""


@query(f"WITH {QA} SELECT conv_id, turn, CAST(em AS INTEGER) AS em, round(CASE WHEN coalesce(same, 0) = 0 THEN 0 ELSE 2 * (same / np::DOUBLE) * (same / ng::DOUBLE) / (same / np::DOUBLE + same / ng::DOUBLE) END, 6) AS f1 FROM c")
def answer_f1(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    nxt = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn", "role"))
    rows = c.select("conv_id", "turn", F.col("text").alias("pred"), nxt.alias("gold")).where("gold is not null").withColumn("golds", F.array("gold"))
    return M.qa_scores(rows).select("conv_id", "turn", "em", F.round("f1", 6).alias("f1"))
