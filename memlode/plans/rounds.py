"""Queries that advance in rounds, and assignment with exact margins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memlode.functions import text as T
from memlode.operators import assignment, ranking
from memlode.operators import rounds as O
from memlode.plans.base import Registry, texts
from memlode.plans.retrieval import items
from memlode.session import Scratch, table

R = Registry()
query = R.query


@query("""SELECT 'o' || o_orderkey AS old, 'o' || max(o_orderkey) OVER (PARTITION BY o_custkey) AS final, count(*) OVER (PARTITION BY o_custkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS hops
FROM orders QUALIFY hops > 0""")
def rename_closure(spark, sf_dir):
    """Each order renamed to its customer's next one: where it ends."""
    name = lambda c: F.concat(F.lit("o"), c.cast("string"))
    then = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return O.rename_closure(table(spark, sf_dir, "orders").select(name(F.col("o_orderkey")).alias("old"), name(then).alias("new")).where("new is not null"))


@query()
def diverse_documents(spark, sf_dir):
    """Five documents of each language with little in common; held against plain Python in tests."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("tokens"))
    return O.diverse_choice(d, 5).select("grp", "place", "id", F.round("overlap", 6).alias("overlap"))


@query()
def iterated_search(spark, sf_dir):
    """Items asked three times at most, each time with the head of the best new document; rules of stopping held against plain Python in tests."""
    docs = texts(spark, sf_dir)

    def vectored(df):  # counts of the letters stand for an embedding
        letters = [F.regexp_count(F.lower("text"), F.lit(c)).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"]
        return df.withColumn("vec", F.array(*letters))

    def follow(active, evidence):
        w = W.partitionBy("query_id").orderBy(F.desc("round"), "rank", "id")
        best = evidence.withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "id")
        head = F.array_join(F.slice(F.split(F.coalesce("chunk_text", F.lit("")), " "), 1, 20), " ")
        return vectored(best.join(docs.select("id", "chunk_text"), "id").select("query_id", head.alias("text")))

    search = lambda asked: ranking.bm25_top(docs, asked, 5)
    evidence, ends = O.iterated(vectored(items(spark, sf_dir)), search, follow, rounds=3)
    return evidence.join(Scratch(spark).keep(ends), "query_id").select("query_id", "round", "id", "rank", "rounds", "reason")


@query("""SELECT arm, n * share // 6 + CASE WHEN place < n - (n * 3 // 6 + 3 * (n // 6)) THEN 1 ELSE 0 END AS n, true AS within_one
FROM (SELECT count(*) AS n FROM customer), (VALUES ('control', 3, 0), ('low', 1, 1), ('middle', 1, 2), ('high', 1, 3)) a(arm, share, place)""")
def stratified_arms(spark, sf_dir):
    """Customers of each nation dealt to a control and three doses: exact arms, every cell within one of its share."""
    shares = {"control": 3, "low": 1, "middle": 1, "high": 1}
    out = Scratch(spark).keep(assignment.assigned(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("stratum")), shares, "trial-1"))
    cell = out.groupBy("arm", "stratum").agg(F.count("*").alias("c"))
    arm = cell.groupBy(F.col("arm").alias("a_")).agg(F.sum("c").alias("n"))
    stratum = cell.groupBy(F.col("stratum").alias("s_")).agg(F.sum("c").alias("m"))
    every = arm.crossJoin(F.broadcast(arm.agg(F.sum("n").alias("all"))))
    full = every.join(stratum).join(cell, (F.col("a_") == F.col("arm")) & (F.col("s_") == F.col("stratum")), "left")
    near = F.abs(F.coalesce("c", F.lit(0)) - F.col("n") * F.col("m") / F.col("all")) < 1
    return full.groupBy(F.col("a_").alias("arm"), "n").agg(F.every(near).alias("within_one"))
