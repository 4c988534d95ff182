"""Retrieval and question-answering metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memlode.functions import text as T


def credited(ranked: DataFrame) -> DataFrame:
    """Adds ``credit``: 1 for the first occurrence of a gold id in its query, 0 for repeats and others; the slot stays."""
    first = F.row_number().over(W.partitionBy("query_id", "id").orderBy("rank"))
    return ranked.withColumn("credit", F.when((first == 1) & F.col("is_gold"), 1.0).otherwise(0.0))


def per_query(ranked: DataFrame, gold_counts: DataFrame, k: int = 10) -> DataFrame:
    """nDCG@k, recall@k (over gold and over min(gold, k)), precision@5, reciprocal rank and hit@k of each query.

    ranked: (query_id, id, rank from 1, is_gold), cut at k before repeats are discounted; gold_counts:
    (query_id, n_gold).  Queries without gold or without results score 0.
    """
    own = credited(ranked.where(F.col("rank") <= k))
    agg = own.groupBy("query_id").agg(
        F.sum(F.col("credit") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum("credit").alias("found"),
        F.max(F.when(F.col("credit") > 0, 1.0 / F.col("rank"))).alias("rr"), F.sum(F.when(F.col("rank") <= 5, F.col("credit")).otherwise(0.0)).alias("p5"),
    )
    both = gold_counts.join(agg, "query_id", "left").fillna(0.0, ["dcg", "found", "rr", "p5"])
    n = F.least(F.col("n_gold"), F.lit(k)).cast("int")
    ideal = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return both.select(
        "query_id", "n_gold", F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"), F.when(F.col("n_gold") > 0, F.col("found") / F.col("n_gold")).otherwise(0.0).alias("recall"),
        F.when(n > 0, F.col("found") / n).otherwise(0.0).alias("recall_capped"), (F.col("p5") / 5).alias("p5"), F.col("rr").alias("mrr"), (F.col("found") > 0).cast("int").alias("hit"),
    )


def graded_ndcg(ranked: DataFrame, k: int = 10) -> DataFrame:
    """Ranked gold with gain 1 / (1 + 0.1 * gold place), halved beyond k."""
    gain = 1.0 / (1 + 0.1 * F.col("place"))
    own = F.when(F.col("rank") <= k, 1.0).otherwise(0.5) * gain / F.log2(F.col("rank") + 1.0)
    ideal = gain / F.log2(F.col("place") + 2.0)
    return ranked.groupBy("query_id").agg((F.sum(own) / F.sum(ideal)).alias("graded"))


def rollup(scores: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Means by group with a status: OK, PARTIAL (some errors) or SKIP (all errors); errored rows do not score."""
    ok = ~F.col("error")
    status = F.when(F.count(F.when(ok, 1)) == 0, "SKIP").when(F.count(F.when(~ok, 1)) > 0, "PARTIAL").otherwise("OK")
    return scores.groupBy(*by).agg(F.count("*").alias("n"), status.alias("status"), *[F.round(F.avg(F.when(ok, F.col(m))), 6).alias(m) for m in metrics])


def verdict(deltas: DataFrame, least: float = 0.01, drop: float = -0.02) -> DataFrame:
    """Per variant: mean gain over A, regressed queries, and SHIP / HOLD / REJECT, INSUFFICIENT under ten queries."""
    agg = deltas.groupBy("variant").agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.count(F.when(F.col("delta") < drop, 1)).alias("regressed"))
    v = F.when(F.col("n") < 10, "INSUFFICIENT").when((F.col("mean") >= least) & (F.col("regressed") * 4 <= F.col("n")), "SHIP").when(F.col("mean") < 0, "REJECT").otherwise("HOLD")
    return agg.select("variant", "n", F.round("mean", 6).alias("mean"), "regressed", v.alias("verdict"))


def against_first(scores: DataFrame, metric: str) -> DataFrame:
    """Each variant's score less variant A's on the same query."""
    base = F.max(F.when(F.col("variant") == "A", F.col(metric))).over(W.partitionBy("query_id"))
    return scores.withColumn("delta", F.col(metric) - base).where("variant <> 'A'")


def rank_delta(before: DataFrame, after: DataFrame, k: int = 10, limit: int = 100) -> DataFrame:
    """Sum over a query's ids of the rank gained; an id that is absent counts as rank k + 1; kept within +-limit."""
    a, b = before.select("query_id", "id", F.col("rank").alias("ra")), after.select("query_id", "id", F.col("rank").alias("rb"))
    own = a.join(b, ["query_id", "id"], "full_outer").select("query_id", (F.coalesce("ra", F.lit(k + 1)) - F.coalesce("rb", F.lit(k + 1))).alias("d"))
    return own.groupBy("query_id").agg(F.greatest(F.lit(-limit), F.least(F.lit(limit), F.sum(F.abs("d")))).cast("long").alias("moved"))


def lift(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.select("query_id", "id", F.col("rank").alias("old_rank")), after.select("query_id", "id", F.col("rank").alias("new_rank"))
    return a.join(b, ["query_id", "id"]).withColumn("lift", F.col("old_rank") - F.col("new_rank"))


def qa_scores(rows: DataFrame, keep_gap: bool = False) -> DataFrame:
    """Exact match and token F1 of pred against the best of golds (an array); yes/no answers must agree."""
    p = T.squad_normalise(F.col("pred"), keep_gap)
    each = F.transform("golds", lambda g: T.squad_normalise(g, keep_gap))
    closed = ("yes", "no", "noanswer")

    def f1(g):
        return F.when((p.isin(*closed) | g.isin(*closed)) & (p != g), F.lit(0.0)).otherwise(T.token_f1(p, g))

    return rows.withColumns({"em": F.array_contains(each, p).cast("int"), "f1": F.coalesce(F.array_max(F.transform(each, f1)), F.lit(0.0))})


def joint(answer: Column, support: Column) -> Column:
    return answer * support


def support_scores(gold: Column, got: Column) -> list[Column]:
    same = F.size(F.array_intersect(gold, got))
    p, r = same / F.greatest(F.size(got), F.lit(1)), same / F.greatest(F.size(gold), F.lit(1))
    return [(F.array_sort(gold) == F.array_sort(got)).cast("int").alias("sp_em"), F.when(same > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("sp_f1")]


#: Phrases that count as abstaining.
ABSTAINS = (
    "not mentioned", "no information", "no info", "i don't know", "i do not know", "cannot answer", "can't answer", "unanswerable", "not answerable", "not available",
    "not provided", "no answer", "unknown", "i'm not sure", "cannot be determined", "no relevant", "no record",
)


def category_score(category: Column, gold: Column, pred: Column) -> Column:
    """Score by question category: 1 mean token F1 over the gold's parts (split at ; else at ,), 3 the first
    alternative, 5 whether the prediction abstains, others token F1; punctuation becomes a space."""
    norm = lambda x: T.squad_normalise(x, True)
    gold, pred = F.coalesce(gold, F.lit("")), F.coalesce(pred, F.lit(""))
    cut = lambda sep: F.filter(F.transform(F.split(gold, sep), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.when(F.size(cut(";")) >= 2, cut(";")).otherwise(cut(","))
    each = F.transform(parts, lambda g: T.token_f1(norm(pred), norm(g)))
    several = F.when(F.size(parts) > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(parts)).otherwise(0.0)
    head = F.trim(F.get(F.split(gold, ";"), F.lit(0)))
    first = F.when(head != "", head).otherwise(gold)
    refused = F.lit(False)
    for phrase in ABSTAINS:
        refused = refused | F.contains(F.lower(pred), F.lit(phrase))
    plain = T.token_f1(norm(pred), norm(gold))
    return F.when(category == 1, several).when(category == 3, T.token_f1(norm(pred), norm(first))).when(category == 5, refused.cast("double")).otherwise(plain)


def session_day(raw: Column) -> Column:
    """The date in a session stamp such as '1:56 pm on 8 May, 2023'; null if there is none."""
    from memlode.operators.temporal import MONTHS

    pattern = "(?i)(\\d{1,2})\\s+([a-z]{3,9})\\.?,?\\s+(\\d{4})"
    name = F.lower(F.regexp_extract(raw, pattern, 2))
    month = F.element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), F.nullif(name, F.lit("")))
    day, year = (F.nullif(F.regexp_extract(raw, pattern, i), F.lit("")).cast("int") for i in (1, 3))
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day)).cast("date")
