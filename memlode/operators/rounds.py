"""Operators that advance in rounds over tables: renames to their end, diverse choice, retrieval that asks again.

A round is a few Spark jobs over whole tables; what it leaves is written to the shared scratch folder, so
plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlode.operators import dictionary
from memlode.session import Scratch


def rename_closure(renames: DataFrame) -> DataFrame:
    """(old, final, hops) for renames (old, new): where each old name ends, and after how many renames.

    Pointers double their reach each round, so a chain of n renames takes log2 n of them.  An old name
    given twice goes to the greater new one; null or empty names are left out.  A circle, a name renamed
    to itself included, is an error that names one of its members.
    """
    scratch = Scratch(renames.sparkSession)
    first = renames.where("old <> '' and new <> ''").groupBy("old").agg(F.max("new").alias("final"))
    now = scratch.keep(first.select("old", "final", F.lit(1).cast("long").alias("hops")))
    for _ in range(math.ceil(math.log2(max(2, now.count()))) + 2):
        ahead = now.select(F.col("old").alias("o_"), F.col("final").alias("f_"), F.col("hops").alias("h_"))
        step = now.join(ahead, F.col("final") == F.col("o_"), "left")
        if step.where("o_ is not null").isEmpty():
            return now
        new = scratch.keep(step.select("old", F.coalesce("f_", "final").alias("final"), (F.col("hops") + F.coalesce("h_", F.lit(0))).alias("hops")))
        scratch.drop(now)
        now = new
    left = now.join(now.select(F.col("old").alias("o_")), F.col("final") == F.col("o_"), "left_semi").agg(F.min("final")).first()[0]
    raise ValueError(f"circular rename through {left!r}")


def _rewrite(text: str, pairs: list[tuple[str, str]]) -> str:
    """Names in the targets of links, in wiki links (with anchor or label) and standing alone."""
    for old, new in pairs:
        name, put = re.escape(old), new.replace("\\", "\\\\")
        text = re.sub(rf"(\[[^\]]*\]\()([^)]*?)\b{name}\b([^)]*)\)", rf"\g<1>\g<2>{put}\g<3>)", text)
        text = re.sub(rf"(\[\[){name}((?:#[^|\]\n]*)?(?:\|[^\]\n]*)?)(\]\])", rf"\g<1>{put}\g<2>\g<3>", text)
        text = re.sub(rf"(?:(?<=[\s(,;])|^){name}(?=$|[\s).,?!;:])", put, text, flags=re.M)
    return text


def rewritten(texts: DataFrame, renames: DataFrame) -> DataFrame:
    """(id, text, changed) for every row of texts (id, text): references to old names say the final ones.

    Ids must be distinct.  The automaton of all old names finds which of them a text may hold, so a text
    meets those only, in the order of their names; null texts stay null.
    """
    ends = Scratch(texts.sparkSession).keep(rename_closure(renames))
    held = dictionary.occurrences(texts, ends.select(F.col("old").alias("name"))).select("id", "name").distinct()
    folded = ends.withColumn("name", F.lower(F.trim("old")))
    pairs = held.join(folded, "name").groupBy(F.col("id").alias("i_")).agg(F.array_sort(F.collect_list(F.struct("old", "final"))).alias("pairs"))

    @F.pandas_udf("string")
    def put(text: pd.Series, pairs: pd.Series) -> pd.Series:
        return pd.Series([_rewrite(t, [(p["old"], p["final"]) for p in ps]) for t, ps in zip(text, pairs)], dtype=object)

    both = texts.join(pairs, F.col("id") == F.col("i_"), "left")
    new = F.when(F.col("pairs").isNotNull(), put(F.coalesce("text", F.lit("")), F.coalesce("pairs", F.array().cast("array<struct<old:string,final:string>>")))).otherwise(F.col("text"))
    return both.select("id", "text", new.alias("new")).select("id", F.col("new").alias("text"), F.coalesce(F.col("new") != F.col("text"), F.lit(False)).alias("changed"))


def diverse_choice(items: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(grp, place, id, overlap): a greedy max-min choice of k items (grp, id, tokens) in each group.

    The first is the least in a seeded order; each next one has the least greatest Jaccard overlap with
    those chosen, ties in the same order.  A round is one pass over the items beside the chosen ones (k
    token sets a group at most) and a minimum a group, combined before it is shuffled.  Null tokens are none.
    """
    scratch = Scratch(items.sparkSession)
    own = scratch.keep(items.select("grp", "id", F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))).alias("tokens"), F.xxhash64(F.lit(seed), "grp", "id").alias("turn")))
    chosen = scratch.keep(own.groupBy("grp").agg(F.min_by(F.struct("id", "tokens"), F.struct("turn", "id")).alias("c")).select("grp", F.lit(1).alias("place"), "c.id", "c.tokens", F.lit(0.0).alias("overlap")))
    for place in range(2, k + 1):
        had = chosen.groupBy(F.col("grp").alias("g_")).agg(F.collect_list(F.struct("id", "tokens")).alias("had"))
        had = scratch.broadcast_if_small(scratch.keep(had))
        share = lambda c: F.size(F.array_intersect("tokens", c.tokens)) / F.greatest(F.size(F.array_union("tokens", c.tokens)), F.lit(1))
        left = own.join(had, F.col("grp").eqNullSafe(F.col("g_"))).where(~F.exists("had", lambda c: c.id == F.col("id")))
        worst = left.select("grp", "id", "tokens", "turn", F.array_max(F.transform("had", share)).alias("worst"))
        best = worst.groupBy("grp").agg(F.min_by(F.struct("id", "tokens", "worst"), F.struct("worst", "turn", "id")).alias("c"))
        new = scratch.keep(best.select("grp", F.lit(place).alias("place"), "c.id", "c.tokens", F.col("c.worst").alias("overlap")))
        if new.isEmpty():
            break
        chosen = chosen.unionByName(new)
    return chosen.select("grp", "place", "id", "overlap")


def iterated(questions: DataFrame, search: Callable[[DataFrame], DataFrame], follow: Callable[[DataFrame, DataFrame], DataFrame], rounds: int = 5, overlap: float = 0.8, similar: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Retrieval in rounds for many questions (query_id, text, vec) at once: (evidence, ends).

    Each round asks ``search`` (query_id, text) -> (query_id, id, rank) for the questions still active; what it
    finds beyond the evidence so far is added as (query_id, round, id, rank).  ``follow`` (active questions,
    evidence) -> (query_id, text, vec) makes the next questions.  ends is (query_id, rounds, reason): a question
    stops with 'no_results', with 'chunk_overlap' once at least ``overlap`` of what a round finds is what the
    round before found, with 'query_similarity' if its next text's vector has a cosine of ``similar`` or more to
    one asked before, with 'no_question' if follow has none, or with 'max_rounds'.
    """
    spark = questions.sparkSession
    scratch = Scratch(spark)
    active = scratch.keep(questions.select("query_id", "text", "vec"))
    past = active.select("query_id", "vec")
    evidence = ends = last = None

    def end(rows: DataFrame, n: int, reason: str) -> None:
        nonlocal ends
        done = scratch.keep(rows.select("query_id", F.lit(n).alias("rounds"), F.lit(reason).alias("reason")))
        ends = done if ends is None else ends.unionByName(done)

    for n in range(1, rounds + 1):
        if n > 1:
            asked = scratch.keep(follow(active, evidence).select("query_id", "text", "vec").join(active.select("query_id"), "query_id", "left_semi"))
            end(active.join(asked, "query_id", "left_anti"), n - 1, "no_question")
            near = scratch.keep(asked.join(past.withColumnRenamed("vec", "old"), "query_id").where(_cosine("vec", "old") >= similar - 1e-12).select("query_id").distinct())
            end(near, n - 1, "query_similarity")
            active = scratch.keep(asked.join(near, "query_id", "left_anti"))
            past = past.unionByName(active.select("query_id", "vec"))
        got = scratch.keep(search(active.select("query_id", "text")).select("query_id", "id", "rank"))
        new = got.withColumn("round", F.lit(n))
        if evidence is not None:
            new = new.join(evidence.select("query_id", "id"), ["query_id", "id"], "left_anti")
        new = scratch.keep(new.select("query_id", "round", "id", "rank"))
        known = got.select("query_id", "id", F.lit(0).alias("same")) if last is None else got.join(last.select("query_id", "id", F.lit(1).alias("same")), ["query_id", "id"], "left")
        seen = scratch.keep(known.groupBy("query_id").agg((F.sum(F.coalesce("same", F.lit(0))) / F.count("*")).alias("share")))
        evidence = new if evidence is None else evidence.unionByName(new)
        end(active.join(seen, "query_id", "left_anti"), n, "no_results")
        end(seen.where(F.col("share") >= overlap), n, "chunk_overlap")
        active = scratch.keep(active.join(seen.where(F.col("share") < overlap), "query_id", "left_semi"))
        last = got
        if active.isEmpty():
            return evidence, ends
    end(active, rounds, "max_rounds")
    return evidence, ends


def _cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
