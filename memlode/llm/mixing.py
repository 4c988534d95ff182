"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are words.  Targets come from weights by capped proportional sharing.  Each source is dealt by
hash into shards of about ``shard_words``; equal-token blocks are apportioned to the shards of all
sources by highest quotients target / (2 * blocks + 1), so every shard knows its integer quota.  In a
shard the documents stand in seeded order, a random permutation, and the blocks are cut along it; the
quota takes the shard whole, once or twice, and then the first blocks of the order.  As neighbours in
the order are unrelated that is a random selection, and one that takes documents whole: only the one
in which the last block ends is cut, so blocks can be small and targets are met closely.

What a document gives follows from its place before, at or after its shard's cut, a row a shard: texts
meet that small table and are not shuffled.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memlode.llm.common import documents
from memlode.session import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_COPIES = 2
BLOCK_TOKENS = 8
SHARD_WORDS, SEED = 200_000, 17


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, cap: float = MAX_COPIES) -> np.ndarray:
    """Words for each source: ``share`` of all, by weight, none above cap * size; excess is reshared by weight."""
    sizes = np.asarray(sizes, float)
    out, free, left = np.zeros(len(sizes)), sizes > 0, share * sizes.sum()
    while free.any():
        want = left * weights / weights[free].sum()
        over = free & (want > cap * sizes)
        if not over.any():
            out[free] = want[free]
            break
        out[over] = cap * sizes[over]
        left -= out[over].sum()
        free &= ~over
    return out


def apportion(goal: np.ndarray, seats: int, cap: np.ndarray) -> np.ndarray:
    """Sainte-Lague: ``seats`` by the highest quotients goal / (2q + 1), at most ``cap`` each, ties to the first.

    A divisor is found by bisection at which the rounded, capped shares just do not exceed the seats;
    the few seats still missing go by quotient, so the work does not grow with the number of seats.
    """
    goal, cap = np.asarray(goal, float), np.asarray(cap, np.int64)
    cap = np.where(goal > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if not seats:
        return np.zeros(len(goal), np.int64)
    rounded = lambda scale: np.minimum(np.floor(np.minimum(goal * scale + 0.5, 2.0**62)).astype(np.int64), cap)
    lo, hi = 0.0, 1.0
    while rounded(hi).sum() < seats and hi < 1e300:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if rounded(mid).sum() <= seats else (lo, mid)
    q = rounded(lo)
    missing = seats - int(q.sum())
    up = [(-goal[i] / (2 * q[i] + 1), i) for i in range(len(goal)) if q[i] < cap[i]]
    heapq.heapify(up)
    while missing > 0:
        _, i = heapq.heappop(up)
        q[i] += 1
        missing -= 1
        if q[i] < cap[i]:
            heapq.heappush(up, (-goal[i] / (2 * q[i] + 1), i))
    return q


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _order(seed: int) -> F.Column:
    """Where a row stands in its shard."""
    return F.struct(F.xxhash64(F.lit(seed + 1), "doc_id", "mix_h").alias("r"), F.col("doc_id").alias("i"), F.col("mix_h").alias("h"))


def _placed(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``docs``, with the hash of its text as mix_h, and its source's columns of ``plan`` and its shard."""
    out = docs.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("mix_src")), "left")
    return out.withColumn("mix_shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mix_h"), "mix_shards").cast("int"))


def allocate(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, block_tokens: int = BLOCK_TOKENS, shard_words: int = SHARD_WORDS, seed: int = SEED):
    """(plan, cuts) for rows (doc_id, source, mix_h, mix_size): each source's size, target and shards; each shard's
    whole copies, the row in which its last block ends and the words that a row there gives."""
    spark = sized.sparkSession
    src = sized.groupBy("source").agg(F.sum("mix_size").alias("words")).orderBy(F.asc_nulls_last("source")).collect()
    names, size = [r.source for r in src], np.array([r.words for r in src], float)
    goal = targets(size, np.array([weights[i % len(weights)] for i in range(len(src))]), share) if src else size
    shards = [min(4096, 1 + int(s // shard_words)) for s in size]
    plan = spark.createDataFrame(
        [(i, n, int(s), float(g), k) for i, (n, s, g, k) in enumerate(zip(names, size, goal, shards))],
        "mix_s int, mix_src string, mix_source_size long, mix_target double, mix_shards int",
    )
    own = _placed(sized, plan, seed)
    cells = own.groupBy("mix_s", "mix_shard").agg(F.sum("mix_size").alias("words")).orderBy("mix_s", "mix_shard").collect()
    words = np.array([r.words for r in cells], float)
    of = np.array([r.mix_s for r in cells], int)
    want = goal[of] * words / np.maximum(size[of], 1) if len(cells) else words
    quota = apportion(want, round(want.sum() / block_tokens), np.floor(MAX_COPIES * words / block_tokens)) if len(cells) else words
    rows = [(int(r.mix_s), int(r.mix_shard), *divmod(int(q) * block_tokens, int(r.words))) for r, q in zip(cells, quota) if r.words]
    cell = F.broadcast(spark.createDataFrame(rows, "c_s int, c_shard int, mix_copies long, mix_rest long"))
    at_cell = (F.col("mix_s") == F.col("c_s")) & (F.col("mix_shard") == F.col("c_shard"))
    keyed = own.where("mix_size > 0").groupBy("mix_s", "mix_shard", "doc_id", "mix_h", "mix_size").agg(F.count("*").alias("n")).withColumn("mix_order", _order(seed))
    line = W.partitionBy("mix_s", "mix_shard").orderBy("mix_order")
    laid = keyed.withColumn("end", F.sum(F.col("mix_size") * F.col("n")).over(line)).join(cell, at_cell)
    over = F.col("mix_rest") - F.col("end") + F.col("mix_size") * F.col("n")
    ends = laid.where((over > 0) & (F.col("mix_rest") <= F.col("end"))).select("c_s", "c_shard", F.col("mix_order").alias("mix_cut"), F.floor(over / F.col("n")).cast("long").alias("mix_part"))
    cuts = Scratch(spark).keep(cell.join(ends, ["c_s", "c_shard"], "left"))
    return plan, cuts


def attach(docs: DataFrame, plan: DataFrame, cuts: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` (with mix_h and mix_size) with mix_source_size, mix_target and mix_taken."""
    out = _placed(docs, plan, seed).join(F.broadcast(cuts), (F.col("mix_s") == F.col("c_s")) & (F.col("mix_shard") == F.col("c_shard")), "left")
    order = _order(seed)
    rest = F.when(F.col("mix_cut").isNull(), F.lit(0)).when(order < F.col("mix_cut"), F.col("mix_size")).when(order == F.col("mix_cut"), F.col("mix_part")).otherwise(F.lit(0))
    taken = F.coalesce(F.col("mix_copies") * F.col("mix_size") + F.when(F.col("mix_size") > 0, rest).otherwise(F.lit(0)), F.lit(0))
    return out.withColumn("mix_taken", taken.cast("long"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"mix_size": word_count(F.col("text")), "mix_h": F.xxhash64(F.coalesce("text", F.lit("")))})


def mix(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs`` plus mix_size, mix_source_size, mix_target and mix_taken (words, repeats counted).

    Sources in code point order (null is a source of its own, last) get ``weights`` in turn.  Null text
    and wordless text have size 0 and give nothing.  Rows that repeat a doc_id are mixed as rows of
    their own; equal rows stand together, and those in which a quota ends get the same number, their mean
    share rounded down.  An empty table gives an empty result.  The driver holds one row for each source
    and shard: sources are configuration, shards hold ``shard_words`` words each or more where a source
    has over 4096 of them.
    """
    sized = _sized(docs)
    plan, cuts = allocate(Scratch(docs.sparkSession).keep(sized.select("doc_id", "source", "mix_h", "mix_size")), **options)
    out = attach(sized, plan, cuts, options.get("seed", SEED))
    return out.select(*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_taken")


def op9_mixing(spark, sf_dir) -> DataFrame:
    sized = Scratch(spark).keep(_sized(documents(spark, sf_dir).select("doc_id", "source", "text")).drop("text"))
    out = attach(sized, *allocate(sized))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))
