"""Whether messages take up what a brief showed them, against items shown before and after as placebo arms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlode.operators.stats import counted_below
from memlode.operators.telemetry import as_of_join
from memlode.session import Scratch

ARMS = ("exposed", "past", "future")


def placebo_arms(messages: DataFrame, briefs: DataFrame, hits: DataFrame) -> DataFrame:
    """(grp, arm, pairs, hits): pairs of a message and an item of its group, and those of them in ``hits`` (msg_id, item_id).

    ``messages`` is (msg_id, grp, ts) with distinct ids, ``briefs`` (grp, brief_id, ts, item_id), a row an item, one ts a
    brief.  A message's brief is the group's last at or before it (ties: the greatest id); its items are the exposed ones.
    Other items of earlier briefs are the past arm, items that only later briefs hold the future arm.  Messages before
    the first brief take no part; groups without messages give no rows, rows with a null group, time or item neither.

    Pairs are counted, not made: with introduced(b) the items a group has seen by brief b, the messages of b have
    |b| exposed, introduced(b) - |b| past and all - introduced(b) future items.  Only hits are looked up one by one.
    """
    scratch = Scratch(messages.sparkSession)
    shown = scratch.keep(briefs.select("grp", F.struct(F.col("ts").alias("ts"), F.col("brief_id").alias("brief_id")).alias("brief"), "item_id").dropna(subset=["grp", "item_id"]).where("brief.ts is not null and brief.brief_id is not null").distinct())
    sizes = shown.groupBy("grp", "brief").agg(F.count("*").alias("size"))
    first = scratch.keep(shown.groupBy("grp", "item_id").agg(F.min("brief").alias("first")))
    # every brief of a group in order, each weighing as many items as it is the first to show
    marks = first.select(F.struct("grp", F.col("first").alias("brief")).alias("at"), F.lit(1).alias("new")).unionByName(sizes.select(F.struct("grp", "brief").alias("at"), F.lit(0).alias("new")))
    below = scratch.keep(counted_below(marks, "at", F.col("new")).select("at.grp", "at.brief", "n_below", (F.col("n_below") + F.col("n_same")).alias("upto")))
    ends = below.groupBy("grp").agg(F.min("n_below").alias("base"), F.max("upto").alias("top"))
    seen = sizes.join(below, ["grp", "brief"]).join(ends, "grp").select("grp", "brief", "size", (F.col("upto") - F.col("base")).alias("introduced"), (F.col("top") - F.col("base")).alias("every"))
    right = sizes.select("grp", "brief.ts", "brief")
    current = scratch.keep(as_of_join(messages.dropna(subset=["grp", "ts"]).select(F.col("msg_id").alias("id"), "grp", "ts"), right, "grp", "brief").where("brief is not null").select("id", "grp", "brief"))
    per = current.groupBy("grp", "brief").agg(F.count("*").alias("m")).join(seen, ["grp", "brief"])
    n = lambda c: F.sum(F.col("m") * c)
    pairs = per.groupBy("grp").agg(n(F.col("size")).alias("exposed"), n(F.col("introduced") - F.col("size")).alias("past"), n(F.col("every") - F.col("introduced")).alias("future"))
    wide = pairs.select("grp", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("pairs")) for a in ARMS])).alias("p")).select("grp", "p.arm", "p.pairs")
    met = hits.select(F.col("msg_id").alias("id"), "item_id").distinct().join(current, "id").join(first, ["grp", "item_id"])
    met = met.join(shown.withColumn("shown", F.lit(True)), ["grp", "brief", "item_id"], "left")
    arm = F.when(F.col("shown"), "exposed").when(F.col("first") < F.col("brief"), "past").otherwise("future")
    counts = met.groupBy("grp", arm.alias("arm")).agg(F.count("*").alias("hits"))
    return wide.join(counts, ["grp", "arm"], "left").select("grp", "arm", "pairs", F.coalesce("hits", F.lit(0)).alias("hits"))
