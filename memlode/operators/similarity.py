"""Near-duplicate similarity join on word shingles by prefix filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memlode.session import Scratch


def shingles(rows: DataFrame, k: int = 5) -> DataFrame:
    """(id, n, h): hashes of the distinct k-word shingles of each row's text (lower case, white-space words); fewer words are one shingle."""
    w = F.array_remove(F.split(F.lower("text"), "\\s+"), "")
    own = rows.select("id", w.alias("w")).where(F.size("w") > 0)
    own = own.select("id", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - k, F.lit(0))), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(k)]))
    own = own.select("id", F.array_distinct(grams).alias("hs"))
    return own.select("id", F.size("hs").alias("n"), F.explode_outer("hs").alias("h"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.xxhash64("text").alias("t1"), F.coalesce(F.sha1("text"), F.lit("")).alias("t2"), "text")


def exact_members(rows: DataFrame) -> DataFrame:
    """(id, rep): each id and the least id with the same text.  Texts are hashed where they are read, and only hashes move."""
    keyed = _keyed(rows).drop("text")
    reps = keyed.groupBy("t1", "t2").agg(F.min("id").alias("rep"))
    return keyed.join(reps, ["t1", "t2"]).select("id", "rep")


#: Longs of a text's sketch: a bit for each of 64 times as many classes of its shingles, set if it has an odd number of them.
WORDS = 16


def near_duplicates(rows: DataFrame, threshold: float = 0.8, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of rows (id, text).

    members maps each id to the least id with the same text; pairs (a, b, jaccard) are all links of at
    least ``threshold`` between different texts, as representatives.  A text that shares fewer than
    ceil(threshold * n) of its n shingles with any others has no links, so only the shared shingles of the
    rest go on.  A pair must share one of the n - ceil(threshold * n) + 1 rarest shingles of either side,
    so only those are joined; there the texts differ at least in what nobody shares and in the bits in which
    their sketches differ, and what differs in too much is no candidate.  The shared shingles of candidates
    are then counted.
    """
    scratch = Scratch(rows.sparkSession)
    members = exact_members(rows)
    texts = _keyed(rows).groupBy("t1", "t2").agg(F.min_by("text", "id").alias("text"), F.min("id").alias("id")).select("id", "text")
    sh = shingles(texts, k).withColumn("df", F.count("*").over(W.partitionBy("h"))).where("df > 1")
    bit = lambda i: F.when(F.pmod(F.shiftright("h", 6), F.lit(WORDS)) == i, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int")))
    sketch = [F.coalesce(F.bit_xor(bit(i)), F.lit(0).cast("long")).alias(f"s{i}") for i in range(WORDS)]
    least = F.ceil(F.lit(threshold) * F.col("n") - 1e-9)
    own = sh.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"), *sketch).where(F.size("hs") >= least)
    own = scratch.keep(own.withColumns({"alone": F.col("n") - F.size("hs"), "prefix": F.slice("hs", F.lit(1), (F.size("hs") - least + 1).cast("int")).h, "hs": F.col("hs").h}))
    side = lambda x: own.select(*[F.col(c).alias(f"{c}{x}") for c in ("id", "n", "alone", *[f"s{i}" for i in range(WORDS)])], F.explode("prefix").alias("h"))
    small = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    apart = sum((F.bit_count(F.col(f"s{i}a").bitwiseXOR(F.col(f"s{i}b"))) for i in range(WORDS)), F.col("alonea") + F.col("aloneb"))
    close = (F.col("ida") < F.col("idb")) & small & (apart <= (1 - threshold) / (1 + threshold) * (F.col("na") + F.col("nb")) + 1e-6)
    cand = scratch.keep(side("a").join(side("b"), "h").where(close).select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct())
    has = lambda x: own.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("hs").alias(f"hs{x}"))
    same = cand.join(has("a"), "a").join(has("b"), "b").withColumn("same", F.size(F.array_intersect("hsa", "hsb")))
    jac = F.col("same") / (F.col("na") + F.col("nb") - F.col("same"))
    return members, same.select("a", "b", jac.alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-9)
