"""Maintenance as functional rewrites: marks, compaction, reindexing, archives, audit chains, briefs and budgets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window as W

from memlode.functions import text as T

MARKS = {"canonical": 1.0, "refuted": 0.05}


def access_counts(chunks: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads (id, ts) added to the stored counts; the latest read wins."""
    r = reads.groupBy("id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    out = chunks.join(r, "id", "left")
    return out.withColumns({"access_count": F.col("access_count") + F.coalesce("n", F.lit(0)), "last_accessed_at": F.greatest("last_accessed_at", "last")}).drop("n", "last")


def compacted(chunks: DataFrame, least: int = 3) -> DataFrame:
    """Groups of ``least`` or more rows of a file and type become one summary row with the least id."""
    g = chunks.groupBy("source_file", "chunk_type").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("source_date").alias("first_date"), F.max("source_date").alias("last_date"))
    return g.where(F.col("n") >= least).select("id", "source_file", "chunk_type", "n", "first_date", "last_date")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def reindex_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a reindex does to each file: insert, update (other fingerprint), keep, delete."""
    a, b = old.select("source_file", F.col("fp").alias("old_fp")), new.select("source_file", F.col("fp").alias("new_fp"))
    act = F.when(F.col("old_fp").isNull(), "insert").when(F.col("new_fp").isNull(), "delete").when(F.col("old_fp") == F.col("new_fp"), "keep").otherwise("update")
    return a.join(b, "source_file", "full_outer").select("source_file", act.alias("action"))


def retention_guard(before: int, after: int, least: float = 0.9) -> None:
    """Stops a rewrite that would lose more than its share of rows."""
    if before and after / before < least:
        raise ValueError(f"rewrite keeps {after} of {before} rows, under {least:.0%}")


def ingest_guard(rows: DataFrame, most: int = 10_000, allowed: bool = False) -> DataFrame:
    """Stops an ingest of more than ``most`` rows unless allowed; looks at one row beyond the limit only."""
    if not allowed and rows.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows; pass allowed=True")
    return rows


def marked(chunks: DataFrame, marks: DataFrame) -> DataFrame:
    """Latest mark (id, ts, mark, superseded_by) of each chunk: canonical 1.0, refuted 0.05, stale only flags; none supersedes itself."""
    last = marks.where(F.col("superseded_by").isNull() | (F.col("superseded_by") != F.col("id"))).groupBy("id").agg(F.max_by(F.struct("mark", "superseded_by"), F.struct("ts", "mark")).alias("m"))
    c = chunks.drop("superseded_by").join(last, "id", "left")
    conf = F.when(F.col("m.mark") == "canonical", 1.0).when(F.col("m.mark") == "refuted", 0.05).otherwise(F.col("confidence"))
    return c.withColumns({"confidence": conf, "superseded_by": F.col("m.superseded_by"), "stale": F.coalesce(F.col("m.mark") == "stale", F.lit(False))}).drop("m")


def file_digests(spark, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files under a folder, by their place in it; each is read as a stream by one task."""
    root = "".join(path.rstrip("/").split(":", 1)[-1].lstrip("/"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name in f["path"]:
                fs, local = pyarrow.fs.FileSystem.from_uri(name)
                digest, size = hashlib.sha256(), 0
                with fs.open_input_stream(local, compression=None) as stream:
                    while part := stream.read(1 << 20):
                        digest.update(part)
                        size += len(part)
                rows.append((name.split(root + "/", 1)[-1], size, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["file", "bytes", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("path")
    return files.repartition(max(1, min(256, files.count()))).mapInPandas(run, "file string, bytes long, sha256 string")


def write_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes tables as gzipped JSON lines and a manifest with size and SHA-256 of every file, which is returned."""
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{path}/tables/{name}", compression="gzip")
    spark = next(iter(tables.values())).sparkSession
    file_digests(spark, f"{path}/tables").coalesce(1).write.json(f"{path}/manifest")
    return spark.read.schema("file string, bytes long, sha256 string").json(f"{path}/manifest")


def read_bundle(spark, path: str, schemas: dict) -> dict[str, DataFrame]:
    """The tables of a bundle; files that are changed, lost or added since the manifest was written raise."""
    want = spark.read.schema("file string, bytes long, sha256 string").json(f"{path}/manifest")
    got = file_digests(spark, f"{path}/tables").select("file", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    odd = want.join(got, "file", "full").where(~(F.col("bytes").eqNullSafe(F.col("b")) & F.col("sha256").eqNullSafe(F.col("s"))))
    if bad := [r.file for r in odd.select("file").orderBy("file").limit(20).collect()]:
        raise ValueError(f"bundle does not match its manifest: {bad}")
    return {n: spark.read.schema(s).json(f"{path}/tables/{n}") for n, s in schemas.items()}


def checkpoints(rows: DataFrame, scope: str, size: int = 1000) -> DataFrame:
    """Digests of ranges of a log, chained: each block of ids by scope with its rows' digest, the range before it
    and ``chain``, which hashes the chain of the block before it and its own digest.

    A block's digest hashes its rows' digests in order, so only 64 characters a row are gathered, in
    blocks of bounded size.  A scope's chain is a stream of one row a block, which holds one digest.
    """
    each = rows.select(scope, "id", F.floor(F.col("id") / size).alias("block"), F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("h"))
    g = each.groupBy(scope, "block").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "h"))), lambda s: s.h), ""), 256).alias("digest"))
    w = W.partitionBy(scope).orderBy("block")
    g = g.withColumns({"previous_last": F.lag("last_id").over(w), "previous_digest": F.lag("digest").over(w)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = object(), ""
        for f in frames:
            out = []
            for key, digest in zip(f[scope], f["digest"]):
                last = hashlib.sha256(f"{last if key == now else ''}|{digest}".encode()).hexdigest()
                now = key
                out.append(last)
            yield f.assign(chain=out)

    return g.repartition(scope).sortWithinPartitions(scope, "block").mapInPandas(run, StructType([*g.schema, StructField("chain", StringType())]))


def broken_links(old: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """The first block of each scope whose chain differs between two readings of a log, or that one of them lacks."""
    a, b = (x.select(scope, "block", F.col("chain").alias(n)) for x, n in ((old, "was"), (new, "now")))
    odd = a.join(b, [scope, "block"], "full").where(~F.col("was").eqNullSafe(F.col("now")))
    return odd.groupBy(scope).agg(F.min("block").alias("block"))


def brief(chunks: DataFrame, salience: Column, as_of: Column, n: int = 140) -> DataFrame:
    """What a brief shows of a chunk: title, one line, age in days, token estimate (4 characters a token), salience."""
    line = T.first_line(F.col("chunk_text"), n)
    return chunks.select("id", T.title_of(F.col("source_file")).alias("title"), line.alias("line"), F.datediff(as_of, F.col("source_date")).alias("age"), F.ceil(F.length(line) / 4).cast("long").alias("tokens"), salience.alias("salience"))


def novelty(serves: Column, pain: Column) -> Column:
    return F.when(pain >= 0.9, F.lit(0.0)).otherwise(F.least(F.lit(0.15), 0.05 * F.log1p(serves.cast("double"))))


def outcome_boost(severity: Column, weight: float = 1.0) -> Column:
    level = F.when(severity == 1, 0.25).when(severity == 2, 0.5).when(severity == 3, 0.75).when(severity == 4, 1.0).otherwise(0.0)
    return weight * 0.043 * level


def within_budget(rows: DataFrame, by: str, order: list, cost: str, budget: float) -> DataFrame:
    """The longest prefix of each group whose running cost stays within the budget."""
    w = W.partitionBy(by).orderBy(*order)
    run = F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("running", run).where(F.col("running") <= budget)


def through_share(rows: DataFrame, by: str, order: list, cost: str, share: float) -> DataFrame:
    """The prefix of each group up to and with the row that crosses ``share`` of the group's cost."""
    before = F.coalesce(F.sum(cost).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"before": before, "total": F.sum(cost).over(W.partitionBy(by))}).where(F.col("before") < share * F.col("total")).drop("before", "total")


def greedy_fill(costs: list[int], budget: int, full: float = 0.95) -> list[int]:
    """Indices taken in order, skipping what does not fit, until ``full`` of the budget is used; the first, cut, if nothing fits."""
    out, used = [], 0
    for i, c in enumerate(costs):
        if used >= full * budget:
            break
        if used + c <= budget:
            out.append(i)
            used += c
    return out or ([0] if costs else [])


def designated(rows: DataFrame, by: str, seed: str) -> DataFrame:
    """Of each group the id with the least seeded digest."""
    key = F.struct(F.sha2(F.concat_ws("|", F.lit(seed), F.col(by).cast("string"), F.col("id").cast("string")), 256), "id")
    return rows.groupBy(by).agg(F.min_by("id", key).alias("id"))


def churn(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Of two served lists: who enters, who leaves and their Jaccard."""
    a, b = before.groupBy(by).agg(F.collect_set("id").alias("a")), after.groupBy(by).agg(F.collect_set("id").alias("b"))
    none = F.array().cast(before.select(F.collect_set("id")).schema[0].dataType)
    j = a.join(b, by, "full_outer").select(by, F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    union = F.size(F.array_union("a", "b"))
    return j.select(by, F.size(F.array_except("b", "a")).alias("enter"), F.size(F.array_except("a", "b")).alias("leave"), F.round(F.size(F.array_intersect("a", "b")) / F.greatest(union, F.lit(1)), 6).alias("jaccard"))


def attributed(messages: DataFrame, items: DataFrame, least: float = 0.6, common: float = 0.05) -> DataFrame:
    """(msg_id, item_id, share): items at least ``least`` of whose tokens a message has; tokens in over ``common`` of the messages do not count."""
    m = messages.select("msg_id", "grp", F.explode_outer(F.array_distinct(T.tokens(F.col("text")))).alias("t")).where(F.length("t") >= 4)
    n = messages.agg(F.count("*").alias("n_msg"))
    stop = m.groupBy("t").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where(F.col("df") >= common * F.col("n_msg")).select("t")
    it = items.select("item_id", "grp", F.explode_outer(F.array_distinct(T.tokens(F.col("text")))).alias("t")).where(F.length("t") >= 4).join(stop, "t", "left_anti")
    size = it.groupBy("item_id").agg(F.count("*").alias("size")).where("size >= 3")
    hit = m.join(it, ["grp", "t"]).groupBy("msg_id", "item_id").agg(F.count("*").alias("same")).join(size, "item_id")
    return hit.withColumn("share", F.col("same") / F.col("size")).where(F.col("share") >= least).select("msg_id", "item_id", F.round("share", 6).alias("share"))
