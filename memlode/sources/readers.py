"""Readers and sinks: files by walk, JSON lines, CSV, graphs, evaluation summaries, logs, posts, snapshots, reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from memlode.operators.textual import html_text

GRAPH = "nodes array<struct<id:string,label:string,file_type:string,source_file:string,author:string,community:int>>, links array<struct<source:string,target:string,relation:string,confidence_score:double>>, edges array<struct<source:string,target:string,relation:string,confidence_score:double>>"
METRICS = ("ndcg_at_10", "mrr", "recall_at_10", "precision_at_5", "mean_latency_ms", "p95_latency_ms", "n_queries")
SUMMARY = "struct<label:string," + ",".join(f"{m}:double" for m in METRICS) + ">"


def walk(spark: SparkSession, path: str, pattern: str = "*.{md,json}", skip: tuple[str, ...] = ("node_modules", ".git")) -> DataFrame:
    """(path, text, modified) of all files below ``path`` that match; folders named in ``skip`` are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    inside = "/(" + "|".join(re.escape(s) for s in skip) + ")/"
    return files.where(~F.col("path").rlike(inside)).select("path", F.decode("content", "utf-8").alias("text"), F.col("modificationTime").alias("modified"))


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines by schema; broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def csv_metrics(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def graph_chunks(spark: SparkSession, path: str, repo: str, most: int = 8) -> DataFrame:
    """A chunk for each node of graph files (nodes, and links or edges) with up to ``most`` outgoing neighbours, by id."""
    g = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    nodes = g.select(F.explode("nodes").alias("n")).select("n.*").dropDuplicates(["id"])
    edges = g.select(F.posexplode(F.coalesce("links", "edges")).alias("pos", "e")).select("pos", "e.*")
    names = nodes.select(F.col("id").alias("target"), F.col("label").alias("name"))
    own = edges.join(names, "target", "left").withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("pos", "target"))).where(F.col("k") <= most)
    shown = F.concat(F.col("relation"), F.lit(" → "), F.coalesce("name", "target"))
    near = own.groupBy(F.col("source").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", shown.alias("s")))), lambda x: x.s), "; ").alias("near"))
    parts = [F.col("label"), F.concat(F.lit("Type: "), "file_type"), F.concat(F.lit("Source: "), "source_file"), F.concat(F.lit("Links: "), "near")]
    return nodes.join(near, "id", "left").select(
        F.concat(F.lit(f"graph:{repo}:"), "id").alias("source_file"), F.concat_ws("\n", *parts).alias("chunk_text"),
        F.lit("graph_node").alias("chunk_type"), F.lit("external").alias("source_type"), F.to_json(F.struct("id", "community", "file_type", "author")).alias("metadata"),
    )


def replace_prefix(store: DataFrame, fresh: DataFrame, prefix: str) -> DataFrame:
    """The store with all rows of a path prefix replaced by fresh ones."""
    return store.where(~F.col("source_file").startswith(prefix)).unionByName(fresh, allowMissingColumns=True)


def eval_summaries(spark: SparkSession, path: str) -> DataFrame:
    """A row for each configuration of evaluation files under data-<gate> folders, in either shape
    ({"aggregate": {name: summary}} or {"summary": summary}); other shapes and broken files give none."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("ran_at"), F.col("value"))
    many = F.from_json(F.get_json_object("value", "$.aggregate"), f"map<string,{SUMMARY}>")
    single = F.from_json(F.get_json_object("value", "$.summary"), SUMMARY)
    a = raw.where(many.isNotNull()).select("file", "ran_at", F.explode(many).alias("config", "s"))
    b = raw.where(many.isNull() & single.isNotNull()).select("file", "ran_at", F.lit(None).cast("string").alias("config"), single.alias("s"))
    rows = a.unionByName(b)
    name = F.concat_ws("::", F.coalesce("s.label", F.lit("unknown")), "config")
    return rows.select(F.concat_ws("::", F.regexp_extract("file", "/data-([^/]+)/", 1), name).alias("run_id"), name.alias("config_id"), *[F.col(f"s.{m}").alias(m) for m in METRICS], "ran_at", "file")


def log_tail(spark: SparkSession, path: str, n: int = 3) -> DataFrame:
    """The last n (1 to 20) non-empty lines with their timestamp, if any, and whether they report success."""
    # by file, by the block of the file that a task reads, and within the task by line
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(at.alias("at"), F.col("value").alias("raw")).where(F.trim("raw") != "")
    last = lines.orderBy(F.desc("at")).limit(max(1, min(20, n)))
    ts = F.nullif(F.regexp_extract("raw", "^\\[?(\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}(?:Z|[+-]\\d{2}:?\\d{2})?)\\]?", 1), F.lit(""))
    ok = F.col("raw").rlike("(?i)\\b(OK|PASS|all .* invariants OK)\\b|✓") & ~F.col("raw").rlike("(?i)\\b(FAIL|ERROR)\\b|✗")
    return last.select("at", F.trim("raw").alias("raw"), ts.alias("timestamp"), ok.alias("ok")).orderBy("at").drop("at")


def posts(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a posts dump (XML rows) with their title, stripped body and answers by score."""
    schema = "_Id long, _PostTypeId int, _ParentId long, _Score int, _Title string, _Body string, _Tags string"
    rows = spark.read.format("xml").option("rowTag", "row").schema(schema).load(path)
    text = html_text(F.col("_Body"))
    q = rows.where("_PostTypeId = 1").select(F.col("_Id").alias("id"), F.col("_Title").alias("title"), text.alias("body"))
    a = rows.where("_PostTypeId = 2").groupBy(F.col("_ParentId").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("_Score")).alias("k"), F.col("_Id").alias("i"), text.alias("t")))).alias("a"))
    return q.join(a, "id", "left").select("id", "title", "body", F.transform(F.coalesce("a", F.array().cast("array<struct<k:int,i:bigint,t:string>>")), lambda x: x.t).alias("answers"))


def snapshots_to_drop(names: list[str], keep: int = 7) -> list[str]:
    """Of dated snapshot folders (...-YYYY-MM-DD) those beyond the newest ``keep``."""
    dated = sorted((m[0], n) for n in names if (m := re.search(r"\d{4}-\d{2}-\d{2}", n)))
    return [n for _, n in dated[:-keep]] if keep else [n for _, n in dated]


def write_snapshot(df: DataFrame, root: str, day: str) -> str:
    """A versioned full copy; a snapshot of the same day is replaced."""
    path = f"{root}/snapshot-{day}"
    df.write.mode("overwrite").parquet(path)
    return path


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A report of a small table: the first ``most`` rows as they stand."""
    rows = df.limit(most).collect()
    cells = lambda r: "| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |"
    return "\n".join([f"## {title}", "", cells(df.columns), "|" + "---|" * len(df.columns), *map(cells, rows), ""])


