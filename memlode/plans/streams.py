"""Streaming queries, run to the end of what is there and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlode.plans.base import Registry, telemetry
from memlode.session import Scratch, drop_path, table
from memlode.streaming import capture as C
from memlode.streaming import keyed as K
from memlode.streaming import telemetry as S

R = Registry()
query = R.query


def streamed(spark, df, make, mode="append", sink=False):
    """Writes ``df`` as a file source, streams it through ``make`` and returns what the sink holds."""
    root = Scratch(spark).place()
    df.write.parquet(f"{root}/in")
    S.run_available(make(S.file_stream(spark, f"{root}/in", df.schema)), f"{root}/out", f"{root}/cp", mode, S.idempotent_sink(f"{root}/out") if sink else None)
    out = spark.read.parquet(f"{root}/out")
    drop_path(spark, f"{root}/in")
    return out


def events(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return t.withColumn("ts", F.col("ts").cast("timestamp")).select("id", "ts", "feature", "user_id", "latency_ms")


@query("SELECT date_trunc('hour', ts) AS hour, feature, count(*) AS n, round(sum(latency_ms), 4) AS total FROM @telemetry GROUP BY 1, 2")
def stream_hourly(spark, sf_dir):
    """Hourly buckets in complete mode through an idempotent sink."""
    out = streamed(spark, events(spark, sf_dir), S.hourly, "complete", sink=True)
    last = out.agg(F.max("batch").alias("b"))
    return out.join(F.broadcast(last), F.col("batch") == F.col("b")).select("hour", "feature", "n", F.round("total", 4).alias("total"))


@query("SELECT id, feature FROM @telemetry")
def stream_deduplicated(spark, sf_dir):
    """Each id once although the source holds every row twice."""
    e = events(spark, sf_dir)
    return streamed(spark, e.union(e), S.deduplicated).select("id", "feature")


@query("""SELECT conv_id * 100 + turn AS id, CASE WHEN role NOT IN ('user', 'assistant') THEN 'source' WHEN length(trim(text)) < 3 THEN 'empty' ELSE 'pass' END AS decision FROM conversations""")
def stream_capture(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    e = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("content"), F.col("role").alias("source"), F.array().cast("array<string>").alias("decorators"))
    return streamed(spark, e, lambda s: S.capture(s, ["user", "assistant"])).select("id", "decision")


@query()
def rate_limited(spark, sf_dir):
    """Token bucket and near-duplicate ring for each user, as the batch twin of the stateful stream."""
    e = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "id", "ts", F.concat_ws(" ", "feature", F.col("latency_ms").cast("string")).alias("content"))
    return S.limited_batch(e)


def kept_state(spark, df, make, mode, sink):
    """streamed() with the state store that lists in the state need, through a sink of its own."""
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    root = Scratch(spark).place()
    spark.conf.set(key, store)
    try:
        df.write.parquet(f"{root}/in")
        S.run_available(make(S.file_stream(spark, f"{root}/in", df.schema)), f"{root}/out", f"{root}/cp", mode, sink(f"{root}/out"))
    finally:
        spark.conf.set(key, before)
    drop_path(spark, f"{root}/in")
    return f"{root}/out"


@query("SELECT feature, id, ts, CAST(row_number() OVER (PARTITION BY feature ORDER BY ts DESC, id DESC) AS INTEGER) AS place FROM @telemetry QUALIFY place <= 10")
def stream_last_runs(spark, sf_dir):
    """The last ten runs of each feature, kept as lists in the state of a stream."""
    out = kept_state(spark, events(spark, sf_dir).select("feature", "id", "ts"), K.last_runs, "update", S.idempotent_sink)
    return K.newest_lists(spark.read.parquet(out))


@query("""WITH r AS (SELECT CAST(user_id AS VARCHAR) AS client, id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM @telemetry)
SELECT client, id, CASE WHEN n <= 4 THEN 'delivered' ELSE 'dropped' END AS outcome, greatest(total - 4, 0) AS lost FROM r""")
def stream_client_queues(spark, sf_dir):
    """A queue of four for each client that reads once, at the end: older events are dropped."""
    e = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("client"), "id", "ts", F.lit(0).alias("read"))
    ends = e.groupBy("client").agg(F.lit(-1).cast("long").alias("id"), (F.max("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"), F.lit(4).alias("read"))
    out = spark.read.parquet(kept_state(spark, e.union(ends).coalesce(32), lambda s: K.client_queues(s, 4), "append", S.idempotent_sink))
    lost = out.groupBy(F.col("client").alias("c_")).agg(F.max("dropped").alias("lost"))
    return out.join(lost, F.col("client") == F.col("c_")).select("client", "id", "outcome", "lost")


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS id, role, text, length(text) AS n FROM conversations),
f AS (SELECT *, CASE WHEN role NOT IN ('user', 'assistant') THEN 'source_not_allowed' WHEN n < 20 THEN 'classifier_low_signal' ELSE 'ok' END AS reason FROM c)
SELECT id, reason, CASE reason WHEN 'source_not_allowed' THEN 'source-allowlist' WHEN 'classifier_low_signal' THEN 'classifier' ELSE 'persisted' END AS layer, reason = 'ok' AS captured, CASE WHEN reason = 'ok' THEN sha256(text) END AS text_sha256 FROM f""")
def stream_capture_decisions(spark, sf_dir):
    """The whole capture pipeline over all turns: a decision each, and the texts kept."""
    c = table(spark, sf_dir, "conversations")
    when = F.timestamp_micros(F.lit(1704067200000000) + F.coalesce("turn", F.lit(0)) * 60000000)
    e = c.select(F.col("conv_id").cast("string").alias("key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), when.alias("ts"), F.lit("chat").alias("source"), "role", F.col("text").alias("content"))
    out = kept_state(spark, e, C.captured, "append", lambda path: C.two_outputs(spark, path))
    kept = spark.read.parquet(f"{out}/kept").select(F.col("id").alias("k_"), F.sha2("text", 256).alias("text_sha256"))
    return spark.read.parquet(f"{out}/decisions").join(kept, F.col("id") == F.col("k_"), "left").select("id", "reason", "layer", "captured", "text_sha256")
