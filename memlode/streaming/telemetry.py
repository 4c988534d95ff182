"""Structured Streaming forms of the telemetry operators: watermarked windows, idempotent sinks, stateful limits."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W


def file_stream(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """Parquet files as a stream, ``files`` a trigger at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def hourly(events: DataFrame, late: str = "24 hours", width: str = "1 hour") -> DataFrame:
    """Count, sum and approximate percentiles by feature and hour.  Rows later than ``late`` behind the
    newest are dropped; in update mode a late row within it revises its hour."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "feature")
    out = w.agg(F.count("*").alias("n"), F.sum("latency_ms").alias("total"), F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], 10000).alias("p"))
    return out.select(F.col("w.start").alias("hour"), "feature", "n", "total", *[F.get("p", F.lit(i)).alias(k) for i, k in enumerate(("p50", "p95", "p99"))])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "24 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str = "id", late: str = "24 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def capture(events: DataFrame, sources: list[str]) -> DataFrame:
    """The stateless part of the capture pipeline, in order, with the decision of each event in ``decision``."""
    text = F.regexp_replace("content", "(?is)<private>.*?</private>", "[private]")
    short = F.length(F.trim(text)) < 3
    d = F.when(F.coalesce(F.array_contains("decorators", "skip"), F.lit(False)), "skipped").when(~F.col("source").isin(*sources), "source").when(short, "empty").otherwise("pass")
    return events.withColumns({"content": text, "decision": d})


def trigram_cosine(a: Counter, b: Counter) -> float:
    dot = sum(n * b[g] for g, n in a.items())
    size = sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
    return dot / size if size else 0.0


def _grams(text: str) -> Counter:
    return Counter(text[i : i + 3] for i in range(len(text) - 2))


def admit(rows: list[tuple], tokens: float, last: float | None, ring: list[str], rate: float = 30.0, similar: float = 0.95, memory: int = 10):
    """Decisions for one key's rows (ts seconds, content), in time order: near-duplicates of the last
    ``memory`` admitted texts go before the token bucket (rate a minute, continuous refill) is asked.

    Returns the decisions and the new (tokens, last, ring).
    """
    out = []
    for ts, content in rows:
        if last is not None:
            tokens = min(rate, tokens + max(0.0, ts - last) * rate / 60)
        last = ts if last is None else max(last, ts)
        g = _grams(content)
        if any(trigram_cosine(g, _grams(r)) > similar for r in ring):
            out.append("duplicate")
        elif tokens < 1:
            out.append("limited")
        else:
            tokens -= 1
            ring = (ring + [content])[-memory:]
            out.append("pass")
    return out, tokens, last, ring


LIMITED = "key string, id long, ts timestamp, decision string"


class Limiter(StatefulProcessor):
    """admit() as a stateful operator: one bucket and ring of texts for each key.  Rows are ordered by
    time within a micro-batch; across batches they are taken as they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("limit", "tokens double, last double, ring array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["ts", "id"])
        tokens, last, ring = self.state.get() if self.state.exists() else (30.0, None, [])
        secs = own["ts"].astype("int64") // 1000 / 1e6 if str(own["ts"].dtype) == "datetime64[ns]" else own["ts"].map(lambda t: t.timestamp())
        got, tokens, last, ring = admit(list(zip(secs, own["content"])), tokens, last, list(ring))
        self.state.update((tokens, last, ring))
        yield pd.DataFrame({"key": key[0], "id": own["id"].to_numpy(), "ts": own["ts"].to_numpy(), "decision": got})

    def close(self) -> None:
        pass


def limited(events: DataFrame) -> DataFrame:
    """Stream of decisions for events (key, id, ts, content); needs the RocksDB state store."""
    return events.groupBy("key").transformWithStateInPandas(Limiter(), LIMITED, "append", "none")


def limited_batch(events: DataFrame) -> DataFrame:
    """The batch twin of limited(): the whole history of a key in time order."""
    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["ts", "id"])
        got = admit([(t.timestamp(), c) for t, c in zip(own["ts"], own["content"])], 30.0, None, [])[0]
        return pd.DataFrame({"key": own["key"], "id": own["id"], "ts": own["ts"], "decision": got})

    return events.groupBy("key").applyInPandas(run, LIMITED)


def idempotent_sink(path: str, limit: int | None = None):
    """A foreachBatch function that writes each micro-batch to its own folder: a retried batch replaces itself.
    With ``limit``, only the newest rows of a batch by ts are kept, as a bounded broadcast would."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if limit is not None:
            batch = batch.withColumn("n_", F.row_number().over(W.orderBy(F.desc("ts"), F.desc("id")))).where(F.col("n_") <= limit).drop("n_")
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def replay(spark: SparkSession, path: str, after: int) -> DataFrame:
    """What a reconnecting client missed: rows with ids beyond the last it saw."""
    return spark.read.parquet(path).where(F.col("id") > after).orderBy("id")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", sink=None) -> None:
    """Runs a stream over all that is there now and stops; the checkpoint holds the cursor."""
    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    (q.foreachBatch(sink) if sink else q.format("parquet").option("path", path)).start().awaitTermination()
