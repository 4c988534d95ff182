"""The capture pipeline as one stream: layers of decisions, a stateful gate, two outputs.

Layers without state are columns; the first that objects decides.  Rows that no layer rejects come to
the gate of their key, which holds a token bucket and the last texts it let through.  Every event
leaves one decision row; what is captured also leaves its redacted text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memlode.operators import privacy, textual
from memlode.session import drop_path
from memlode.streaming.telemetry import trigram_cosine

#: Layers and the reasons they reject with, in the order in which they are asked.
REJECTIONS = {
    "decorator": "explicit_skip",
    "env-gate": "env_disabled",
    "source-allowlist": "source_not_allowed",
    "privacy-filter": "pii_detected_skip",
    "classifier": "classifier_low_signal",
    "rate-limit": "rate_limited",
    "persistence": "dry_run",
}
DUPLICATE, KEPT, KEPT_LAYER = "dedup_hit", "ok", "persisted"
LOW_SIGNAL = 0.4
#: Lines at the head of a text in which a decorator counts.
HEAD_LINES = 4
DECIDED = "key string, id long, us long, captured boolean, reason string, layer string, redactions int, text string"


@dataclass(frozen=True)
class Rules:
    """What the pipeline is told: none of it is read from the environment."""

    enabled: bool = True
    sources: tuple[str, ...] = ("chat",)
    roles: tuple[str, ...] = ("user", "assistant")
    drop_private: bool = False
    min_length: int = 20
    rate: float = 30.0
    similar: float = 0.95
    memory: int = 10
    dry_run: bool = False
    mark: str = "@memo:"


def decorator(content: Column, mark: str, kind: str) -> Column:
    """Whether a comment at the head of a text says ``kind``."""
    head = F.array_join(F.slice(F.split(F.coalesce(content, F.lit("")), "\n"), 1, HEAD_LINES), "\n")
    return head.rlike(f"(?i)(^|\\s)(?://|#|<!--|/\\*)\\s*\\Q{mark}\\E{kind}\\b")


def layered(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """events (key, id, ts, source, role, content) with the redacted text, the number of redactions and, where a
    layer without state objects, its name in ``layer``.  A 'capture' decorator goes past the classifier only.
    Null content counts as empty; a null source or role is not allowed."""
    content = F.coalesce("content", F.lit(""))
    counts = textual.secret_counts(content)
    rows = events.select(
        F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.unix_micros("ts").alias("us"), "source", "role",
        textual.redact(content).alias("text"), F.aggregate(F.map_values(counts), F.lit(0), lambda a, n: a + n.cast("int")).alias("redactions"),
        decorator(content, rules.mark, "skip").alias("skip"), decorator(content, rules.mark, "capture").alias("wanted"),
    )
    allowed = F.coalesce((F.col("source") != "unknown") & F.col("source").isin(*rules.sources) & F.col("role").isin(*rules.roles), F.lit(False))
    layer = F.when(F.col("skip"), "decorator").when(F.lit(not rules.enabled), "env-gate").when(~allowed, "source-allowlist")
    layer = layer.when(F.lit(rules.drop_private) & (F.col("redactions") > 0), "privacy-filter")
    layer = layer.when(~F.col("wanted") & (privacy.signal_score(F.col("text"), rules.min_length) < LOW_SIGNAL), "classifier")
    return rows.select("key", "id", "us", "text", F.when(F.col("skip") | F.lit(not rules.enabled) | ~allowed, 0).otherwise(F.col("redactions")).alias("redactions"), layer.alias("layer"))


def _grams(text: str) -> Counter:
    return Counter(text[i : i + 3] for i in range(max(1, len(text) - 2))) if text else Counter()


def gate(rows: list[tuple[int, str]], tokens: float, last: int | None, ring: list[str], rules: Rules) -> tuple[list[str], float, int | None, list[str]]:
    """Outcomes of one key's rows (microseconds, text) in order, and the new state.

    The bucket refills continuously; a text too like one of the last let through costs no token.
    """
    out = []
    known = [(t, _grams(t)) for t in ring]
    for us, text in rows:
        if last is not None:
            tokens = min(rules.rate, tokens + max(0, us - last) * rules.rate / 60e6)
        last = us if last is None else max(last, us)
        g = _grams(text)
        if any((t == text and bool(t)) or trigram_cosine(g, h) > rules.similar for t, h in known):
            out.append(DUPLICATE)
        elif tokens < 1:
            out.append(REJECTIONS["rate-limit"])
        else:
            tokens -= 1
            known = [*known, (text, g)][-rules.memory :]
            out.append(REJECTIONS["persistence"] if rules.dry_run else KEPT)
    return out, tokens, last, [t for t, _ in known]


def _decide(own: pd.DataFrame, tokens: float, last: int | None, ring: list[str], rules: Rules) -> tuple[pd.DataFrame, float, int | None, list[str]]:
    own = own.sort_values(["us", "id"], kind="stable")
    open_ = own["layer"].isna().to_numpy()
    got, tokens, last, ring = gate(list(zip(own["us"][open_].tolist(), own["text"][open_].tolist())), tokens, last, ring, rules)
    reason = own["layer"].map(REJECTIONS).astype(object)
    layer = own["layer"].astype(object)
    reason[open_] = got
    layer[open_] = [{KEPT: KEPT_LAYER, REJECTIONS["persistence"]: "persistence"}.get(r, "rate-limit") for r in got]
    kept = reason == KEPT
    out = pd.DataFrame({"key": own["key"], "id": own["id"], "us": own["us"], "captured": kept, "reason": reason, "layer": layer, "redactions": own["redactions"], "text": own["text"].where(kept, None)})
    return out, tokens, last, ring


class Gate(StatefulProcessor):
    """gate() for each key.  Rows stand by time within a micro-batch; batches are taken as they come."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", "tokens double, last long, ring array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tokens, last, ring = self.state.get() if self.state.exists() else (self.rules.rate, None, [])
        out, tokens, last, ring = _decide(pd.concat(list(rows)), tokens, last, list(ring), self.rules)
        self.state.update((tokens, last, ring))
        yield out

    def close(self) -> None:
        pass


def captured(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The stream of DECIDED rows; needs the RocksDB state store."""
    return layered(events, rules).groupBy("key").transformWithStateInPandas(Gate(rules), DECIDED, "append", "none")


def captured_batch(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The batch twin of captured(): a key's rows in time order."""
    def run(own: pd.DataFrame) -> pd.DataFrame:
        return _decide(own, rules.rate, None, [], rules)[0]

    return layered(events, rules).groupBy("key").applyInPandas(run, DECIDED)


def two_outputs(spark: SparkSession, path: str):
    """A foreachBatch function: captured texts in ``path``/kept, one decision an event in ``path``/decisions.

    A micro-batch is written once, and both outputs are made from what was written, so the gate is not
    run twice; a retried batch replaces its own folders.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        whole = f"{path}/whole/batch={batch_id}"
        batch.write.mode("overwrite").parquet(whole)
        back = spark.read.schema(batch.schema).parquet(whole)
        when = F.timestamp_micros("us").alias("ts")
        back.where("captured").select("key", "id", when, "text", "redactions").write.mode("overwrite").parquet(f"{path}/kept/batch={batch_id}")
        back.select("key", "id", when, "captured", "reason", "layer", "redactions").write.mode("overwrite").parquet(f"{path}/decisions/batch={batch_id}")
        drop_path(spark, whole)

    return write
