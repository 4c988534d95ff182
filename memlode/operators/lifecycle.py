"""What happens to stored rows over time: compaction, reindexing, imports, sealed bundles, and the series, events and reports about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memlode.functions import text as T
from memlode.operators.maintenance import retention_guard

# --- rewrites --------------------------------------------------------------------------------------


def compact(chunks: DataFrame, least: int = 3, lines: int = 20, summary: Column | None = None) -> DataFrame:
    """The store with every group of ``least`` or more rows of a file and type replaced by one row: the least id, the
    newest date and a summary text.  Other rows, and other columns of the row that stays, are as they were.

    The default summary lists the first ``lines`` rows by id, a line each; ``summary`` may be any
    column over these (array ``lines_``), so a group gathers no more than that.
    """
    keys = ["source_file", "chunk_type"]
    sizes = chunks.groupBy(*keys).agg(F.count("*").alias("n_"), F.min("id").alias("low_"), F.max("source_date").alias("newest_")).where(F.col("n_") >= least)
    named = sizes.select(*[F.col(k).alias(f"{k}_") for k in keys], "n_", "low_", "newest_")
    same = (F.col("source_file").eqNullSafe(F.col("source_file_"))) & (F.col("chunk_type").eqNullSafe(F.col("chunk_type_")))
    group = chunks.join(named, same)
    first = group.withColumn("k_", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).where(F.col("k_") <= lines)
    texts = first.groupBy(F.col("low_").alias("of_")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k_", T.first_line(F.col("chunk_text")).alias("l")))), lambda s: s.l).alias("lines_"))
    text = summary if summary is not None else F.concat_ws("\n", F.concat(F.lit("["), F.col("n_").cast("string"), F.lit(" rows]")), "lines_")
    made = group.where(F.col("id") == F.col("low_")).join(texts, F.col("id") == F.col("of_"))
    made = made.withColumns({"chunk_text": text, "source_date": F.col("newest_")}).select(*chunks.columns)
    return chunks.join(named, same, "left_anti").unionByName(made)


def reindexed(store: DataFrame, fresh: DataFrame, fingerprint: str = "fp", least: float = 0.9) -> DataFrame:
    """The store after a reindex: files whose fingerprint is the same keep their rows, changed and new files have the
    fresh ones, vanished files none.  Raises if that keeps less than its share of rows."""
    files = lambda d, n: d.select(F.col("source_file").alias(n), F.col(fingerprint).alias(f"{n}_fp")).distinct()
    same = files(store, "a").join(files(fresh, "b"), (F.col("a") == F.col("b")) & F.col("a_fp").eqNullSafe(F.col("b_fp"))).select(F.col("a").alias("source_file"))
    out = store.join(same, "source_file", "left_semi").unionByName(fresh.join(same, "source_file", "left_anti"), allowMissingColumns=True)
    retention_guard(store.count(), out.count(), least)
    return out


def import_report(store: DataFrame, incoming: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key..., outcome, differs): what an import would do with each incoming row, without doing it: ``new``, ``same``, or
    ``conflict`` with the columns that differ."""
    old = store.select(*key, F.struct(*columns).alias("old_")).dropDuplicates(key)
    both = incoming.select(*key, F.struct(*columns).alias("new_")).dropDuplicates(key).join(old, key, "left")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"old_.{c}").eqNullSafe(F.col(f"new_.{c}")), F.lit(c)) for c in columns]))
    outcome = F.when(F.col("old_").isNull(), "new").when(F.size(differs) > 0, "conflict").otherwise("same")
    return both.select(*key, outcome.alias("outcome"), F.when(outcome == "conflict", differs).alias("differs"))


def imported(store: DataFrame, incoming: DataFrame, key: list[str], replace: bool = False) -> DataFrame:
    """The store after an import: new rows come in; where a key is known the store's row stays, or goes if ``replace``."""
    incoming = incoming.dropDuplicates(key)
    if replace:
        return store.join(incoming.select(*key), key, "left_anti").unionByName(incoming)
    return store.unionByName(incoming.join(store.select(*key), key, "left_anti"))


def sealed(rows: DataFrame, key: bytes, label: str) -> DataFrame:
    """Rows as (label, sealed): each as JSON under AES-GCM with the label as authenticated data.  The 16, 24 or 32
    bytes of the key come from the caller; deriving them is out of scope."""
    whole = F.to_json(F.struct(*rows.columns))
    return rows.select(F.lit(label).alias("label"), F.base64(F.aes_encrypt(whole, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), F.lit(label))).alias("sealed"))


def opened(bundle: DataFrame, key: bytes, label: str, schema: str) -> DataFrame:
    """The rows of a sealed bundle; raises for a wrong key, a changed row or rows under another label."""
    plain = F.aes_decrypt(F.unbase64("sealed"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(label)).cast("string")
    return bundle.select(F.from_json(plain, schema).alias("r")).select("r.*")


# --- reports ---------------------------------------------------------------------------------------


def duplicate_files(rows: DataFrame, text: str, file: str, most: int = 20) -> DataFrame:
    """(file, n, extra): the files with the most rows whose text an earlier row (by id) has, anywhere."""
    first = F.row_number().over(W.partitionBy(F.sha2(text, 256)).orderBy("id"))
    g = rows.select(F.col(file).alias("file"), (first > 1).alias("again")).groupBy("file").agg(F.count("*").alias("n"), F.count(F.when(F.col("again"), 1)).alias("extra"))
    return g.where("extra > 0").orderBy(F.desc("extra"), "file").limit(most)


def provenance_counts(rows: DataFrame, known: tuple[str, ...], kind: str = "provenance_kind", confidence: str = "confidence") -> DataFrame:
    """(kind, n, mean, std): rows of each known kind, others together with none; mean and population deviation of confidence."""
    own = F.when(F.col(kind).isin(*known), F.col(kind))
    return rows.groupBy(own.alias("kind")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean"), F.stddev_pop(confidence).alias("std"))


def recent_costs(calls: DataFrame, now: Column, provider: str, cost: Column, ok: Column, hours: int = 24) -> DataFrame:
    """(provider, usd, calls, success): calls of the last hours, and all of them as provider null; success is 1 without any."""
    own = calls.where(F.unix_micros(F.col("ts").cast("timestamp")) >= F.unix_micros(now) - hours * 3_600_000_000).select(F.col(provider).alias("provider"), cost.alias("c_"), ok.cast("int").alias("ok_"))
    sums = [F.coalesce(F.sum("c_"), F.lit(0.0)).alias("usd"), F.count("*").alias("calls"), F.coalesce(F.avg("ok_"), F.lit(1.0)).alias("success")]
    return own.groupBy("provider").agg(*sums).union(own.agg(*sums).select(F.lit(None).cast("string"), "usd", "calls", "success"))


def step_changes(history: DataFrame, by: str, day: str, value: str, percent: float = 20.0) -> DataFrame:
    """(by, day, previous_day, value, previous, change_pct): days on which a metric moved by more than ``percent`` of the
    day before; no comparison with null or zero."""
    w = W.partitionBy(by).orderBy(day)
    own = history.withColumns({"previous": F.lag(value).over(w), "previous_day": F.lag(day).over(w)})
    own = own.withColumn("change_pct", (F.col(value) - F.col("previous")) / F.abs(F.nullif(F.col("previous"), F.lit(0.0))) * 100)
    return own.where(F.abs("change_pct") > percent).select(by, day, "previous_day", value, "previous", "change_pct")


def guarded_series(points: DataFrame, labels: list[str], allowed: dict[str, list[str]], denied: list[str], most: int) -> DataFrame:
    """The points (metric, ts, labels...) of the series a store admits: labels on the deny-list go, values off a label's
    allow-list become 'other', and of a metric's series the first ``most`` by first appearance stay."""
    kept = [c for c in labels if c not in denied]
    own = points.drop(*denied).withColumns({c: F.when(F.col(c).isin(*allowed[c]) | F.col(c).isNull(), F.col(c)).otherwise("other") for c in kept if allowed.get(c)})
    series = own.groupBy("metric", *kept).agg(F.min("ts").alias("t_")).withColumn("k_", F.row_number().over(W.partitionBy("metric").orderBy("t_", *kept))).where(F.col("k_") <= most)
    names = {c: f"{c}__" for c in ("metric", *kept)}
    same = None
    for c, n in names.items():
        one = F.col(c).eqNullSafe(F.col(n))
        same = one if same is None else same & one
    return own.join(series.select(*[F.col(c).alias(n) for c, n in names.items()]), same, "left_semi")


def profile(entities: DataFrame, now: Column, top: int = 20, projects: int = 15, days: int = 30) -> DataFrame:
    """(part, place, id, name, entity_type): the most mentioned entities, the projects that are not closed, the decisions of
    the last days and the preferences, from entities (id, name, entity_type, mentions, status, last_seen)."""
    seen = F.col("last_seen").cast("timestamp")
    parts = {
        "top": (F.lit(True), top), "projects": ((F.col("entity_type") == "project") & ~F.coalesce(F.col("status").isin("closed", "completed"), F.lit(False)), projects),
        "decisions": ((F.col("entity_type") == "decision") & (F.unix_micros(seen) >= F.unix_micros(now) - days * 86_400_000_000), top), "preferences": (F.col("entity_type") == "preference", top),
    }
    out = None
    for name, (which, most) in parts.items():
        w = W.partitionBy(F.lit(name)).orderBy(F.desc("mentions"), "id")
        own = entities.where(which).orderBy(F.desc("mentions"), "id").limit(most).select(F.lit(name).alias("part"), F.row_number().over(w).alias("place"), "id", "name", "entity_type")
        out = own if out is None else out.unionByName(own)
    return out


# --- events ----------------------------------------------------------------------------------------

#: Kinds of events and the fields of each; a ? marks one that may be missing.
EVENTS = {
    "chunk.created": "chunk_id long, source_file? string, type? string, section? string, token_count? long, ts long",
    "chunk.deleted": "chunk_id long, ts long",
    "kg.entity.created": "entity_id long, name string, entity_type string, ts long",
    "kg.relation.created": "relation_id long, source_entity_id long, target_entity_id long, relation_type string, ts long",
    "search.executed": "query string, result_count long, mode? string, ts long",
    "provider.call": "provider string, op_type string, latency_ms double, cost_usd? double, model? string, token_count? long, ts long",
    "op_audit.started": "op_id long, op_type string, ts long",
    "op_audit.completed": "op_id long, op_type string, status string, duration_ms double, ts long",
    "health.warning": "code string, message string, severity string, context? map<string,string>, ts long",
}


def typed_events(events: DataFrame, kind: str) -> DataFrame:
    """The events (kind, payload as JSON) of one kind with their fields as columns; those that lack a required one are
    left out.  The same on streams."""
    fields = [f.strip().split(" ", 1) for f in EVENTS[kind].split(", ")]
    schema = ", ".join(f"{n.rstrip('?')} {t}" for n, t in fields)
    own = events.where(F.col("kind") == kind).select(F.from_json("payload", schema).alias("p"))
    whole = F.col("p").isNotNull()
    for n, _ in fields:
        if not n.endswith("?"):
            whole = whole & F.col(f"p.{n}").isNotNull()
    return own.where(whole).select("p.*")


# --- selection -------------------------------------------------------------------------------------


def filled_budget(texts: Column, budget: Column, enough: float = 0.95, joiner: str = "\n\n---\n\n") -> Column:
    """Of texts in order of worth, those that fit a budget of characters, joined: one that does not fit is skipped, and
    filling stops at ``enough`` of the budget; if none fits, the first one cut to it."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))

    def step(a, t):
        fits = (a.used < F.lit(enough) * budget) & (a.used + F.length(t) <= budget)
        return F.when(fits, F.struct(F.array_append(a.kept, t).alias("kept"), (a.used + F.length(t)).alias("used"))).otherwise(a)

    return F.aggregate(texts, start, step, lambda a: F.when(F.size(a.kept) > 0, F.array_join(a.kept, joiner)).otherwise(F.left(F.get(texts, F.lit(0)), budget)))


def evidence_scores(got: Column, gold: Column, k: int) -> list[Column]:
    """hit and recall of the gold ids among the first k; 0 without gold."""
    first = F.slice(got, 1, k)
    found = F.size(F.filter(first, lambda x: F.array_contains(gold, x)))
    return [F.when(F.size(gold) > 0, (found > 0).cast("int")).otherwise(0).alias("hit"), F.when(F.size(gold) > 0, found / F.size(F.array_distinct(gold))).otherwise(0.0).alias("recall")]


#: Fields of a leading block and the relation that each states.
FIELD_RELATIONS = {"agent": "is_agent_of", "references": "references", "supersedes": "supersedes", "caused_by": "caused_by", "resolves": "resolves", "decided_by": "decided_by"}


def leading_block(text: Column) -> Column:
    """The leading --- block of a text, after a line break; only that break if there is none."""
    block = F.regexp_extract(text, "^\\uFEFF?---[ \\t]*\\r?\\n([\\s\\S]*?)\\r?\\n---", 1)
    return F.concat(F.lit("\n"), F.regexp_replace(block, "\\r", ""))


def stated(b: Column) -> Column:
    """array<struct<relation, target>>: relations that a leading block states, as a scalar, [a, b] or dashed lines."""
    bare = lambda v: F.regexp_replace(F.trim(v), "^(?:\"([\\s\\S]*)\"|'([\\s\\S]*)')$", "$1$2")
    parts = []
    for name, relation in FIELD_RELATIONS.items():
        line = F.regexp_extract(b, f"\\n[ \\t]*{name}[ \\t]*:[ \\t]*([^\\n]*)", 1)
        dashed = F.regexp_extract(b, f"\\n[ \\t]*{name}[ \\t]*:[ \\t]*((?:\\n[ \\t]*(?:- [^\\n]*)?)+)", 1)
        listed = F.transform(F.filter(F.split(dashed, "\\n"), lambda x: F.trim(x).startswith("- ")), lambda x: F.regexp_replace(x, "^[ \\t]*- ", ""))
        flow = F.regexp_extract(line, "^\\[(.*)\\][ \\t]*$", 1)
        items = F.when(F.trim(line) == "", listed).when(line.rlike("^\\[.*\\][ \\t]*$"), F.split(flow, ",")).otherwise(F.array(line))
        targets = F.filter(F.transform(items, bare), lambda x: F.trim(x) != "")
        parts.append(F.transform(targets, _tagged(relation)))
    return F.concat(*parts)


def stated_relations(rows: DataFrame, text: str = "text") -> DataFrame:
    """(id, relation, target): relations that the leading --- block of a text states."""
    own = rows.select("id", leading_block(F.col(text)).alias("b"))
    return own.select("id", F.explode(stated(F.col("b"))).alias("r")).select("id", "r.relation", "r.target")


def _tagged(relation: str):
    return lambda t: F.struct(F.lit(relation).alias("relation"), F.trim(t).alias("target"))
