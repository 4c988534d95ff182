"""Temporal filters, intent and reranking, and other filters on chunks and hits."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memlode.functions.text import escape_like

#: Month names (English, Portuguese) and the words that make a question temporal.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "janeiro": 1, "fevereiro": 2, "março": 3, "marco": 3, "abril": 4, "maio": 5, "junho": 6, "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
ADVERBS = "quando|que\\s+dia|que\\s+data|qual\\s+data|qual\\s+dia|em\\s+que\\s+dia|em\\s+que\\s+data|primeir[ao]|últim[ao]|inicial|deploy|deployado|deployed|deployamento|ativad[ao]|subiu|lançad[ao]|started|aconteceu|iniciou|iniciado|when|before|after|during"
UNITS = {"m": 60, "h": 3600, "d": 86400, "w": 604800}


def parse_date(value: str, now: datetime) -> datetime:
    """ISO time, a date (midnight UTC) or an age such as 15m, 2h, 7d, 1w before ``now``; else ValueError."""
    value = value.strip()
    if m := re.fullmatch(r"(\d+)([mhdw])", value):
        return now - timedelta(seconds=int(m[1]) * UNITS[m[2]])
    if not re.match(r"\d{4}-\d{2}-\d{2}", value):
        raise ValueError(f"not a date: {value!r}")
    out = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return out if out.tzinfo else out.replace(tzinfo=UTC)


def as_of(chunks: DataFrame, t: Column) -> DataFrame:
    """Rows that existed at t: created by then (or undated) and not yet deleted."""
    return chunks.where((F.col("created_at").isNull() | (F.col("created_at") <= t)) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > t)))


def changed_since(chunks: DataFrame, t: Column) -> DataFrame:
    return chunks.where((F.col("created_at") > t) | (F.coalesce("updated_at", "created_at") > t))


def fresh(chunks: DataFrame, now: Column, days: int, least: float = 0.7) -> DataFrame:
    age = (F.unix_micros(now) - F.unix_micros("created_at")) / F.lit(86400e6)
    return chunks.where(((F.col("importance") >= least) | (F.col("pain") >= least)) & (age <= days))


def in_scope(chunks: DataFrame, prefixes: list[str], column: str = "source_file") -> DataFrame:
    """Rows whose path starts with one of the prefixes; % and _ in a prefix are literal."""
    return chunks.where(reduce(lambda a, b: a | b, [F.col(column).startswith(p) for p in prefixes], F.lit(False)))


def like_scope(prefixes: list[str]) -> list[str]:
    """The escaped LIKE patterns of the prefixes, for SQL stores."""
    return [escape_like(p) + "%" for p in prefixes]


def confidence_filter(chunks: DataFrame, least: float, exclude_null: bool = False, superseded: bool = False, refuted: bool = False) -> DataFrame:
    """Confidence (null: 0.8) at least ``least``; superseded and refuted rows only if asked for."""
    c = F.coalesce("confidence", F.lit(0.8))
    keep = c >= least
    if exclude_null:
        keep = keep & F.col("confidence").isNotNull()
    if not superseded:
        keep = keep & F.col("superseded_by").isNull()
    if not refuted:
        keep = keep & ~((F.coalesce("provenance_kind", F.lit("")) == "user-marked") & (c < 0.3))
    return chunks.where(keep)


def intent(queries: DataFrame, now: Column) -> DataFrame:
    """Adds signal (iso_date, month_year, adverbial, year or null), range_start and range_end, in that order of strength."""
    q = F.col("text")
    edge = "(?=\\s|[.,?!]|$)"
    names = "|".join(sorted(MONTHS, key=lambda n: (-len(n), n)))
    iso = F.try_to_timestamp(F.nullif(F.regexp_extract(q, "\\b(\\d{4}-\\d{2}-\\d{2})\\b", 1), F.lit(""))).cast("date")
    pattern = f"(?iu)(?:^|\\s)({names})(?:\\s+(?:de\\s+|of\\s+)?(\\d{{4}}))?{edge}"
    name, year = F.lower(F.regexp_extract(q, pattern, 1)), F.regexp_extract(q, pattern, 2)
    month = F.element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), F.nullif(name, F.lit("")))
    own = F.when(year != "", year.cast("int"))
    mid = F.make_date(F.year(now), month, F.lit(15))
    own = F.coalesce(own, F.when(mid.cast("timestamp") > now, F.year(now) - 1).otherwise(F.year(now)))
    first = F.make_date(own, month, F.lit(1))
    bare = F.nullif(F.regexp_extract(q, f"(?:^|\\s)(20\\d{{2}}){edge}", 1), F.lit("")).cast("int")
    adverb = q.rlike(f"(?iu)(?:^|\\s)(?:{ADVERBS}){edge}")
    signal = F.when(iso.isNotNull(), "iso_date").when(month.isNotNull(), "month_year").when(adverb, "adverbial").when(bare.isNotNull(), "year")
    out = queries.withColumns({"signal": F.when(F.length(q) >= 3, signal), "i": iso, "f": first, "y": bare})
    pick = lambda a, b, c: F.when(F.col("signal") == "iso_date", a).when(F.col("signal") == "month_year", b).when(F.col("signal") == "year", c)
    out = out.withColumn("range_start", pick(F.col("i"), F.col("f"), F.make_date("y", F.lit(1), F.lit(1))))
    return out.withColumn("range_end", pick(F.col("i"), F.last_day("f"), F.make_date("y", F.lit(12), F.lit(31)))).drop("i", "f", "y")


def proximity(date: Column, anchor: Column, sigma: float = 30.0) -> Column:
    days = F.datediff(date, anchor).cast("double")
    return F.coalesce(0.5 * F.exp(-days * days / (2 * sigma * sigma)), F.lit(0.0))


def rerank(hits: DataFrame, k: int = 20, sigma: float = 30.0, weight: float = 10.0) -> DataFrame:
    """The first k hits of each query gain by nearness of source_date to anchor and are ranked anew; the tail stays."""
    head = F.col("rank") <= k
    out = hits.withColumn("score", F.when(head, F.col("score") + weight * proximity(F.col("source_date"), F.col("anchor"), sigma)).otherwise(F.col("score")))
    w = W.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.desc_nulls_last(F.when(head, F.round("score", 6))), "rank")
    return out.withColumn("new", F.row_number().over(w)).drop("rank").withColumnRenamed("new", "rank")


def inferred_anchor(hits: DataFrame, k: int = 5, floor: float = 0.1) -> DataFrame:
    """(query_id, anchor, gap): upper median date of the first k hits and the gap of the first two scores, at least ``floor``."""
    top = hits.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.sort_array(F.collect_list("source_date")).alias("ds"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b")
    )
    gap = F.greatest(F.lit(floor), F.col("a") - F.coalesce("b", F.lit(0.0)))
    return top.select("query_id", F.get("ds", F.floor(F.size("ds") / 2).cast("int")).alias("anchor"), F.round(gap, 6).alias("gap"))


def gap_bump(score: Column, gap: Column, near: Column, confidence: Column) -> Column:
    """The second rerank: the bump is scaled by the query's score gap and the anchor's confidence."""
    return score + gap * near * 2 * confidence


def focus(hits: DataFrame, topic: list[str]) -> DataFrame:
    """Scores rise by 1.4 where at least half of the topic's terms occur and fall to 0.75 where none does."""
    n = reduce(lambda a, b: a + b, [F.contains(F.lower("chunk_text"), F.lit(t.lower())).cast("int") for t in topic])
    return hits.withColumn("score", F.col("score") * F.when(2 * n >= len(topic), 1.4).when(n == 0, 0.75).otherwise(1.0))


def reason_boost(hits: DataFrame, reasons: DataFrame, weights: dict[str, float], cap: float = 0.3) -> DataFrame:
    """Adds the weights of the reasons (id, reason) that point at a hit, at most ``cap``."""
    pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    own = reasons.groupBy("id").agg(F.least(F.lit(cap), F.sum(F.coalesce(F.element_at(pairs, F.col("reason")), F.lit(0.0)))).alias("plus"))
    return hits.join(own, "id", "left").withColumn("score", F.col("score") * (1 + F.coalesce("plus", F.lit(0.0)))).drop("plus")


def answer_context(hits: DataFrame, k: int = 8) -> DataFrame:
    """Up to k hits with distinct text, best first, with markers chunk_1 ... chunk_k."""
    first = F.row_number().over(W.partitionBy("query_id", F.sha2("chunk_text", 256)).orderBy("rank"))
    own = hits.withColumn("n", first).where("n = 1").withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("n") <= k)
    return own.withColumn("marker", F.concat(F.lit("chunk_"), F.col("n").cast("string"))).drop("n")


def citations(answer: Column, known: Column) -> Column:
    """struct(cited, unknown): markers cited as [chunk_n], each once, and those that ``known`` lacks."""
    found = F.array_distinct(F.regexp_extract_all(answer, F.lit("\\[(chunk_\\d+)\\]"), F.lit(1)))
    return F.struct(F.array_intersect(found, known).alias("cited"), F.array_except(found, known).alias("unknown"))
