"""Queries of identifiers, error messages, viewer events and capture rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlode.operators import privacy as O
from memlode.plans.base import Registry, chunks
from memlode.session import table

R = Registry()
query = R.query


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query()
def national_ids(spark, sf_dir):
    """Twelve kinds of identifiers with offsets, checks and overlap rules: needs match positions, so no SQL; a test
    holds it against plain Python."""
    s = docs(spark, sf_dir).select("id", F.explode(O.identifiers(F.col("text"))).alias("s"))
    return s.select("id", "s.kind", "s.at", "s.till", "s.confidence")


@query()
def national_ids_redacted(spark, sf_dir):
    """The three marker modes; digests of the redacted texts, held against plain Python in a test."""
    d = docs(spark, sf_dir).withColumn("spans", O.identifiers(F.col("text"), 0.5))
    return d.select("id", F.size("spans").alias("n"), *[F.sha2(O.redact_identifiers(F.col("text"), F.col("spans"), m), 256).alias(m) for m in ("default", "preserve", "hash")])


@query()
def identifier_rates(spark, sf_dir):
    return O.identifier_rates(docs(spark, sf_dir)).select("kind", "total", "high", "medium", "low", F.round("rate", 9).alias("rate"))


CNH = "lpad(CAST((c_custkey * 7919 + 12345678901) % 99999999999 AS VARCHAR), 11, '0')"


@query(f"""WITH d AS (SELECT c_custkey AS id, {CNH} AS d FROM customer), s AS (SELECT *, list_sum(list_transform(range(1, 10), lambda i: CAST(d[i] AS INT) * (10 - i))) % 11 AS a, list_sum(list_transform(range(1, 10), lambda i: CAST(d[i] AS INT) * i)) % 11 AS b FROM d),
w AS (SELECT *, CASE WHEN a = 10 THEN 0 ELSE a END AS one, CASE WHEN b = 10 THEN 0 WHEN a = 10 THEN (b + 9) % 11 ELSE b END AS two FROM s)
SELECT id, left(d, 9) || CAST(one AS VARCHAR) || CAST(two AS VARCHAR) AS digits, length(CAST(two AS VARCHAR)) = 1 AND NOT regexp_matches(left(d, 9) || CAST(one AS VARCHAR) || CAST(two AS VARCHAR), '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') AS valid, CAST(one AS VARCHAR) = d[10] AND CAST(two AS VARCHAR) = d[11] AS as_it_is FROM w""")
def driving_licences(spark, sf_dir):
    """Numbers with the right check digits made for them, and as they are."""
    d = F.lpad(((F.col("c_custkey") * 7919 + 12345678901) % 99999999999).cast("string"), 11, "0")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), d.alias("d"))
    a, b = (sum((F.substring("d", i, 1).cast("int") * w(i) for i in range(2, 10)), F.substring("d", 1, 1).cast("int") * w(1)) % 11 for w in (lambda i: 10 - i, lambda i: i))
    c = c.withColumns({"a": a, "b": b}).withColumn("one", F.when(F.col("a") == 10, 0).otherwise(F.col("a"))).withColumn("two", F.when(F.col("b") == 10, 0).when(F.col("a") == 10, (F.col("b") + 9) % 11).otherwise(F.col("b")))
    c = c.withColumn("digits", F.concat(F.substring("d", 1, 9), F.col("one").cast("string"), F.col("two").cast("string")))
    return c.select("id", "digits", O.checked("cnh", F.col("digits")).alias("valid"), O.checked("cnh", F.col("d")).alias("as_it_is"))


@query("""WITH d AS (SELECT c_custkey AS id, lpad(CAST(c_custkey * 104729 % 99999999 AS VARCHAR), 8, '0') || lpad(CAST(c_custkey % 30 AS VARCHAR), 2, '0') AS d FROM customer), s AS (SELECT *, c.d[9:10]::INT AS uf, list_sum(list_transform(range(1, 9), lambda i: CAST(d[i] AS INT) * (i + 1))) % 11 AS r FROM d AS c),
a AS (SELECT *, CASE WHEN r = 10 THEN 0 WHEN r = 0 AND uf <= 2 THEN 1 ELSE r END AS one FROM s), b AS (SELECT *, (CAST(d[9] AS INT) * 7 + CAST(d[10] AS INT) * 8 + one * 9) % 11 AS q FROM a), e AS (SELECT *, CASE WHEN q = 10 THEN 0 WHEN q = 0 AND uf <= 2 THEN 1 ELSE q END AS two FROM b)
SELECT id, d || CAST(one AS VARCHAR) || CAST(two AS VARCHAR) AS digits, uf BETWEEN 1 AND 28 AND NOT regexp_matches(d || CAST(one AS VARCHAR) || CAST(two AS VARCHAR), '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') AS valid FROM e""")
def voter_titles(spark, sf_dir):
    body = F.concat(F.lpad((F.col("c_custkey") * 104729 % 99999999).cast("string"), 8, "0"), F.lpad((F.col("c_custkey") % 30).cast("string"), 2, "0"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), body.alias("d")).withColumn("uf", F.substring("d", 9, 2).cast("int"))

    def digit(total):
        return F.when(total % 11 == 10, 0).when((total % 11 == 0) & (F.col("uf") <= 2), 1).otherwise(total % 11)

    at = lambda i: F.substring("d", i, 1).cast("int")
    c = c.withColumn("one", digit(sum((at(i) * (i + 1) for i in range(2, 9)), at(1) * 2))).withColumn("two", digit(at(9) * 7 + at(10) * 8 + F.col("one") * 9))
    c = c.withColumn("digits", F.concat("d", F.col("one").cast("string"), F.col("two").cast("string")))
    return c.select("id", "digits", O.checked("titulo_eleitor", F.col("digits")).alias("valid"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 400 WHEN 1 THEN 401 WHEN 2 THEN 504 WHEN 3 THEN 500 WHEN 4 THEN 409 ELSE 413 END AS status,
CASE c_custkey % 6 WHEN 0 THEN 'VALIDATION_ERROR' WHEN 1 THEN 'UNAUTHORIZED' WHEN 2 THEN 'LLM_TIMEOUT' WHEN 3 THEN 'INTERNAL_ERROR' WHEN 4 THEN 'CONFLICT' ELSE 'PAYLOAD_TOO_LARGE' END AS code,
CASE c_custkey % 6 WHEN 0 THEN 'bad [REDACTED] of ' || c_name || ' line two' WHEN 1 THEN 'missing or invalid auth token' WHEN 2 THEN 'upstream LLM timed out' WHEN 3 THEN 'internal error' WHEN 4 THEN 'request failed (details redacted)'
  ELSE left(repeat(c_name || ' ', 30), 200) || '…' END AS error FROM customer""")
def error_messages(spark, sf_dir):
    k, name = F.col("c_custkey") % 6, F.col("c_name")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("ValidationError", "UnauthorizedError", "LLMTimeoutError", "TypeError", "ConflictError", "PayloadTooLargeError")]), (k + 1).cast("int"))
    said = F.when(k == 0, F.concat(F.lit("bad token=abcdefghijklmnop0123 of "), name, F.lit("\r\nline two"))).when(k == 4, F.concat(F.lit("open /home/"), name, F.lit("/x failed"))).when(k == 5, F.repeat(F.concat(name, F.lit(" ")), F.lit(30))).otherwise(name)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    c = c.repartition(max(1, c.count() // 16_384), "c_custkey")  # a file of few row groups is else one task's patterns
    c = c.select(F.col("c_custkey").alias("id"), kind.alias("name"), said.alias("message"))
    return c.select("id", *O.safe_error(F.col("name"), F.col("message")))


@query("""SELECT event_id AS id, '{"type":"' || CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'kg' END || '","details":{"query":"' || CASE WHEN event_id % 2 = 0 THEN '<redacted>' ELSE event_type END || '","n":' || user_id || ',"deep":[{"id":' || event_id || '},"' || user_id || '.md"]},"path":"f' || user_id || '.txt"}' AS event FROM events""")
def viewer_events(spark, sf_dir):
    """Forbidden fields at any depth go, with whatever they hold; paths shrink; a search's query is hidden."""
    e, s = table(spark, sf_dir, "events"), lambda c: F.col(c).cast("string")
    parts = [
        F.lit('{"type": "'), F.when(F.col("event_id") % 2 == 0, "search").otherwise("kg"), F.lit('", "details": {"query": "'), F.col("event_type"), F.lit('", "n": '), s("user_id"), F.lit(', "deep": [{"id": '), s("event_id"),
        F.lit(', "content": {"a": {"x": 1}, "b": "SECRET"}}, "/home/u/'), s("user_id"), F.lit('.md"], "vector": [1, [2]]}, "password": "p\\", \\"x", "path": "/var/data/f'), s("user_id"), F.lit('.txt"}'),
    ]
    return e.select(F.col("event_id").alias("id"), O.bare_event(F.concat(*parts)).alias("event"))


WORDS = "\\b(?:[A-Za-z]{3,}|[aA]n?|[oO]r|[iI]f)\\b"


@query(f"""WITH d AS (SELECT doc_id AS id, text, length(text) AS n, coalesce(list_sum(list_transform(regexp_extract_all(text, '(?i)\\bhttps?://\\S+'), lambda x: length(x))), 0) AS links, len(regexp_extract_all(text, '[{{}};=<>()\\[\\]]')) AS code FROM documents)
SELECT id, CASE WHEN text IS NULL OR n < 20 OR regexp_full_match(text, '[\\s\\p{{P}}]+') THEN 0.0::DOUBLE WHEN links / n >= 0.5 THEN 0.1 ELSE round(0.25 + CASE WHEN code::DOUBLE / n >= 0.08 THEN -0.15 ELSE 0.15 END
+ CASE WHEN regexp_matches(text, '{WORDS}') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(text, '[.!?](\\s|$)') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(text, '[a-z]') AND regexp_matches(text, '[A-Z]') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(text, '\\w') THEN 0.15 ELSE 0 END, 6) END AS score FROM d""")
def signal_scores(spark, sf_dir):
    return docs(spark, sf_dir).select("id", F.round(O.signal_score(F.col("text")), 6).alias("score"))


FAST_SQL = " || ".join(f"list_transform(regexp_extract_all(text, '{p.replace(O.EDGE, chr(92) + 'b')}'), lambda v: struct_pack(kind := '{k}', name := trim(v, ' ' || chr(10) || chr(9) || chr(13))))" for k, p in O.FAST.items())


@query(f"""WITH h AS (SELECT doc_id AS id, {FAST_SQL} AS h FROM documents), k AS (SELECT id, list_filter(h, lambda x: x.kind <> 'date') AS h FROM h WHERE len(list_filter(h, lambda x: x.kind <> 'proper_noun')) >= 3),
u AS (SELECT id, list_filter(h, lambda x, i: list_position(h, x) = i)[1:20] AS h FROM k), e AS (SELECT id, unnest(h) AS e FROM u)
SELECT id, e.kind AS kind, e.name AS name, CASE e.kind WHEN 'email' THEN 'person' WHEN 'phone' THEN 'person' WHEN 'cpf' THEN 'person' WHEN 'proper_noun' THEN 'person' WHEN 'cnpj' THEN 'organization' WHEN 'url' THEN 'document' ELSE 'metric' END AS type FROM e""")
def fast_entities(spark, sf_dir):
    return O.fast_path(docs(spark, sf_dir))


VERBS = ("requires", "Blocked By", "mentioned_with", " augments ", "migrates_from", "extracted from", "blocks", "likes")


@query(f"""WITH v AS (SELECT p_partkey AS id, {list(VERBS)}[p_partkey % 8 + 1] AS verb, CASE p_partkey % 5 WHEN 0 THEN 'Extends' WHEN 1 THEN 'unknown' WHEN 2 THEN 'other' END AS given FROM part)
SELECT id, CASE WHEN given = 'Extends' THEN 'extends' ELSE CASE id % 8 WHEN 0 THEN 'depends_on' WHEN 1 THEN 'depends_on' WHEN 2 THEN 'mentions' WHEN 3 THEN 'extends' WHEN 4 THEN 'replaces' WHEN 5 THEN 'derived_from' WHEN 6 THEN 'opposes' ELSE 'unknown' END END AS reason FROM v""")
def relation_reasons(spark, sf_dir):
    i = F.col("p_partkey")
    given = F.when(i % 5 == 0, "Extends").when(i % 5 == 1, "unknown").when(i % 5 == 2, "other")
    return table(spark, sf_dir, "part").select(i.alias("id"), O.relation_reason(F.element_at(F.array(*map(F.lit, VERBS)), (i % 8 + 1).cast("int")), given).alias("reason"))


@query("""SELECT id, CASE section WHEN 'compiled' THEN 0.9::DOUBLE WHEN 'frontmatter' THEN 0.9 WHEN 'timeline' THEN 0.95 ELSE CASE source_type WHEN 'external' THEN 0.7 WHEN 'ocr-cache' THEN 0.65 WHEN 'lesson' THEN 0.75 ELSE 0.8 END END AS confidence,
CASE section WHEN 'compiled' THEN 'declared' WHEN 'frontmatter' THEN 'declared' WHEN 'timeline' THEN 'observed' ELSE CASE source_type WHEN 'external' THEN 'derived' WHEN 'ocr-cache' THEN 'inferred' WHEN 'lesson' THEN 'derived' END END AS provenance_kind FROM @chunks""")
def write_defaults(spark, sf_dir):
    c = chunks(spark, sf_dir)
    other = F.when(F.col("source_type") == "external", "graphify").when(F.col("source_type") == "ocr-cache", "kg-extract").when(F.col("source_type") == "lesson", "consolidate").otherwise("markdown")
    return c.select("id", *O.write_defaults(F.when(F.col("section").isNotNull(), F.concat(F.lit("entity-"), F.col("section"))).otherwise(other)))


@query("""SELECT id, chunk_type IN ('daily_log') OR (access_count % 4 = 0 AND length(chunk_text) > 50) OR (access_count % 3 = 0 AND length(chunk_text) > 200) AS ambiguous FROM @chunks""")
def ambiguous_texts(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", O.ambiguous(F.col("chunk_text"), F.col("chunk_type"), F.col("access_count") % 4, F.col("access_count") % 3).alias("ambiguous"))


@query("""SELECT event_id AS id, '{"a":{"x":' || user_id || ',"y":[{"b":1,"c":"é"}]},"type":"' || event_type || '"}' AS canonical FROM events""")
def canonical_json(spark, sf_dir):
    raw = F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('", "a": {"y": [{"c": "é", "b": 1}], "x": '), F.col("user_id").cast("string"), F.lit("}}"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), O.canonical_json(raw).alias("canonical"))
