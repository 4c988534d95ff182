"""Queries on texts, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlode.functions import text as T
from memlode.operators import textual as O
from memlode.plans.base import Registry, chunks
from memlode.session import table

R = Registry()
query = R.query
FLAT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query("SELECT item_id AS id, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM benchmark")
def query_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.sanitize_query(F.col("text")).alias("q"))


@query("""SELECT page_id AS id, CASE WHEN regexp_matches(url, '//blog\\.') THEN 'blog' WHEN regexp_matches(url, '//m\\.') THEN 'mobile' WHEN regexp_matches(url, '\\.html$') THEN 'file' WHEN regexp_matches(url, '/$') THEN 'folder' ELSE 'other' END AS kind FROM pages""")
def url_class(spark, sf_dir):
    rules = [("//blog\\.", "blog"), ("//m\\.", "mobile"), ("\\.html$", "file"), ("/$", "folder")]
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), O.path_class(F.col("url"), rules).alias("kind"))


@query("""SELECT id, CASE WHEN section = 'compiled' THEN 'compiled' WHEN source_type = 'external' THEN 'external' WHEN chunk_type = 'feedback' THEN 'user_statement' WHEN section = 'timeline' THEN 'timeline' END AS origin FROM @chunks""")
def origin_backfill(spark, sf_dir):
    own = F.when(F.col("section") == "compiled", "compiled").when(F.col("source_type") == "external", "external").when(F.col("chunk_type") == "feedback", "user_statement").when(F.col("section") == "timeline", "timeline")
    return chunks(spark, sf_dir).select("id", own.alias("origin"))


@query(f"""SELECT id, CASE WHEN length(f) > 100 THEN rtrim(left(f, 99)) || '…' ELSE f END AS snippet, left(sha1(text), 16) AS h1, left(sha256(text), 16) AS h2, left(sha1(lower(text)), 8) AS h3 FROM (SELECT doc_id AS id, text, {FLAT.format('text')} AS f FROM documents)""")
def snippets_and_hashes(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("id", T.snippet(t, 100).alias("snippet"), T.short_hash(t).alias("h1"), T.short_hash(t, "sha2").alias("h2"), T.short_hash(F.lower(t), "sha1", 8).alias("h3"))


@query("""WITH l AS (SELECT doc_id AS id, text, trim(regexp_replace(regexp_replace(coalesce(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)[1], ''), '<[^>]*>', '', 'g'), '^[#>*\\-\\s]+', '')) AS l,
list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]'), lambda x: trim(x)), lambda x: length(x) > 10)[1] AS s FROM documents)
SELECT id, CASE WHEN length(l) > 140 THEN left(l, 139) || '…' ELSE l END AS line, coalesce(s, '') AS sentence FROM l""")
def one_liners(spark, sf_dir):
    return docs(spark, sf_dir).select("id", T.first_line(F.col("text")).alias("line"), T.first_sentence(F.col("text")).alias("sentence"))


@query("""SELECT item_id AS id, list_aggregate(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), 'string_agg', ' ') AS n FROM benchmark""")
def answer_normalised(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.squad_normalise(F.col("text")).alias("n"))


GRAMS = "list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))"


@query(f"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS t FROM conversations),
g AS (SELECT conv_id, turn, CASE WHEN len(t) >= 3 THEN {GRAMS} WHEN len(t) > 0 THEN [list_aggregate(t, 'string_agg', ' ')] ELSE [] END AS g FROM w)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.g) > 0 AND len(b.g) > 0 THEN len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::DOUBLE ELSE 0 END, 6) AS sim FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def turn_similarity(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.word_shingles(F.col("text")).alias("g"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("g").alias("h"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("g"), F.col("h")), 6).alias("sim"))


@query()
def secrets_redacted(spark, sf_dir):
    """Ordered secret patterns with lookaround, and Luhn: no SQL form."""
    d = docs(spark, sf_dir).withColumn("kinds", O.secret_counts(F.col("text")))
    return d.select("id", F.sha2(O.redact(O.strip_private(F.col("text"))), 256).alias("redacted_sha256"), F.size("kinds").alias("n_kinds"), F.aggregate(F.map_values("kinds"), F.lit(0), lambda a, n: a + n).alias("n"))


@query("""WITH c AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '\\b\\d{13,19}\\b')) AS v FROM documents), d AS (SELECT id, list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN (len(v) - i) % 2 = 1 THEN (CAST(v[i] AS INT) * 2) // 10 + (CAST(v[i] AS INT) * 2) % 10 ELSE CAST(v[i] AS INT) END)) % 10 = 0 AS ok FROM c) SELECT id, count(*) AS found, count(*) FILTER (WHERE ok) AS valid FROM d GROUP BY 1""")
def luhn_checked(spark, sf_dir):
    """Runs of 13 to 19 digits, and those of them that pass the check."""
    v = docs(spark, sf_dir).select("id", F.explode(F.regexp_extract_all("text", F.lit("\\b\\d{13,19}\\b"), F.lit(0))).alias("v"))
    return v.groupBy("id").agg(F.count("*").alias("found"), F.count(F.when(T.luhn(F.col("v")), 1)).alias("valid"))


LINKED = "doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'see [x](../entities/people/p-' || doc_id || '.md) and people/p-' || doc_id WHEN 1 THEN 'note [[projects/q-' || (doc_id % 7) || '|Q]] now' WHEN 2 THEN 'of agents/a-' || (doc_id % 5) || ', src/lib/m' || (doc_id % 9) || '.py:12' ELSE '`people/code` none' END AS text"


def linked(spark, sf_dir):
    i = F.col("doc_id")
    k = i % 4
    s = lambda c: c.cast("string")
    t = F.when(k == 0, F.concat(F.lit("see [x](../entities/people/p-"), s(i), F.lit(".md) and people/p-"), s(i))).when(k == 1, F.concat(F.lit("note [[projects/q-"), s(i % 7), F.lit("|Q]] now")))
    t = t.when(k == 2, F.concat(F.lit("of agents/a-"), s(i % 5), F.lit(", src/lib/m"), s(i % 9), F.lit(".py:12"))).otherwise("`people/code` none")
    return table(spark, sf_dir, "documents").select(i.alias("id"), t.alias("text"))


@query("""SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'project' ELSE 'agent' END AS entity_type, CASE doc_id % 4 WHEN 0 THEN 'p-' || doc_id WHEN 1 THEN 'q-' || (doc_id % 7) ELSE 'a-' || (doc_id % 5) END AS slug,
CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'wikilink' ELSE 'bare' END AS source FROM documents WHERE doc_id % 4 <> 3""")
def entity_links(spark, sf_dir):
    return O.links(linked(spark, sf_dir))


@query("SELECT doc_id AS id, 'src/lib/m' || (doc_id % 9) || '.py' AS path, 12 AS line FROM documents WHERE doc_id % 4 = 2")
def code_references(spark, sf_dir):
    return O.code_refs(linked(spark, sf_dir))


@query("""SELECT page_id AS id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'g'), 'zzzz', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), O.html_text(F.col("html")).alias("text"))


SNIP = f"CASE WHEN length({FLAT.format('text')}) > 120 THEN rtrim(left({FLAT.format('text')}, 119)) || '…' ELSE {FLAT.format('text')} END"


@query(f"""WITH s AS (SELECT *, {SNIP} AS s FROM conversations), l AS (SELECT *, lag(role || ': ' || s, 1) OVER w AS a, lag(role || ': ' || s, 2) OVER w AS b FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role))
SELECT conv_id, turn, concat_ws(chr(10), b, a) AS context, role || ': ' || text AS block FROM l""")
def conversation_blocks(spark, sf_dir):
    return O.conversation_blocks(table(spark, sf_dir, "conversations"))


@query("""WITH r AS (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2), p AS (SELECT conv_id, string_agg(role, ',' ORDER BY f, role) AS participants FROM r GROUP BY 1),
c AS (SELECT conv_id, count(*) AS n_turns, arg_min(text, turn) AS t FROM conversations GROUP BY 1), l AS (SELECT conv_id, n_turns, trim(regexp_replace(list_filter(string_split(t, chr(10)), lambda x: length(trim(x)) > 0)[1], '^[#>*\\-\\s]+', '')) AS l FROM c)
SELECT conv_id, participants, n_turns, CASE WHEN length(l) > 180 THEN left(l, 179) || '…' ELSE l END AS first_line FROM p JOIN l USING (conv_id)""")
def conversation_digests(spark, sf_dir):
    return O.digests(table(spark, sf_dir, "conversations"))


@query()
def fixed_chunks(spark, sf_dir):
    """Sequential splits; held against the plain function in tests."""
    return O.chunked(docs(spark, sf_dir)).select("id", "n", F.sha2("piece", 256).alias("piece_sha256"))


@query("""SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""SELECT c_custkey AS id, lpad(CAST((c_custkey * 7919 + 12345678901) % 99999999999 AS VARCHAR), 11, '0') AS digits, CASE WHEN substr(d, 10, 1) = CAST(c1 AS VARCHAR) AND substr(d, 11, 1) = CAST(c2 AS VARCHAR) AND NOT regexp_matches(d, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') THEN true ELSE false END AS valid FROM
(SELECT *, list_sum(list_transform(range(1, 10), lambda i: CAST(d[i] AS INT) * (11 - i))) * 10 % 11 % 10 AS c1, list_sum(list_transform(range(1, 11), lambda i: CAST(d[i] AS INT) * (12 - i))) * 10 % 11 % 10 AS c2 FROM (SELECT c_custkey, lpad(CAST((c_custkey * 7919 + 12345678901) % 99999999999 AS VARCHAR), 11, '0') AS d FROM customer))""")
def cpf_checked(spark, sf_dir):
    d = F.lpad(((F.col("c_custkey") * 7919 + 12345678901) % 99999999999).cast("string"), 11, "0")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), d.alias("digits"), T.cpf(d).alias("valid"))
