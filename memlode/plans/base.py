"""Registration of queries and the shared derivations of the model tables from the supplied ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlode.session import table

#: All that depends on "now" takes this instant.
AS_OF = "2025-01-15 00:00:00"


class Registry:
    """Queries of one module: name, function of (spark, sf_dir), and DuckDB SQL or None."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = expand(sql)
            return f

        return add


#: chunks: documents and labels in the shape of the retrieval model; the same text runs on both engines.
CHUNKS = """
SELECT d.doc_id AS id, d.source AS source_file, d.text AS chunk_text,
  CASE d.doc_id % 9 WHEN 0 THEN 'feedback' WHEN 1 THEN 'person' WHEN 2 THEN 'lesson' WHEN 3 THEN 'decision' WHEN 4 THEN 'project'
    WHEN 5 THEN 'team' WHEN 6 THEN 'daily' WHEN 7 THEN 'pending' ELSE 'graph_node' END AS chunk_type,
  CASE d.doc_id % 4 WHEN 1 THEN 'compiled' WHEN 2 THEN 'frontmatter' WHEN 3 THEN 'timeline' END AS section,
  CASE WHEN d.doc_id % 8 = 4 THEN CAST(1.2 AS DOUBLE) END AS section_boost,
  CASE d.doc_id % 6 WHEN 0 THEN 'entity' WHEN 1 THEN 'lesson' WHEN 2 THEN 'note' WHEN 3 THEN 'external' WHEN 4 THEN 'ocr-cache' END AS source_type,
  CASE l.quality WHEN 1 THEN CAST(0.9 AS DOUBLE) WHEN 0 THEN CAST(0.4 AS DOUBLE) END AS importance,
  CASE l.toxic WHEN 1 THEN CAST(1.0 AS DOUBLE) WHEN 0 THEN CAST(0.3 AS DOUBLE) END AS pain,
  CAST(DATE '2024-01-01' + CAST(d.doc_id % 400 AS INTEGER) AS DATE) AS source_date,
  CAST(CAST(DATE '2024-01-01' + CAST(d.doc_id % 400 AS INTEGER) AS DATE) AS TIMESTAMP) AS created_at,
  CASE WHEN d.doc_id % 3 = 0 THEN CAST(CAST(DATE '2024-01-01' + CAST(d.doc_id % 400 + d.doc_id % 30 AS INTEGER) AS DATE) AS TIMESTAMP) END AS updated_at,
  CASE WHEN d.doc_id % 13 = 0 THEN CAST(CAST(DATE '2024-01-01' + CAST(d.doc_id % 400 + 60 AS INTEGER) AS DATE) AS TIMESTAMP) END AS deleted_at,
  CASE WHEN d.doc_id % 5 = 1 THEN CAST(CAST(DATE '2024-06-01' + CAST(d.doc_id % 200 AS INTEGER) AS DATE) AS TIMESTAMP) END AS last_accessed_at,
  CASE WHEN d.doc_id % 10 = 5 THEN 45 END AS retention_days,
  CAST(d.doc_id % 50 AS BIGINT) AS access_count,
  CASE WHEN d.doc_id % 7 <> 0 THEN CAST(d.doc_id % 10 AS DOUBLE) / 10 END AS confidence,
  CASE d.doc_id % 3 WHEN 0 THEN 'user-marked' WHEN 1 THEN 'llm' END AS provenance_kind,
  CASE WHEN d.doc_id % 11 = 0 THEN d.doc_id + 1 END AS superseded_by
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

#: telemetry: events as search and provider telemetry.
TELEMETRY = """
SELECT event_id AS id, ts, CASE user_id % 6 WHEN 0 THEN 'ada' WHEN 1 THEN 'bel' WHEN 2 THEN 'cai' WHEN 3 THEN 'dov' WHEN 4 THEN 'eve' ELSE 'fyn' END AS agent,
  user_id, event_type AS feature, value AS latency_ms, {k} AS result_count, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS failed
FROM events
"""

#: relations: line items as (part, supplied_by, supplier) with a confidence and a date.
RELATIONS = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS source_id, CASE WHEN l_returnflag = 'R' THEN 'returned_to' ELSE 'supplied_by' END AS predicate,
  l_suppkey AS target_id, round(CAST(1 AS DOUBLE) - l_discount * 8, 2) AS confidence, l_orderkey AS evidence_id, l_shipdate AS created_at,
  CASE l_linenumber % 3 WHEN 0 THEN 'regex' WHEN 1 THEN 'llm' ELSE 'manual' END AS method,
  CASE WHEN l_linenumber = 7 THEN l_orderkey * 10 + 1 END AS superseded_by
FROM lineitem
"""

SPARK_K = "CAST(get_json_object(props, '$.k') AS BIGINT)"
DUCK_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
VIEWS = {"chunks": CHUNKS, "telemetry": TELEMETRY.replace("{k}", DUCK_K), "relations": RELATIONS}


def expand(sql: str) -> str:
    """``@chunks`` and the like stand for the derived tables."""
    for name, text in VIEWS.items():
        sql = sql.replace(f"@{name}", f"({text.strip()})")
    return sql.replace("@as_of", f"TIMESTAMP '{AS_OF}'")


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    for n in names:
        text = text.replace(f" {n} ", f" {{{n}}} ").replace(f" {n}\n", f" {{{n}}}\n")
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CHUNKS, "documents", "labels")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searched columns of chunks, from documents alone."""
    kind = "element_at(array('feedback', 'person', 'lesson', 'decision', 'project', 'team', 'daily', 'pending', 'graph_node'), CAST(doc_id % 9 + 1 AS INT))"
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text AS chunk_text", "source AS source_file", f"{kind} AS chunk_type", "CAST(doc_id % 50 AS BIGINT) AS access_count")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, TELEMETRY.replace("{k}", SPARK_K), "events")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, RELATIONS, "lineitem")
