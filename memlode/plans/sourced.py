"""Queries that go through the file sources: tables are written in the source's form and read back by it."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlode.operators import maintenance
from memlode.plans.base import Registry
from memlode.session import Scratch, table
from memlode.sources import readers

R = Registry()
query = R.query


def place(spark) -> str:
    return Scratch(spark).place()


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def source_json_lines(spark, sf_dir):
    path = place(spark)
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.json(path)
    return readers.json_lines(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("SELECT p_partkey, p_brand, p_retailprice FROM part")
def source_csv(spark, sf_dir):
    path = place(spark)
    table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice").write.option("header", True).csv(path)
    return readers.csv_metrics(spark, path, "p_partkey long, p_brand string, p_retailprice double")


@query("""SELECT 'graph:tpch:n' || n_nationkey AS source_file, n_name || chr(10) || 'Type: nation' || chr(10) || 'Links: in → ' || r_name AS chunk_text FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'graph:tpch:r' || r_regionkey, r_name || chr(10) || 'Type: region' FROM region""")
def source_graph(spark, sf_dir):
    """Nations and regions as a graph file; each nation links to its region."""
    path = place(spark)
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nid, rid = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    nodes = n.select(nid.alias("id"), F.col("n_name").alias("label"), F.lit("nation").alias("file_type")).union(r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), "r_name", F.lit("region")))
    links = n.select(nid.alias("source"), rid.alias("target"), F.lit("in").alias("relation"))
    one = nodes.agg(F.collect_list(F.struct("id", "label", "file_type")).alias("nodes")).crossJoin(links.agg(F.collect_list(F.struct("source", "target", "relation")).alias("links")))
    one.coalesce(1).write.json(path)  # two tables of fixed size
    return readers.graph_chunks(spark, path, "tpch").select("source_file", "chunk_text")


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 5) AS norm2 FROM embeddings")
def source_vectors(spark, sf_dir):
    """The packed vector table as Parquet arrays, written and read back."""
    path = place(spark)
    table(spark, sf_dir, "embeddings").select("vec_id", "embedding").write.parquet(path)
    square = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(path).select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(square, 5).alias("norm2"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def source_archive(spark, sf_dir):
    """A bundle with manifest, verified on the way back."""
    path = place(spark)
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    maintenance.write_bundle({"orders": own}, path)
    return maintenance.read_bundle(spark, path, {"orders": own.schema})["orders"]


@query("SELECT event_id, user_id FROM events")
def source_snapshot(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", "user_id")
    return spark.read.parquet(readers.write_snapshot(own, place(spark), "2024-01-31"))
