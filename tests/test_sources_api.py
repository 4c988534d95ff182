import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memlode.api import Memory
from memlode.operators import selection as S
from memlode.sources import readers as R


def test_walk_and_lines(spark, tmp_path):
    for p, t in {"a/x.md": "one", "a/b/y.json": "{}", "node_modules/z.md": "no", "a/q.txt": "no"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    assert sorted(r.text for r in R.walk(spark, str(tmp_path)).collect()) == ["one", "{}"]
    (tmp_path / "l.jsonl").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    assert sorted(r.id for r in R.json_lines(spark, str(tmp_path / "l.jsonl"), "id long").collect()) == [1, 2]
    (tmp_path / "m.csv").write_text("name,v\na,1.5\n")
    assert R.csv_metrics(spark, str(tmp_path / "m.csv"), "name string, v double").first().v == 1.5


def test_graph_source(spark, tmp_path):
    g = {"nodes": [{"id": str(i), "label": f"N{i}", "file_type": "code"} for i in range(12)], "links": [{"source": "0", "target": str(i), "relation": "uses"} for i in range(1, 12)]}
    (tmp_path / "g.json").write_text(json.dumps(g))
    rows = {r.source_file: r.chunk_text for r in R.graph_chunks(spark, str(tmp_path / "g.json"), "repo").collect()}
    assert len(rows) == 12 and rows["graph:repo:0"].count("→") == 8 and rows["graph:repo:1"] == "N1\nType: code"
    store = spark.createDataFrame([("graph:repo:9x", "old"), ("keep", "k")], "source_file string, chunk_text string")
    fresh = R.graph_chunks(spark, str(tmp_path / "g.json"), "repo").select("source_file", "chunk_text")
    assert R.replace_prefix(store, fresh, "graph:repo:").count() == 13


def test_eval_log_posts(spark, tmp_path):
    d = tmp_path / "data-g5"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"aggregate": {"active": {"label": "L", "mrr": 0.5}, "off": {"mrr": 0.25}}}))
    (d / "b.json").write_text(json.dumps({"summary": {"label": "M", "ndcg_at_10": 0.7}}))
    (d / "c.json").write_text("[1]")
    (d / "d.json").write_text("{broken")
    assert sorted(r.run_id for r in R.eval_summaries(spark, str(tmp_path)).collect()) == ["g5::L::active", "g5::M", "g5::unknown::off"]
    (tmp_path / "x.log").write_text("old\n\n[2026-01-01T00:00:00Z] all 4 invariants OK\nERROR it is not OK\n")
    rows = R.log_tail(spark, str(tmp_path / "x.log"), 2).collect()
    assert [(r.timestamp, r.ok) for r in rows] == [("2026-01-01T00:00:00Z", True), (None, False)]
    (tmp_path / "p.xml").write_text('<posts><row Id="1" PostTypeId="1" Score="3" Title="T" Body="&lt;p&gt;q &amp;amp; r&lt;/p&gt;"/><row Id="2" PostTypeId="2" ParentId="1" Score="1" Body="low"/><row Id="3" PostTypeId="2" ParentId="1" Score="9" Body="high"/></posts>')
    p = R.posts(spark, str(tmp_path / "p.xml")).first()
    assert (p.title, p.body, p.answers) == ("T", "q & r", ["high", "low"])


def test_reports_snapshots_events(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.123456), (None, 2.0)], "k string, v double")
    assert R.markdown(df, "T").splitlines()[2:] == ["| k | v |", "|---|---|", "| a\\|b | 0.1235 |", "|  | 2 |"]
    assert R.snapshots_to_drop([f"s-2024-01-{d:02d}" for d in range(1, 11)] + ["other"]) == ["s-2024-01-01", "s-2024-01-02", "s-2024-01-03"]
    assert spark.read.parquet(R.write_snapshot(df, str(tmp_path), "2024-01-01")).count() == 2


def test_multi_hop(spark):
    rows = [("What is it?", 0), ("Compare: difference between Ann Lee and Bob and Carl vs Dora, and why?", 10), ("before the merge happened, who left?", 2), ("", 0), (None, 0)]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    score, hop = S.multi_hop(F.col("t"))
    got = [(r.s, r.h) for r in d.select("i", score.alias("s"), hop.alias("h")).orderBy("i").collect()]
    assert [g[0] for g in got] == [0, 10 + 1, 2, 0, 0] and [g[1] for g in got] == [False, True, False, False, False]


def test_rerank_protection(spark):
    rows = [(1, i, i, ["compiled", None, "timeline", None][i % 4], float(i)) for i in range(1, 9)]
    d = spark.createDataFrame(rows, "query_id long, id long, rank int, section string, s double")
    by = lambda m: {r.id: r.new_rank for r in S.protected(d, F.col("s"), m).collect()}
    a = by("bypass")
    assert a[4] == 4 and a[8] == 8 and a[7] == 1 and sorted(a.values()) == list(range(1, 9))
    assert by("factor")[8] == 1 and by("anchor")[4] == 1 and by("anchor")[8] == 2 and by("anchor")[7] == 3


def test_quota_pick():
    c = lambda i, s, t="t", line=None: {"id": i, "score": s, "title": t + str(i), "line": line or f"unique line {i}"}
    pools = [[c(1, 9.0), c(2, 8.0), c(3, 7.0)], [c(4, 1.0), c(5, 0.5)]]
    assert [x["id"] for x in S.quota_pick(pools, [2, 2], 4)] == [1, 2, 4, 5]
    assert [x["id"] for x in S.quota_pick(pools, [1, 1], 3)] == [1, 2, 4]
    assert 5 in [x["id"] for x in S.quota_pick(pools, [2, 0], 2, pinned={5})]
    assert 9 in [x["id"] for x in S.quota_pick(pools, [2, 2], 4, [c(9, 0.1)], 1)]
    same = [[c(1, 2.0, line="alpha bravo charlie delta"), c(2, 1.0, line="alpha bravo charlie delta")]]
    assert [x["id"] for x in S.quota_pick(same, [2], 2)] == [1]


def test_small_rules(spark):
    assert S.diverse([(1, {"a", "b"}), (2, {"a", "b"}), (3, {"c"})], 2) == [1, 3]
    assert S.iterate({1, 2}, lambda n, s: {1, 2, 3}, overlap=0.6) == ({1, 2, 3}, 2)
    with pytest.raises(ValueError):
        S.renamed(F.col("t"), {"a": "b", "b": "a"})
    d = spark.createDataFrame([("see people/ann and people/ann-lee",)], "t string")
    assert d.select(S.renamed(F.col("t"), {"people/ann": "people/anna"}).alias("t")).first().t == "see people/anna and people/ann-lee"
    now = F.lit("2024-01-01 12:30:00").cast("timestamp")
    assert spark.range(1).select(S.cron_due(F.lit(30), F.lit(9), now).alias("v")).first().v
    ops = spark.createDataFrame([(1, "started", datetime(2024, 1, 1)), (2, "started", datetime(2024, 1, 1, 11)), (3, "success", datetime(2023, 1, 1))], "id int, status string, started_at timestamp")
    assert [r.status for r in S.zombies(ops, now).orderBy("id").collect()] == ["crashed", "started", "success"]


def test_memory(spark, sf):
    from memlode.plans.base import chunks
    from memlode.session import table

    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text").where("query_id < 5")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    m = Memory(chunks(spark, sf), F.lit("2025-01-15 00:00:00").cast("timestamp"), e, lambda qs: qs.join(e.withColumnRenamed("id", "query_id"), "query_id").select("query_id", "vec"), lambda x: x.select("query_id", F.when(F.col("query_id") != 2, "so says [chunk_1]").otherwise("nothing").alias("answer")))
    hits = m.search(q, 5).collect()
    assert {h.query_id for h in hits} == {0, 1, 2, 3, 4} and max(sum(h.query_id == k for h in hits) for k in range(5)) <= 5
    old = m.at(F.lit("2024-02-01").cast("timestamp"))
    assert {h.id for h in old.search(q).collect()} <= {r.id for r in old.chunks.select("id").collect()}
    got = {r.query_id: r for r in m.answer(q).collect()}
    assert got[2].abstained and not got[1].abstained and got[1].cited == ["chunk_1"]
