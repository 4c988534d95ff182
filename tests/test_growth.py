"""Work and memory that must not outgrow the input, and results that only larger tables show."""

import datetime as dt
import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from memlode import session
from memlode.operators import dictionary, extraction, inference, privacy, ranking, telemetry, textual
from memlode.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def stages(spark):
    gateway = spark.sparkContext._gateway
    listed = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    it, out = listed.iterator(), {}
    while it.hasNext():
        s = it.next()
        out[s.stageId()] = s
    return out


def shuffled(spark, run):
    """What run() returns and the rows that it shuffled."""
    before = set(stages(spark))
    out = run()
    return out, sum(s.shuffleWriteRecords() for k, s in stages(spark).items() if k not in before)


def unsent(spark, run):
    """run() as on tables that are too large to be broadcast unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def tables(spark, path, **rows):
    """A folder of Parquet tables, each given as (schema, rows), and a DuckDB connection that sees them."""
    duck = duckdb.connect()
    for name, (schema, own) in rows.items():
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
        duck.execute(f"create view {name} as select * from '{path}/{name}.parquet/*.parquet'")
    return str(path), duck


def listed(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_last_served_shuffles_no_pairs(spark, tmp_path):
    path, duck = tables(
        spark, tmp_path,
        customer=("c_custkey long, c_nationkey int", [(i, i % 2) for i in range(300)] + [(7, 0), (301, None), (5, 1)]),
        supplier=("s_suppkey long, s_nationkey int", [(i, i % 2) for i in range(200)] + [(205, None), (4, 1)]),
        orders=("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz", [(i, i % 250, dt.datetime(2024, 1, 1 + i % 28)) for i in range(200)] + [(200, None, None)]),
        lineitem=("l_orderkey long, l_suppkey long", [(i % 210, i * 7 % 210) for i in range(700)]),
    )
    got, n = shuffled(spark, lambda: unsent(spark, lambda: QUERIES["last_served"](spark, path).collect()))
    want = duck.execute(SQL["last_served"]).fetchall()
    assert listed(got) == listed(want) and len(want) > 30_000
    assert n < 10_000  # orders and lines may move, the pairs may not


def test_last_served_takes_little_room_on_disk(spark, tmp_path):
    path, duck = tables(
        spark, tmp_path,
        customer=("c_custkey long, c_nationkey int", [(i, i % 25) for i in range(5000)]),
        supplier=("s_suppkey long, s_nationkey int", [(i * 7919 % 14_009, i % 25) for i in range(14_000)]),
        orders=("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz", [(i, i, dt.datetime(2024, 1, 1 + i % 28)) for i in range(5000)]),
        lineitem=("l_orderkey long, l_suppkey long", [(i % 5000, i * 31 % 14_009) for i in range(60_000)]),
    )
    QUERIES["last_served"](spark, path).write.parquet(f"{tmp_path}/out")
    summed = "select count(*), count(served_at), sum(hash(agent, id, served_at)), bit_xor(hash(agent, id, served_at)) from "
    got = duck.execute(f"{summed} '{tmp_path}/out/*.parquet'").fetchone()
    assert got == duck.execute(f"{summed} ({SQL['last_served']})").fetchone() and got[0] == 2_800_000 and got[1] > 2000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.5 * got[0]


def test_pairs_are_whole_in_any_cut(spark, monkeypatch):
    left = [(i, i % 3) for i in range(40)] + [(5, 2)] * 30 + [(None, 1), (None, 1), (9, 1), (50, None), (51, 7)]
    right = [(i, i % 3) for i in range(30)] + [(4, 1)] * 25 + [(None, 1), (None, 1), (4, 0), (60, None), (61, 8)]
    found = {(k, g, o): k * 100 + o for k, g in left for o, h in right if g == h and None not in (k, o, g) and (k * 7 + o) % 4 < 3} | {(5, 2, 2): None, (5, 2, 90): 1}
    frames = [spark.createDataFrame(rows, of).repartition(3) for rows, of in ((left, "k long, g int"), (right, "o long, g int"), ([(*x, v) for x, v in found.items()], "k long, g int, o long, v long"))]
    want = listed((k, o, found.get((k, g, o))) for k, g in left for o, h in right if g == h and g is not None)
    for run, rows, block in ((504, 1 << 22, 1 << 20), (3, 40, 8), (1, 1 << 22, 1000), (4, 5000, 1)):
        monkeypatch.setattr(telemetry, "RUN", run, raising=False)
        assert listed(telemetry.looked_up(frames[0], frames[1], "g", frames[2], "k", "o", "v", rows, block).collect()) == want
    assert not telemetry.looked_up(frames[0].where("k = 51"), frames[1], "g", frames[2], "k", "o", "v").collect()


def test_resamples_broadcast_no_clusters(spark):
    c = spark.range(3000).selectExpr("id % 2 as stratum", "id as cluster", "id * 1.0D as x")
    for run, few in ((inference.resamples, 2), (inference.stratified_resamples, 0)):  # the two are the number of clusters and one row a range
        got = run(c, 5)
        got.collect()
        assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("BroadcastExchange") <= few
        assert got.groupBy("draw").agg({"times": "sum"}).where("`sum(times)` <> 3000").isEmpty()


def test_names_across_what_a_longer_one_left(spark):
    names = ["is on", "xlonger", "a b", "bxa", "onx", "aa", "s o"]
    texts = ["isxlongeron", "axlongerb bxa", None, "", "aaa isxlongeronxlonger", "abxab", "IS ON aaxlongera", "isbxaon is on"]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    want = []
    for i, text in enumerate(texts):
        text, found = (text or "").lower(), []
        for n in sorted(names, key=lambda n: (-len(n), n)):
            if n in text:
                text, found = text.replace(n, " "), [*found, n]
        want.append((i, len(found), sorted(found)))
    assert want[0] == (0, 2, ["is on", "xlonger"])
    for block in (1 << 20, 150):
        got = dictionary.query_entities(t, spark.createDataFrame([(n,) for n in names], "name string"), block_bytes=block, blanks=True)
        assert sorted((r.id, r.n, r.entities) for r in got.collect()) == want


def test_graph_walk_has_edges_of_a_seed_to_itself(spark, tmp_path):
    lines = [(1, 1, 1_000_100, 100, 0.05, "R"), (1, 2, 1_000_100, 7, 0.02, "N"), (2, 1, 5, 7, 0.01, "N"), (2, 2, 1_000_200, 9, 0.0, "R"), (3, 1, 1_000_007, 7, 0.0, "N")]
    path, duck = tables(
        spark, tmp_path,
        part=("p_partkey long", [(1_000_100,), (1_000_200,), (5,)]),
        lineitem=("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_returnflag string, l_shipdate timestamp_ntz", [(*x, dt.datetime(2024, 1, 1)) for x in lines]),
    )
    want = duck.execute(SQL["graph_walk"]).fetchall()
    assert listed(QUERIES["graph_walk"](spark, path).collect()) == listed(want)
    assert [r[2] for r in want if r[0] == r[1] == 1_000_100] in ([0, 1], [1, 0])


def peak_mb(monkeypatch, frame, make, batch):
    """Peak of what NumPy and Python hold in the mapInArrow function that make() gives to Spark, over one large batch."""
    got = []
    with monkeypatch.context() as m:
        m.setattr(type(frame), "mapInArrow", lambda self, f, schema: got.append(f) or self.sparkSession.createDataFrame([], schema))
        make()
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in got[0](iter([batch])))
        return rows, tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_vector_search_holds_a_bounded_slice(spark, monkeypatch):
    vecs = np.random.default_rng(1).normal(size=(10_000, 16))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000), pa.int64()), pa.array(vecs.tolist(), pa.list_(pa.float64()))], ["id", "vec"])
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(vecs[:800].tolist())], "query_id long, vec array<double>")
    rows, mb = peak_mb(monkeypatch, asked, lambda: ranking.knn(asked.withColumnRenamed("query_id", "id"), asked, 5), batch)
    assert rows == 4000 and mb < 120  # all at once: 64 MB of scores, and again for each step of their order


def test_terms_are_counted_in_a_bounded_slice(spark, monkeypatch):
    words = [f"w{i}" for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000), pa.int64()), pa.array([words * 4] * 10_000, pa.list_(pa.string()))], ["id", "t0"])
    docs = spark.createDataFrame([(1, "w1")], "id long, chunk_text string")
    rows, mb = peak_mb(monkeypatch, docs, lambda: ranking._terms_held(docs, words, {"chunk_text": 1.0}), batch)
    assert rows == 10_000 and mb < 20  # all at once: 16 MB for each of several arrays


def test_members_make_no_shingles(spark, tmp_path):
    text = lambda i: " ".join(f"word{i % 7}x{k}" for k in range(40))
    path, duck = tables(spark, tmp_path, documents=("doc_id long, text string", [(i, text(i)) for i in range(300)] + [(301, None), (302, None), (303, "")]))
    got, n = shuffled(spark, lambda: QUERIES["near_duplicate_members"](spark, path).collect())
    assert listed(got) == listed(duck.execute(SQL["near_duplicate_members"]).fetchall())
    assert n <= 2 * 303


def test_error_messages_spread_over_tasks(spark, tmp_path):
    path, _ = tables(spark, tmp_path, customer=("c_custkey long, c_name string", [(i, f"c{i}") for i in range(70_000)]))
    assert QUERIES["error_messages"](spark, path).rdd.getNumPartitions() == 4


def test_near_duplicates_shuffle_each_shingle_once(spark, tmp_path):
    words = lambda i, n=40: [f"w{i}x{k}" for k in range(n)]
    line = [f"common{k}" for k in range(12)]
    texts = [" ".join(words(i) + line) for i in range(60)] + [" ".join([*words(i)[:-1], "other", *line]) for i in range(0, 60, 6)]
    texts += [" ".join(words(3, 20) + line), " ".join(line), " ".join(line[:3]), " ".join(line[:2]), "", None, texts[0].upper(), texts[1]]
    path, duck = tables(spark, tmp_path, documents=("doc_id long, text string", list(enumerate(texts))))
    got, n = unsent(spark, lambda: shuffled(spark, lambda: QUERIES["near_duplicate_pairs"](spark, path).collect()))
    assert listed(got) == listed(duck.execute(SQL["near_duplicate_pairs"]).fetchall())
    assert len(got) >= 10 and n < 2 * sum(len((t or "").split()) for t in texts)


def test_graph_boost_follows_the_hits(spark):
    asked = spark.createDataFrame([(q, "about ten") for q in range(40)], "query_id long, text string")
    known = spark.createDataFrame([(10, "ten", 3), (11, "eleven", 1)], "entity_id long, name string, mention_count int")
    rel = spark.createDataFrame([(10 + i % 2, 11 - i % 2, i, 0.5) for i in range(1500)], "source_id long, target_id long, evidence_id long, confidence double")
    hits = spark.createDataFrame([(q, q, 1.0, 1) for q in range(40)] + [(q, 9000, 1.0, 2) for q in range(40)], "query_id long, id long, score double, rank int")
    got, n = unsent(spark, lambda: shuffled(spark, lambda: dictionary.graph_boosted(hits, asked, known, rel).collect()))
    assert {(r.query_id, r.id): round(r.score, 6) for r in got} == {(q, i): 1.0375 if i < 9000 else 1.0 for q in range(40) for i in (q, 9000)}
    assert n < 20_000  # a row for every query and chunk of its entities: 60 000, twice


def test_interleaved_shuffles_its_best_alone(spark, tmp_path):
    docs = [(i, f"common word{i % 9} w{i}" if i % 7 else "other", None, "s") for i in range(600)] + [(600, None, "xx", None)]
    path, duck = tables(
        spark, tmp_path,
        documents=("doc_id long, text string, lang string, source string", docs),
        labels=("doc_id long, quality int, toxic int", [(1, 1, 0)]),
        benchmark=("item_id long, text string", [(q, f"common word{q} w{q * 30}") for q in range(20)] + [(20, "unheard"), (21, "")]),
    )
    got, n = unsent(spark, lambda: shuffled(spark, lambda: QUERIES["interleaved"](spark, path).collect()))
    assert listed(got) == listed(duck.execute(SQL["interleaved"]).fetchall())
    assert len(got) >= 100 and n < 2000  # a row for every query and matching document: 10 000, several times


def test_audit_violations_tasks_have_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50, raising=False)
    lines = [(i // 4, i % 4 + 1, i * 7 % 11, i * 5 % 13) for i in range(1000)] + [(3, 1, 2, 2), (999, 1, 1, 1)]
    path, duck = tables(spark, tmp_path, lineitem=("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long", lines), orders=("o_orderkey long", [(i,) for i in range(250)]))
    out = QUERIES["audit_violations"](spark, path)
    assert listed(out.collect()) == listed(duck.execute(SQL["audit_violations"]).fetchall())
    assert out.rdd.getNumPartitions() == 21


def mixed(words, n, size, seed=5):
    rng = np.random.default_rng(seed)
    return [(i, "".join(rng.choice(words, size))) for i in range(n)] + [(n, None), (n + 1, "")]


def seconds(frame):
    began = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def prose(spark):
    return spark.createDataFrame([(i, "The Quick brown-fox jumped, et al. over src docs 3 entities. " * 20_000) for i in range(2)], "id long, text string").coalesce(1)


FAST_WORDS = [" ", " ", " ", "R$ 1.5 mil", "us$3k", "U$", "€ 4", "12.345.678/0001-90", "123.456.789-09", "a1/2/2024", "1/2/24", "+55 (11) 91234-5678", "ana@b.co", "https://x.y/z)", "7,5 %", "9%", "Ana", " Éva", "Rio", " de ", "x", "é", "-", "\n", "A", "Óscar Lima", "4"]


def test_fast_entities_as_all_patterns_find_them(spark):
    rows = spark.createDataFrame(mixed(FAST_WORDS, 300, 16), "id long, text string")

    def of(k, p):
        return F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), lambda v: F.struct(F.lit(k).alias("kind"), F.trim(F.regexp_replace(v, "^\\s+|\\s+$", "")).alias("value")))

    plain = F.concat(*[of(k, p) for k, p in privacy.FAST.items()])
    want = []
    for i, hits in rows.select("id", plain).collect():
        if len([k for k, _ in hits or [] if k != "proper_noun"]) >= 3:
            want += [(i, k, v, privacy.TYPES[k]) for k, v in [h for h in dict.fromkeys(map(tuple, hits)) if h[0] != "date"][:20]]
    assert listed(privacy.fast_path(rows).collect()) == listed(want) and len(want) > 500 and len({w[1] for w in want}) == 10


def test_fast_entities_spare_texts_without_parts(spark):
    rows = prose(spark)
    seconds(privacy.fast_path(rows))
    assert seconds(privacy.fast_path(rows)) < seconds(rows.select(F.regexp_extract_all("text", F.lit(privacy.FAST["proper_noun"]), F.lit(0))))


LINK_WORDS = [" ", " ", "(", "[[projects/a-b]]", "[[entities/person/x#y|z]]", "[t](../entities/projects/q.md#s)", "[", "](", "projects/abc", "person/x1", "`", ".", "src/a.py:12", "Docs/b_c.md", "evals/x.ts", "\n", "#", "/", "x", ":7", "|", "]]"]


def test_links_and_code_as_their_groups(spark):
    rows = spark.createDataFrame(mixed(LINK_WORDS, 400, 14), "id long, text string")
    some = 0
    for p in (*textual.LINKS.values(), textual.CODE_REF):
        both = F.arrays_zip(*[F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), F.lit(k)).alias(c) for k, c in ((1, "a"), (2, "b"))])
        got = rows.select("id", F.coalesce("text", F.lit("")).alias("text")).select("id", extraction._pairs("text", p).alias("m"), both.alias("n")).collect()
        assert [r.m for r in got] == [r.n for r in got]
        some += sum(len(r.m) > 0 for r in got) > 20
    assert some == 4


def test_links_and_code_are_searched_once(spark):
    rows, patterns = prose(spark).withColumn("text", F.concat("text", F.lit("src/a.py"))), (textual.LINKS["bare"], textual.CODE_REF)
    plain = rows.select(*[F.regexp_extract_all("text", F.lit(p), F.lit(k)) for p in patterns for k in (1, 2)])
    seconds(extraction.pattern_counts(rows))
    assert seconds(extraction.pattern_counts(rows)) < 0.7 * seconds(plain)


DOCUMENTS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def test_passages_of_any_length_are_gold(spark, tmp_path):
    texts = ["alpha beta gamma delta epsilon zeta eta", "xalpha beta gamma delta epsilonish tail", None, "", "one word", "beta", "Alpha beta", "alpha  beta", "gamma alpha beta ünïcode 𝄞 beta", "beta"]
    asked = ["alpha beta gamma delta epsilon", "beta", "ta gam", "", None, texts[0], "Alpha beta", "beta", "nowhere to be found here at all", " ", "ünïcode 𝄞"]
    path, duck = tables(
        spark, tmp_path, benchmark=("item_id long, text string", list(enumerate(asked))), labels=(LABELS, [(1, 1, 0)]),
        documents=(DOCUMENTS, [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]),
    )
    for name in ("passage_scores", "score_rollup"):
        assert listed(QUERIES[name](spark, path).collect()) == listed(duck.execute(SQL[name]).fetchall())
    docs, b = (spark.createDataFrame(list(enumerate(x)), f"{k} long, {c} string") for x, k, c in ((texts, "id", "text"), (asked, "query_id", "passage")))
    want = {(q, i) for q, p in enumerate(asked) for i, t in enumerate(texts) if None not in (p, t) and p in t}
    for size in (200, dictionary.BLOCK_BYTES):  # some blocks and one
        assert sorted(map(tuple, dictionary.holders(docs, b, block_bytes=size).collect())) == sorted(want)


def test_gold_takes_no_row_a_word(spark, tmp_path):
    texts = [" ".join(f"w{i}x{k}" for k in range(500)) for i in range(40)]
    path, _ = tables(
        spark, tmp_path, benchmark=("item_id long, text string", [(i, t[100:200]) for i, t in enumerate(texts[:10])]),
        documents=(DOCUMENTS, [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]),
    )
    got, n = unsent(spark, lambda: shuffled(spark, lambda: QUERIES["passage_scores"](spark, path).collect()))
    assert len(got) == 10 and all(r.n_gold == 1 and r.hit == 1 for r in got)
    assert n < 20 * len(texts)  # a row for each run of four words: 19 880, and twice


def test_passages_are_found_a_text_at_a_time(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(2_000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5_000), pa.int64()), pa.array([text] * 5_000)], ["id", "text"])
    docs, b = spark.createDataFrame([(1, "w1")], "id long, text string"), spark.createDataFrame([(7, "w1 w2 w3"), (8, "w5")], "query_id long, passage string")
    rows, mb = peak_mb(monkeypatch, docs, lambda: dictionary.holders(docs, b), batch)
    assert rows == 10_000 and mb < 5  # all at once: 56 MB of strings
