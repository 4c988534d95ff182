import math
import os
import re

import numpy as np
import regex

import corpus_pipeline as P
from memlode.llm import mixing, quality_model, simhash
from memlode.llm import queries as Q
from memlode.session import table
from tests.llm.test_decontaminate import plain
from tests.llm.test_pii import PLAIN, brute_terms, spans
from tests.llm.util import documents, no_documents


def _tables(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (9, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")


def test_stages_on_the_supplied_documents(spark, sf):
    """Each stage against its own input: what it keeps, and that it keeps the columns."""
    docs = table(spark, sf, "documents")
    cols = docs.columns
    from memlode.llm import decontaminate

    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == cols
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "quality":
            want = {r.doc_id for r in quality_model.score(docs, quality_model.train(docs, table(spark, sf, "labels"))).where("predicted = 1").select("q_row.doc_id").collect()}
        elif name == "near_dedup":
            want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
        elif name == "benchmark_free":
            items = [r.text for r in table(spark, sf, "benchmark").collect()]
            find = decontaminate.Searcher(items)
            want = {r.doc_id for r in docs.collect() if not find.search(r.text.encode())}
        else:
            want = {r.doc_id for r in docs.collect()}
        assert ids == want and out.count() == len(ids), name
        docs = out
    mixed = P.STAGES[-1][1](spark, docs, sf)
    assert mixed.count() > 0 and set(cols) <= set(mixed.columns)


def _features(t):
    """The classifier's statistics, by Python's own functions."""
    ws = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    n, chars, lines = max(1, len(ws)), max(1, len(t)), t.split("\n")
    per = lambda p, of: len(regex.findall(p, t)) / of
    return [
        math.log1p(len(t)), sum(map(len, ws)) / n, per(r"[#*$%&|<>=_~^{}\[\]\\]", chars), per(r"\p{Lu}", chars), per("[!?]", chars), per("[.,;:]", n), per("[0-9]", chars),
        len(set(ws)) / n, len(set(ws)) / math.sqrt(n), len(set(lines)) / len(lines), len(ws) / len(lines),
    ]


def test_run_matches_brute_force(spark, sf):
    """All five stages over the supplied documents, each in plain Python on what the one before kept."""
    docs = table(spark, sf, "documents")
    model = quality_model.train(docs, table(spark, sf, "labels"))
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    assert len(rows) == docs.count()
    good = [i for i, r in rows.items() if model.score(np.array([_features(r["text"] or "")]))[0] >= 0.5]
    prints = {i: simhash.fingerprint((rows[i]["text"] or "").encode()) for i in good}
    root = {i: i for i in good}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in good:
        for j in good:
            if i < j and bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= 4 and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = [i for i in good if find(i) == i]
    items = [plain(r.text) for r in table(spark, sf, "benchmark").collect()]
    clean = [i for i in kept if not any(s and len(s & plain(rows[i]["text"])) >= 0.8 * len(s) for s in items)]
    texts = {}
    for i in clean:
        t = rows[i]["text"] or ""
        for kind, p in PLAIN.items():
            t = re.sub(p, lambda m: f"<{kind.upper()}>" if spans(m.group()).startswith(kind) or f"{kind}:0:{len(m.group())}" in spans(m.group()) else m.group(), t)
        texts[i] = re.sub("[A-Za-z0-9_-]{32,}", lambda m: "<SECRET>" if len(set(m.group())) >= 8 and re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group()) else m.group(), t)
    assert not brute_terms([rows[i]["text"] or "" for i in clean])
    size = {i: len([w for w in re.split("[\x20\x09-\x0d]+", t) if w]) for i, t in texts.items()}
    sources = sorted({rows[i]["source"] for i in clean}, key=lambda x: (x is None, x))
    words = np.array([sum(size[i] for i in clean if rows[i]["source"] == s) for s in sources], float)
    goal = mixing.targets(words, np.array([(5.0, 2.0, 1.0)[k % 3] for k in range(len(sources))]))
    assert max(words) < mixing.SHARD_WORDS  # one shard a source
    quota = mixing.apportion(goal, round(goal.sum() / mixing.BLOCK_TOKENS), np.floor(2 * words / mixing.BLOCK_TOKENS))
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    order = {r.doc_id: tuple(r.o) for r in mixing._sized(d).select("doc_id", mixing._order(mixing.SEED).alias("o")).collect()}
    want = {}
    for s, q in zip(sources, quota):
        line = [i for i in sorted((i for i in clean if rows[i]["source"] == s), key=order.get) for _ in range(size[i])]
        for i in set(line):
            want[i] = (2 * line)[: q * mixing.BLOCK_TOKENS].count(i)
    got = P.run(spark, sf).collect()
    assert {r.doc_id: r.mix_taken for r in got} == {i: n for i, n in want.items() if n} and len(got) == len({r.doc_id for r in got}) > 50
    assert all(r.text == texts[r.doc_id] and r.mix_size == size[r.doc_id] for r in got) and len(kept) < len(good) < len(rows)


def test_pipeline_awkward_and_empty(spark, tmp_path):
    _tables(spark, tmp_path)
    for frame in (documents(spark), no_documents(spark)):
        docs = frame
        for _, stage in P.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert set(docs.columns) <= set(out.columns)
            here, there = ({(r.doc_id, r.source) for r in x.select("doc_id", "source").collect()} for x in (docs, out))
            assert there <= here and out.count() <= docs.count()
            docs = out
        assert (docs.count() == 0) == frame.isEmpty()


def test_every_query_runs(spark, sf):
    import __spark_entry__ as e

    names = e.queries()
    for f in Q.OPERATORS:
        assert f.__name__ in names
    assert "pipeline" in names
    for name in ("op1_simhash", "op9_mixing", "op10_html_extract"):
        assert names[name](spark, sf).count() > 0


def test_imports_are_not_swallowed():
    root = os.path.dirname(os.path.abspath(P.__file__))
    for path in [P.__file__, *(os.path.join(root, "memlode/llm", f) for f in os.listdir(os.path.join(root, "memlode/llm")) if f.endswith(".py"))]:
        assert "ImportError" not in open(path).read()
