import random
import re
from collections import Counter

import numpy as np

from memlode.llm import quality_model as Q
from memlode.llm import quality_rules as QR
from tests.llm.util import documents, no_documents


def labelled(spark, n=600):
    rng = random.Random(5)
    words = ["river", "stone", "and", "the", "walk", "morning", "light", "of", "green", "house"]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(20, 200))
        bad = i % 5 == 0
        t = " ".join(x + rng.choice(["###", "$$$", "&&&"]) for x in w) if bad else " ".join(w) + "."
        docs.append((i, t))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r.predicted for r in Q.score(docs, Q.train(docs, labels)).select("q_row.doc_id", "predicted").collect()}
    assert np.mean([got[i] == int(i % 5 != 0) for i in got]) > 0.98


def test_the_column_equals_the_model(spark):
    docs, labels = labelled(spark, 200)
    m = Q.train(docs, labels)
    from pyspark.sql import functions as F

    x = Q.with_features(docs).select(*Q.NAMES).toPandas().to_numpy(float)
    got = Q.with_features(docs).select(m.column([F.col(c) for c in Q.NAMES]).alias("s")).toPandas()["s"]
    assert np.allclose(np.sort(got), np.sort(m.score(x))) and 0 < len(m.rules) < 80


def test_a_bounded_sample_is_enough(spark):
    docs, labels = labelled(spark)
    assert Q.train(docs, labels, sample=60).rules


def test_classifier_awkward_rows(spark):
    d = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (9, 0, 0), (None, 1, 1), (12, None, None), (77, 1, 0)], "doc_id long, quality int, toxic int")
    rows = Q.score(d, Q.train(d, labels)).collect()
    assert len(rows) == d.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert Q.keep_good(d, labels).columns == d.columns
    none = Q.score(d, Q.train(d, labels.where("false"))).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    assert Q.score(no_documents(spark), Q.train(no_documents(spark), labels)).count() == 0


def counts(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def test_base_counts(spark):
    rng = random.Random(1)
    texts = [None, "", " \n ", "a b a b a b a", "x y z\nx y z\n\n \nx y z", "#*$ %&|<>", "a b c d a b c e a b c"] + [" ".join(rng.choices("abcd", k=rng.randint(0, 60))).replace("d", "\n") for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang")
    for r in QR.quality_rules(d).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_divergence_separates_junk(spark):
    rng = random.Random(2)
    common = QR.COMMON["en"].split()
    good = [" ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("abcdefghij", k=6)) for _ in range(200)) + "." for _ in range(60)]
    bad = [" ".join("".join(rng.choices("abcdefghij", k=6)) + rng.choice(["###", "$$$"]) for _ in range(200)) for _ in range(8)]
    shout = [g.upper().replace(" ", "!! ") for g in good[:5]]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad + shout)], "doc_id long, text string").selectExpr("*", "'en' as lang")
    kept = {r.doc_id for r in QR.quality_rules(d).where("kept").collect()}
    assert kept == set(range(60))


def test_texts_without_common_words_are_rejected(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    common = QR.COMMON["en"].split()
    good = [" ".join(rng.choice(common) if rng.random() < 0.3 else word() for _ in range(n)) + "." for n in (60, 120, 200, 500, 1500) for _ in range(12)]
    bad = [" ".join(word() for _ in range(n)) + "." for n in (120, 400, 1200, 3000)] + [" ".join([word() for _ in range(1200)] + common[:5]) + "."]
    d = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string").selectExpr("*", "'en' as lang")
    assert {r.doc_id for r in QR.quality_rules(d).where("kept").collect()} == set(range(60))


def test_js_distance(spark):
    from pyspark.sql import functions as F

    def js(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0)
        return np.sqrt((kl(p) + kl(q)) / 2)

    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    got = spark.range(1).select(QR.js_distance(F.array(*[F.lit(x) for x in p]), q)).first()[0]
    assert abs(got - js(p, q)) < 1e-12


def plain_histograms(text):
    """Base counts and histograms of one text, by the definitions, in plain Python."""
    text = text or ""
    ws = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    classes = {"upper": str.isupper, "accent": lambda c: 0xC0 <= ord(c) <= 0x24F, "stop": lambda c: c in ".,", "shout": lambda c: c in "!?", "quote": lambda c: c in "\"'():;/_=~^+@-"}
    ascii_upper = lambda c: "A" <= c <= "Z"
    n = [sum((ascii_upper if k == "upper" else f)(c) for c in text) for k, f in classes.items()]
    chars = sum(len(w) for w in ws)
    symbols, digits = sum(c in "#*$%&|<>" for c in text), sum("0" <= c <= "9" for c in text)
    h_c = [chars - digits - sum(n) - symbols, len(text) - chars, symbols, *n]
    vocab = sorted({w for v in QR.COMMON.values() for w in v.split()})
    shapes = {x + y: w for w in vocab for x in (w, w.capitalize(), w.upper()) for y in ("", *QR.AFTER)}
    hits = Counter(shapes[w] for w in ws if w in shapes)
    h_w = [hits[w] for w in vocab]
    share = lambda h: [x / max(1, sum(h)) for x in h]
    cover = [x / max(1, len(ws)) for x in h_w] + [1 - sum(h_w) / max(1, len(ws))]
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return {"n": len(ws), "failed": failed, "hists": (share(h_c), share(h_w), cover), "totals": (sum(h_c), sum(h_w), len(ws))}


def plain_kept(rows):
    """The verdicts of (text, lang): medians, then means over what is kept, then the limits."""
    prof = [(plain_histograms(t), lang) for t, lang in rows]

    def refs(chosen, robust):
        out = {}
        for lang in QR.COMMON:
            own = [p["hists"] for p, x in chosen if x == lang and not p["failed"]]
            if own:
                middle = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
                c = [(middle if robust else lambda v: sum(v) / len(v))([h[0][i] for h in own]) for i in range(len(own[0][0]))]
                out[lang] = ([x / (sum(c) or 1) for x in c], *([sum(h[k][i] for h in own) / len(own) for i in range(len(own[0][k]))] for k in (1, 2)))
        return out

    def js(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0)
        return np.sqrt(max(0.0, (kl(p) + kl(q)) / 2))

    def kept(p, known, words_too):
        if p["failed"]:
            return False
        near = [min((js(p["hists"][k], r[k]) for r in known.values()), default=0) for k in range(3)]
        limits = [a + b / np.sqrt(max(1, t)) for a, b, t in zip((QR.MAX_CHAR, QR.MAX_WORD, QR.MAX_COVER), (QR.SLACK_CHAR, QR.SLACK_WORD, QR.SLACK_COVER), p["totals"])]
        return all(near[k] <= limits[k] for k in range(3 if words_too else 1))

    known = refs(prof, True)
    for words_too in (False, *[True] * (QR.ROUNDS - 1)):
        known = refs([x for x in prof if kept(x[0], known, words_too)], False) or known
    return [kept(p, known, True) for p, _ in prof]


def test_verdicts_equal_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], plain_kept([(r.text, r.lang) for r in rows])))
    got = {r.doc_id: r.kept for r in QR.quality_rules(docs).collect()}
    assert got == want and 0.1 < sum(want.values()) / len(want) < 0.99
    some = [(k, t, lang) for k, (t, lang) in enumerate(awkward_texts())]
    d = spark.createDataFrame(some, "doc_id long, text string, lang string")
    assert [r.kept for r in QR.quality_rules(d).orderBy("doc_id").collect()] == plain_kept([(t, lang) for _, t, lang in some])


def awkward_texts():
    rng = random.Random(12)
    for k in range(90):
        lang = rng.choice(["en", "fr", "de", "es", None, "xx"])
        common = QR.COMMON.get(lang or "en", QR.COMMON["en"]).split()
        word = lambda: "".join(rng.choices("abcdeéß", k=5))
        ws = [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(rng.choice([0, 10, 49, 50, 80, 400]))]
        if k % 9 == 0:
            ws = [w.upper() + "!" for w in ws]
        if k % 11 == 0:
            ws = ws[:20] * (len(ws) // 20)
        yield (None if k % 17 == 0 else rng.choice([" ", "\n", ", "]).join(ws) + rng.choice(["", ".", " 12 $ #"])), lang


def test_rules_awkward_rows(spark):
    out = QR.quality_rules(documents(spark)).collect()
    assert len(out) == documents(spark).count()
    assert QR.quality_rules(no_documents(spark)).count() == 0
    alone = QR.quality_rules(documents(spark).where("doc_id = 9")).selectExpr("*").collect()
    assert len(alone) == 1 and alone[0].n_words == 60_000


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(3)
    h = (rng.random((1500, 25)) < rng.uniform(0.1, 0.9, 25)).astype(np.float32)
    y = (rng.random(1500) < 1 / (1 + np.exp(-(h[:, 0] * 2 - h[:, 1] * 1.5 + h[:, 2] - 0.5)))).astype(float)
    for l1 in (0.0015, 0.02):
        b, w = Q.lasso_logistic(h, y, l1, steps=3000)
        g = h.T @ (1 / (1 + np.exp(-(h @ w + b))) - y) / len(y)
        assert abs((1 / (1 + np.exp(-(h @ w + b))) - y).mean()) < 1e-5
        on = np.abs(w) > 1e-8
        assert np.abs(g[on] + l1 * np.sign(w[on])).max() < 1e-4 and (np.abs(g[~on]) <= l1 + 1e-4).all() and 3 <= on.sum()
        short = Q.lasso_logistic(h, y, l1)
        assert np.abs(short[1] - w).max() < 0.02  # the steps that fit() takes come near enough


def test_paths_hold_for_the_rows_of_their_nodes():
    """Every path is the conjunction that leads to its node: children split the rows of their parent."""
    rng = np.random.default_rng(5)
    x = rng.random((600, 4))
    r = (x[:, 0] > 0.4) * 1.0 - (x[:, 1] < 0.3) * (x[:, 2] > 0.5)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, Q.BINS + 1)[1:-1])) for k in range(4)]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    out = []
    leaves = Q._grow(binned, cuts, r, np.arange(600), np.arange(4), 3, (), out)
    assert sorted(np.concatenate([rows for rows, _ in leaves]).tolist()) == list(range(600))
    paths = [p for p in out if not any(q[: len(p)] == p and len(q) > len(p) for q in out)]
    held = sorted(tuple(np.flatnonzero(Q.holds(p, x))) for p in paths)
    assert held == sorted(tuple(sorted(rows.tolist())) for rows, _ in leaves) and len(leaves) > 4
    assert all(abs(r[rows].mean() - m) < 1e-12 for rows, m in leaves)
    k, _, t = out[0][0]
    gain = lambda k, t: (r[x[:, k] <= t].sum() ** 2 / (x[:, k] <= t).sum() + r[x[:, k] > t].sum() ** 2 / (x[:, k] > t).sum())
    assert gain(k, t) >= max(gain(j, c) for j in range(4) for c in cuts[j]) - 1e-9  # the first split is the best of all
