"""Identifiers, errors, events and inference against plain Python."""

import itertools
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memlode.operators import inference as I
from memlode.operators import privacy as P


def digits_ok(kind, d):
    """Check digits by the published rules, written apart from the columns."""
    n = list(map(int, d))
    if len(set(n)) == 1 and kind in ("cpf", "pix_cpf", "cnpj", "cartao_br", "cnh", "titulo_eleitor"):
        return False
    mod = lambda xs, ws: sum(a * b for a, b in zip(xs, ws)) % 11
    if kind in ("cpf", "pix_cpf"):
        return len(n) == 11 and [0 if (r := mod(n[:k], range(k + 1, 1, -1))) < 2 else 11 - r for k in (9, 10)] == n[9:]
    if kind == "cnpj":
        ws = [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
        return len(n) == 14 and [0 if (r := mod(n[: 12 + k], ws[1 - k :])) < 2 else 11 - r for k in (0, 1)] == n[12:]
    if kind == "cartao_br":
        return 13 <= len(n) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(n))) % 10 == 0
    if kind == "cnh":
        a, b = mod(n[:9], range(9, 0, -1)), mod(n[:9], range(1, 10))
        two = 0 if b == 10 else b - 2 * (a == 10)
        return len(n) == 11 and n[9:] == [0 if a == 10 else a, two + 11 if two < 0 else two]
    if kind == "titulo_eleitor":
        uf = int(d[8:10])
        fix = lambda r: 0 if r == 10 else 1 if r == 0 and uf in (1, 2) else r
        one = fix(mod(n[:8], range(2, 10)))
        return len(n) == 12 and 1 <= uf <= 28 and n[10:] == [one, fix((n[8] * 7 + n[9] * 8 + one * 9) % 11)]
    if kind == "telefone_br":
        return 8 <= len(n) <= 13 and not (len(n) >= 12 and d[:2] != "55") and not (len(n) == 11 and d[2] != "9")
    if kind == "pix_phone":
        return bool(re.fullmatch("55[1-9][0-9]9[0-9]{8}", d))
    return d != "00000000" if kind == "cep" else True


def plain_identifiers(text, least=0.0, pix_cpf=False):
    found = []
    before, after = "(?<![^\\s(,;:./=\"'\\[<>])", "(?![^\\s),;:.!?/=\"'\\]>-])"
    for order, (kind, (pattern, good, bad)) in enumerate(P.IDENTIFIERS.items()):
        if kind == "pix_cpf" and not pix_cpf:
            continue
        for m in re.finditer(f"{before}(?:{pattern}){after}", text, re.A):
            v = m.group()
            v = v.lower() if kind in ("pix_uuid", "pix_email") else re.sub("[.-]", "", v).upper() if kind == "rg" else re.sub("[^0-9]", "", v)
            sure = good if bad is None or digits_ok(kind, v) else bad
            if sure >= least:
                found.append((m.start(), m.start() - m.end(), -sure, order, kind, m.end(), v))
    out, upto = [], -1
    for at, _, doubt, _, kind, till, v in sorted(found):
        if at >= upto:
            out.append((kind, at, till, -doubt, v))
            upto = till
    return out


def numbers(rng):
    def with_checks(kind, body, size):
        return next((body + "".join(map(str, c)) for c in itertools.product(range(10), repeat=size - len(body)) if digits_ok(kind, body + "".join(map(str, c)))), body)

    body = lambda n: "".join(rng.choices("0123456789", k=n))
    cpf, cnpj = with_checks("cpf", body(9), 11), with_checks("cnpj", body(12), 14)
    title = body(8) + f"{rng.randint(0, 31):02d}"
    return [
        cpf, f"{cpf[:3]}.{cpf[3:6]}.{cpf[6:9]}-{cpf[9:]}", cnpj, f"{cnpj[:2]}.{cnpj[2:5]}.{cnpj[5:8]}/{cnpj[8:12]}-{cnpj[12:]}", with_checks("cnh", body(9), 11), with_checks("titulo_eleitor", title, 12), body(rng.randint(7, 20)),
        f"{body(5)}-{body(3)}", "00000-000", f"+55{rng.randint(11, 99)}9{body(8)}", f"(11) 9{body(4)}-{body(4)}", f"a.{body(2)}@b.com.br", "11111111111", "123e4567-e89b-42d3-a456-426614174000", f"{body(2)}.{body(3)}.{body(3)}-X", "4532 0151 1283 0366",
    ]


def cases():
    rng = random.Random(5)
    texts = ["", None, "no numbers at all", "é 😀 529.982.247-25, (11) 91234-5678!"]
    for _ in range(400):
        parts = [rng.choice([*numbers(rng), "palavra", "é", "x=", "(", ")."]) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice([" ", ", ", "", ":", "😀 "]).join(parts))
    return texts


def test_identifiers_match_plain_python(spark):
    texts = cases()
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r for r in d.select("i", P.identifiers(F.col("t")).alias("a"), P.identifiers(F.col("t"), 0.5, True).alias("b")).collect()}
    seen = Counter()
    for i, t in enumerate(texts):
        own = lambda s: [(x.kind, x["at"], x.till, x.confidence, x.value) for x in s]
        assert own(got[i].a) == plain_identifiers(t or ""), t
        assert own(got[i].b) == plain_identifiers(t or "", 0.5, True), t
        seen.update((k, c) for k, _, _, c, _ in own(got[i].b))
    assert {k for k, _ in seen} >= set(P.IDENTIFIERS) - {"pix_cpf", "rg"} and seen["cnh", P.MEDIUM] + seen["titulo_eleitor", P.HIGH] > 3


def test_redaction_modes(spark):
    def fnv(s):
        h = 0x811C9DC5
        for c in s.encode():
            h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
        return f"{h:08x}"[:6]

    texts = [t for t in cases() if t]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string").withColumn("s", P.identifiers(F.col("t"), 0.5))
    for r in d.select("t", *[P.redact_identifiers(F.col("t"), F.col("s"), m).alias(m) for m in ("default", "preserve", "hash")]).collect():
        want = {"default": r.t, "preserve": r.t, "hash": r.t}
        for kind, at, till, _, v in reversed(plain_identifiers(r.t, 0.5)):
            tag = f"[REDACTED:{kind}]"
            for mode, mark in (("default", tag), ("preserve", tag.ljust(till - at, "_")), ("hash", f"[REDACTED:{kind}:{fnv(v)}]")):
                want[mode] = want[mode][:at] + mark + want[mode][till:]
        assert {m: r[m] for m in want} == want
    with pytest.raises(ValueError):
        P.redact_identifiers(F.lit("a"), F.col("s"), "other")


def test_rates_of_a_clean_corpus(spark):
    text = "\n".join(["x" * 300, "529.982.247-25", "y" * 300, "", "z"])
    assert spark.range(1).select(P.text_blocks(F.lit(text)).alias("b")).first().b == ["x" * 300 + "\n529.982.247-25\n", "y" * 300 + "\n\nz\n"]
    got = {r.kind: (r.total, r.high, round(r.rate, 3)) for r in P.identifier_rates(spark.createDataFrame([(text,), (None,)], "text string")).collect()}
    assert got == {"any": (2, 1, 0.5), "cpf": (1, 1, 0.5)}


def test_errors_and_details(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(P.scrubbed(F.lit(""))) == one(P.scrubbed(F.lit(None).cast("string"))) == "request failed"
    assert one(P.scrubbed(F.lit("Bearer " + "a" * 20 + " sk-" + "b" * 20 + " password=x&y"))) == "[REDACTED] [REDACTED] [REDACTED]&y"
    assert one(P.scrubbed(F.lit("open C:\\temp\\x"))) == one(P.scrubbed(F.lit("at (node:12)"))) == "request failed (details redacted)"
    d = {"a": "ok", "stack": "s", "b": ["/etc/passwd", "fine\nline"], "c": {"Cause": 1}, "n": 3, "t": True}
    assert json.loads(one(P.safe_details(F.lit(json.dumps(d))))) == {"a": "ok", "b": ["fine line"], "n": 3, "t": True}
    assert one(P.safe_details(F.lit('["/tmp/x"]'))) is None and one(P.safe_details(F.lit("{broken"))) is None


def test_events_lose_forbidden_fields_at_any_depth(spark):
    raws = [
        '{"id":1,"content":{"a":{"x":1},"b":"SECRET"}}', '{"type":"search","details":{"query":"q","text":"secret, x","n":1},"password":"p","path":"/home/a/b.md"}', "{broken", None,
        '{"a":[["/x/y","//z/y","C:\\\\\\\\d\\\\\\\\e.txt","/ab","http://h/p"],{"token":1,"t":{"secret":[1],"k":null}}]}', '"/root/file"', "3",
    ]
    d = spark.createDataFrame(list(enumerate(raws)), "i long, v string")
    got = [r.x for r in d.select("i", P.bare_event(F.col("v")).alias("x")).orderBy("i").collect()]
    assert [None if g is None else json.loads(g) for g in got] == [{"id": 1}, {"type": "search", "details": {"query": "<redacted>", "n": 1}, "path": "b.md"}, None, None, {"a": [["y", "//z/y", "e.txt", "/ab", "http://h/p"], {"t": {"k": None}}]}, "file", 3]
    assert json.loads(d.where("i = 1").select(P.bare_event(F.col("v"), True).alias("x")).first().x)["details"]["query"] == "q"


def clustered(n=12, seed=1):
    rng = random.Random(seed)
    return [(c, "treatment" if rng.random() < 0.5 else "control", rng.random(), rng.randint(1, 5)) for c in range(n) for _ in range(rng.randint(1, 6))]


def test_resamples_draw_whole_clusters(spark):
    d = spark.createDataFrame(clustered(), "c long, arm string, x double, n long")
    c = I.cluster_sums(d, "c", "x")
    rows = I.resamples(c, 300).collect()
    per = Counter()
    for r in rows:
        per[r.draw] += r.times
    assert set(per.values()) == {12} and len(per) == 300
    times = Counter(r.times for r in rows)
    assert 0.3 < times[1] * 1 / 3600 < 0.44 and max(times) >= 3  # as drawing with replacement gives
    assert {(r.draw, r.cluster, r.times) for r in rows} == {(r.draw, r.cluster, r.times) for r in I.resamples(c.repartition(5), 300).collect()}


def test_bootstraps_match_plain_python(spark):
    data = clustered()
    d = spark.createDataFrame(data, "c long, arm string, x double, n long").withColumn("n", F.col("n").cast("double"))
    drawn = {}
    for r in I.resamples(I.cluster_sums(d, "c", "x"), 200).collect():
        drawn.setdefault(r.draw, []).append((r.cluster, r.times))

    def ends(vs, tail=0.025):
        s = sorted(v for v in vs if v is not None)
        return s[math.floor(tail * (len(s) - 1))], s[math.ceil((1 - tail) * (len(s) - 1))]

    def total(draw, arm, k):
        return sum(t * sum(r[k] for r in data if r[0] == c and r[1] == arm) for c, t in draw)

    def ratio(draw, arm):
        return total(draw, arm, 2) / total(draw, arm, 3) if total(draw, arm, 3) else None

    once = [(c, 1) for c in range(12)]
    for r in I.ratios(d, "c", "arm", "x", "n", 200).collect():
        vs = [ratio(x, r.arm) for x in drawn.values()]
        assert (r.lo, r.hi) == pytest.approx(ends(vs)) and r.estimate == pytest.approx(ratio(once, r.arm)) and r.dropped == vs.count(None)
    gap = lambda x: None if None in (ratio(x, "treatment"), ratio(x, "control")) else ratio(x, "treatment") - ratio(x, "control")
    g = I.ratio_difference(d, "c", "arm", "x", "n", "treatment", "control", 200).first()
    vs = [v for x in drawn.values() if (v := gap(x)) is not None]
    assert (g.lo, g.hi) == pytest.approx(ends(vs)) and g.estimate == pytest.approx(gap(once)) and g.p == pytest.approx((1 + sum(v <= 0 for v in vs)) / (1 + len(vs)))
    means = {c: sum(r[2] for r in data if r[0] == c) / sum(r[0] == c for r in data) for c in range(12)}
    m = I.mean_of_means(d, "c", "x", 200).first()
    vs = [sum(means[c] * t for c, t in x) / 12 for x in drawn.values()]
    assert (m.lo, m.hi) == pytest.approx(ends(vs)) and m.estimate == pytest.approx(sum(means.values()) / 12)


def test_rerandomisation_is_near_the_exact_test(spark):
    ys = [3.1, 2.9, 5.0, 1.2, 0.5, 0.9, 2.2, 1.1]
    arms = ["treatment", "treatment", "treatment", "control", "treatment", "control", "control", "control"]
    blocks = [0, 0, 0, 0, 1, 1, 1, 1]
    gap = lambda t: sum(y for i, y in enumerate(ys) if i in t) / len(t) - sum(y for i, y in enumerate(ys) if i not in t) / (8 - len(t))
    seen = gap({i for i, a in enumerate(arms) if a == "treatment"})
    every = [gap(set(a) | set(b)) for a in itertools.combinations(range(4), 3) for b in itertools.combinations(range(4, 8), 1)]
    exact = sum(abs(g) >= abs(seen) - 1e-12 for g in every) / len(every)
    d = spark.createDataFrame([(i, y, a, b) for i, (y, a, b) in enumerate(zip(ys, arms, blocks))], "unit long, y double, arm string, block long")
    got = I.rerandomised(d, "y", "arm", "block", 3000).first()
    assert got.d == pytest.approx(seen) and got.p == pytest.approx(exact, abs=0.03)


def test_equivalence_test():
    from fractions import Fraction

    def tail(p, xs, n):
        return float(sum(math.comb(n, x) * Fraction(p) ** x * (1 - Fraction(p)) ** (n - x) for x in xs))

    for k, n in ((50, 100), (130, 260), (3, 9), (0, 5), (9, 9)):
        got = I.tost(k, n)
        assert got[1:] == pytest.approx((tail("0.4", range(k, n + 1), n), tail("0.6", range(k + 1), n)), rel=1e-9) and got[0] == (max(got[1:]) < 0.05)
    assert I.tost(5, 10, 0.05, 0.1)[1] == 0.0


def test_small_stats_on_empty_tables(spark):
    d = spark.createDataFrame([], "c long, arm string, x double, n double")
    assert I.mean_of_means(d, "c", "x", 10).collect()[0].clusters == 0 if I.mean_of_means(d, "c", "x", 10).count() else True
    assert I.ratios(d, "c", "arm", "x", "n", 10).count() == 0 and I.robust_mean(d, "c", "x").first()["mean"] is None


def test_nearest_vectors_skip_null_ones(spark):
    from memlode.operators import ranking

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, []), (5, [1.0, 0.0, 0.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "query_id long, vec array<double>")
    assert [(r.query_id, r.id) for r in ranking.knn(v, q, 5).orderBy("rank").collect()] == [(7, 1), (7, 3)]


def test_sealed_rows_open_with_their_key_and_label_only(spark):
    from memlode.operators import lifecycle as L

    d = spark.createDataFrame([(1, "é"), (2, None)], "id long, v string")
    s = L.sealed(d, b"k" * 32, "a/1")
    assert sorted(L.opened(s, b"k" * 32, "a/1", "id long, v string").collect()) == sorted(d.collect())
    for key, label in ((b"x" * 32, "a/1"), (b"k" * 32, "a/2")):
        with pytest.raises(Exception, match="AES|decrypt|tag|Tag"):
            L.opened(s, key, label, "id long, v string").collect()


def test_budget_falls_back_to_the_first_text(spark):
    from memlode.operators import lifecycle as L

    fill = lambda ts, n: spark.range(1).select(L.filled_budget(F.array(*map(F.lit, ts)), F.lit(n), joiner="|").alias("x")).first().x
    assert fill(["aaaa", "bbbbbbbb", "cc"], 7) == "aaaa|cc" and fill(["aaaa", "bb"], 3) == "bb" and fill(["aaaa", "bbbb"], 3) == "aaa" and fill(["a" * 95, "b" * 5], 100) == "a" * 95


def test_reindex_guard(spark):
    from memlode.operators import lifecycle as L

    a = spark.createDataFrame([(f"f{i}", "x") for i in range(10)], "source_file string, fp string")
    with pytest.raises(ValueError):
        L.reindexed(a, a.limit(0))
    assert L.reindexed(a, a.withColumn("fp", F.lit("y"))).count() == 10
