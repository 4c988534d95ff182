import math
import random
import re
from collections import Counter

import regex
from pyspark.sql import functions as F

from memlode.llm import pii
from tests.llm.util import documents, no_documents

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    vals = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(v - 9 * (v > 9) for v in vals) % 10 == 0


def spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_spans_match_the_plain_patterns(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "a@b", "@", ".", "..", "1", "255", "256", "+1", "+", " ", "-", "(", ")", "4111111111111111", "4111 1111 1111 1111", "0000000000000", "x", "é", "😀", "12345", "5.6", "a.b-c+d%e_f", "\n", "1.2.3.4", "99"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(1500)] + ["a@b.c+d@e.f", "1.2.3.4.5.6.7.8", "+1 2 3(4)5 6 7 8 9-", "0001.002.3.0255", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(d).collect():
        base = ",".join(s for s in r.spans.split(",") if not s.startswith(("term", "secret")))
        assert base == spans(texts[r.doc_id]), texts[r.doc_id]


def test_long_runs_neither_hang_nor_overflow(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "a@b" + ".c" * 60_000, "+1" + "(" * 200_000, "1." * 100_000]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[3].spans == f"email:0:{len(texts[3])}" and got[1].n_card == got[2].n_card == 0


def corpus(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(400)]
    docs += [(1000 + i, " ".join(word() for _ in range(60)) + " Quarkington wrote from q.ark@example.org today " + " ".join(word() for _ in range(20))) for i in range(6)]
    docs += [(2000, "only Quarkington is named here " + word())]
    docs += [(3000 + i, "copy with c.opy@example.org and " + " ".join(f"peculiar{j}" for j in "abcdefghi")) for i in range(50)]
    docs += [(4000 + i, "today wrote from " + " ".join(word() for _ in range(9))) for i in range(200)]
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_disclosing_terms(spark):
    got = {r.doc_id: r.spans for r in pii.find(corpus(spark)).collect()}
    assert re.fullmatch(r"term:5:16", got[2000])
    assert all("term:" in got[1000 + i] and "email:" in got[1000 + i] for i in range(6))
    assert all("term:" not in got[3000 + i] for i in range(50))  # copies are one observation
    assert all(got[i] == "" for i in range(400)) and all(got[4000 + i] == "" for i in range(200))


def long_texts(spark, copies=0):
    """Long unrelated texts over one vocabulary; six of them, one perhaps with many copies, hold an address and a name."""
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(2000)]
    text = lambda: " ".join(rng.choices(vocab, k=1500))
    docs = [(i, text()) for i in range(150)] + [(1000 + i, text() + " Quarkington wrote from q.ark@example.org") for i in range(6)]
    docs += [(2000 + i, docs[150][1]) for i in range(copies)] + [(3000, "Quarkington alone")]
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_unrelated_long_texts_are_separate_observations(spark):
    got = {r.doc_id: r.spans for r in pii.find(long_texts(spark)).collect()}
    assert got[3000] == "term:0:11" and all("term:" in got[1000 + i] for i in range(6)) and all(got[i] == "" for i in range(150))


def test_many_copies_do_not_outweigh_other_texts(spark):
    got = {r.doc_id: r.spans for r in pii.find(long_texts(spark, copies=300)).collect()}
    assert got[3000] == "term:0:11" and all("term:" in got[i] for i in (*range(1000, 1006), *range(2000, 2300)))


def test_near_copies_are_one_observation(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    base = [word() for _ in range(300)]
    docs = [(i, " ".join([*base[: 20 * i], word(), *base[20 * i + 1 :], "n.ear@example.org"])) for i in range(12)]
    docs += [(100 + i, " ".join(word() for _ in range(60))) for i in range(100)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert pii.near_classes(d).count() == 11 and all("term:" not in r.spans for r in pii.find(d).collect())


def test_loose_copies_are_no_witnesses_of_their_value(spark):
    """A third of the words changed in each: too unlike for the common bands, but they hold one number."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    base = [word() for _ in range(200)]
    docs = []
    for i in range(12):
        own = list(base)
        for at in range(rng.randrange(17), 200, 17):
            own[at] = word()
        docs.append((i, " ".join([*own, "+1 555 123 4567"])))
    docs += [(100 + i, " ".join(word() for _ in range(60))) for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert all("term:" not in r.spans for r in pii.find(d).collect())


def test_sanitised_text(spark):
    d = corpus(spark).withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r for r in pii.sanitise(d).collect()}
    assert "Quarkington" not in got[2000].text and "Quarkington" not in got[1000].text and "<EMAIL>" in got[1000].text
    assert got[1000].n_chars == len(got[1000].text) and len(got) == d.count()
    same = {r.doc_id: r.text for r in d.collect()}
    assert all(got[i].text == same[i] for i in range(400))


def test_terms_inside_addresses_leave_no_part_of_them(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(300)]
    docs += [(1000 + i, " ".join(word() for _ in range(60)) + " Quark of Wumbo and Email wrote from quark@wumbo.com today") for i in range(6)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for options in ({}, {"removes": 2.0}):
        for r in pii.sanitise(d, **options).where("doc_id >= 1000").collect():
            assert "<EMAIL>" in r.text and not re.search("quark|wumbo|@|<<|>>", r.text.lower()), r.text
    for r in pii.find(d).where("doc_id >= 1000").collect():
        at = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",")]
        assert len(at) > 2 and all(t <= at[0][0] or a >= at[0][1] for a, t in at[1:])


def test_terms_of_any_form(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    names = ["jdoe42", "AB-1234", "Smith-Jones", "O'Brien", "李明", "Ame\u0301lie", "a.b*c(d", "Smith", "x\\Ey", "44017"]
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(300)]
    docs += [(1000 + i, " ".join(word() for _ in range(60)) + " [" + "], (".join(names) + "), q.ark@example.org +1 (555) 123-4567") for i in range(6)]
    docs += [(2000 + i, f"«{n}», {word()}") for i, n in enumerate(names)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(d).collect()}
    assert all(got[2000 + i] == f"term:1:{1 + len(n)}" for i, n in enumerate(names)) and all(got[i] == "" for i in range(300))
    assert got[1000].count("term:") == len(names)
    clean = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert all(clean[2000 + i] == t.replace(n, "<TERM>") for i, (n, (_, t)) in enumerate(zip(names, docs[-len(names) :])))
    assert clean[1000].endswith("<EMAIL> <PHONE>") and not any(n in clean[1000] for n in names)


def brute_terms(texts):
    """The terms and whether they are removed, for unrelated texts: every text is a class of its own."""
    held, words = [], []
    for t in texts:
        got, bare = set(), t
        for kind, p in PLAIN.items():
            for m in re.finditer(p, t):
                v, d = m.group().lower(), re.sub("[^0-9]", "", m.group())
                if f"{kind}:{m.start()}:{m.end()}" not in spans(t):
                    continue
                own = {"email": ["@" + v.split("@")[-1], *re.findall("^[^@a-z]*([a-z]{3,})[^@]*@", v)], "ip": [v.rsplit(".", 1)[0]], "card": [d[:6]], "phone": [d[:-7]]}[kind]
                got |= {"any", f"{kind} {v}", *(f"{kind} {i} {x}" for i, x in enumerate(own))}
                bare = bare.replace(m.group(), " ")
        for m in re.findall("[A-Za-z0-9_-]{32,}", bare):
            if len(set(m)) >= 8 and re.search("[0-9]", m) and re.search("[A-Za-z]", m):
                got |= {"any", m}
                bare = bare.replace(m, " ")
        held.append(got)
        words.append({w for x in bare.split() if (w := re.sub(r"^[\W_]+|[\W_]+$", "", x).lower())})
    total, n_t = len(texts), Counter(w for ws in words for w in ws)
    n_c = {c: n for c, n in Counter(c for h in held for c in h).items() if 3 <= n < total}
    both = Counter((c, w) for h, ws in zip(held, words) for c in h if c in n_c for w in ws)
    both = {k: n for k, n in both.items() if n >= 3}
    out = {}
    for (c, w), n in both.items():
        expected = n_c[c] * n_t[w] / total
        share = math.log2(n * total / (n_c[c] * n_t[w])) / math.log2(total / n_c[c])
        if share >= 0.85 and n > expected and n * math.log(n / expected) - n + expected >= math.log(len(both) / 0.05):
            out[w] = out.get(w, False) or share >= 0.97
    return out


def test_terms_match_brute_force(spark):
    rng = random.Random(21)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(600)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs = [text(80) for _ in range(400)]
    for i in range(40):
        docs[i].append(f"{rng.choice(vocab)}.{i}@mail{i % 4}.example.org")
        docs[i] += [f"desk{i % 4}"] * (i % 9 > 0) + ["contact:"]
    for i in range(30, 60):
        docs[i] += ["token", "=", '"' + "".join(rng.choices("0123456789abcdef", k=40)) + '"']
    for i in range(60, 75):
        docs[i] += [f"10.2.{i % 3}.{i}", f"(host{i % 3})", f"+{i % 3} 555 {i}00 1234"]
    for i in range(100, 108):
        docs[i] += ["contact", "desk1"]
    for d in docs:
        rng.shuffle(d)
    texts = [" ".join(d) for d in docs]
    want = brute_terms(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.near_classes(d).isEmpty()
    got = {r.term: r.removed for r in pii.disclosing_terms(d, pii.scan(d)).select("term", "removed").distinct().collect()}
    assert got == want and {"token", "host1"} <= set(want) and not set(vocab) & set(want)
    rows = {r.doc_id: r for r in pii.find(d).collect()}
    for i, t in enumerate(texts):
        hit = sum(re.sub(r"^[\W_]+|[\W_]+$", "", w) in want for w in t.split())
        assert (rows[i].n_term, rows[i].n_secret) == (hit, int(30 <= i < 60)) and rows[i].n_spans == len([s for s in rows[i].spans.split(",") if s])


def test_words_of_a_text(spark):
    """Terms are the words at white space, without what is no letter, mark or digit at their ends, lower-cased."""
    rng = random.Random(2)
    bits = ["a", "B", "é", "1", "e\u0301", "李", ".", "-", "'", " ", "  ", "\n", "\t", pii.FILL, "(", "\xa0", "😀"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(1500)] + ["!" * 2_000, "! " * 1_000, "a" + "." * 2_000 + "b", ""]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in d.select("text", pii.terms_of(F.col("text")).alias("ws")).collect():
        want = {w for x in re.split(f"[ \t-\r{pii.FILL}]+", r.text) if (w := regex.sub(r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", "", x).lower())}
        assert set(r.ws) == want and len(r.ws) == len(want), r.text[:80]
    long = spark.createDataFrame([("!" * 300_000,), ("! " * 300_000,), ("a" + "." * 300_000 + "b",)], "text string")
    assert [len(r.ws) for r in long.select(pii.terms_of(F.col("text")).alias("ws")).collect()] == [0, 0, 1]


def test_secrets(spark):
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    texts = [f'token = "{key}".', f"{key[:31]} short", "a1" * 40, "x" * 40, "9" * 40, f"{key}@example.org", f"AKIA-{key}_z"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(d).collect()}
    assert [got[i] for i in range(7)] == ["secret:9:49", "", "", "", "", "email:0:52", "secret:0:47"]
    clean = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert clean[0] == 'token = "<SECRET>".' and clean[5] == "<EMAIL>" and clean[2] == texts[2]


def test_awkward_rows(spark):
    d = documents(spark)
    out = pii.find(d).collect()
    assert len(out) == d.count()
    one = next(r for r in out if r.doc_id == 11 and r.spans)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 1, 1)
    clean = pii.sanitise(d)
    assert clean.columns == d.columns and clean.count() == d.count()
    text = [r.text for r in clean.collect() if r.doc_id == 11 and "mail" in r.text][0]
    assert text == "mail me at <EMAIL> or <PHONE>, card <CARD>, ip <IP>"
    assert pii.find(no_documents(spark)).count() == 0 and pii.sanitise(no_documents(spark)).count() == 0
