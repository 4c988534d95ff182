import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from memlode.llm import divergence as D
from tests.llm.util import documents, no_documents

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)


@pytest.mark.parametrize("digest", [xxhash.xxh64_intdigest, lambda b: len(b) % 3, lambda b: 7])
def test_counts_whatever_the_hash(digest):
    """With hashes that collide, the verification by bytes keeps terms apart."""
    rng = random.Random(2)
    texts = ["".join(rng.choices("abAB é漢1. \n", k=rng.randint(0, 60))) for _ in range(80)] + ["", "ab", "AB", "x" * 5000]
    groups = np.array([k % 3 for k in range(len(texts))])
    n, docs = Counter(), Counter()
    for k, t in enumerate(texts):
        own = [lower(w) for w in TERM.findall(t)]
        n.update((k % 3, w) for w in own)
        docs.update({(k % 3, w) for w in own})
    g, terms, total, having = D.counted(*buffers(texts), groups, digest)
    keys = [(a, b.decode()) for a, b in zip(g.tolist(), terms)]
    assert dict(zip(keys, total.tolist())) == n and dict(zip(keys, having.tolist())) == docs and len(keys) == len(n)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abZ é漢1. \n\x00\x7f"), max_size=12), max_size=6))
def test_tokens_are_those_of_the_pattern(texts):
    raw, offsets = buffers(texts)
    data = D.LOWER[raw]
    begin, end, text = D.boundaries(data, offsets)
    got = [(int(t), data[a:b].tobytes().decode()) for a, b, t in zip(begin, end, text)]
    assert got == [(k, lower(w)) for k, t in enumerate(texts) for w in TERM.findall(t)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=20), st.integers(1, 15))
def test_pieces_cover_all(sizes, most):
    got = list(D.pieces(np.array(sizes, np.int64), most))
    assert [k for a, b in got for k in range(a, b)] == list(range(len(sizes)))
    assert all(b - a == 1 or sum(sizes[a:b]) <= most for a, b in got)


def test_shares_are_exact():
    rng = random.Random(1)
    for top in (10, 10**6, 10**12, 10**14):
        for _ in range(200):
            n, v = rng.randint(0, top), rng.randint(1, 10**5)
            c = rng.randint(0, n)
            assert D.share(np.array([c]), np.array([n]), v)[0] == 1 + 10**9 * (c + 5) // (n + 5 * v)


def test_reduceat_sums_equal_dense_ones():
    rng = np.random.default_rng(0)
    dense = np.where(rng.random((9, 40)) < 0.3, rng.integers(10, 99, (9, 40)), 0)
    dense[4] = 0
    absent = rng.integers(1, 30, 9)
    rows, terms = np.nonzero(dense)
    whole = np.where(dense > 0, dense, absent[:, None])
    got = np.stack(list(D.pairwise(np.searchsorted(rows, np.arange(10)), terms, dense[rows, terms], absent, 40)))
    assert (got == np.abs(whole[:, None] - whole[None]).sum(axis=2)).all()


def plain(rows, least, ranks=50):
    rows = [(lang or "", source or "", text or "") for lang, source, text in rows]
    docs, n, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, text in rows:
        groups[lang].add(source)
        own = [lower(w) for w in TERM.findall(text)]
        docs.update({(lang, w) for w in own})
        n.update((lang, source, w) for w in own)
    out = []
    for lang, sources in groups.items():
        kept = [w for (g, w), k in docs.items() if g == lang and k >= least]
        v = len(kept)
        total = {s: sum(n[lang, s, w] for w in kept) for s in sources}
        p = {s: {w: 1 + 10**9 * (n[lang, s, w] + 5) // (total[s] + 5 * v) for w in kept} for s in sources}
        q = {w: 1 + 10**9 * (sum(n[lang, s, w] for s in sources) + 5) // (sum(total.values()) + 5 * v) for w in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[t][w]) for w in kept), t) for t in sources if t != s]
            terms = [(p[s][w] - q[w], w) for w in kept if n[lang, s, w] > 0 and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, x, r) for r, (x, item) in enumerate(items, 1) if part == "pair" or r <= ranks]
    return sorted(out)


def found(docs, **more):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in D.divergences(D.term_counts(docs), **more).collect())


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_whole_operator(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "PIECE", 500)
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("Sun", "moon", "é", "漢", "STAR", "ß") for b in ("", "light", "Å", "x1y")]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "é"]), rng.choice([" ", ".", "7\n"]).join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(200)]
    rows += [("xx", "only", "no kept term here"), ("xx", "other", None), ("yy", "s", ""), rows[0], rows[0]]
    d = spark.createDataFrame([(k, t, lang, s, 1, "z", 2) for k, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string, docs long").repartition(3)
    assert found(d, least=10) == plain(rows, 10)
    assert found(d, least=10, ranks=2) == plain(rows, 10, 2)


def test_awkward_documents(spark):
    rows = [(r.lang, r.source, r.text) for r in documents(spark).collect()]
    assert found(documents(spark), least=2) == plain(rows, 2)
    assert found(documents(spark)) == plain(rows, 30)
    assert found(no_documents(spark)) == []
