import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memlode.llm import topk as T

KIND = "vec_id long, embedding array<double>, label int, terms string, query_id long"


def plain(rows, k, asks=lambda i: i % 20 == 0):
    """The same by Python integers over all pairs."""
    good = [(i, [max(-(1 << 63), min((1 << 63) - 1, int(np.floor(float(x) * 64)) if abs(x) < 1e300 else (1 << 63) - 1 if x > 0 else -(1 << 63))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in good if i is not None and asks(i)}:
        hits = []
        for vec in {tuple(v) for i, v in good if i == q}:
            hits += [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(vec, w)))), c) for c, w in good if c != q]
        hits.sort(key=lambda h: (-h[0], h[1] is None, h[1] or 0))
        out += [(q, r, c, s) for r, (s, c) in enumerate(hits[:k], 1)]
    return sorted(out)


def found(spark, rows, k=20, **more):
    d = spark.createDataFrame([(i, v, 0, "x", 5) for i, v in rows], KIND).repartition(3)
    v = T.vectors(d)
    return sorted(tuple(r) for r in T.search(v, v.where("vec_id % 20 = 0"), k, **more).collect())


def some_rows(seed, n=160, dim=7):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, 0.0, rng.gauss(0, 1), 0.5]) for _ in range(dim)]) for i in range(n)]
    rows += [(40, None), (60, [1.0, None]), (80, [float("nan")] * dim), (100, [float("-inf"), 1.0]), (120, []), (None, [2.0] * dim), (None, [2.0] * dim)]
    rows += [rows[3], rows[3], rows[20], (20, [0.25] * dim), (20, [0.25] * dim), (7, [9.0] * (dim + 3)), (140, [3.0])]
    return rows


def test_all_pairs(spark):
    rows = some_rows(1)
    want = plain(rows, 20)
    assert found(spark, rows) == want
    assert found(spark, rows, cells=60, block=16) == want  # many blocks of queries and of candidates
    assert found(spark, rows, k=3, block=5) == plain(rows, 3)


def test_ties_and_few_rows(spark):
    rows = [(i, [1.0, 1.0]) for i in range(60)]
    assert found(spark, rows) == plain(rows, 20)
    assert found(spark, [(0, [1.0]), (20, [2.0])]) == [(0, 1, 20, 64 * 128), (20, 1, 0, 64 * 128)]
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(None, None)]) == []


def test_negative_parts_floor_and_large_ones_saturate(spark):
    rows = [(0, [-0.001, 1e17]), (1, [0.99 / 64, 1e17]), (2, [-1.0, -1e300]), (3, [3e9, 3e9]), (20, [1e12, -1e12])]
    assert found(spark, rows) == plain(rows, 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=4, max_size=4), min_size=1, max_size=30), st.integers(1, 9))
def test_partition_selection_is_a_stable_sort(rows, k):
    s = np.array(rows).T.copy()
    q, c = T.select(s, k)
    for j in range(len(s)):
        want = sorted(range(s.shape[1]), key=lambda i: (-s[j, i], i))[:k]
        assert sorted(c[q == j]) == sorted(want)


@pytest.mark.parametrize("density", [0.05, 0.4, 0.9])
@pytest.mark.parametrize("kind", [np.int32, np.int64, object])
def test_accumulated_scores_are_inner_products(density, kind):
    rng = np.random.default_rng(3)
    a, b = (np.where(rng.random((n, 50)) < density, rng.integers(-9, 9, (n, 50)), 0) for n in (33, 71))
    one = lambda m: T.Postings(np.arange(0, m.size + 1, 50), m.ravel())
    got = T.accumulate(one(a).strip(4, 30), 26, one(b), kind)
    assert (got == a[4:30] @ b.T).all()
