"""Operators in rounds and assignment against plain Python."""

import random
import re
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from memlode.operators import assignment as A
from memlode.operators import rounds as O
from memlode.operators.stats import HashStream


def test_rename_closure(spark):
    rng = random.Random(1)
    order = list(range(70))
    rng.shuffle(order)
    pairs = [(f"n{order[k]}", f"n{order[k + 1]}") for k in range(39)] + [(f"n{a}", f"m{a % 4}") for a in order[45:]] + [("n1", ""), ("", "x"), (None, "y"), ("z", None)]
    last = {}
    for a, b in pairs:
        if a and b:
            last[a] = max(b, last.get(a, ""))
    want = {}
    for a in last:
        at, hops = a, 0
        while at in last:
            at, hops = last[at], hops + 1
        want[a] = (at, hops)
    d = spark.createDataFrame(pairs, "old string, new string")
    assert {r.old: (r.final, r.hops) for r in O.rename_closure(d).collect()} == want and max(h for _, h in want.values()) == 39
    assert O.rename_closure(d.where("false")).count() == 0
    for circle in ([("a", "b"), ("b", "c"), ("c", "b")], [("a", "a")], [(f"c{k}", f"c{(k + 1) % 5}") for k in range(5)]):
        with pytest.raises(ValueError, match="circular"):
            O.rename_closure(spark.createDataFrame(circle, "old string, new string")).count()


def test_rewritten(spark):
    renames = [("old-name", "new-name"), ("new-name", "last.name"), ("Paper", "paper-two"), ("a.b", "ab")]
    texts = [
        "see [the page](docs/old-name.md) and [[old-name#part|label]], old-name.", "x-old-name y old-name-z", "[[new-name]] Paper; paper (a.b) axb", None, "", "line\nold-name\n(old-name)", "[[old-name", "nothing",
    ]
    want = [
        "see [the page](docs/last.name.md) and [[last.name#part|label]], last.name.", "x-old-name y old-name-z", "[[last.name]] paper-two; paper (ab) axb", None, "", "line\nlast.name\n(last.name)", "[[old-name", "nothing",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: (r.text, r.changed) for r in O.rewritten(d, spark.createDataFrame(renames, "old string, new string")).collect()}
    assert got == {k: (w, w != t) for k, (t, w) in enumerate(zip(texts, want))}


def test_diverse_choice(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), k, [rng.choice("pqrstuvw") for _ in range(rng.randint(0, 6))]) for k in range(40)] + [("c", 50, None), ("c", 51, ["p"])]
    d = spark.createDataFrame(rows, "grp string, id long, tokens array<string>")
    turn = {r.id: r.t for r in d.select("id", F.xxhash64(F.lit(42), "grp", "id").alias("t")).collect()}
    want = []
    for g in ("a", "b", "c", None):
        own = {i: set(t or []) for grp, i, t in rows if grp == g}
        chosen = []
        while own and len(chosen) < 6:
            share = lambda x, y: len(x & y) / max(1, len(x | y))
            worst = {i: max((share(t, c) for _, c in chosen), default=0.0) for i, t in own.items()}
            best = min(own, key=lambda i: (worst[i], turn[i], i))
            want.append((g, len(chosen) + 1, best, round(worst[best], 9)))
            chosen.append((best, own.pop(best)))
    got = [(r.grp, r.place, r.id, round(r.overlap, 9)) for r in O.diverse_choice(d, 6).collect()]
    key = lambda r: (r[0] or "", r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert O.diverse_choice(d.where("false"), 3).count() == 0


def test_iterated_stops_by_each_rule(spark):
    """Chunks are numbers; a question finds the chunks its text names, and its next text is a table's."""
    script = {
        1: [("1 2 3", [1.0, 0.0]), ("4 5", [0.0, 1.0]), ("6", [0.5, 0.5])],  # runs on to the last round
        2: [("1 2", [1.0, 0.0]), ("1 2", [0.0, 1.0])],  # finds the same again
        3: [("7", [1.0, 0.0]), ("8", [2.0, 0.1])],  # asks almost the same
        4: [("", [1.0, 0.0])],  # finds nothing
        5: [("9", [1.0, 0.0])],  # has no next question
        6: [("1 2 3 4 5", [1.0, 0.0]), ("1 2 3 4 6", [0.0, 1.0])],  # four of five known
    }
    rows = [(q, n, t, v) for q, steps in script.items() for n, (t, v) in enumerate(steps, 1)]
    table = spark.createDataFrame(rows, "query_id long, n int, text string, vec array<double>")
    found = F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("p", "w")
    search = lambda asked: asked.select("query_id", found).select("query_id", F.col("w").cast("long").alias("id"), (F.col("p") + 1).alias("rank"))
    count = iter(range(2, 9))
    follow = lambda active, evidence: table.where(F.col("n") == next(count)).join(active.select("query_id"), "query_id").select("query_id", "text", "vec")
    evidence, ends = O.iterated(table.where("n = 1"), search, follow, rounds=3)
    assert {r.query_id: (r.rounds, r.reason) for r in ends.collect()} == {1: (3, "max_rounds"), 2: (2, "chunk_overlap"), 3: (1, "query_similarity"), 4: (1, "no_results"), 5: (1, "no_question"), 6: (2, "chunk_overlap")}
    got = sorted((r.query_id, r["round"], r.id) for r in evidence.collect())
    assert got == [(1, 1, 1), (1, 1, 2), (1, 1, 3), (1, 2, 4), (1, 2, 5), (1, 3, 6), (2, 1, 1), (2, 1, 2), (3, 1, 7), (5, 1, 9), (6, 1, 1), (6, 1, 2), (6, 1, 3), (6, 1, 4), (6, 1, 5), (6, 2, 6)]


def roundings(rows, columns):
    n = sum(rows)
    cells = [[sorted({a * b // n, -(-a * b // n)}) for b in columns] for a in rows]
    for flat in product(*[c for r in cells for c in r]):
        t = [flat[i * len(columns) : (i + 1) * len(columns)] for i in range(len(rows))]
        if [sum(r) for r in t] == rows and [sum(c) for c in zip(*t)] == columns:
            yield tuple(t)


@pytest.mark.parametrize(("rows", "columns"), [([5, 4, 3], [4, 4, 4]), ([3, 3], [1, 2, 3]), ([4, 2, 1, 1], [3, 5]), ([6, 6], [6, 6])])
def test_controlled_rounding_is_uniform(rows, columns):
    every = set(roundings(rows, columns))
    got = Counter(tuple(map(tuple, A.controlled_rounding(rows, columns, HashStream(f"s{k}")))) for k in range(60 * len(every)))
    assert set(got) == every
    assert all(25 < c < 105 for c in got.values()) or len(every) == 1


def test_assignment(spark):
    rng = random.Random(3)
    units = [(k, rng.choice(["a", "a", "a", "b", "c", None])) for k in range(600)]
    shares = {"control": 3, "low": 1, "middle": 1, "high": 1}
    d = spark.createDataFrame(units, "unit long, stratum string")
    got = {r.unit: (r.stratum, r.arm) for r in A.assigned(d.repartition(5), shares, "x").collect()}
    assert len(got) == 600 and all(got[u][0] == s for u, s in units)
    assert Counter(a for _, a in got.values()) == {"control": 300, "low": 100, "middle": 100, "high": 100}
    sizes, cells = Counter(s for _, s in units), Counter(got.values())
    for (s, m), (a, n) in product(sizes.items(), {"control": 300, "low": 100, "middle": 100, "high": 100}.items()):
        assert abs(cells[s, a] - n * m / 600) < 1
    assert got == {r.unit: (r.stratum, r.arm) for r in A.assigned(d, shares, "x").collect()}
    other = {r.unit: (r.stratum, r.arm) for r in A.assigned(d, shares, "y").collect()}
    assert sum(got[u] != other[u] for u in got) > 200
    assert A.assigned(d.where("false"), shares, "x").count() == 0


def test_no_arm_depends_on_the_order_of_units():
    by = defaultdict(set)
    for k in range(40):
        for i, r in enumerate(A.controlled_rounding([7, 5], [4, 4, 4], HashStream(str(k)))):
            by[i].add(tuple(r))
    assert len(by[0]) == 3 and not re.search("-", str(by))
