"""Extraction routing, references of audits, placebo arms, resampling within strata and simulated power against plain Python."""

import datetime as dt
import math
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from memlode.operators import exposure, extraction, inference, knowledge, power, stats

TEXTS = [
    ("see [x](../entities/people/ana.md) and people/ana, [[projects/q|Q]]", "compiled", "spec", (2, 0, 0)),
    ("people/ana", "compiled", "conversation", (1, 0, 0)),
    ("people/ana", None, "spec", (1, 0, 0)),
    ("nothing", "timeline", None, (0, 0, 0)),
    ("---\nagent: [a, b]\nresolves: 'x'\ntitle: t\n---\nrun src/lib/m.py:12 and src/lib/m.py:12, src/lib/m.py:13", "frontmatter", None, (0, 3, 2)),
    ("`people/ana` in code", "prose", "daily_log", (0, 0, 0)),
    (None, None, None, (0, 0, 0)),
    ("", "compiled", "freeform", (0, 0, 0)),
    ("src/a.ts", "timeline", "freeform", (0, 0, 1)),
]


def test_routes(spark):
    d = spark.createDataFrame([(k, *t[:3], "x") for k, t in enumerate(TEXTS)], "id long, text string, section string, kind string, n_refs string")
    got = {r.id: r for r in extraction.routed(d).collect()}
    assert len(got) == len(TEXTS)
    for k, (_, section, kind, counts) in enumerate(TEXTS):
        n, structured = sum(counts), section in ("compiled", "frontmatter", "timeline")
        skip = structured and n > 0 and kind not in ("conversation", "daily_log", "freeform")
        want = "regex_only" if skip else "gemini_only_after_regex_zero" if n == 0 else "regex_primary_gemini_secondary" if structured else "gemini_only"
        assert ((got[k].n_links, got[k].n_stated, got[k].n_code), got[k].method, got[k].skipped, got[k].n_found) == (counts, want, skip, n)
    assert extraction.routed(d.where("false")).count() == 0


def test_merge_keeps_patterns_first(spark):
    schema = "source string, target string, relation string, place int"
    first = [("A", "b", "uses", 1), ("a", "B", "USES", 0), ("x", None, "uses", 2)]
    second = [("A", "b", "Uses", 0), ("c", "d", "is", 5), ("C", "D", "is", 4), ("X", None, "uses", 0)]
    seen, want = set(), []
    for rows, how in ((first, "regex"), (second, "gemini")):
        for s, t, r, _ in sorted(rows, key=lambda x: x[3]):
            key = tuple(v and v.lower() for v in (s, t, r))
            if key not in seen:
                seen.add(key)
                want.append((s, t, r, how))
    got = extraction.merged(spark.createDataFrame(first, schema), spark.createDataFrame(second, schema))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) == 3


def test_reference_ids(spark):
    cases = [("[1, 2,\n30]", [1, 2, 30]), ("[]", None), ('["1"]', None), ("[1.5]", None), ("[0]", None), ("[-1]", None), ("[1,]", None), ("{}", None), ("", None), (None, None), (" [7] ", [7]), ("[1 2]", None), ("[99999999999999999999]", None), ("[[1]]", None), ("[" + ",".join(["5"] * 30000) + "]", [5] * 30000)]
    d = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, j string")
    assert [r.v for r in d.select("k", knowledge.reference_ids(F.col("j")).alias("v")).orderBy("k").collect()] == [w for _, w in cases]


def test_audit_references(spark):
    rng = random.Random(5)
    one = lambda: rng.choice([None, *range(12)])
    audits = [(k, one(), rng.choice([None, [], [rng.randrange(12) for _ in range(rng.randint(1, 6))]]), one()) for k in range(200)]
    relations, entities = [1, 2, 3, 5, 8, 8], [0, 1, 2, 3, 4]
    ids = lambda v: spark.createDataFrame([(x,) for x in v], "id long")
    d = spark.createDataFrame(audits, "audit_id long, subject_id long, targets array<long>, picked_id long")
    got = {r.audit_id: (r.valid, r.missing_subject, r.missing_targets, r.missing_picked) for r in knowledge.audit_references(d.repartition(3), ids(relations), ids(entities)).collect()}
    for k, subject, targets, picked in audits:
        ms, mt, mp = subject not in entities, [t for t in targets or [] if t not in relations], picked is not None and picked not in relations
        assert got[k] == (not (ms or mt or mp), ms, mt, mp)
    assert len(got) == 200
    assert knowledge.audit_references(d.limit(3), ids([]), ids([])).where("valid").count() == 0
    assert knowledge.audit_references(d.where("false"), ids([1]), ids([1])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_placebo_arms(spark, seed):
    rng = random.Random(seed)
    at = lambda s: None if s is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    groups = ["a", "a", "a", "b", "c"]
    briefs = [(g, b, at(s), i) for g in "abd" for b, s in ((b, rng.choice([50, 500, 40_000, rng.randrange(90_000)])) for b in range(12)) for i in [rng.choice([*range(15), None]) for _ in range(4)]]
    messages = [(m, rng.choice(groups + [None]), at(rng.choice([50, 500, None, rng.randrange(99_000), rng.randrange(99_000)]))) for m in range(120)]
    hits = sorted({(rng.randrange(125), rng.randrange(16)) for _ in range(900)})
    want = {}
    for m, g, ts in messages:
        own = sorted({(t, b) for h, b, t, i in briefs if h == g and i is not None})
        now = [o for o in own if ts is not None and o[0] <= ts]
        if not now:
            continue
        items = lambda keep: {i for h, b, t, i in briefs if h == g and i is not None and keep((t, b))}
        cur = items(lambda o: o == now[-1])
        past = items(lambda o: o < now[-1]) - cur
        future = items(lambda o: o > now[-1]) - cur - past
        for arm, members in (("exposed", cur), ("past", past), ("future", future)):
            n, h = want.get((g, arm), (0, 0))
            want[g, arm] = (n + len(members), h + sum((m, i) in hits for i in members))
    got = exposure.placebo_arms(spark.createDataFrame(messages, "msg_id long, grp string, ts timestamp"), spark.createDataFrame(briefs + briefs[:9], "grp string, brief_id long, ts timestamp, item_id long"), spark.createDataFrame(hits + hits[:5], "msg_id long, item_id long"))
    assert {(r.grp, r.arm): (r.pairs, r.hits) for r in got.collect()} == want
    assert len(want) == 6 and all(h > 0 for _, h in want.values())


def uniform(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64(struct.pack("<q", p), seed=h).intdigest()
    return (h % (1 << 53)) / float(1 << 53)


def test_resamples_within_strata(spark):
    rng = random.Random(3)
    data = [(s, c, float(rng.randint(0, 3)), float(rng.choice([0, 0, 1, 2]))) for s, n in (("p", 5), ("q", 1), (None, 3)) for c in range(n) for _ in range(3)]
    d = spark.createDataFrame(data, "s string, c long, x double, y double")
    keys = sorted({(s, c) for s, c, *_ in data}, key=lambda k: (k[0] is not None, k[0] or "", k[1]))
    total = {k: [sum(r[i] for r in data if r[:2] == k) for i in (2, 3)] for k in keys}
    values = []
    for draw in range(80):
        x = y = 0.0
        for s in ("p", "q", None):
            own = [i for i, k in enumerate(keys) if k[0] == s]
            for place in range(1, len(own) + 1):
                k = keys[own[0] + math.floor(uniform(42, own[0], draw, place) * len(own))]
                x, y = x + total[k][0], y + total[k][1]
        values.append(x / y if y else None)
    r = inference.stratified_ratio(d.repartition(4), "s", "c", "x", "y", 80).first()
    known = sorted(v for v in values if v is not None)
    tail = 0.025
    assert (r.lo, r.hi) == pytest.approx((known[math.floor(tail * (len(known) - 1))], known[math.ceil((1 - tail) * (len(known) - 1))]))
    assert r.estimate == pytest.approx(sum(t[0] for t in total.values()) / sum(t[1] for t in total.values()))
    assert (r.strata, r.clusters, r.n, r.dropped) == (2, 9, len(known), values.count(None))


def test_power_is_the_simulation(spark):
    rng = random.Random(9)
    pilot = [(u, [round(rng.gauss(u, 0.2), 3) for _ in range(rng.choice([2, 3, 4]))]) for u in range(9)]
    sizes, grid, sims, draws, alpha, seed = [3, 0, 2, 4], [0.0, 0.4, 1.0], 12, 60, 0.05, 7

    def two(values, a, b):
        i, j = math.floor(a * len(values)), math.floor(b * (len(values) - 1))
        return values[i], values[j + (j >= i)]

    want = {}
    for q in grid:
        deltas, found = [], 0
        for sim in range(sims):
            means = []
            for cluster, size in enumerate(s for s in sizes if s):
                each = []
                for place in range(1, size + 1):
                    u = lambda k: uniform(seed, sim, cluster, place, k)  # noqa: B023, E731
                    base, other = math.floor(u(0) * 9), math.floor(u(1) * 8)
                    second = other + (other >= base) if u(2) < q else base
                    arms = [two(pilot[base][1], u(3), u(4)), two(pilot[second][1], u(5), u(6)), two(pilot[base][1], u(7), u(8))]
                    each.append(sum(abs(x - y) for x in arms[0] for y in arms[1]) / 4 - sum(abs(x - y) for x, y in arms) / 3)
                means.append(sum(each) / len(each))
            low = sum(sum(means[math.floor(uniform(seed, sim, d, p) * len(means))] for p in range(1, len(means) + 1)) <= 0 for d in range(1, draws + 1))
            deltas.append(sum(means) / len(means))
            found += (1 + low) / (1 + draws) < alpha
        want[q] = (sum(deltas) / sims, found / sims)
    extra = [(90, [1.0]), (91, None), (None, [1.0, 2.0])]
    d = spark.createDataFrame(pilot + extra, "unit long, values array<double>")
    curve = power.power_curve(d.repartition(3), lambda a, b: F.abs(a - b), sizes, grid, sims, draws, alpha, seed)
    got = {r.q: (r.mean_delta, r.power) for r in curve.collect()}
    assert set(got) == set(grid) and all(got[q] == pytest.approx(want[q]) for q in grid)
    assert got[0.0][1] < 0.4 < got[1.0][1] and got[1.0][0] > got[0.0][0] + 0.5
    assert power.least_detectable(curve, want[1.0][1]).first().effect == pytest.approx(min(m for m, p in want.values() if p >= want[1.0][1]))
    assert power.least_detectable(curve, 1.1).first().effect is None
    with pytest.raises(ValueError):
        power.power_curve(d.where("unit = 1"), lambda a, b: F.abs(a - b), sizes, grid)


def test_regrets(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice(["a", "b", "c", None]), rng.choice([True, True, False, None]), rng.choice([None, *map(float, range(9))]), float(rng.randint(3, 20))) for k in range(60)] + [(100 + k, "few", True, 1.0, 1.0) for k in range(4)] + [(200 + k, "blank", True, None, 2.0) for k in range(5)]
    d = spark.createDataFrame(rows, "id long, s string, ok boolean, x double, y double")
    got = {r.id: (r.regret_x, r.regret_y) for r in stats.regrets(d.repartition(3), "s", F.col("ok"), ["x", "y"]).collect()}
    want = {}
    for i, s, _, x, y in rows:
        good = [r for r in rows if r[1] == s and r[2]]
        if len(good) >= 5:
            known = [r[3] for r in good if r[3] is not None]
            want[i] = (None if x is None or not known else max(0.0, x - min(known)), max(0.0, y - min(r[4] for r in good)))
    assert got == want and 100 not in got and got[200] == (None, 0.0)
