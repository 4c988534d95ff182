"""Names in texts, attribution by substring and dates, against plain Python."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlode.functions import dates
from memlode.operators import dictionary as O


def some_texts(rng, n=60):
    syl = ["ab", "b", "ca", "é", "x1", " ", "-", ".", "A", "d e"]
    return [(i, None if i % 17 == 0 else "".join(rng.choices(syl, k=rng.randint(0, 40)))) for i in range(n)]


NAMES = ["ab", "abb", " bca ", "BCA", "é", "d e", "x1", None, "", "  ", "caab", "b", "a", "zz"]


@pytest.mark.parametrize("block", [1 << 20, 70])
def test_occurrences(spark, block):
    rows = some_texts(random.Random(1))
    t = spark.createDataFrame(rows, "id long, text string").repartition(3).selectExpr("*", "1 as name", "2 as start")
    got = sorted(tuple(r) for r in O.occurrences(t, spark.createDataFrame([(n, 1) for n in NAMES], "name string, id int"), block_bytes=block).collect())
    names = {n.strip().lower() for n in NAMES if n and n.strip()}
    want = []
    for i, text in rows:
        low = (text or "").lower()
        for n in names:
            for at in range(len(low)):
                if low.startswith(n, at):
                    want.append((i, n, at, at + len(n), low[at - 1 : at] if at else "", low[at + len(n) : at + len(n) + 1]))
    assert got == sorted(want) and len(want) > 300


def greedy(text, names):
    """Longest first over the text itself; covered characters become a mark that no name has."""
    found = []
    for n in sorted(names, key=lambda n: (-len(n), n)):
        if n in text:
            found.append(n)
            text = text.replace(n, "\x00" * len(n))
    return sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 70])
def test_longest_first(spark, block):
    rows = some_texts(random.Random(2), 80)
    t = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = {r.id: r for r in O.query_entities(t, spark.createDataFrame([(n,) for n in NAMES], "name string"), block_bytes=block).collect()}
    names = {n.strip().lower() for n in NAMES if n and n.strip()}
    for i, text in rows:
        assert got[i].entities == greedy((text or "").lower(), names) and got[i].n == len(got[i].entities) and got[i].method == "known"
    assert O.query_entities(t.where("false"), t.selectExpr("text as name")).count() == 0


def test_without_a_dictionary_names_are_guessed(spark):
    said = ["ask Ana Maria about \"memory log\" and 'the store'", "nothing here", None, "", "Toto saw Toto and Éva", "xÉva Rio"]
    t = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    none = spark.createDataFrame([("",), (None,)], "name string")
    got = {r.id: (r.n, r.entities, r.method) for r in O.query_entities(t, none).collect()}
    assert got[0] == (3, ["Ana Maria", "memory log", "the store"], "guessed") and got[1] == got[2] == got[3] == (0, [], "guessed")
    assert got[4][1] == ["Toto"] and got[5][1] == ["Éva Rio"]  # an accented capital begins a name only after a letter, as \b has it


def test_mentions_by_boundary_and_count(spark):
    rng = random.Random(4)
    ents = [(k, n, rng.randint(0, 5)) for k, n in enumerate(["ab", "ca", "x1x", "bca", "d e", "éé", "abb", "cab", "b", "bab"])]
    rows = [(i, "".join(rng.choices(["ab", "ca", "x1x", "d e", " ", "-", "B", "éé"], k=rng.randint(1, 14)))) for i in range(80)]
    t, e = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(ents, "entity_id long, name string, mention_count int")
    got = sorted(tuple(r) for r in O.mentions(t, e, least=2, most=2).collect())
    want = []
    for i, text in rows:
        own = [(-c, k) for k, n, c in ents if len(n) >= 2 and re.search(r"(?:^|[^a-z0-9])" + re.escape(n) + r"(?:$|[^a-z0-9])", text.lower())]
        want += [(i, k) for _, k in sorted(own)[:2]]
    assert got == sorted(want) and len(want) > 40


def test_evidence_and_boost(spark):
    asked = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 99)], "query_id long, entity_id long")
    rel = spark.createDataFrame([(10, 20, 100, 0.9), (20, 30, 101, 0.7), (11, None, 102, 0.4), (12, 10, 103, 0.6), (10, 21, None, 0.9), (10, 11, 104, 0.3), (20, 10, 100, 0.95)], "source_id long, target_id long, evidence_id long, confidence double")
    direct, around = O.evidence(asked, rel)
    assert sorted(map(tuple, direct.collect())) == [(1, 100, 0.95), (1, 102, 0.4), (1, 103, 0.6), (1, 104, 0.3), (2, 103, 0.6)]
    assert sorted(map(tuple, around.collect())) == [(1, 100, 0.95), (1, 101, 0.7), (1, 103, 0.6), (2, 100, 0.95), (2, 103, 0.6), (2, 104, 0.3)]
    narrow = O.evidence(asked, rel, fan=1)[1]
    assert sorted(map(tuple, narrow.where("query_id = 1").collect())) == [(1, 100, 0.95), (1, 101, 0.7)]  # 10's best neighbour is 20
    hits = spark.createDataFrame([(1, 100, 0.0, 1), (1, 101, 0.5, 2), (1, 7, 0.5, 3), (3, 7, 0.5, 1)], "query_id long, id long, score double, rank int")
    queries = spark.createDataFrame([(1, "about Ten and eleven?"), (3, None)], "query_id long, text string")
    ents = spark.createDataFrame([(10, "ten", 3), (11, "eleven", 1)], "entity_id long, name string, mention_count int")
    got = {(r.query_id, r.id): (round(r.score, 6), r.new_rank) for r in O.graph_boosted(hits, queries, ents, rel).collect()}
    assert got == {(1, 100): (0.5 + 0.05 * 1.5 * 0.95, 1), (1, 101): (0.535, 2), (1, 7): (0.5, 3), (3, 7): (0.5, 1)}
    bare = O.graph_boosted(hits, queries, ents, rel.where("false"))
    assert {r.id: r.score for r in bare.where("query_id = 1").collect()} == {100: 0.5, 101: 0.5, 7: 0.5}


def test_strict_attribution(spark):
    rng = random.Random(8)
    lines = ["the gate of the old town was shut at nine", "a short one", "Another LINE that is long enough to count…", "the gate of the old town was shut"]
    stems = ["release-2024", "gateway_x", "evolution", "ab-1", "shared-stem", "shared-stem", "shared-stem", "notes.2025"]
    items = [(k, k % 2, lines[k % 4], stems[k]) for k in range(8)] + [(8, 0, None, None)]
    bits = ["the gate of the old town was shut at nine", "ANOTHER line that is long enough to count", "release-2024", "xrelease-2024", "release-2024é", "gateway_x.", "evolution", "shared-stem", "a short one", "notes.2025", " ", " and "]
    msgs = [(m, m % 2, "".join(rng.choices(bits, k=5))) for m in range(60)] + [(60, 0, None), (61, 5, bits[0])]
    got = sorted(map(tuple, O.strictly_attributed(spark.createDataFrame(msgs, "msg_id long, grp int, text string"), spark.createDataFrame(items, "item_id long, grp int, one_liner string, stem string")).collect()))
    want = []
    for m, g, text in msgs:
        low = (text or "").lower()
        for i, grp, line, stem in items:
            ol, s = (line or "").lower().rstrip("…"), (stem or "").lower()
            ok = len(s) >= 8 and sum(x[3] == stem for x in items) <= 2 and re.search("[-_0-9]", s)
            if g == grp and ((len(ol) >= 25 and ol in low) or (ok and re.search(r"(?<!\w)" + re.escape(s) + r"(?!\w)", low))):
                want.append((m, i))
    assert got == sorted(want) and len(want) > 30


CASES = [
    ("May 7, 2023", "7 May 2023"), ("May 7 2023", "7 May 2023"), ("May 7th, 2023", "7 May 2023"), ("7 May 2023", "7 May 2023"), ("7 May, 2023", "7 May 2023"), ("2023-05-07", "7 May 2023"),
    ("5/7/2023", "7 May 2023"), ("May 2023", "May 2023"), ("session_1", "8 May 2023"), ("Around session 5 (early conversation)", "12 June 2023"), ("Last year", "Last year"), ("2022", "2022"),
    ("4 years", "4 years"), ("Woodhaven, 10 July 2022", "10 July 2022"), ("  on 13/7/2023 ", "on 13/7/2023"), ("12/40/2023", "12/40/2023"), ("it was Sept. or march, 2021", "March 2021"), ("room 7 maybe 2023", "7 May 2023"),
    ("2023-13-01", "2023-13-01"), ("session 9", "session 9"), ("", ""), (None, None), ("Decembre 3, 2020", "Decembre 3, 2020"), ("dec or Decembre 3, 2020", "3 December 2020"), ("the 1st Aug 2019, or 2 Sep 2020", "1 August 2019"),
]


def test_dates(spark):
    known = F.create_map(F.lit("session_1"), F.lit("8 May 2023"), F.lit("session_5"), F.lit("12 June 2023"))
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "id int, text string")
    got = [r.day for r in d.select("id", dates.canonical_date(F.col("text"), known).alias("day")).orderBy("id").collect()]
    assert got == [w for _, w in CASES]
    alone = d.where("id in (0, 8)").select(dates.canonical_date(F.col("text")).alias("day")).collect()
    assert [r.day for r in alone] == ["7 May 2023", "session_1"]
    bare = spark.createDataFrame([("around early May 2023 (or so)",), ("last year",)], "t string").select(dates.without_qualifiers(F.col("t")).alias("t")).collect()
    assert [r.t for r in bare] == ["May 2023", ""]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6)), max_size=20))
def test_spans_that_stand_never_overlap(spans):
    import bisect

    taken = []
    for start, size in sorted(spans, key=lambda s: (-s[1], s[0])):
        k = bisect.bisect_left(taken, (start + size, -1))
        free = not (k and taken[k - 1][1] > start)
        assert free == all(start + size <= a or b <= start for a, b in taken)
        if free:
            bisect.insort(taken, (start, start + size))
