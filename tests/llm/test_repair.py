import hashlib
import random
import re
import zlib
from itertools import groupby

from hypothesis import given, settings
from hypothesis import strategies as st

from memlode.llm import repair as R

SAID = re.compile(r"[^\x20\x09-\x0D]")


def ends(initials, faults):
    """All (cost, audit, lines) of at most two inserts in a row, tried out one by one."""

    def walk(i, state, cost, audit, ins):
        if i == len(initials) and state in (0, 3):
            yield cost, audit
        step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
        fits = "a" if state == 2 else "u"
        if ins < 2:
            yield from walk(i, step[fits], cost + 5, audit + "I", ins + 1)
        if i < len(initials):
            yield from walk(i + 1, state, cost + 2, audit + "D", 0)
            if faults[i] in (0, 3):
                more = 5 if faults[i] == 3 else 0
                yield from walk(i + 1, step[fits], cost + more + 1, audit + "R", 0)
                if initials[i] in step:
                    yield from walk(i + 1, step[initials[i]], cost + more, audit + "K", 0)

    return walk(0, 0, 0, "", 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax "), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=5))
def test_cheapest_and_least_of_all_edits(rows):
    initials, faults = "".join(r[0] for r in rows), bytes(r[1] for r in rows)
    assert R.search(initials, faults) == min(ends(initials, faults))


def table_of(rows):
    """Forward dynamic programming over whole strings, for conversations of any length."""
    best = {0: (0, "")}

    def inserted(b):
        for s, t in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if s in b:
                c = (b[s][0] + 5, b[s][1] + "I")
                b[t] = min(b.get(t, c), c)
        return b

    inserted(best)
    for ini, fault in rows:
        new = {}
        for s, (c, a) in best.items():
            step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[s]
            more = 5 * (fault == 3)
            ways = [(s, (c + 2, a + "D"))]
            if fault in (0, 3):
                ways.append((3 if s == 2 else 2, (c + more + 1, a + "R")))
                if ini in step:
                    ways.append((step[ini], (c + more, a + "K")))
            for t, w in ways:
                new[t] = min(new.get(t, w), w)
        best = inserted(new)
    return min(best[s] for s in (0, 3) if s in best)


def test_long_conversations():
    rng = random.Random(4)
    for n in (50, 400, 1500):
        for weights in ((8, 1, 1, 1), (1, 0, 0, 1), (0, 1, 1, 1), (2, 1, 1, 5)):
            rows = [(rng.choice("uuaaas"), rng.choices(range(4), weights)[0]) for _ in range(n)]
            assert R.search("".join(r[0] for r in rows), bytes(r[1] for r in rows)) == table_of(rows)
    clean = "ua" * 50_000
    assert R.search(clean, bytes(len(clean))) == (0, "K" * len(clean))


def plain(rows):
    """The whole operator in plain Python."""
    out = {}
    for conv, own in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        kept = []
        for _, turn, role, text in own:
            role, text = " " if role is None else role, " " if text is None else text
            hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            role = "user" if hit == 4 else role
            dig = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            kept += [((turn is not None, turn or 0), role, dig, k, turn, text) for k in range(0 if hit == 0 else 2 if hit == 3 else 1)]
        kept.sort(key=lambda r: r[:4])
        seen, faults = set(), []
        for _, role, _, _, _, text in kept:
            said = SAID.findall(text)
            faults.append(1 if not said else 2 if (role, text) in seen else 3 if said[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] or " " for r in kept]
        turns = [r[4] for r in kept if r[4] is not None]
        cost, audit = table_of(list(zip(initials, faults)))
        lines, at, state = [], 0, 0
        for e in audit:
            turn = 3 if state == 2 else 2
            name = {2: "user", 3: "assistant"}[turn]
            if e == "I":
                lines.append(f"{name}:")
                state = turn
                continue
            role, text = kept[at][1], kept[at][5]
            at += 1
            if e == "K":
                lines.append(f"{role}:{text}")
                state = 1 if role[0] == "s" else turn
            elif e == "R":
                lines.append(f"{name}:{text}")
                state = turn
        pairs = [a + b for a, b in zip(initials, initials[1:])]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_whole_operator_on_awkward_rows(spark):
    rng = random.Random(9)
    said = ["Yes.", "no", "", None, "  \t\n", "What? ", "long " * 9_000 + "end.", "ünï 漢字!", "a\nb?\n\n", "Yes."]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant", "usher"]
    rows = [(c, t * rng.choice([1, 1, 2]), rng.choice(roles), rng.choice(said)) for c in range(60) for t in range(rng.randint(1, 12))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t}.") for t in range(3000)]
    rows += [(None, 0, "user", "null id."), (None, None, None, None), (7, None, "assistant", "null turn"), (7, None, "user", "x."), rows[0], rows[0]]
    rows += [(c, 0, "user", "gone or not") for c in range(200, 260)]  # some lose their only row
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).selectExpr("*", "1 as hit", "2 as again", "3 as counts", "'z' as audit")
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in R.repair(R.damage(d)).collect()}
    want = plain(rows)
    assert got == want
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for v in got.values())
    assert R.repair(R.damage(d.where("false"))).count() == 0
