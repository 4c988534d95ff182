"""Conversation structure repair by A* on the edit lattice.

A node of the lattice is (rows read, state): nothing said yet, a system row, the user's turn done, the
assistant's turn done.  Edges keep, re-role or delete the next row, or insert an empty turn.  The
heuristic of a node is the suffix sum, over the rows not yet read, of deletions that must come (blank
and duplicate rows) and of what a truncated row costs at least; it never overstates and is consistent,
so the first audit that reaches a node under the key (cost + heuristic, audit) is the cheapest there
and the least in ASCII among the cheapest.  Since cost + heuristic only grows by what an edge costs
over the heuristic's step, the search needs no suffix sum ahead of its place and runs on reduced costs.

Audits are never written out during the search: closed nodes form a tree with jump pointers, and two
audits are compared below their last common node, so a conversation of n rows takes O(n) memory.

Texts do not meet in one task's memory: faults are judged row by row before the shuffle, the search
sees a few bytes a row, and the repaired text is hashed as a stream with the audit at its head.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from memlode.session import table

DROP, EMPTY, UNSTOP, REPEAT, AS_USER = range(5)
EVERY = 20
#: Fault classes of a row.
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What a row with this fault costs at least: the heuristic's steps.
LEAST = (0, 2, 2, 2)
RETITLE, DELETE, INSERT, STUMP = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: state -> {initial: next state}; what an inserted or re-roled turn becomes is the one of u and a that fits.
STEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
TURN = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: A character that is no white space, and a text that ends in a stop.
_SAID = r"[^\x20\x09-\x0D]"
_STOPPED = r"[.!?][\x20\x09-\x0D]*\z"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, again): the rows after damage; null conv_id and turn stay null as keys.

    In the key of the damage, and as role and text, a null reads as one space.  ``again`` is 1 for the
    copy of a repeated row and -1 for a dropped row, which only tells that its conversation was there.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    hit = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(EVERY)).cast("int")
    rows = rows.withColumn("hit", hit)
    text = F.when(F.col("hit") == EMPTY, F.lit("")).when(F.col("hit") == UNSTOP, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == AS_USER, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("hit") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.when(F.col("hit") == DROP, -1).otherwise(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("again"))


def own_fault(text: Column) -> Column:
    """The fault a row has by itself: blank or truncated, else clean (duplicates show in order only)."""
    return F.when(~text.rlike(_SAID), F.lit(BLANK)).when(~text.rlike(_STOPPED), F.lit(TRUNCATED)).otherwise(F.lit(CLEAN)).cast("byte")


class _Node:
    """A closed node: its edit, its depth, its parent and a jump to an ancestor further up."""

    __slots__ = ("parent", "edit", "depth", "jump")

    def __init__(self, parent: _Node | None, edit: str):
        self.parent, self.edit = parent, edit
        if parent is None:
            self.depth, self.jump = 0, self
        else:
            self.depth = parent.depth + 1
            j = parent.jump
            self.jump = j.jump if parent.depth - j.depth == j.depth - j.jump.depth else parent


def _up(x: _Node, depth: int) -> _Node:
    while x.depth > depth:
        x = x.jump if x.jump.depth >= depth else x.parent
    return x


def _less(x: _Node, y: _Node) -> bool:
    """Whether x's audit comes before y's.  Equal audits are equal nodes: the edits decide the path."""
    a, b = _up(x, min(x.depth, y.depth)), _up(y, min(x.depth, y.depth))
    if a is b:
        return x.depth < y.depth
    while a.parent is not b.parent:
        if a.jump is not b.jump:
            a, b = a.jump, b.jump
        else:
            a, b = a.parent, b.parent
    return a.edit < b.edit


class _Open:
    """A heap entry: reduced cost, and the audit as a node whose parent is closed."""

    __slots__ = ("cost", "node", "row", "state")

    def __init__(self, cost: int, node: _Node, row: int, state: int):
        self.cost, self.node, self.row, self.state = cost, node, row, state

    def __lt__(self, other: _Open) -> bool:
        return self.cost < other.cost if self.cost != other.cost else _less(self.node, other.node)


def search(initials: str, faults: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, the ASCII-least among them, by A*.

    ``initials`` has one character a row (a blank for a role without one), ``faults`` its class.
    """
    n = len(faults)
    if not n:
        return 0, ""
    heap = [_Open(0, _Node(None, ""), 0, START)]
    closed: set[int] = set()
    while True:
        e = heapq.heappop(heap)
        key = e.row << 2 | e.state
        if key in closed:
            continue
        closed.add(key)
        i, s, node = e.row, e.state, e.node
        if i == n and s in (START, ASSISTANT):
            break
        edges = [("I", INSERT, i, TURN[s])]
        if i < n:
            fault, least = faults[i], LEAST[faults[i]]
            edges.append(("D", DELETE - least, i + 1, s))
            if fault not in (BLANK, DUPLICATE):
                stump = STUMP * (fault == TRUNCATED) - least
                edges.append(("R", RETITLE + stump, i + 1, TURN[s]))
                if (to := STEP[s].get(initials[i])) is not None:
                    edges.append(("K", stump, i + 1, to))
        for edit, more, row, state in edges:
            if row << 2 | state not in closed:
                heapq.heappush(heap, _Open(e.cost + more, _Node(node, edit), row, state))
    out = []
    while node.parent is not None:
        out.append(node.edit)
        node = node.parent
    return e.cost + sum(LEAST[f] for f in faults), "".join(reversed(out))


def plan(rows: DataFrame) -> DataFrame:
    """(conv_id, counts, audit) of damaged rows, one a conversation; counts are COUNTS in order.

    Rows stand by turn (nulls first), equal turns by role, text digest and copy.  Only a digest, a
    fault and an initial of each row are shuffled; a conversation is held as two bytes and a digest a
    row.  A null conv_id is a conversation of its own; one whose rows are all dropped has zeros.
    """
    narrow = rows.select("conv_id", "turn", _digest().alias("digest"), "role", "again", F.substring("role", 1, 1).alias("initial"), F.when(F.col("again") >= 0, own_fault(F.col("text"))).alias("fault"))
    out = StructType([StructField("conv_id", LongType()), StructField("counts", ArrayType(LongType())), StructField("audit", StringType())])
    fields = to_arrow_schema(out)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = batches  # no conversation yet
        first = last = None
        distinct = 0
        seen: set[bytes] = set()
        initials: list[str] = []
        faults = bytearray()

        def row() -> tuple:
            counts = [faults.count(bytes([k])) for k in (BLANK, DUPLICATE, TRUNCATED)]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            gaps = last - first + 1 - distinct if first is not None else 0
            cost, audit = search("".join(initials), bytes(faults))
            return now, [gaps, *counts, illegal, cost], audit

        done = []
        for b in batches:
            for conv, turn, digest, initial, fault in zip(*(b.column(k).to_pylist() for k in range(5))):
                if conv != now:
                    if now is not batches:
                        done.append(row())
                    now, first, last, distinct, seen, initials, faults = conv, None, None, 0, set(), [], bytearray()
                if fault is None:
                    continue
                if turn is not None:
                    first = turn if first is None else first
                    distinct += turn != last
                    last = turn
                faults.append(fault if fault == BLANK or digest not in seen else DUPLICATE)
                seen.add(digest)
                initials.append(initial or " ")
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done), fields)], schema=fields)
                done = []
        if now is not batches:
            done.append(row())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done), fields)], schema=fields)

    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "again")
    return ordered.select("conv_id", "turn", "digest", "initial", "fault").mapInArrow(repaired, out)


def _digest() -> Column:
    """Stands for (role, text): 256 bits of both, with the role's length between."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def rebuild(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, counts, audit, repaired_sha256): plans with the digest of the repaired ``role:text`` lines.

    A conversation's audit goes at the head of its rows and is read off as they stream by.
    """
    head = plans.select("conv_id", F.lit(0).cast("byte").alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("again"), "counts")
    body = rows.where("again >= 0").select("conv_id", F.lit(1).cast("byte").alias("part"), "turn", "role", "text", _digest().alias("digest"), "again", F.lit(None).cast("array<bigint>").alias("counts"))
    out = StructType([StructField("conv_id", LongType()), StructField("counts", ArrayType(LongType())), StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    fields = to_arrow_schema(out)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = (), None
        for b in batches:
            done = []
            for conv, part, role, text, counts in zip(*(b.column(k).to_pylist() for k in range(5))):
                if part == 0:
                    if reader is not None:
                        done.append((*now, reader.end()))
                    now, reader = (conv, counts, text), _Repaired(text)
                else:
                    reader.row(role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done), fields)], schema=fields)
        if reader is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*now, reader.end()), fields)], schema=fields)

    ordered = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest", "again")
    return ordered.select("conv_id", "part", "role", "text", "counts").mapInArrow(hashed, out)


class _Repaired:
    """Applies an audit to rows as they come and hashes what stays."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.any, self.hash = audit, 0, START, False, hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = TURN[self.state]
            self._line(ROLE[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEP[self.state][role[0]]
            self._line(role, text)
        elif edit == "R":
            self.state = TURN[self.state]
            self._line(ROLE[self.state], text)

    def end(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of damage()'s rows: its faults, the cost and audit of its edits, the repaired digest.

    A conversation of which no row is left has zeros, an empty audit and the digest of nothing.
    """
    done = rebuild(rows, plan(rows))
    return done.select("conv_id", *(F.col("counts")[k].alias(c) for k, c in enumerate(COUNTS)), "audit", "repaired_sha256")


def op12_conversation_repair(spark, sf_dir) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The same in DuckDB, by dynamic programming: a list of the best (cost, audit) of each state, as one string that sorts."""

    def add(x: str, cost: int | str, edit: str) -> str:
        return f"CASE WHEN {x} = '~' THEN '~' ELSE lpad(CAST(CAST(left({x}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{edit}' END"

    a = [f"a[{k}]" for k in range(1, 5)]
    stump = "CASE WHEN x[1][1] = '3' THEN 5 ELSE 0 END"
    stays = "x[1][1] IN ('0', '3')"

    def row(k: int, froms: tuple[int, ...], initial: str) -> str:
        ways = [add(a[k], 2, "D")]
        for f in froms:
            if k in (USER, ASSISTANT):
                ways.append(f"CASE WHEN {stays} THEN {add(a[f], f'1 + {stump}', 'R')} ELSE '~' END")
            ways.append(f"CASE WHEN {stays} AND x[1][2:] = '{initial}' THEN {add(a[f], stump, 'K')} ELSE '~' END")
        return f"least({', '.join(ways)})"

    rows = f"[{add(a[0], 2, 'D')}, {row(1, (0,), 's')}, {row(2, (0, 1, 3), 'u')}, {row(3, (2,), 'a')}]"
    user = f"least({a[2]}, {', '.join(add(a[k], 5, 'I') for k in (0, 1, 3))})"
    both = f"least({a[3]}, {add(a[2], 5, 'I')}, {', '.join(add(a[k], 10, 'II') for k in (0, 1))})"
    step = f"CASE WHEN x[1] = '9' THEN [{a[0]}, {a[1]}, {user}, {both}] ELSE {rows} END"
    return f"""
WITH keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
marked AS (SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda c, b: list_reduce(range(8), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END), xor(c, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS hit FROM keyed),
damaged AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS again FROM marked WHERE hit <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), again) AS n FROM damaged),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM placed),
talks AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
  count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal,
  flatten(list([[fault || left(role, 1), '', '', ''], ['9', '', '', '']] ORDER BY n)) AS codes FROM judged GROUP BY conv_id),
solved AS (SELECT * EXCLUDE (codes), list_reduce(codes, lambda a, x: {step}, ['000000000', '~', '000000005I', '000000010II']) AS ends FROM talks),
best AS (SELECT * EXCLUDE (ends), least(ends[1], ends[4]) AS found, CAST(left(found, 9) AS BIGINT) AS cost, substr(found, 10) AS audit FROM solved),
edits AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS pos FROM best WHERE audit <> ''),
lines AS (SELECT *, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS n FROM edits),
kept AS (SELECT l.conv_id, pos, edit, r.role, CASE WHEN edit = 'I' THEN '' ELSE r.text END AS text, row_number() OVER w AS place, first_value(edit = 'K' AND r.role[1] = 's') OVER w AS led
  FROM lines l LEFT JOIN placed r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.n = r.n AND l.edit <> 'I' WHERE edit <> 'D' WINDOW w AS (PARTITION BY l.conv_id ORDER BY pos)),
said AS (SELECT conv_id, string_agg((CASE WHEN edit = 'K' THEN role WHEN (place - CAST(led AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY pos) AS body FROM kept GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN said s ON c.conv_id IS NOT DISTINCT FROM s.conv_id"""


REPAIR_SQL = _sql()
