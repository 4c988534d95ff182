"""SimHash near-duplicate classes by pigeonring filtering.

A fingerprint of 64 bits is cut into tau + 1 segments on a ring.  If two fingerprints differ in at
most tau bits, some segment starts a chain whose first l segments differ, for every l, in at most
floor(l * tau / (tau + 1)) bits.  The first two steps of that chain (0 bits in the first segment,
at most 1 in the first two) make the join keys: both segments with one bit of the second masked.
The longer chain prefixes prune candidates before the full Hamming check.

Nothing is sampled or capped.  Equal fingerprints are grouped before the search; a key shared by
more than ``TILE`` fingerprints is dealt out in tiles that together compare every pair; a group
yields a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from memlode.operators.graph import connected_components
from memlode.session import Scratch

#: Most fingerprints of one key that one group compares; larger keys are dealt out in tiles.
TILE = 4096
_STEP = 16384


def fingerprint(raw: bytes | None, k: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a text given as UTF-8 (None: as empty).

    Words are lower-cased (A-Z only), shingles of ``k`` words count with repeats; a text with fewer
    words is one shingle, a text without words has fingerprint 0.  A bit is 1 if set in over half of
    the shingles' XXH64.
    """
    words = raw.lower().split() if raw else []
    n = len(words)
    if not n:
        return 0
    text = b" ".join(words)
    if n < k:
        starts, ends = [0], [len(text)]
    else:
        lens = np.fromiter(map(len, words), np.int64, n)
        stop = np.cumsum(lens + 1) - 1
        starts, ends = (stop - lens)[: n - k + 1].tolist(), stop[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _STEP):
        h = np.array([digest(text[s:e], seed) for s, e in zip(starts[at : at + _STEP], ends[at : at + _STEP])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(raws: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in raws], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``; other columns are not read.  A worker holds one batch as it came and one text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x.as_py()) for x in b.column(1)], pa.int64())], ["doc_id", "fp"])

    kind = {f.name: f.dataType for f in docs.schema}["doc_id"]
    schema = StructType([StructField("doc_id", kind), StructField("fp", LongType())])
    return docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw")).mapInArrow(run, schema)


def ring(tau: int) -> list[list[int]]:
    """Bit numbers of each of the tau + 1 segments."""
    m = tau + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [list(range(cuts[i], cuts[i + 1])) for i in range(m)]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chain_keys(fps: DataFrame, tau: int) -> DataFrame:
    """(key, fp): the keys of all chains of two segments.  The low 3 bits of a key hold the chain's start (tau below 8)."""
    segs = ring(tau)
    m, keys = len(segs), []
    for i in range(m):
        nxt = segs[(i + 1) % m]
        for j, b in enumerate(nxt):
            keep = _signed(_mask(segs[i]) | _mask(x for x in nxt if x != b))
            h = F.xxhash64(F.lit(i * 64 + j), F.col("fp").bitwiseAND(F.lit(keep)))
            keys.append(h.bitwiseAND(F.lit(~7)).bitwiseOR(F.lit(i)))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _hot_keys(fps: DataFrame, tau: int, tile: int) -> DataFrame:
    """(key, parts) of the chain keys that more than ``tile`` fingerprints may share.

    Counts the unmasked segment pairs (a few rows a fingerprint): a masked key is the union of two
    of those, so one of them has over half of its rows.
    """
    segs = ring(tau)
    m = len(segs)
    pairs = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(segs[i]) | _mask(segs[(i + 1) % m])))).alias("fp")) for i in range(m)]
    hot = fps.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.i", "p.fp").count().where(F.col("count") > tile // 2)
    keys = chain_keys(hot.select("fp"), tau).join(hot, "fp").where(F.col("key").bitwiseAND(F.lit(7)) == F.col("i"))
    total = F.sum("count") + tile // 2
    return keys.groupBy("key").agg(F.ceil(total / tile).cast("int").alias("parts"))


def _links(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of each key's fingerprints; rows come sorted by key."""
    segs = ring(tau)
    m = len(segs)
    one = np.uint64(1)
    chains = [[(np.uint64(_mask(b for s in range(n) for b in segs[(i + s) % m])), n * tau // m) for n in range(3, m)] for i in range(m)]

    def near(x, y, start: int):
        d = x ^ y
        ok = np.ones(d.shape, bool)
        for mask, budget in chains[start]:
            ok &= np.bitwise_count(d & mask) <= budget
        return ok & (np.bitwise_count(d) <= tau) & (d != 0)

    def group(start: int, fps: np.ndarray, out: list) -> None:
        left = np.unique(fps)
        while len(left) > 1:
            root, left = left[0], left[1:]
            todo = [root]
            while todo and len(left):
                hit = near(todo.pop(), left, start)
                if hit.any():
                    found = left[hit]
                    out.append((np.full(len(found), root), found))
                    todo.extend(found)
                    left = left[~hit]

    def emit(out: list) -> pa.RecordBatch:
        a, b = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.uint64) for k in (0, 1))
        e = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(e[:, k].view(np.int64) if len(e) else [], pa.int64()) for k in (0, 1)], ["src", "dst"])

    tail_k, tail_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def run(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        out: list = []
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[edge, len(k)])
        two = edge[size == 2]
        for start in range(m):
            at = two[(k[two] & 7) == start]
            hit = at[near(f[at], f[at + one.astype(np.int64)], start)]
            if len(hit):
                out.append((f[hit], f[hit + 1]))
        for at, n in zip(edge[size > 2].tolist(), size[size > 2].tolist()):
            group(int(k[at] & 7), f[at : at + n], out)
        return emit(out)

    for batch in batches:
        k = np.r_[tail_k, batch.column(0).to_numpy(zero_copy_only=False)]
        f = np.r_[tail_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1], "left"))  # the last key may go on in the next batch
        tail_k, tail_f = k[cut:], f[cut:]
        if cut:
            yield run(k[:cut], f[:cut])
    if len(tail_k):
        yield run(tail_k, tail_f)


def links(fps: DataFrame, tau: int = 4, tile: int = TILE) -> DataFrame:
    """(src, dst) links between distinct fingerprints (column fp) that differ in at most ``tau`` bits.

    The links span every class that the full set of links would connect.
    """
    if not 1 <= tau <= 7:
        raise ValueError("tau must be from 1 to 7")
    keys = chain_keys(fps, tau)
    hot = Scratch(fps.sparkSession).keep(_hot_keys(fps, tau, tile))
    if not hot.isEmpty():
        part = F.pmod(F.xxhash64("fp"), F.col("parts"))
        keys = keys.join(hot, "key", "left").select("key", "fp", F.coalesce("parts", F.lit(1)).alias("parts"))
        keys = keys.select("key", "fp", part.alias("c"), "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("t"))
        tiled = F.xxhash64("key", F.least("c", "t"), F.greatest("c", "t")).bitwiseAND(F.lit(~7)).bitwiseOR(F.col("key").bitwiseAND(F.lit(7)))
        keys = keys.select(F.when(F.col("parts") > 1, tiled).otherwise(F.col("key")).alias("key"), "fp")
    dealt = keys.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda it: _links(it, tau), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, tau: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``docs``.

    root names the class by its least fingerprint; component_id is the least doc_id reachable over links of at most ``tau`` differing bits, the
    row's own included.  Null text counts as empty; rows with a null id take part and take the least
    id of their class, null if there is none.  Repeated rows each get a row.  An empty table gives
    an empty result.  Columns besides doc_id and text are ignored, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    fps = scratch.keep(fingerprints(docs))
    groups = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected_components(links(groups.select("fp"), tau))
    member = groups.join(roots, groups.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = member.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = scratch.keep(member.join(lows, "root").select("fp", "root", "component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, tau: int = 4) -> DataFrame:
    """One row of each class, with all columns of ``docs``: one that has the least id.

    Where several rows of a class carry that id (or the class has no id at all) the one with the least
    fingerprint stays, and of rows that agree in both any one: those few rows are dealt with apart.
    Whole rows meet only the ids that go, and are not shuffled while these are few enough to broadcast.
    """
    scratch = Scratch(docs.sparkSession)
    own = near_duplicates(docs, tau, scratch)
    twice = scratch.keep(own.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice_id")))
    gone = own.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone_id"))
    gone = scratch.keep(gone.union(twice).distinct())
    single = docs.join(scratch.broadcast_if_small(gone), F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
    if twice.isEmpty():
        return single
    again = scratch.broadcast_if_small(twice)
    least = own.join(again, F.col("doc_id").eqNullSafe(F.col("twice_id")), "left_semi").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = scratch.keep(least.groupBy(F.col("root"), F.col("doc_id").alias("keep_id")).agg(F.min("fp").alias("keep_fp")).select("keep_id", "keep_fp"))
    several = docs.join(again, F.col("doc_id").eqNullSafe(F.col("twice_id")), "left_semi").withColumn("own_fp", _fingerprints(F.encode(F.coalesce("text", F.lit("")), "utf-8")))
    several = several.join(scratch.broadcast_if_small(kept), F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("own_fp") == F.col("keep_fp")), "left_semi")
    return single.unionByName(several.dropDuplicates(["doc_id", "own_fp"]).drop("own_fp"))


def op1_simhash(spark, sf_dir) -> DataFrame:
    from memlode.llm.common import documents

    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
