"""Exact top-k search by inner product, term at a time.

A vector is a sparse row: its terms are the positions with an integer weight other than zero.  A task
turns blocks of its candidates into postings (position -> candidates and weights).  The queries come
in blocks of bounded size; each term of theirs scatters its weight times its posting list into a dense
array of scores, one line a query, until every posting of every query term is added.  Partition
selection then takes each query's best of the block, the task merges them over its blocks, and one
ranking merges the tasks.  Nothing is pruned, so the result is that of all pairs.

Defined cases: a null vector, or one with a null, NaN or infinite component, takes no part; an empty
vector scores 0 with all; vectors of unequal length meet in the positions both have.  Components
beyond a long saturate, and so do scores.  A ``vec_id`` names a row: rows of the query's own id are no
candidates of it.  Repeated rows are a candidate each; a query repeated with the same vector asks once
(with another vector: the best hits of both make one list).  A row without an id asks nothing but is a
candidate, after all others on ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from memlode.session import Scratch, table

SCALE, EVERY, K = 64, 20, 20
#: Components of one block of queries: what a broadcast holds.
QUERY_CELLS = 1 << 20
#: Scores held at once: candidates of a block times queries of a strip.
SCORE_CELLS = 1 << 18
#: Candidates of a block at most.
BLOCK = 2048
_LONG = (1 << 63) - 1
_HITS = "query_id long, vec_id long, score long"


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long (saturating); null if the vector takes no part."""
    x = lambda v: v.cast("double")
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) != float("inf")))
    return F.when(whole, F.transform(vector, lambda v: F.floor(x(v) * scale).cast("long")))


def vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, terms) of all rows that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("terms"))
    return rows.where("terms is not null")


class Postings:
    """Integer rows turned round: for each position, which rows have a weight there and which weight."""

    def __init__(self, offsets: np.ndarray, values: np.ndarray):
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        row = np.repeat(np.arange(n, dtype=np.int32), lengths)
        position = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)
        full = values != 0
        row, position, values = row[full], position[full], values[full]
        order = np.argsort(position, kind="stable")
        self.rows, self.values = row[order], values[order]
        self.terms, self.starts = np.unique(position[order], return_index=True)
        self.ends = np.r_[self.starts[1:], len(order)].astype(np.int64)
        self.size = n
        self.largest = max((abs(int(values.min())), abs(int(values.max())))) if len(values) else 0
        self.longest = int(lengths.max()) if n else 0

    def strip(self, lo: int, hi: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(position, rows from 0, weights) of rows lo to hi."""
        out = []
        for t, a, b in zip(self.terms.tolist(), self.starts.tolist(), self.ends.tolist()):
            i, j = a + np.searchsorted(self.rows[a:b], [lo, hi])
            if j > i:
                out.append((t, self.rows[i:j] - lo, self.values[i:j]))
        return out


def _line(rows: np.ndarray, values: np.ndarray, size: int, kind) -> tuple[np.ndarray | None, np.ndarray]:
    """A posting list as it is scattered: (None, one weight for each of ``size``) if it names over half of them, else itself."""
    values = values.astype(kind)
    if 2 * len(rows) <= size:
        return rows, values
    full = np.zeros(size, kind)
    full[rows] = values
    return None, full


def accumulate(strip: list, width: int, block: Postings, kind) -> np.ndarray:
    """The scores (queries x candidates) of a block: each query term adds its weight times its postings.

    A long list on either side goes as a full line with zeros between, which costs less than its index.
    """
    scores = np.zeros((width, block.size), kind)
    room = np.empty_like(scores)
    where = {t: k for k, t in enumerate(block.terms.tolist())}
    for term, asks, weights in strip:
        k = where.get(term)
        if k is None:
            continue
        span = slice(block.starts[k], block.ends[k])
        asks, weights = _line(asks, weights, width, kind)
        rows, values = _line(block.rows[span], block.values[span], block.size, kind)
        if asks is None and rows is None:
            scores += np.multiply(weights[:, None], values, out=room)
        else:
            at = np.ix_(asks, rows) if asks is not None and rows is not None else (asks if rows is None else (slice(None), rows))
            scores[at] += weights[:, None] * values
    return scores


def select(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) of each query's k largest scores; ties at the cut go to the first candidates.

    ``scores`` is queries x candidates.  Partitioning finds the k-th score; all above it are in, and of
    those equal to it as many as are wanted, in order.
    """
    n = scores.shape[1]
    if n <= k:
        return np.divmod(np.arange(scores.size), max(n, 1))
    cut = np.sort(scores, axis=1)[:, n - k] if scores.dtype == object else np.partition(scores, n - k, axis=1)[:, n - k]
    above, at = scores > cut[:, None], scores == cut[:, None]
    left = k - above.sum(axis=1)
    tied = at.sum(axis=1) > left
    if tied.any():
        at[tied] &= np.cumsum(at[tied], axis=1) <= left[tied, None]
    return np.nonzero(above | at)


class _Merged:
    """The best of each query over the blocks of a task: lists that are cut when they reach twice k."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, query: np.ndarray, ids: np.ndarray, nulls: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, ids, nulls, score))
        self.held += len(query)
        if self.held > max(4 * self.k * len(self.queries), 1 << 16):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        q, ids, nulls, score = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((ids, nulls, -score, q))
        q = q[order]
        first = np.r_[True, q[1:] != q[:-1]]
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        keep = order[rank < self.k]
        whole = tuple(np.concatenate(c)[keep] for c in zip(*self.parts))
        self.parts, self.held = [whole], len(keep)
        return whole

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        q, ids, nulls, score = self.cut()
        for at in range(0, len(q), 1 << 16):
            s = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(self.queries[q[s]]), pa.array(ids[s], mask=nulls[s]), pa.array([max(-_LONG - 1, min(_LONG, int(x))) for x in score[s]] if score.dtype == object else score[s], pa.int64())], schema=schema)


def _searcher(asked: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, spark, block: int):
    """A mapInArrow function that yields its task's best candidates for one block of queries."""
    sent = spark.sparkContext.broadcast(asked)
    schema = to_arrow_schema(spark.createDataFrame([], _HITS).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, offsets, values = sent.value
        queries = Postings(offsets, values)
        width = max(1, SCORE_CELLS // block)
        strips = [(lo, min(lo + width, len(ids)), queries.strip(lo, min(lo + width, len(ids)))) for lo in range(0, len(ids), width)]
        best = _Merged(ids, k)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                own, lists = part.column(0), part.column(1)
                nulls = np.asarray(own.is_null())
                name = own.fill_null(0).to_numpy(zero_copy_only=False)
                order = np.lexsort((name, nulls))  # rows in the order in which they win ties
                lists = lists.take(pa.array(order))
                name, nulls = name[order], nulls[order]
                docs = Postings(np.asarray(lists.offsets, np.int64), np.asarray(lists.flatten(), np.int64))
                most = queries.largest * docs.largest * min(queries.longest, docs.longest)
                twins = int(np.unique(name, return_counts=True)[1].max())
                kind = np.int32 if most < 1 << 31 else np.int64 if most <= _LONG else object
                for lo, hi, strip in strips:
                    scores = accumulate(strip, hi - lo, docs, kind)
                    q, c = select(scores, k + twins)  # the query's own rows may be among them
                    other = nulls[c] | (name[c] != ids[lo + q])
                    q, c = q[other], c[other]
                    got = scores[q, c]
                    best.add(lo + q, name[c], nulls[c], got if kind is object else got.astype(np.int64))
        yield from best.rows(schema)

    return run


def search(rows: DataFrame, queries: DataFrame, k: int = K, cells: int = QUERY_CELLS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the largest inner product of each query.

    ``rows`` and ``queries`` are (vec_id, terms) as vectors() gives them.  Queries are dealt by hash into
    blocks of about ``cells`` components, each a broadcast of that size beside one pass over the rows;
    what the tasks found is written between, so a lost executor repeats one block's tasks.  A task holds
    k candidates a query of its block, and one strip of scores.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    asked = queries.where("vec_id is not null").distinct()
    total = asked.agg(F.sum(F.size("terms") + 1)).first()[0] or 0
    n = max(1, math.ceil(total / cells))
    if n > 1:
        rows = scratch.keep(rows)
        asked = scratch.keep(asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "terms"), F.lit(n)).cast("int")).repartition("part").sortWithinPartitions("part"))
    hits: DataFrame | None = None
    for i in range(n):
        own = (asked.where(F.col("part") == i) if n > 1 else asked).select("vec_id", "terms").toArrow()
        if not own.num_rows:
            continue
        own = own.sort_by("vec_id").combine_chunks()
        lists = own.column("terms").combine_chunks()
        sent = (own.column("vec_id").to_numpy(), np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py(), np.asarray(lists.flatten(), np.int64))
        found = rows.mapInArrow(_searcher(sent, k, spark, block), _HITS)
        found = scratch.keep(found) if n > 1 else found
        hits = found if hits is None else hits.unionByName(found)
    hits = spark.createDataFrame([], _HITS) if hits is None else hits
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op13_topk(spark, sf_dir) -> DataFrame:
    rows = vectors(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where(F.col("vec_id") % EVERY == 0))


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
