"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item of n distinct shingles is contained in a document if at least ``threshold`` of them occur
there.  The document may be thousands of times longer, so a MinHash of the document says little;
instead the item is sketched: its K smallest shingle hashes are a uniform sample of its shingles, and
the share of them found among the document's shingles estimates the containment.  Items are
partitioned by size, and a partition sets K and the shingles a document needs to be looked up at all.
Of an item's n shingles m = n - ceil(threshold * n) may be missing, so a document that contains it holds
at least K - m of the sketch: documents whose estimate is below (K - m) / K cannot contain it, and the
search loses nothing.  Candidates are then verified on the shingles themselves.

The documents stream past the item index; there is no shuffle and no pair of documents.  The index is
sent to the executors in blocks of bounded size (``block_bytes``), ``GROUP`` of them a pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from memlode.llm.common import documents
from memlode.session import Scratch, table

BLOCK_BYTES, GROUP = 16 << 20, 4
_PIECE = 8 << 20
_FILTER_BITS = 20


def _table() -> bytes:
    out = bytearray(range(256))
    for c in range(128):
        ch = chr(c)
        out[c] = ord(ch.lower()) if ch.isalnum() else 32
    return bytes(out)


_FOLD = _table()


def fold_words(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, ASCII punctuation and white space separate."""
    return raw.translate(_FOLD).split()


def _pieces(raw: bytes, overlap: int) -> Iterator[list[bytes]]:
    """The words of a text in pieces that share ``overlap`` words, so a huge text needs bounded memory."""
    if len(raw) <= _PIECE:
        yield fold_words(raw)
        return
    tail: list[bytes] = []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + _PIECE)
        while end < len(raw) and _FOLD[raw[end]] != 32:
            end += 1
        got = tail + fold_words(raw[at:end])
        yield got
        tail, at = got[-overlap:] if overlap else [], end


class Searcher:
    """The items of one block, indexed; finds those that a text contains.

    An item shorter than ``k`` words is one shingle of its own length.
    """

    def __init__(self, texts: list[str | None], k: int = 5, threshold: float = 0.8):
        self.k, self.threshold = k, threshold
        rng = np.random.default_rng(7)
        self.mult = rng.integers(1, 1 << 62, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.words = [fold_words((t or "").encode()) for t in texts]
        self.need = np.zeros(len(texts), np.int64)  # of each item's sketch
        self.lengths: set[int] = set()  # of shingles
        self._verify: dict[int, dict[tuple, int]] = {}
        sized: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for i, words in enumerate(self.words):
            if words:
                own = np.array(sorted(set(self._shingles(words).values())), np.uint64)
                sized.setdefault(len(own).bit_length(), []).append((i, len(own), own))
                self.lengths.add(min(k, len(words)))
        seen = np.zeros(1 << _FILTER_BITS, bool)
        self.partitions = []  # least number of shingles of a document, sketch hashes, where their items start, items
        for c, items in sorted(sized.items()):
            most = (1 << c) - 1  # shingles of an item of this size
            size = 2 * (most - self._least(most)) + 4
            hashes, owners = [], []
            for i, n, own in items:
                sketch = own[np.argsort(own * np.uint64(0x9E3779B97F4A7C15), kind="stable")][:size]
                self.need[i] = max(1, len(sketch) - (n - self._least(n)))
                hashes.append(sketch), owners.append(np.full(len(sketch), i))
            h, o = np.concatenate(hashes), np.concatenate(owners)
            by = np.argsort(h, kind="stable")
            keys, at = np.unique(h[by], return_index=True)
            seen[self._slot(keys)] = True
            self.partitions.append((self._least(1 << (c - 1)), keys, np.r_[at, len(h)], o[by]))
        self.seen = seen

    def _least(self, n: int) -> int:
        """How many of n shingles make the threshold."""
        return math.ceil(self.threshold * n - 1e-9)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def _hashes(self, words: list[bytes], k: int) -> np.ndarray:
        """Hashes of all shingles of k words, in order."""
        n = max(0, len(words) - k + 1)
        w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out += w[j : j + n] * self.mult[j]
        return out ^ (out >> np.uint64(29))

    def _shingles(self, words: list[bytes]) -> dict[tuple, int]:
        k = min(self.k, len(words))
        return {tuple(words[i : i + k]): h for i, h in enumerate(self._hashes(words, k).tolist())}

    def shingles(self, i: int) -> dict[tuple, int]:
        """The distinct shingles of an item and their hashes."""
        if i not in self._verify:
            if len(self._verify) >= 1024:
                self._verify.clear()
            self._verify[i] = self._shingles(self.words[i])
        return self._verify[i]

    def candidates(self, raw: bytes) -> list[int]:
        """The items of whose sketch the text holds enough."""
        hits, size = [np.zeros(0, np.uint64)], 0
        for words in _pieces(raw, self.k - 1):
            for k in self.lengths:
                h = self._hashes(words, k)
                size += len(h)
                hits.append(h[self.seen[self._slot(h)]])
        found = np.unique(np.concatenate(hits))
        out: list[int] = []
        for least, keys, start, owners in self.partitions:
            if size < least or not len(found):
                continue
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            at = at[keys[at] == found]
            if len(at):
                who = np.concatenate([owners[start[p] : start[p + 1]] for p in at.tolist()])
                item, n = np.unique(who, return_counts=True)
                out += item[n >= self.need[item]].tolist()
        return out

    def search(self, text: bytes | None) -> list[tuple[int, float]]:
        """(item number, containment) of every item whose containment reaches the threshold."""
        raw = text or b""
        found = self.candidates(raw)
        if not found:
            return []
        keys = np.unique(np.fromiter((h for i in found for h in self.shingles(i).values()), np.uint64))
        there: set[tuple] = set()
        for words in _pieces(raw, self.k - 1):
            for k in {min(self.k, len(self.words[i])) for i in found}:
                for p in np.flatnonzero(np.isin(self._hashes(words, k), keys)).tolist():
                    there.add(tuple(words[p : p + k]))
        out = []
        for i in sorted(found):
            own = self.shingles(i)
            c = sum(s in there for s in own) / len(own)
            if c >= self.threshold - 1e-12:
                out.append((i, c))
        return out


_built: dict = {}


def _searcher(items, k: int, threshold: float) -> Searcher:
    """One searcher for each block, ``GROUP`` at most, in a worker process."""
    key = (items.value["block"], k, threshold)
    if key not in _built:
        while len(_built) >= GROUP:
            _built.pop(next(iter(_built)))
        _built[key] = Searcher(items.value["texts"], k, threshold)
    return _built[key]


def _groups(benchmark: DataFrame, block_bytes: int):
    """The items' ids and texts, in lists of up to ``GROUP`` blocks of about ``block_bytes``; each is sent to the executors once."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for first in range(0, n, GROUP):
        group = []
        for b in range(first, min(n, first + GROUP)):
            rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
            texts = [r[1] for r in rows]
            if rows:
                group.append(([r[0] for r in rows], spark.sparkContext.broadcast({"block": hash(tuple(texts)), "texts": texts})))
        if group:
            yield group


def _raw(text) -> object:
    return F.encode(F.coalesce(text, F.lit("")), "utf-8")


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, containment, n_shingles): a row for each document row and item it contains.

    Shingles have ``k`` words; an item of 1 to k - 1 words is one shingle of its own length and found in
    any document that has these words in a row.  Null or wordless texts neither contain nor are
    contained.  containment is the exact share of the item's distinct shingles that occur in the
    document.  Items that agree in id and text count once; null ids are kept.  Other columns are ignored.
    """
    kind = {f.name: f.dataType for f in docs.schema}["doc_id"]
    item_kind = {f.name: f.dataType for f in benchmark.schema}["item_id"]
    schema = StructType([StructField("doc_id", kind), StructField("item_id", item_kind), StructField("containment", DoubleType()), StructField("n_shingles", LongType())])
    fields = to_arrow_schema(schema)
    out = docs.sparkSession.createDataFrame([], schema)
    for group in _groups(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raws = b.column(1).to_pylist()
                for ids, items in group:
                    find = _searcher(items, k, threshold)
                    got = [(i, j, c) for i, raw in enumerate(raws) for j, c in find.search(raw)]
                    own = b.column(0).take(pa.array([i for i, _, _ in got], pa.int64()))
                    cols = [own, [ids[j] for _, j, _ in got], [c for _, _, c in got], [len(find.shingles(j)) for _, j, _ in got]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(cols, fields)], schema=fields)

        out = out.union(docs.select("doc_id", _raw("text").alias("raw")).mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no item of the benchmark, with all their columns.

    A benchmark of more than ``GROUP`` blocks takes several passes; what one leaves is written for the next.
    """
    out, scratch = docs, Scratch(docs.sparkSession)
    for n, group in enumerate(_groups(benchmark, block_bytes)):
        out = (scratch.keep(out) if n else out).where(_clean([items for _, items in group], k, threshold)(_raw("text")))
    return out


def _clean(blocks: list, k: int, threshold: float):
    def clean(raws: pd.Series) -> pd.Series:
        finds = [_searcher(items, k, threshold) for items in blocks]
        return pd.Series([not any(f.search(x) for f in finds) for x in raws], dtype=bool)

    return F.pandas_udf(clean, BooleanType())


def op2_decontamination(spark, sf_dir) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
