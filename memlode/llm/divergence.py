"""Source divergence audit: how far apart the term distributions of a language's sources are.

Tokens are found in bytes: the UTF-8 buffers of a batch stand one after the other as Arrow has them, a
lookup table gives each byte's class and lower case, and where the class changes a token begins or
ends.  The 64-bit XXH64 of its bytes groups the tokens; each group is then verified byte by byte
against its first member and split if a different token shares the hash.  A batch leaves one row for
each (lang, source, term), so frequent terms are summed before anything is shuffled.

Divergences are sums over CSR matrices, sources by terms, of blocks of a language's terms: for one
source against all others at once, the difference on stored entries is a reduceat over their rows, and
that on absent entries, where the other's share is a constant, comes from the sorted shares' prefix
sums.  Blocks have a bounded number of entries, whatever the size of a language or a source.

All arithmetic is on integers.  Shares are 1 + floor(10^9 (count + 5) / (N + 5 V)), by long division
in three steps that stay within 64 bits for every N below 10^15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from memlode.llm.common import documents
from memlode.session import Scratch

#: A term counts if this many documents of its language have it.
LEAST_DOCS = 30
#: Added to each count; ranks kept of the part ``term``; the whole that shares are parts of, as three factors.
PRIOR, TERMS = 5, 50
_THOUSANDS = 3
#: Bytes of text taken at once; one longer text is taken whole.
PIECE = 8 << 20
#: Entries (sources with the term) of a block of terms, about.
BLOCK = 1 << 16
_COUNTS = "lang string, source string, term string, n long, docs long"
_FOUND = "lang string, source string, part string, item string, value long"

#: Lower case of a byte that belongs to a token (A-Z, a-z and all beyond ASCII), 0 for the others.
LOWER = np.zeros(256, np.uint8)
LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
LOWER[0x41:0x5B] = LOWER[0x61:0x7B]
LOWER[0x80:] = np.arange(0x80, 0x100)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of the tokens of lower-cased bytes, in order; no token spans two texts."""
    inside = np.r_[False, data != 0, False]
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    both = cuts[(data[cuts] != 0) & (data[cuts - 1] != 0)]
    begin[both] = True
    end[both - 1] = True
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begin, end, np.searchsorted(offsets, begin, side="right") - 1


def grouped(data: np.ndarray, begin: np.ndarray, end: np.ndarray, digest=xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(first token of each group, group of each token): tokens with the same bytes, by hash, verified."""
    raw = data.tobytes()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, len(begin))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    other = _differs(data, begin, end, first[group])
    if other.any():  # another token has the hash of its group's first: these are grouped by their bytes
        names: dict[bytes, int] = {}
        extra = []
        for k in np.flatnonzero(other).tolist():
            name = raw[begin[k] : end[k]]
            if name not in names:
                names[name] = len(first) + len(extra)
                extra.append(k)
            group[k] = names[name]
        first = np.r_[first, np.array(extra, first.dtype)]
    return first, group


def _differs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, like: np.ndarray, cells: int = 1 << 21) -> np.ndarray:
    """Whether each token's bytes differ from those of the token ``like``; so many bytes at a time."""
    size = end - begin
    out = size != size[like]
    todo = np.flatnonzero(~out & (like != np.arange(len(begin))))
    ends = np.cumsum(size[todo])
    at = 0
    while at < len(todo):
        till = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + cells, side="right")))
        some = todo[at:till]
        n = size[some]
        start = np.r_[0, np.cumsum(n)[:-1]]
        step = np.arange(int(n.sum())) - np.repeat(start, n)
        wrong = data[np.repeat(begin[some], n) + step] != data[np.repeat(begin[like[some]], n) + step]
        out[some] = np.logical_or.reduceat(wrong, start)
        at = till
    return out


def counted(raw: np.ndarray, offsets: np.ndarray, groups: np.ndarray, digest=xxhash.xxh64_intdigest) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(group, term, occurrences, texts that have it) of a batch; ``groups`` has the group of each text."""
    data = LOWER[raw]
    begin, end, text = boundaries(data, offsets)
    if not len(begin):
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, term = grouped(data, begin, end, digest)
    pair, n = np.unique(text * len(first) + term, return_counts=True)  # one for each text and term
    text, term = np.divmod(pair, len(first))
    key, inverse, docs = np.unique(groups[text] * len(first) + term, return_inverse=True, return_counts=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, inverse, n)
    group, term = np.divmod(key, len(first))
    low = data.tobytes()
    names = [low[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())]
    return group, [names[k] for k in term.tolist()], total, docs


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and texts with the term, by language and source.

    Null text, lang and source read as ''.  The empty term (no token is empty) marks each group that
    occurs, with 0.
    """
    fields = to_arrow_schema(docs.sparkSession.createDataFrame([], _COUNTS).schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2)
            wide = pa.types.is_large_string(texts.type)
            for lo, hi in pieces(np.diff(_offsets(texts, wide)), PIECE):
                part = texts.slice(lo, hi - lo)
                offsets = _offsets(part, wide)
                raw = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                both = pa.StructArray.from_arrays([b.column(k).slice(lo, hi - lo).cast(pa.string()) for k in (0, 1)], ["l", "s"])
                owners = list(zip(both.field(0).to_pylist(), both.field(1).to_pylist()))
                names = sorted(set(owners))
                place = {o: k for k, o in enumerate(names)}
                group, terms, n, having = counted(raw, offsets - offsets[0], np.array([place[o] for o in owners], np.int64))
                group = np.r_[group, np.arange(len(names))]
                cols = [[names[k][0] for k in group], [names[k][1] for k in group], [*terms, *[b""] * len(names)], np.r_[n, np.zeros(len(names), np.int64)], np.r_[having, np.zeros(len(names), np.int64)]]
                arrays = [pa.array(c, pa.binary()).cast(f.type) if f.name == "term" else pa.array(c, f.type) for c, f in zip(cols, fields)]
                yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(rows, _COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _offsets(texts: pa.Array, wide: bool) -> np.ndarray:
    kind = np.int64 if wide else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)


def pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes, or of one row."""
    lo, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > lo and total + n > most:
            yield lo, k
            lo, total = k, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def share(count: np.ndarray, n: np.ndarray | int, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (n + 5 v)), digit group by digit group."""
    whole = np.asarray(n + PRIOR * v, np.int64)
    rest = np.asarray(count, np.int64) + PRIOR
    out, rest = rest // whole, rest % whole
    for _ in range(_THOUSANDS):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def pairwise(indptr: np.ndarray, terms: np.ndarray, shares: np.ndarray, absent: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row of a CSR matrix of shares, the sums of |difference| to all rows, over ``width`` terms.

    ``absent`` is the share of a row's terms that are not stored.
    """
    stored = np.diff(indptr)
    full = np.flatnonzero(stored)
    for s in range(len(absent)):
        own = np.full(width, absent[s], np.int64)
        own[terms[indptr[s] : indptr[s + 1]]] = shares[indptr[s] : indptr[s + 1]]
        ranked = np.sort(own)
        below = np.r_[0, np.cumsum(ranked)]
        at = np.searchsorted(ranked, absent)
        sums = absent * at - below[at] + (below[-1] - below[at]) - absent * (width - at)
        if len(full):
            x = own[terms]
            gain = np.abs(x - shares) - np.abs(x - np.repeat(absent, stored))
            sums[full] += np.add.reduceat(gain, indptr[full])
        yield sums


def divergences(counts: DataFrame, least: int = LEAST_DOCS, ranks: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) from term_counts(): see the module and op11's contract.

    A language without kept terms has its pairs with 0.  Repeated documents count each.
    """
    scratch = Scratch(counts.sparkSession)
    counts = scratch.keep(counts)
    vocabulary = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("in_docs")).where(F.col("in_docs") >= least).select("lang", "term")
    kept = scratch.keep(counts.join(scratch.broadcast_if_small(scratch.keep(vocabulary)), ["lang", "term"], "left_semi").select("lang", "source", "term", "n"))
    marks = counts.where("term = ''").select("lang", "source")
    size = kept.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.count("*").alias("entries"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = scratch.keep(marks.select("lang").distinct().join(size, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), (1 + F.floor(F.coalesce("entries", F.lit(0)) / BLOCK)).cast("int").alias("blocks")))
    small = scratch.broadcast_if_small(langs)
    sources = marks.join(totals, ["lang", "source"], "left").join(small, "lang")
    heads = sources.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.coalesce("total", F.lit(0)).alias("n"), "v")
    cells = kept.join(small, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "n", "v")
    found = heads.unionByName(cells).groupBy("lang", "block").applyInArrow(_block(counts.sparkSession, ranks), _FOUND)
    best = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term is in one block, a pair in all
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = best.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= ranks)).select("lang", "source", "part", "item", "value", "rank")


def _block(spark, ranks: int):
    fields = to_arrow_schema(spark.createDataFrame([], _FOUND).schema)

    def run(table: pa.Table) -> pa.Table:
        lang, v = table.column("lang")[0].as_py(), table.column("v")[0].as_py()
        source, term, n = (table.column(c).to_pylist() for c in ("source", "term", "n"))
        heads = sorted((s, k) for k, (s, t) in enumerate(zip(source, term)) if t is None)
        names = [s for s, _ in heads]
        place = {s: k for k, s in enumerate(names)}
        totals = np.array([n[k] for _, k in heads], np.int64)
        words = sorted({t for t in term if t is not None}, key=lambda t: t.encode())
        column = {t: k for k, t in enumerate(words)}
        cell = np.array([(place[s], column[t], c) for s, t, c in zip(source, term, n) if t is not None], np.int64).reshape(-1, 3)
        cell = cell[np.lexsort((cell[:, 1], cell[:, 0]))]
        rows, terms, count = cell.T
        indptr = np.searchsorted(rows, np.arange(len(names) + 1))
        nothing = v == 0
        absent = np.zeros(len(names), np.int64) if nothing else share(np.zeros(len(names), np.int64), totals, v)
        shares = share(count, totals[rows], v) if len(cell) else count
        out: list[tuple[str, str, str, int]] = []
        for s, sums in enumerate(pairwise(indptr, terms, shares, absent, len(words))):
            out += [(names[s], "pair", names[t], int(x)) for t, x in enumerate(sums.tolist()) if t != s]
        if len(cell):
            whole = np.zeros(len(words), np.int64)
            np.add.at(whole, terms, count)
            lead = shares - share(whole, int(totals.sum()), v)[terms]
            for s in range(len(names)):
                own = np.arange(indptr[s], indptr[s + 1])
                own = own[(lead[own] > 0) & (count[own] > 0)]
                own = own[np.argsort(-lead[own], kind="stable")[:ranks]]  # terms stand in byte order
                out += [(names[s], "term", words[terms[k]], int(lead[k])) for k in own.tolist()]
        cols = [[lang] * len(out), *map(list, zip(*out))] if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], schema=fields)

    return run


def op11_source_divergence(spark, sf_dir) -> DataFrame:
    return divergences(term_counts(documents(spark, sf_dir)))


#: Items sort by bytes: DuckDB compares strings so.
DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
voc AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN voc USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN voc USING (lang) GROUP BY lang),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
ln AS (SELECT lang, sum(total) AS total FROM gn GROUP BY lang),
p AS (SELECT g.lang, g.source, voc.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + {PRIOR})) // (total + {PRIOR} * v) AS p
  FROM gn g JOIN v USING (lang) JOIN voc USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = voc.term),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + {PRIOR})) // (any_value(total) + {PRIOR} * any_value(v)) AS q FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL SELECT p.lang, source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= {TERMS}"""
