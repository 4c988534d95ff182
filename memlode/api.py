"""The three user-facing primitives over DataFrames: search, answer and the temporal filter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memlode.operators import ranking, temporal


@dataclass
class Memory:
    """A store of chunks (schema of the plans' ``chunks``), optionally with vectors (id, vec).

    Queries come as a DataFrame (query_id, text), so one call serves many questions.  Nothing reads the
    clock: ``now`` is given.  ``embed`` turns queries into (query_id, vec), ``write`` turns contexts into
    answers; both are the caller's.
    """

    chunks: DataFrame
    now: Column
    vectors: DataFrame | None = None
    embed: Callable[[DataFrame], DataFrame] | None = None
    write: Callable[[DataFrame], DataFrame] | None = None
    options: dict = field(default_factory=dict)

    def at(self, t: Column) -> Memory:
        """The store as it was at t: filters run before either leg is scored."""
        return Memory(temporal.as_of(self.chunks, t), self.now, self.vectors, self.embed, self.write, self.options)

    def since(self, t: Column) -> Memory:
        return Memory(temporal.changed_since(self.chunks, t), self.now, self.vectors, self.embed, self.write, self.options)

    def _full_text(self, queries: DataFrame, limit: int) -> DataFrame:
        hits = ranking.bm25_top(self.chunks, queries, 20, **self.options)
        own = ranking.boosted(hits.join(self.chunks, "id"), "fts", self.now.cast("date"))
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "rank")
        return own.withColumn("rank0", F.row_number().over(w) - 1).where(F.col("rank0") < 2 * limit).select("query_id", F.lit("fts").alias("leg"), "rank0", "id")

    def _semantic(self, queries: DataFrame, limit: int) -> DataFrame:
        live = self.vectors.join(self.chunks.select("id"), "id", "left_semi")
        near = ranking.knn(live, self.embed(queries), 8 * limit).withColumn("distance", 1 - F.col("cos"))
        own = ranking.boosted(ranking.semantic_scores(near).join(self.chunks, "id"), "semantic", self.now.cast("date"))
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "rank")
        return own.withColumn("rank0", F.row_number().over(w) - 1).where(F.col("rank0") < 4 * limit).select("query_id", F.lit("semantic").alias("leg"), "rank0", "id")

    def search(self, queries: DataFrame, limit: int = 5) -> DataFrame:
        """(query_id, pos, id, score, match_type): fused, deduplicated hits of each query."""
        legs = self._full_text(queries, limit)
        if self.vectors is not None and self.embed is not None:
            legs = legs.union(self._semantic(queries, limit))
        key = F.concat("source_file", F.lit("::"), F.substring("chunk_text", 1, 50)).alias("key")
        fused = ranking.rrf(legs.join(self.chunks.select("id", key), "id"))
        w = W.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 9)), "id")
        pool = fused.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= max(3 * limit, 15))
        own = pool.join(self.chunks.select("id", "source_file", "chunk_type", "section", "chunk_text"), "id")
        cols = ["query_id", "id", "pos", "score", "match_type", "source_file", "chunk_type", "section", "chunk_text"]
        return ranking.deduped(own.select(*cols), limit).select("query_id", "pos", "id", "score", "match_type")

    def answer(self, queries: DataFrame, top_k: int = 8, characters: int = 12_000) -> DataFrame:
        """(query_id, answer, cited, unknown, abstained): contexts within a character budget go to ``write``
        (query_id, text, context -> query_id, answer); an answer without a known citation abstains."""
        top_k = max(1, min(20, top_k))
        hits = self.search(queries, 2 * top_k).withColumn("rank", F.col("pos")).join(self.chunks.select("id", "chunk_text"), "id")
        own = temporal.answer_context(hits, top_k)
        w = W.partitionBy("query_id").orderBy("rank")
        run = F.sum(F.length("chunk_text")).over(w.rowsBetween(W.unboundedPreceding, 0))
        fits = own.withColumns({"run": run, "n": F.row_number().over(w)}).where((F.col("run") <= characters) | (F.col("n") == 1))
        line = F.concat(F.lit("["), "marker", F.lit("] "), "chunk_text")
        context = fits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda s: s.l), "\n").alias("context"), F.collect_set("marker").alias("known"))
        asked = queries.join(context, "query_id", "left")
        said = self.write(asked.where("context is not null").select("query_id", "text", "context"))
        out = asked.select("query_id", F.coalesce("known", F.array().cast("array<string>")).alias("known")).join(said, "query_id", "left")
        c = temporal.citations(F.coalesce("answer", F.lit("")), F.col("known"))
        return out.select("query_id", "answer", c.getField("cited").alias("cited"), c.getField("unknown").alias("unknown"), (F.size(c.getField("cited")) == 0).alias("abstained"))
