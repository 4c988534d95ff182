"""What patterns find in a text decides whether a model reads it too; relations of both are merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlode.operators.knowledge import SINGULAR
from memlode.operators.lifecycle import leading_block, stated
from memlode.operators.textual import CODE_REF, DIRS, LINKS, strip_code

#: Sections whose patterns may suffice, kinds of text that a model always reads, and how a text is read.
STRUCTURED = ("compiled", "frontmatter", "timeline")
FREE = ("conversation", "daily_log", "freeform")
PATTERNS_ONLY = "regex_only"
MODEL_ONLY = "gemini_only"
PATTERNS_THEN_MODEL = "regex_primary_gemini_secondary"
MODEL_AFTER_NONE = "gemini_only_after_regex_zero"


#: How a match begins and what a text must hold for one: plain searches before patterns that look behind.
BEGINS = {LINKS["bare"]: f"(?=[{''.join(sorted({d[0] for d in DIRS.split('|')}))}])", CODE_REF: "(?=[sdteSDTE])"}
HOLDS = {LINKS["markdown"]: "](", LINKS["wikilink"]: "[["}


def _pairs(text: str, pattern: str) -> Column:
    """Both groups of each match; every pattern has a slash, so a text without one is not searched.

    A text is searched once: no pattern depends on more than the match but for its edges, which the ends of the match are too.
    """
    part = lambda m, k: F.regexp_extract(m, pattern, k)
    pairs = F.transform(F.regexp_extract_all(text, F.lit(BEGINS.get(pattern, "") + pattern), F.lit(0)), lambda m: F.struct(part(m, 1).alias("a"), part(m, 2).alias("b")))
    some = F.contains(F.col(text), F.lit("/")) & F.contains(F.col(text), F.lit(HOLDS.get(pattern, "/")))
    return F.when(some, pairs).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def pattern_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with n_links (distinct entities outside code), n_stated (relations of the leading block) and n_code
    (distinct code references).  All within the row: nothing is shuffled.  Null texts hold none.
    """
    single = F.create_map(*[F.lit(x) for kv in SINGULAR.items() for x in kv])
    whole = rows.withColumn("whole_", F.coalesce(F.col(text), F.lit(""))).withColumns({"prose_": strip_code(F.col("whole_")), "block_": leading_block(F.col("whole_"))})
    named = lambda p: F.transform(_pairs("prose_", p), lambda m: F.struct(F.coalesce(F.try_element_at(single, m.a), m.a).alias("kind"), m.b.alias("slug")))
    found = whole.withColumns({"links_": F.concat(*[named(p) for p in LINKS.values()]), "code_": _pairs("whole_", CODE_REF), "stated_": stated(F.col("block_"))})
    size = lambda c: F.size(c).cast("long")
    return found.withColumns({"n_links": size(F.array_distinct("links_")), "n_stated": size("stated_"), "n_code": size(F.array_distinct("code_"))}).drop("whole_", "prose_", "block_", "links_", "code_", "stated_")


def routed(rows: DataFrame, text: str = "text", section: str = "section", kind: str = "kind") -> DataFrame:
    """The rows with n_found, method and skipped: whether a model need not read the text, and how it is read.

    A model is skipped where patterns find something in a structured section of a text that is not of a free kind.
    Else patterns that find nothing leave all to it, and patterns go first in structured sections only.  Null sections
    are unstructured, null kinds are not free.
    """
    structured = F.coalesce(F.col(section).isin(*STRUCTURED), F.lit(False))
    free = F.coalesce(F.col(kind).isin(*FREE), F.lit(False))
    n = F.col("n_links") + F.col("n_stated") + F.col("n_code")
    counted = pattern_counts(rows, text).withColumn("n_found", n)
    skipped = structured & ~free & (F.col("n_found") > 0)
    method = F.when(skipped, PATTERNS_ONLY).when(F.col("n_found") == 0, MODEL_AFTER_NONE).when(structured, PATTERNS_THEN_MODEL).otherwise(MODEL_ONLY)
    return counted.withColumns({"method": method, "skipped": skipped})


def merged(patterns: DataFrame, model: DataFrame) -> DataFrame:
    """(source, target, relation, method) of relations (source, target, relation, place), each once whatever its case.

    What patterns found goes before what a model did, then the lower place, then the spelling.  A minimum a key, combined
    before it is shuffled, so a relation stated everywhere is no hot key.  Nulls equal each other.
    """
    parts = ("source", "target", "relation")
    both = patterns.select(*parts, "place", F.lit(0).alias("turn"), F.lit("regex").alias("method")).unionByName(model.select(*parts, "place", F.lit(1).alias("turn"), F.lit("gemini").alias("method")))
    keys = [F.lower(F.col(c)).alias(f"{c}_") for c in parts]
    first = both.groupBy(*keys).agg(F.min(F.struct("turn", "place", *parts, "method")).alias("r"))
    return first.select(*[f"r.{c}" for c in parts], "r.method")
