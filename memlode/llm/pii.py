"""Personal data: base patterns and information-theoretic sanitisation (DataFrame functions only).

Base spans (e-mail, IP, card, phone) come from one regular expression each, matched leftmost without
overlap; offsets follow from the pieces between the matches.  A secret is a run whose own information
content no word has: 32 or more letters, digits, - and _ with both letters and digits and 8 or more
different characters, outside base spans.

Protected entities are the values found and what recurs of them (``parts``: an address's owner and
domain, a card's issuer, a phone's area, a network), and the fact that a text holds personal data at
all.  A term t discloses an entity c when their pointwise mutual information over the corpus,
log2(p(c, t) / (p(c) p(t))), reaches a share of the entity's information content -log2 p(c): whoever
reads t can all but infer c.  Such terms are generalised to a placeholder or, above a second
threshold, removed.  Probabilities count near-duplicate classes of texts, the components of texts that
agree in a band of MinHash values over word shingles: copies and near copies of a text are one
observation, unrelated texts stay apart.  An entity needs ``SUPPORT`` classes, however many texts each
has, and so does a pair.  A pair must also be too frequent for chance: the Chernoff bound of its count
under independence, times the number of pairs looked at, must stay below ``CHANCE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlode.llm.common import documents, words
from memlode.operators.graph import connected_components
from memlode.session import Scratch

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Each starts where a match can start at all and takes runs whole, so no text makes it slow or deep:
#: the same matches as the plain patterns give.
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){12,18}+(?![\\x20-]?[0-9])",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: A run of characters that may be a secret, and the parts of it that must occur.
SECRET, SECRET_HAS, SECRET_KINDS = "(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,}+", ("[0-9]", "[A-Za-z]"), 8
SUPPORT, CHANCE = 3, 0.05
#: Stands for the characters of base matches while terms are looked for.
FILL = "\uFFFC"
#: Characters that separate words of a bare text; characters that a term starts and ends with, and others.
SPLIT = f"\\x20\\x09-\\x0D{FILL}"
INNER, OUTER = "[\\p{L}\\p{M}\\p{N}]", "[^\\p{L}\\p{M}\\p{N}]"
#: What is between terms: others at either end and around separators.  Taken from the start of a run, so once.
BETWEEN = f"(?<![^\\p{{L}}\\p{{M}}\\p{{N}}{SPLIT}])[^\\p{{L}}\\p{{M}}\\p{{N}}{SPLIT}]*+(?:[{SPLIT}]{OUTER}*+|$)|^{OUTER}++"
#: At the start of the name of a placeholder.
HOLDER = "(?<=<)(?-i:EMAIL|IP|CARD|PHONE|SECRET)>"
#: Near-duplicate classes: words a shingle, bands and MinHash values a band.
SHINGLE, BANDS, ROWS = 3, 4, 5
#: The same for texts that hold one value: they are few and alike far more often than by chance.
FINE_BANDS, FINE_ROWS = 16, 3
#: A text's shingle hashes are represented by so many of the least: a uniform sample that like texts share.
SKETCH = 128
DISCLOSES, REMOVES = 0.85, 0.97


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    d = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    vals = F.transform(d, lambda x, i: x.cast("int") * (1 + i % 2))
    return F.aggregate(F.transform(vals, lambda v: F.when(v > 9, v - 9).otherwise(v)), F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, "\\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return luhn(_digits(v))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    if kind == "secret":
        return v.rlike(SECRET_HAS[0]) & v.rlike(SECRET_HAS[1]) & (F.size(F.array_distinct(F.split(v, ""))) >= SECRET_KINDS)
    return F.lit(True)


def _maybe(kind: str, text: Column) -> Column:
    """A cheap test that no text with a match fails."""
    if kind in ("email", "phone"):
        return F.contains(text, F.lit("@" if kind == "email" else "+"))
    if kind == "secret":
        return text.rlike(SECRET)
    return text.rlike("[0-9]\\.[0-9]" if kind == "ip" else "[0-9](?:[\\x20-]?[0-9]){12}")


def _pattern(kind: str) -> str:
    return SECRET if kind == "secret" else PATTERNS[kind]


def matches(text: Column, pattern: Column) -> Column:
    """array<struct<at, till, value>>: all matches with their code point offsets."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda v, g: F.struct(v.alias("v"), g.alias("g")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<at:int,till:int,value:string>>").alias("out"))

    def add(acc, s):
        at = acc.pos + s.g
        till = at + F.length(s.v)
        return F.struct(till.alias("pos"), F.array_append(acc.out, F.struct(at.alias("at"), till.alias("till"), s.v.alias("value"))).alias("out"))

    return F.aggregate(steps, start, add, lambda a: a.out)


def base_spans(text: Column, kind: str) -> Column:
    none = F.array().cast("array<struct<at:int,till:int,value:string>>")
    own = F.filter(matches(text, F.lit(_pattern(kind))), lambda m: valid(kind, m.value))
    return F.when(_maybe(kind, text), own).otherwise(none)


def _joined(spans: list[tuple[str, Column]]) -> Column:
    def shown(kind, c):
        return F.transform(c, lambda m: F.concat_ws(":", F.lit(kind), m.at.cast("string"), m.till.cast("string")))

    parts = [shown(k, c) for k, c in spans]
    return F.array_join(F.concat(*parts), ",")


def _key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").alias("k_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k_h")]


def terms_of(text: Column) -> Column:
    """The distinct possible terms of a bare text: its words, from the first to the last letter, mark or digit of each."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), BETWEEN), ""))


def _let(value: Column, f) -> Column:
    """f(value) with value computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def bands(text: Column, n: int = BANDS, rows: int = ROWS) -> Column:
    """array<bigint>: a hash of each band of MinHash values over the shingles of ``SHINGLE`` words.

    The values are those of the text's bottom sketch, whose Jaccard similarity to another's is that of the
    shingle sets but for sampling.  A shorter text is one shingle; all texts without words agree.
    """
    def shingles(ws):
        every = F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(SHINGLE)]))
        return F.slice(F.sort_array(F.array_distinct(every)), 1, SKETCH)

    def least(hs):
        return F.transform(F.array(*[F.lit(b) for b in range(n * rows)]), lambda b: F.array_min(F.transform(hs, lambda h: F.xxhash64(h, b))))

    def cut(mins):
        return F.array(*[F.xxhash64(F.lit(i), F.slice(mins, i * rows + 1, rows)) for i in range(n)])

    return _let(words(text), lambda ws: _let(_let(shingles(ws), least), cut))


def near_classes(docs: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(node, root): the class of each text, both as text hashes, but for texts that are their own root.

    Texts that agree in a band are linked and classes are the components of the links: no pair of texts
    is formed.  With shingle sets of Jaccard similarity 0.95, 0.9, 0.5 and 0.1 a link is there with a
    probability of 0.997, 0.97, 0.12 and 0.00004.  Texts that hold a common value (k_h, entity of ``values``) are
    linked by finer bands (0.9 at 0.5, 0.35 at 0.3, 0.02 at 0.1): loose copies of one text are no separate witnesses of
    its values.
    """
    scratch = Scratch(docs.sparkSession)
    # an outer explode, as below; equal texts have equal bands
    keys = docs.select(_key(docs)[1], F.explode_outer(bands(F.col("text"))).alias("band")).distinct()
    keys = scratch.keep(keys)
    lows = keys.groupBy("band").agg(F.min("k_h").alias("low"), F.count("*").alias("n")).where("n > 1").select("band", "low")
    edges = keys.join(lows, "band").select(F.col("k_h").alias("src"), F.col("low").alias("dst"))
    if values is not None:
        holders = scratch.keep(values.select(F.col("k_h").alias("v_h")).distinct())
        held = docs.select(_key(docs)[1], "text").join(scratch.broadcast_if_small(holders), F.col("k_h") == F.col("v_h"), "left_semi")
        fine = held.select("k_h", F.explode_outer(bands(F.col("text"), FINE_BANDS, FINE_ROWS)).alias("band")).distinct()
        fine = scratch.keep(fine.join(values.select("k_h", "entity"), "k_h").select("k_h", F.xxhash64("entity", "band").alias("key")))
        first = fine.groupBy("key").agg(F.min("k_h").alias("low"), F.count("*").alias("n")).where("n > 1").select("key", "low")
        edges = edges.union(fine.join(first, "key").select(F.col("k_h").alias("src"), F.col("low").alias("dst")))
    return scratch.keep(connected_components(edges))


def with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the class of the text whose hash is k_h; few narrow columns, as large classes shuffle them."""
    classes = Scratch(rows.sparkSession).broadcast_if_small(classes)
    return rows.join(classes, F.col("k_h") == F.col("node"), "left").withColumn("class", F.coalesce("root", "k_h")).drop("node", "root")


def parts(kind: str, v: Column) -> list[Column]:
    """What of a value recurs with others: each as text, null where there is none."""
    if kind == "email":
        owner = F.regexp_extract(v, "^[^@a-z]*([a-z]{3,})[^@]*@", 1)
        return [F.concat(F.lit("domain:"), F.substring_index(v, "@", -1)), F.when(owner != "", F.concat(F.lit("owner:"), owner))]
    if kind == "ip":
        return [F.concat(F.lit("net:"), F.substring_index(v, ".", 3))]
    digits = _digits(v)
    if kind == "card":
        return [F.concat(F.lit("issuer:"), F.substring(digits, 1, 6))]
    return [F.concat(F.lit("area:"), F.left(digits, F.length(digits) - 7))]


def entities(spans: dict[str, Column]) -> Column:
    """The distinct protected entities of a text, from its spans by kind: values with their kinds, their parts and ``any``."""
    def named(kind, col):
        if kind == "secret":  # a value of its own, nothing of it recurs
            return F.transform(col, lambda m: F.concat(F.lit("secret:"), m.value))
        return F.flatten(F.transform(F.transform(col, lambda m: F.lower(m.value)), lambda v: F.array(F.concat(F.lit(f"{kind}:"), v), *parts(kind, v))))

    some = F.greatest(*[F.size(c) for c in spans.values()]) > 0
    return F.array_distinct(F.array_compact(F.concat(*[named(k, c) for k, c in spans.items()], F.when(some, F.array(F.lit("any"))).otherwise(F.array().cast("array<string>")))))


def scan(docs: DataFrame) -> DataFrame:
    """For every row: its key, the base spans of each kind and, outside them, the secrets."""
    out = docs.select(*_key(docs), F.coalesce("text", F.lit("")).alias("text"))
    # the outer explode of one row keeps the spans from being computed for every use of them
    out = out.select("*", F.explode_outer(F.array(F.struct(*[base_spans(F.col("text"), k).alias(k) for k in KINDS]))).alias("base"))
    some = F.greatest(*[F.size(f"base.{k}") for k in KINDS]) > 0
    out = bare(out, some, KINDS)
    return out.select("k_id", "k_h", "base.*", base_spans(F.col("bare"), "secret").alias("secret"))


def masked(text: Column, kind: str, shown=None) -> Column:
    """The text with each valid match v of a kind replaced by shown(v), or by its placeholder."""
    shown = shown or (lambda v: F.lit(f"<{kind.upper()}>"))
    found = F.regexp_extract_all(text, F.lit(_pattern(kind)), F.lit(0))
    own = F.transform(found, lambda v: F.when(valid(kind, v), shown(v)).otherwise(v))
    pieces = F.zip_with(F.split(text, _pattern(kind), -1), own, lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))
    return F.when(_maybe(kind, text), F.array_join(pieces, "")).otherwise(text)


def bare(docs: DataFrame, some: Column, kinds: tuple = ALL_KINDS) -> DataFrame:
    """``docs`` with column bare: the text with ``FILL`` for each character of a match, so offsets stay.  ``some`` says
    which texts may have matches at all."""
    out = docs.withColumn("bare", F.coalesce("text", F.lit(""))).withColumn("some_", some)
    for kind in kinds:  # a step each: in one expression every step would hold several copies of the one before
        out = out.withColumn("bare", F.when(F.col("some_"), masked(F.col("bare"), kind, lambda v: F.repeat(F.lit(FILL), F.length(v)))).otherwise(F.col("bare")))
    return out.drop("some_")


def disclosing_terms(docs: DataFrame, found: DataFrame, support: int = SUPPORT, discloses: float = DISCLOSES, removes: float = REMOVES, chance: float = CHANCE) -> DataFrame | None:
    """(k_h, term, removed): the terms of each text, by its hash, that disclose an entity, or None if there are none.

    All counts are over all documents, each near-duplicate class once.  Texts are not shuffled while the
    table of those that hold a frequent entity is small: the passes over them meet broadcast tables.
    """
    scratch = Scratch(docs.sparkSession)
    # outer explodes: the optimizer derives no size tests from them, which would compute the arrays twice
    seen = found.select("k_h", F.explode_outer(entities({k: F.col(k) for k in ALL_KINDS})).alias("entity")).where("entity is not null").distinct()
    own = F.substring_index("entity", ":", 1).isin(*ALL_KINDS)
    seen = scratch.keep(seen.select("k_h", F.xxhash64("entity").alias("entity"), own.alias("value")))
    texts = scratch.keep(seen.groupBy("entity").agg(F.count("*").alias("texts")).where(F.col("texts") >= support).select("entity"))
    if texts.isEmpty():
        return None
    seen = scratch.keep(seen.join(scratch.broadcast_if_small(texts), "entity", "left_semi"))
    classes = near_classes(docs, seen.where("value"))
    total = found.select("k_h").distinct().count() - classes.count()
    seen = scratch.keep(with_class(seen.drop("value"), classes))
    often = seen.select("entity", "class").distinct().groupBy("entity").agg(F.count("*").alias("n_c")).where((F.col("n_c") >= support) & (F.col("n_c") < total))
    often = scratch.keep(often)
    held = scratch.keep(seen.join(scratch.broadcast_if_small(often), "entity").select("k_h", "entity", "n_c", "class"))
    if held.isEmpty():
        return None
    holders = scratch.keep(held.select("k_h").distinct())
    spotted = scratch.keep(found.where(F.greatest(*[F.size(k) for k in ALL_KINDS]) > 0).select(F.col("k_h").alias("s_h")).distinct())
    every = docs.select(_key(docs)[1], "text").join(scratch.broadcast_if_small(spotted), F.col("k_h") == F.col("s_h"), "left").withColumn("some", F.col("s_h").isNotNull()).drop("s_h")
    near = uses(every.join(scratch.broadcast_if_small(holders), "k_h", "left_semi")).join(scratch.broadcast_if_small(held), "k_h")
    both = scratch.keep(near.groupBy("entity", "n_c", "term").agg(F.countDistinct("class").alias("n_ct")).where(F.col("n_ct") >= support))
    pairs = both.count()
    if not pairs:
        return None
    # a share of ``discloses`` bounds n_t: terms of more classes than that need no further count
    most = F.max(F.col("n_ct") / F.col("n_c") * F.pow(F.col("n_c"), F.lit(discloses)) * F.lit(float(total) ** (1 - discloses)))
    bound = scratch.keep(both.groupBy("term").agg(most.alias("most")))
    # at least so many classes: each counts once or, where only another of its texts has the term, not at all;
    # rows of one text share its count, so that nothing but sums by term is shuffled
    copies = scratch.keep(found.groupBy(F.col("k_h").alias("node")).agg(F.count("*").alias("rows")).where("rows > 1"))
    roots = every.join(scratch.broadcast_if_small(classes), F.col("k_h") == F.col("node"), "left_anti")
    roots = roots.join(scratch.broadcast_if_small(copies), F.col("k_h") == F.col("node"), "left")
    few = uses(roots.withColumn("part", 1 / F.coalesce("rows", F.lit(1))), scratch.broadcast_if_small(bound), "part").groupBy("term").agg(F.sum("part").alias("n"))
    wanted = scratch.keep(bound.join(few, "term", "left").where(F.coalesce("n", F.lit(0.0)) <= F.col("most") * 1.001).select("term"))
    used = scratch.keep(with_class(uses(every, scratch.broadcast_if_small(wanted)).distinct(), classes))
    n_t = used.groupBy("term").agg(F.countDistinct("class").alias("n_t"))
    share = F.log2(F.col("n_ct") * F.lit(float(total)) / (F.col("n_c") * F.col("n_t"))) / F.log2(F.lit(float(total)) / F.col("n_c"))
    expected = F.col("n_c") * F.col("n_t") / F.lit(float(total))
    surprise = F.col("n_ct") * F.log(F.col("n_ct") / expected) - F.col("n_ct") + expected
    scored = both.join(n_t, "term").where((F.col("n_ct") > expected) & (surprise >= F.log(F.lit(pairs / chance)))).select("term", share.alias("share"))
    terms = scratch.keep(scored.where(F.col("share") >= discloses).groupBy("term").agg((F.max("share") >= removes).alias("removed")))
    return scratch.keep(used.join(scratch.broadcast_if_small(terms), "term").select("k_h", "term", "removed"))


def uses(texts: DataFrame, terms: DataFrame | None = None, *carry: str) -> DataFrame:
    """(k_h, *carry, term): the terms of each text (k_h, text, and whether it has ``some`` matches), of ``terms`` only if given."""
    rows = bare(texts, F.col("some")).select("k_h", *carry, terms_of(F.col("bare")).alias("ws")).select("k_h", *carry, F.explode_outer("ws").alias("term")).where("term is not null")
    return rows if terms is None else rows.join(terms, "term", "left_semi")


def own_patterns(terms: DataFrame) -> DataFrame:
    """For each text with such terms: its hash, a regular expression of them and the list of those to remove.

    Longer terms come first, so none is cut by one that it starts with; placeholders do not match.
    """
    longest = F.transform(F.array_sort(F.collect_set(F.struct((-F.length("term")).alias("n"), F.col("term").alias("t")))), lambda x: F.regexp_replace(x.t, "([^\\p{L}\\p{M}\\p{N}])", "\\\\$1"))
    pattern = F.concat(F.lit(f"(?iu)(?<!{INNER})(?!{HOLDER})(?:"), F.array_join(longest, "|"), F.lit(f")(?!{INNER})"))
    removed = F.collect_set(F.when(F.col("removed"), F.col("term")))
    own = Scratch(terms.sparkSession).keep(terms.groupBy(F.col("k_h").alias("p_h")).agg(pattern.alias("k_any"), removed.alias("k_remove")))
    # near copies have like patterns, so the size on disk tells little
    size = own.agg(F.sum(2 * F.octet_length("k_any") + 64)).first()[0] or 0
    return F.broadcast(own) if size <= 8 << 20 else own


def find(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term, n_spans) for every row of ``docs``.

    Null text is empty: no spans.  Rows that repeat id and text each get a row; a null id is allowed.
    spans holds the base spans by kind, then the secrets and the disclosing terms outside them, as kinds
    ``secret`` and ``term``; n_spans counts all.
    """
    none = F.array().cast("array<struct<at:int,till:int,value:string>>")
    found = Scratch(docs.sparkSession).keep(scan(docs))
    terms = disclosing_terms(docs, found, **options)
    out = found
    if terms is None:
        out = out.withColumn("term", none)
    else:
        spans = bare(docs.select(_key(docs)[1], F.col("text")).join(own_patterns(terms), F.col("k_h") == F.col("p_h")), F.lit(True))
        spans = spans.select("p_h", matches(F.col("bare"), F.col("k_any")).alias("term")).dropDuplicates(["p_h"])
        out = out.join(spans, F.col("k_h") == F.col("p_h"), "left").withColumn("term", F.coalesce("term", none))
    number = {k: F.size(k).cast("long") for k in (*ALL_KINDS, "term")}
    return out.select(
        F.col("k_id").alias("doc_id"), *[number[k].alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined([(k, F.col(k)) for k in KINDS]), 256).alias("base_sha256"), _joined([(k, F.col(k)) for k in number]).alias("spans"),
        number["secret"].alias("n_secret"), number["term"].alias("n_term"), sum(number.values()).alias("n_spans"),
    )


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with text (and n_chars) sanitised: base matches and secrets become placeholders, then disclosing
    terms outside them become <TERM> or go.  Null text stays null; other columns stay as they are."""
    found = Scratch(docs.sparkSession).keep(scan(docs))
    terms = disclosing_terms(docs, found, **options)
    out = docs.withColumn("k_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    for kind in ALL_KINDS:  # before the terms: a term may be a part of an address
        out = out.withColumn("text", masked(F.col("text"), kind))
    if terms is not None:
        out = out.join(own_patterns(terms), F.col("k_h") == F.col("p_h"), "left")
        found = F.transform(F.regexp_extract_all("text", F.col("k_any"), F.lit(0)), lambda v: F.when(F.array_contains("k_remove", F.lower(v)), F.lit("")).otherwise(F.lit("<TERM>")))
        pieces = F.zip_with(F.split("text", F.col("k_any"), -1), found, lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))
        out = out.withColumn("text", F.when(F.col("k_any").isNull(), F.col("text")).otherwise(F.array_join(pieces, "")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def op8_pii(spark, sf_dir) -> DataFrame:
    return find(documents(spark, sf_dir))
