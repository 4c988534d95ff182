"""Quality rules by distribution divergence (DataFrame functions only).

Each document's character classes, its common words among themselves and its common words among all
words are compared, by Jensen-Shannon distance, with references for a set of languages.  The references are means over all documents of the corpus that
carry the language and are long enough; one pass computes every document's histograms, an aggregate
makes the references, and the verdict is arithmetic on the kept histograms.  Nothing is shuffled but
the partial sums of a few hundred numbers for each language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlode.llm.common import documents, words
from memlode.session import Scratch

#: Frequent function words of each language (public word lists).
COMMON = {
    "en": "the of and to in is that it for was with as are be this on by from",
    "fr": "de la le et les des en un une du que est pour qui dans par sur pas",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein",
    "es": "de la que el en y los del se las por un para con una su al lo",
}
#: Character classes of the histogram, as Java character classes.  White space, the symbols
#: of the base counts and plain characters (all others, so mostly a-z) complete it; digits are left out.
CLASSES = {"upper": "[A-Z]", "accent": "[\\x{C0}-\\x{24F}]", "stop": "[.,]", "shout": "[!?]", "quote": "[\"'():;/_=~^+@-]"}
#: Fixed value: what may stand after a common word that still counts.
AFTER = ".,;:!?"
MIN_WORDS = 50
#: Verdict: greatest distance to the nearest reference.  Sampling noise falls with length, so short texts get more.
MAX_CHAR = 0.15
MAX_WORD = 0.55
SLACK_CHAR, SLACK_WORD = 1.0, 2.0
#: The same for the common words with a bin for all other words: texts without common words are far from all references.
MAX_COVER, SLACK_COVER = 0.2, 1.2
#: References are made anew from the documents kept so far, so many times.
ROUNDS = 2


def base_counts(text: Column) -> dict[str, Column]:
    """word_chars, n_symbols, n_dup_lines of a text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "word_chars": F.coalesce(F.length(text) - F.regexp_count(text, F.lit("[\\x20\\x09-\\x0D]")), F.lit(0)).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long"),
        "n_dup_lines": F.aggregate(F.array(lines), F.lit(0).cast("long"), lambda a, x: a + F.size(x) - F.size(F.array_distinct(x))),
    }


def repeated_words(windows: Column) -> Column:
    """Words that lie in a 3-word window that occurs twice or more, from the windows' hashes in order."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(p):
        same = F.transform(p, lambda x, k: F.when((x.h == F.get(p, k - 1).h) | (x.h == F.get(p, k + 1).h), x.i).otherwise(-1))
        return F.sort_array(F.filter(same, lambda i: i >= 0))

    def let(value: Column, f):  # computes value once
        return F.element_at(F.transform(F.array(value), f), 1)

    covered = lambda s: F.coalesce(F.aggregate(s, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a.n + F.least(F.lit(3), i - a.last)).alias("n"), i.alias("last")), lambda a: a.n), F.lit(0))
    whole = let(pairs, lambda p: let(starts(p), covered))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(whole).cast("long")


def _total(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0), lambda a, x: a + x)


def _shares(hist: str, total: str) -> Column:
    """A histogram's shares; all 0 where it is empty."""
    return F.transform(hist, lambda x: x / F.greatest(F.col(total), F.lit(1)))


def js_distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram (array of shares) to a fixed one."""
    def term(x, y):
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)

    ref = F.array(*[F.lit(float(x)) for x in q])
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, ref, term), F.lit(0.0), lambda a, x: a + x) / 2))


def profile(docs: DataFrame, *, common: dict = COMMON) -> DataFrame:
    """doc_id, lang, the base counts, two histograms as shares and their totals for every row; cover
    is the second with a last bin for all other words, as shares of all words."""
    vocab = sorted({w for ws in common.values() for w in ws.split()})
    shapes = [x + y for w in vocab for x in {w, w.capitalize(), w.upper()} for y in ("", *AFTER)]
    d = docs.select("doc_id", "lang", "text", words(F.col("text")).alias("ws"))
    windows = F.transform(F.sequence(F.lit(0), F.size("ws") - 3), lambda i: F.xxhash64(F.get("ws", i), F.get("ws", i + 1), F.get("ws", i + 2)))
    windows = F.when(F.size("ws") >= 3, windows).otherwise(F.array().cast("array<bigint>"))
    hits = F.array_join(F.filter("ws", lambda w: w.isin(*shapes)), "  ")
    hits = F.lower(F.regexp_replace(F.concat(F.lit(" "), hits, F.lit(" ")), f"[{AFTER}]", ""))
    counts = [F.coalesce(F.regexp_count("text", F.lit(c)), F.lit(0)).alias(f"c_{k}") for k, c in CLASSES.items()]
    digits = F.coalesce(F.regexp_count("text", F.lit("[0-9]")), F.lit(0)).alias("c_digit")
    d = d.select("doc_id", "lang", F.coalesce(F.length("text"), F.lit(0)).alias("len"), F.size("ws").cast("long").alias("n_words"), windows.alias("wins"), hits.alias("hits"), *[v.alias(k) for k, v in base_counts(F.col("text")).items()], *counts, digits)
    classes = [F.col("len") - F.col("word_chars"), F.col("n_symbols"), *[F.col(f"c_{k}") for k in CLASSES]]
    plain = F.col("word_chars") - F.col("c_digit") - sum((F.col(f"c_{k}") for k in CLASSES), F.col("n_symbols"))
    counted = [(F.length("hits") - F.length(F.replace(F.col("hits"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2) for w in vocab]
    base = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    d = d.select(*base, repeated_words(F.col("wins")).alias("n_repeat_words"), F.array(plain, *classes).cast("array<int>").alias("h_c"), F.array(*counted).cast("array<int>").alias("h_w"))
    d = d.withColumns({"char_total": _total(F.col("h_c")), "word_total": _total(F.col("h_w"))})
    every = F.greatest(F.col("n_words"), F.lit(1))
    d = d.withColumn("cover", F.array_append(F.transform("h_w", lambda x: x / every), 1 - F.col("word_total") / every))
    return d.withColumns({"chars": _shares("h_c", "char_total"), "common": _shares("h_w", "word_total")}).drop("h_c", "h_w")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(profiles: DataFrame, *, common: dict = COMMON, robust: bool = False) -> dict[str, tuple[list, list, list]]:
    """For each configured language the mean histograms over all its documents that pass the base rules.

    ``robust`` takes medians for the character classes, which up to half of junk does not move.

    A language without such documents has no reference.  One row a configured language reaches the driver.
    """
    n_chars, n_words = len(CLASSES) + 3, len({w for ws in common.values() for w in ws.split()})
    mean = lambda col, n: F.array(*[F.avg(F.get(col, F.lit(i))) for i in range(n)])
    good = profiles.where(F.col("lang").isin(*common) & ~base_failed())
    middle = F.array(*[F.percentile_approx(F.get("chars", F.lit(i)), 0.5, 2000) for i in range(n_chars)])
    rows = good.groupBy("lang").agg((middle if robust else mean("chars", n_chars)).alias("c"), mean("common", n_words).alias("w"), mean("cover", n_words + 1).alias("o")).collect()
    return {r.lang: ([x / (sum(r.c) or 1) for x in r.c], list(r.w), list(r.o)) for r in rows}


def judge(profiles: DataFrame, refs: dict, max_char: float = MAX_CHAR, max_word: float | None = MAX_WORD) -> DataFrame:
    """Adds base_failed, char_distance, word_distance, cover_distance and kept.

    Distances are to the nearest reference; with no reference at all they are null and only the base
    rules speak.  The limits grow by a slack divided by the root of the number of characters, or of
    common words, or of all words, that the histogram is made of: that guards short texts.  max_word None
    leaves words out.
    """
    def nearest(col, k):
        ds = [js_distance(F.col(col), r[k]) for r in refs.values()]
        return F.array_min(F.array(*ds)) if ds else F.lit(None).cast("double")

    out = profiles.withColumns({"base_failed": base_failed(), "char_distance": nearest("chars", 0), "word_distance": nearest("common", 1), "cover_distance": nearest("cover", 2)})
    far = (F.col("char_distance") > max_char + SLACK_CHAR / F.sqrt(F.greatest(F.col("char_total"), F.lit(1))))
    if max_word is not None:
        far = far | (F.col("word_distance") > max_word + SLACK_WORD / F.sqrt(F.greatest(F.col("word_total"), F.lit(1))))
        far = far | (F.col("cover_distance") > MAX_COVER + SLACK_COVER / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the base counts, base_failed, distances and kept.

    Null text has no words (and fails on length).  Null or unknown lang only means that the document
    adds to no reference: it is compared with all of them.  Repeated rows each get a row.
    """
    prof = Scratch(docs.sparkSession).keep(profile(docs))
    refs = references(prof, robust=True)
    for words_too in (None, *[MAX_WORD] * (ROUNDS - 1)):  # junk among the references would bring them nearer to junk
        refs = references(judge(prof, refs, max_word=words_too).where("kept")) or refs
    return judge(prof, refs)


def op5_quality_rules(spark, sf_dir) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
