"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def _marked() -> tuple[str, str]:
    """Lower-case letters with marks whose base is an ASCII letter, and these; then the combining marks, which go."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(c).islower()]
    pairs = [(c, base) for c, base in pairs if base != c and base.isascii()]
    return "".join(c for c, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(base for _, base in pairs)


MARKED, PLAIN = _marked()


def let(value: Column, f) -> Column:
    """f(value) with value computed once: inside a lambda an expression is otherwise computed anew for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def fold(text: Column) -> Column:
    """Lower case without accents (Latin letters and combining marks); plain ASCII text skips the translation."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(F.lower(text), MARKED, PLAIN)).otherwise(F.lower(text))


def tokens(text: Column) -> Column:
    """Accent-folded word tokens (letters, digits, underscore); null text has none."""
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}_]+"), "")


def sanitize_query(text: Column) -> Column:
    """Keeps letters, digits and white space, collapses spaces and trims."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[^\\p{L}\\p{N}\\s]", " "), "\\s+", " "))


def canonical(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), "\\s+", " ")


def js_round(x: Column, places: int = 2) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(x * 10**places + 0.5) / 10**places


def snippet(text: Column, n: int) -> Column:
    """White space flattened; longer than n: cut at n - 1, right-trimmed, with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…"))).otherwise(flat)


def first_line(text: Column, n: int = 140) -> Column:
    """First non-empty line without tags and markdown marks, cut to n characters with an ellipsis."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0)
    line = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.get(lines, 0), F.lit("")), "<[^>]*>", ""), "^[#>*\\-\\s]+", ""))
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n - 1), F.lit("…"))).otherwise(line)


def title_of(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.(md|txt|jsonl|json)$", "")


def first_sentence(text: Column) -> Column:
    parts = F.transform(F.split(text, "[.!?\\n]"), lambda x: F.trim(x))
    return F.coalesce(F.get(F.filter(parts, lambda x: F.length(x) > 10), 0), F.lit(""))


def short_hash(text: Column, algorithm: str = "sha1", n: int = 16) -> Column:
    return F.substring(F.sha1(text) if algorithm == "sha1" else F.sha2(text, 256), 1, n)


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-8 bytes, as 8 hex digits."""
    codes = F.transform(F.filter(F.split(F.hex(F.encode(text, "utf-8")), "(?<=\\G..)"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, c: (a.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def word_shingles(text: Column, n: int = 3) -> Column:
    """Distinct n-word shingles of cleaned text; fewer words are one shingle; none: empty."""
    clean = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\\s]", " ")

    def grams(t):
        many = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, n), " ")))
        return F.when(F.size(t) >= n, many).when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))

    return let(F.array_remove(F.split(clean, "\\s+"), ""), grams)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column, least: int = 3) -> Column:
    """Shared tokens over the smaller set, 0 if either has under ``least``."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small >= least, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


def trigram_counts(text: Column) -> Column:
    """Sorted character 3-grams, with repeats."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(F.length(text) >= 3, F.array_sort(grams)).otherwise(F.array().cast("array<string>"))


def squad_normalise(text: Column, keep_gap: bool = False) -> Column:
    """Lower case without punctuation and articles; punctuation becomes a space if ``keep_gap``, else it goes."""
    bare = F.regexp_replace(F.lower(text), "[!-/:-@\\[-`{-~]", " " if keep_gap else "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "\\b(a|an|the)\\b", " "), "\\s+", " "))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Sum over distinct tokens of the lesser count."""
    shared = F.array_distinct(F.array_intersect(a, b))
    return F.aggregate(shared, F.lit(0), lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))


def token_f1(pred: Column, gold: Column) -> Column:
    def score(p, g):
        def f1(same):
            prec, rec = same / F.greatest(F.size(p), F.lit(1)), same / F.greatest(F.size(g), F.lit(1))
            return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).when(same == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))

        return let(multiset_overlap(p, g), f1)

    words = lambda x: F.array_remove(F.split(x, " "), "")
    return let(words(pred), lambda p: let(words(gold), lambda g: score(p, g)))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def weighted_digits(d: Column, weights: list[int]) -> Column:
    return reduce(lambda a, b: a + b, [F.substring(d, i + 1, 1).cast("int") * w for i, w in enumerate(weights)])


def luhn(d: Column) -> Column:
    """Luhn check of a digit string."""
    vals = F.transform(F.filter(F.split(F.reverse(d), ""), lambda x: x != ""), lambda x, i: x.cast("int") * (1 + i % 2))
    return F.aggregate(vals, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def cpf(d: Column) -> Column:
    """Check digits of an 11-digit CPF; equal digits throughout fail."""
    def check(n):
        r = weighted_digits(d, list(range(n + 1, 1, -1))) * 10 % 11
        return F.when(r == 10, 0).otherwise(r) == F.substring(d, n + 1, 1).cast("int")

    return F.coalesce(d.rlike("^[0-9]{11}$") & ~d.rlike("^(.)\\1*$") & check(9) & check(10), F.lit(False))


def cnpj(d: Column) -> Column:
    """Check digits of a 14-digit CNPJ; equal digits throughout fail."""
    def check(n):
        w = [(5 - i if n == 12 else 6 - i) for i in range(n)]
        w = [x if x >= 2 else x + 8 for x in w]
        r = weighted_digits(d, w) % 11
        return F.when(r < 2, 0).otherwise(11 - r) == F.substring(d, n + 1, 1).cast("int")

    return F.coalesce(d.rlike("^[0-9]{14}$") & ~d.rlike("^(.)\\1*$") & check(12) & check(13), F.lit(False))


def cnh(d: Column) -> Column:
    """Check digits of an 11-digit driving licence; equal digits throughout fail."""
    first = weighted_digits(d, list(range(9, 0, -1))) % 11
    second = weighted_digits(d, list(range(1, 10))) % 11
    over = first == 10  # the first digit is then 0 and the second loses 2
    dv2 = F.when(second == 10, 0).otherwise(F.pmod(second - F.when(over, 2).otherwise(0), F.lit(11)))
    given = lambda i: F.substring(d, i, 1).cast("int")
    return F.coalesce(d.rlike("^[0-9]{11}$") & ~d.rlike("^(.)\\1*$") & (F.when(over, 0).otherwise(first) == given(10)) & (dv2 == given(11)), F.lit(False))


def titulo(d: Column) -> Column:
    """Check digits and state of a 12-digit voter's title; equal digits throughout fail."""
    state = F.substring(d, 9, 2).cast("int")

    def digit(total):
        r = total % 11
        return F.when(r == 10, 0).when((r == 0) & (state <= 2), 1).otherwise(r)

    given = lambda i: F.substring(d, i, 1).cast("int")
    first = digit(weighted_digits(d, list(range(2, 10))))
    second = digit(given(9) * 7 + given(10) * 8 + first * 9)
    return F.coalesce(d.rlike("^[0-9]{12}$") & ~d.rlike("^(.)\\1*$") & state.between(1, 28) & (first == given(11)) & (second == given(12)), F.lit(False))


def escape_like(prefix: str) -> str:
    return prefix.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
