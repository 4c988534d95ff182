"""Dates in answers, brought to one form: 'D Month YYYY', 'Month YYYY' or 'YYYY'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months and their abbreviations.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
ABBREVIATIONS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")
#: The shapes of dates, in the order in which they are tried, and words that only qualify one.
SESSION = "(?i)\\bsession[_\\s]+(\\d+)\\b"
MONTH_DAY_YEAR = "(?i)\\b([a-z]+)\\s+(\\d{1,2})(?:st|nd|rd|th)?,?\\s+(\\d{4})\\b"
ISO = "\\b(\\d{4})-(\\d{1,2})-(\\d{1,2})\\b"
SLASHED = "\\b(\\d{1,2})/(\\d{1,2})/(\\d{4})\\b"
DAY_MONTH_YEAR = "(?i)\\b(\\d{1,2})(?:st|nd|rd|th)?\\s+([a-z]+),?\\s+(\\d{4})\\b"
MONTH_YEAR = "(?i)\\b([a-z]+),?\\s+(\\d{4})\\b"
CANONICAL = "^(?:\\d{4}|[A-Za-z]+\\s+\\d{4}|\\d{1,2}\\s+[A-Za-z]+\\s+\\d{4})$"
QUALIFIERS = ("(?i)\\blast year\\b", "(?i)\\bthis year\\b", "(?i)\\b(?:early|mid|late|around|approximately|approx\\.|roughly)\\s+", "(?s)\\(.*?\\)")


def _first(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def month_name(word: Column) -> Column:
    """The month a word names: in full, or by an abbreviation at its head (four letters, then three); else null."""
    low = F.lower(word)
    full = F.create_map(*[F.lit(x) for m in MONTHS for x in (m.lower(), m)])
    short = F.create_map(*[F.lit(x) for a in ABBREVIATIONS for x in (a, next(m for m in MONTHS if m.lower().startswith(a[:3])))])
    at = lambda m, k: F.try_element_at(m, F.coalesce(k, F.lit("-")))
    return F.coalesce(at(full, low), at(short, F.substring(low, 1, 4)), at(short, F.substring(low, 1, 3)))


def _whole(number: Column) -> Column:
    return number.cast("int").cast("string")


def numbered_month(number: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MONTHS]), number.cast("int") - 1)


def canonical_date(text: Column, sessions: Column | None = None) -> Column:
    """A text's first date in one form; texts without a date, or in the form already, are only trimmed.

    ``sessions`` maps 'session_N' to dates; a session named in the text goes before all else.  Then come, in
    order, 'Month D, YYYY', ISO, 'M/D/YYYY', 'D Month YYYY' and 'Month YYYY'; a shape that names no real
    month is passed over.  Null stays null.
    """
    raw = F.regexp_replace(text, "^\\s+|\\s+$", "")
    low = F.lower(raw)
    named = F.lit(False)
    for m in MONTHS:
        named = named | F.contains(low, F.lit(m.lower()))
    named = named | low.rlike("\\b(?:" + "|".join(ABBREVIATIONS) + ")\\b")
    dated = named | raw.rlike(ISO) | raw.rlike(SLASHED) | raw.rlike(SESSION)
    ways = []
    if sessions is not None:
        ways.append(F.try_element_at(sessions, F.concat(F.lit("session_"), F.coalesce(_first(raw, SESSION, 1), F.lit("-")))))
    join = lambda *parts: F.when(F.greatest(*[p.isNull().cast("int") for p in parts], F.lit(0)) == 0, F.concat_ws(" ", *parts))
    ways.append(join(_whole(_first(raw, MONTH_DAY_YEAR, 2)), month_name(_first(raw, MONTH_DAY_YEAR, 1)), _first(raw, MONTH_DAY_YEAR, 3)))
    ways.append(join(_whole(_first(raw, ISO, 3)), numbered_month(_first(raw, ISO, 2)), _first(raw, ISO, 1)))
    day = _first(raw, SLASHED, 2).cast("int")
    ways.append(F.when(day.between(1, 31), join(day.cast("string"), numbered_month(_first(raw, SLASHED, 1)), _first(raw, SLASHED, 3))))
    ways.append(join(_whole(_first(raw, DAY_MONTH_YEAR, 1)), month_name(_first(raw, DAY_MONTH_YEAR, 2)), _first(raw, DAY_MONTH_YEAR, 3)))
    ways.append(join(month_name(_first(raw, MONTH_YEAR, 1)), _first(raw, MONTH_YEAR, 2)))
    return F.when(raw.rlike(CANONICAL) | ~dated, raw).otherwise(F.coalesce(*ways, raw))


def without_qualifiers(text: Column) -> Column:
    """A text without words that only qualify a date, and without asides in parentheses."""
    for pattern in QUALIFIERS:
        text = F.regexp_replace(text, pattern, "")
    return F.trim(text)
