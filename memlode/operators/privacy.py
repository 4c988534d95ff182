"""Personal identifiers, error messages, viewer events and what a text is worth capturing, as columns.

All is built-in expressions but the viewer events, whose JSON nests to any depth.
"""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlode.functions import text as T

# --- Brazilian identifiers -------------------------------------------------------------------------

#: How sure a match is.
HIGH, MEDIUM_HIGH, MEDIUM, MEDIUM_LOW, LOW, VERY_LOW = 0.95, 0.85, 0.75, 0.65, 0.5, 0.3
#: What may stand before and after an identifier.
BEFORE, AFTER = "(?<=^|[\\s(,;:./=\"'\\[<>])", "(?=[\\s),;:.!?/=\"'\\]>-]|$)"
#: Kinds in order of precedence: pattern, confidence with a passed (or no) check, with a failed one.
IDENTIFIERS = {
    "cnpj": ("\\d{2}\\.\\d{3}\\.\\d{3}/\\d{4}-\\d{2}|\\d{14}", HIGH, MEDIUM_LOW),
    "pix_uuid": ("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}", MEDIUM_HIGH, None),
    "cpf": ("\\d{3}\\.\\d{3}\\.\\d{3}-\\d{2}|\\d{11}", HIGH, VERY_LOW),
    "cartao_br": ("\\d{4}[\\s-]?\\d{4}[\\s-]?\\d{4}[\\s-]?\\d{1,7}|\\d{13,19}", HIGH, VERY_LOW),
    "telefone_br": ("(?:\\+?55[\\s-]?)?(?:\\(?[1-9][0-9]\\)?[\\s-]?)?9?\\d{4}[\\s-]?\\d{4}", MEDIUM_HIGH, LOW),
    "pix_phone": ("\\+55[1-9][0-9]9\\d{8}", HIGH, MEDIUM_LOW),
    "pix_email": ("[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}", MEDIUM_HIGH, None),
    "pix_cpf": ("\\d{11}", HIGH, VERY_LOW),
    "cep": ("\\d{5}-\\d{3}", MEDIUM_HIGH, VERY_LOW),
    "rg": ("\\d{1,2}\\.\\d{3}\\.\\d{3}-[\\dxX]|\\d{7,9}[\\dxX]?", MEDIUM_LOW, None),
    "cnh": ("\\d{11}", MEDIUM, VERY_LOW),
    "titulo_eleitor": ("\\d{12}", HIGH, VERY_LOW),
}
SPAN = "struct<kind:string,at:int,till:int,confidence:double,value:string>"


def normal(kind: str, raw: Column) -> Column:
    if kind in ("pix_uuid", "pix_email"):
        return F.lower(raw)
    if kind == "rg":
        return F.upper(F.regexp_replace(raw, "[.\\-]", ""))
    return F.regexp_replace(raw, "[^0-9]", "")


def checked(kind: str, v: Column) -> Column:
    """Whether a normalised value passes its kind's check; kinds without one pass."""
    n = F.length(v)
    if kind in ("cpf", "pix_cpf"):
        return T.cpf(v)
    if kind == "cartao_br":
        return n.between(13, 19) & ~v.rlike("^(.)\\1+$") & T.luhn(v)
    if kind == "telefone_br":
        return n.between(8, 13) & ((n < 12) | v.startswith("55")) & ((n != 11) | (F.substring(v, 3, 1) == "9"))
    if kind == "cep":
        return n.eqNullSafe(8) & (v != "00000000")
    own = {"cnpj": T.cnpj, "cnh": T.cnh, "titulo_eleitor": T.titulo, "pix_phone": lambda d: d.rlike("^55[1-9][0-9]9[0-9]{8}$")}
    return own[kind](v) if kind in own else F.lit(True)


def _matches(text: Column, kind: str) -> Column:
    pattern, good, bad = IDENTIFIERS[kind]
    pattern = f"{BEFORE}(?:{pattern}){AFTER}"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda v, g: F.struct(v.alias("v"), g.alias("g")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def add(acc, p):
        at, value = acc.pos + p.g, normal(kind, p.v)
        till = at + F.length(p.v)
        sure = F.lit(good) if bad is None else F.when(checked(kind, value), good).otherwise(bad)
        span = F.struct(F.lit(kind).alias("kind"), at.alias("at"), till.alias("till"), sure.alias("confidence"), value.alias("value"))
        return F.struct(till.alias("pos"), F.array_append(acc.out, span).alias("out"))

    return F.when(text.rlike("@" if kind == "pix_email" else "[0-9]"), F.aggregate(pairs, start, add, lambda a: a.out)).otherwise(F.array().cast(f"array<{SPAN}>"))


def identifiers(text: Column, least: float = 0.0, pix_cpf: bool = False) -> Column:
    """array of SPAN: personal identifiers with code point offsets.  Of overlapping ones the first, then the longest,
    then the surest, then the first kind stays.  Null text has none."""
    text = F.coalesce(text, F.lit(""))
    kinds = [k for k in IDENTIFIERS if pix_cpf or k != "pix_cpf"]

    def ranked_as(i):
        return lambda s: F.struct(s.at.alias("at"), (s.at - s.till).alias("size"), (-s.confidence).alias("doubt"), F.lit(i).alias("kind"), s.alias("span"))

    ranked = [F.transform(_matches(text, k), ranked_as(i)) for i, k in enumerate(kinds)]
    order = F.filter(F.array_sort(F.concat(*ranked)), lambda r: r.span.confidence >= least)
    start = F.struct(F.lit(-1).alias("till"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.aggregate(order, start, lambda a, r: F.when(r.at >= a.till, F.struct(r.span.till.alias("till"), F.array_append(a.out, r.span).alias("out"))).otherwise(a), lambda a: a.out)


def short_hash(value: Column) -> Column:
    """The first six hex digits of the 32-bit FNV-1a hash of an ASCII text."""
    step = lambda h, c: h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619 % (1 << 32)
    h = F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), F.lit(2166136261), step)
    return F.substring(F.lower(F.lpad(F.hex(h), 8, "0")), 1, 6)


def redact_identifiers(text: Column, spans: Column, mode: str = "default") -> Column:
    """``text`` with each span replaced by a marker of its kind: plain, of the span's length where that is longer
    (``preserve``), or with a hash of the value that tells equal values (``hash``)."""
    if mode not in ("default", "preserve", "hash"):
        raise ValueError(f"unknown mode {mode!r}")

    def marker(s):
        tag = F.concat(F.lit("[REDACTED:"), s.kind)
        if mode == "hash":
            return F.concat(tag, F.lit(":"), short_hash(s.value), F.lit("]"))
        tag = F.concat(tag, F.lit("]"))
        return F.when(s.till - s.at > F.length(tag), F.rpad(tag, s.till - s.at, "_")).otherwise(tag) if mode == "preserve" else tag

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(s.till.alias("pos"), F.concat(a.out, F.substring(text, a.pos + 1, s.at - a.pos), marker(s)).alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a.out, F.substring(text, a.pos + 1, F.length(text))))


def text_blocks(text: Column, size: int = 500) -> Column:
    """Lines gathered into blocks: a line that would take a block over ``size`` starts the next."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(a, line):
        full = (F.length(a.cur) + F.length(line) > size) & (F.length(a.cur) > 0)
        return F.struct(F.when(full, F.array_append(a.out, a.cur)).otherwise(a.out).alias("out"), F.concat(F.when(full, F.lit("")).otherwise(a.cur), line, F.lit("\n")).alias("cur"))

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), start, step, lambda a: F.when(F.trim(F.regexp_replace(a.cur, "\\s+", " ")) != "", F.array_append(a.out, a.cur)).otherwise(a.out))


def identifier_rates(rows: DataFrame, text: str = "text") -> DataFrame:
    """(kind, total, high, medium, low, rate) over the blocks of a corpus without identifiers: what is found is false.

    high is a confidence of 0.9 or more, medium 0.6 or more; rate is high over all blocks.  Kind ``any`` counts blocks
    with a sure match.
    """
    blocks = rows.select(F.explode(text_blocks(F.col(text))).alias("block")).select(identifiers(F.col("block")).alias("spans"))
    n = blocks.agg(F.count("*").alias("blocks"), F.count(F.when(F.exists("spans", lambda s: s.confidence >= 0.9), 1)).alias("hit"))
    own = blocks.select(F.explode("spans").alias("s")).select("s.kind", "s.confidence")
    sure = F.col("confidence")
    per = own.groupBy("kind").agg(F.count("*").alias("total"), F.count(F.when(sure >= 0.9, 1)).alias("high"), F.count(F.when((sure >= 0.6) & (sure < 0.9), 1)).alias("medium"), F.count(F.when(sure < 0.6, 1)).alias("low"))
    every = n.select(F.lit("any").alias("kind"), F.col("blocks").alias("total"), F.col("hit").alias("high"), F.lit(0).cast("long").alias("medium"), F.lit(0).cast("long").alias("low"))
    return per.union(every).crossJoin(F.broadcast(n.select("blocks"))).select("kind", "total", "high", "medium", "low", (F.col("high") / F.nullif(F.col("blocks"), F.lit(0))).alias("rate"))


# --- errors ----------------------------------------------------------------------------------------

#: Error names with status, code and the message that always stands for them ("" : the scrubbed own one).
ERRORS = {
    "ValidationError": (400, "VALIDATION_ERROR", ""),
    "InvalidBodyError": (400, "INVALID_BODY", ""),
    "BadRequestError": (400, "BAD_REQUEST", ""),
    "WeakPassphraseError": (400, "WEAK_PASSPHRASE", ""),
    "UnauthorizedError": (401, "UNAUTHORIZED", "missing or invalid auth token"),
    "ForbiddenError": (403, "FORBIDDEN", "forbidden"),
    "NotFoundError": (404, "NOT_FOUND", "resource not found"),
    "ConflictError": (409, "CONFLICT", ""),
    "PayloadTooLargeError": (413, "PAYLOAD_TOO_LARGE", ""),
    "BadPassphraseError": (422, "BAD_PASSPHRASE", "bad passphrase or wrong key"),
    "TamperedArchiveError": (422, "TAMPERED_ARCHIVE", "archive integrity check failed"),
    "MissingAADError": (422, "MISSING_AAD", ""),
    "SchemaVersionError": (422, "SCHEMA_VERSION_MISMATCH", ""),
    "ManifestError": (422, "MANIFEST_ERROR", ""),
    "ArchiveFormatError": (422, "ARCHIVE_FORMAT_ERROR", ""),
    "RateLimitError": (429, "RATE_LIMITED", "rate limit exceeded"),
    "CostCapExceededError": (429, "COST_CAP_EXCEEDED", ""),
    "LLMTimeoutError": (504, "LLM_TIMEOUT", "upstream LLM timed out"),
    "LLMUnreachableError": (502, "LLM_UNREACHABLE", "upstream LLM unreachable"),
    "RetrievalEmptyError": (503, "RETRIEVAL_EMPTY", ""),
    "HallucinationError": (422, "HALLUCINATION_AFTER_RETRY", ""),
}
#: What never appears in a message: keys and settings become a mark, a path takes the message with it.
KEYS = (
    "AIza[0-9A-Za-z_-]{20,}", "sk-[A-Za-z0-9]{20,}", "(?i)Bearer\\s+[A-Za-z0-9._-]{20,}", "eyJ[A-Za-z0-9_-]{20,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}", "xox[bps]-[A-Za-z0-9-]{20,}",
    "ghp_[A-Za-z0-9]{20,}", "key=[A-Za-z0-9_-]{16,}", "token=[A-Za-z0-9_-]{16,}", "(?i)password=[^\\s&]+", "(?i)passphrase=[^\\s&]+",
    "(?i)\\bGEMINI_API_KEY=[^\\s]+", "(?i)\\bANTHROPIC_API_KEY=[^\\s]+", "\\bAWS_[A-Z_]+=[^\\s]+",
)
PATHS = (
    "/Users/[^\\s'\"`]+",
    "/home/[^\\s'\"`]+",
    "/root/[^\\s'\"`]+",
    "/var/[^\\s'\"`]+",
    "/etc/[^\\s'\"`]+",
    "/tmp/[^\\s'\"`]+",
    "/opt/[^\\s'\"`]+",
    "(?i)C:\\\\[^\\s'\"`]+",
    "\\(node:\\d+\\)",
    "[A-Za-z]:\\\\Users\\\\[^\\s'\"`]+",
)
MOST = 200


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return functools.reduce(Column.__or__, [text.rlike(p) for p in patterns])


def scrubbed(message: Column) -> Column:
    """A message without keys, settings, line breaks and beyond 200 characters; one that holds a path is replaced."""
    out = message
    for pattern in KEYS:
        out = F.regexp_replace(out, pattern, "[REDACTED]")
    flat = F.regexp_replace(out, "[\\r\\n]+", " ")
    flat = F.when(F.length(flat) > MOST, F.concat(F.substring(flat, 1, MOST), F.lit("…"))).otherwise(flat)
    return F.when(F.coalesce(F.length(message), F.lit(0)) == 0, "request failed").when(_any(out, PATHS), "request failed (details redacted)").otherwise(flat)


def safe_error(name: Column, message: Column) -> list[Column]:
    """status, code and error of an error for its user: unknown names and server errors say nothing of their own."""
    def of(k, other):
        table = F.create_map(*[F.lit(x) for n, v in ERRORS.items() for x in (n, v[k])])
        return F.coalesce(F.try_element_at(table, name), F.lit(other))

    status, fixed = of(0, 500), of(2, "")
    said = F.when(fixed != "", fixed).when(status >= 500, "internal error").otherwise(scrubbed(message))
    return [status.alias("status"), of(1, "INTERNAL_ERROR").alias("code"), said.alias("error")]


def safe_details(details: Column) -> Column:
    """Details as JSON, scrubbed at any depth; what holds a path, and stacks, causes and environments, go.  Null if nothing is left."""
    import re

    keys = [re.compile(p) for p in KEYS]
    paths, gone = [re.compile(p) for p in PATHS], re.compile("(?i)(stack|cause|env|process|__proto__)")

    def text(s: str) -> str | None:
        for k in keys:
            s = k.sub("[REDACTED]", s)
        if any(p.search(s) for p in paths):
            return None
        s = re.sub("[\r\n]+", " ", s) or "request failed"
        return s if len(s) <= MOST else s[:MOST] + "…"

    def clean(v):
        if isinstance(v, str):
            return text(v)
        if isinstance(v, list):
            return [x for x in map(clean, v) if x is not None] or None
        if isinstance(v, dict):
            return {k: x for k, y in v.items() if not gone.fullmatch(k) and (x := clean(y)) is not None} or None
        return v

    return _json_column(clean)(details)


# --- viewer events ---------------------------------------------------------------------------------

#: Fields that never leave, and what stands for a query.
FORBIDDEN = ("content", "body", "text", "raw_text", "prompt", "response", "embedding", "embedding_vector", "vector", "password", "token", "api_key", "secret")
REDACTED = "<redacted>"


def _json_column(change):
    """A pandas UDF that maps JSON texts by a function of their values; null for null, broken JSON or a None."""
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                v = None if t is None else change(json.loads(t))
            except ValueError:
                v = None
            out.append(None if v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":")))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")


def bare_event(event: Column, show_query: bool = False) -> Column:
    """A JSON event without forbidden fields at any depth; absolute paths shrink to their last part and a search's
    query is hidden.  Broken JSON gives null: nothing that cannot be read leaves."""
    forbidden = frozenset(FORBIDDEN)

    def short(s: str) -> str:
        unix = len(s) >= 4 and s[0] == "/" and s[1] != "/" and "/" in s[1:]
        drive = len(s) >= 4 and s[0].isascii() and s[0].isalpha() and s[1] == ":" and s[2] in "\\/"
        return s.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1] if unix or drive else s

    def clean(v):
        if isinstance(v, str):
            return short(v)
        if isinstance(v, list):
            return [clean(x) for x in v]
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if k not in forbidden}
        return v

    def whole(v):
        out = clean(v)
        if isinstance(out, dict) and out.get("type") == "search" and isinstance(out.get("details"), dict) and not show_query:
            out["details"]["query"] = REDACTED
        return out

    return _json_column(whole)(event)


def canonical_json(value: Column) -> Column:
    """JSON with sorted keys at any depth and no spaces; null for broken JSON."""
    def order(v):
        if isinstance(v, list):
            return [order(x) for x in v]
        return {k: order(v[k]) for k in sorted(v)} if isinstance(v, dict) else v

    return _json_column(order)(value)


# --- capture ---------------------------------------------------------------------------------------


def signal_score(text: Column, least: int = 20) -> Column:
    """What a text is worth capturing, 0 to 1: length, prose or code, words, sentence ends, case.

    Too short texts and bare punctuation have 0, texts that are mostly links at most 0.1.
    """
    n = F.length(text)
    links = F.aggregate(F.regexp_extract_all(text, F.lit("(?i)(?<![A-Za-z0-9_])https?://\\S+"), F.lit(0)), F.lit(0), lambda a, u: a + F.length(u))
    code = F.regexp_count(text, F.lit("[{};=<>()\\[\\]]")) / n
    some = lambda pattern, worth: F.when(text.rlike(pattern), worth).otherwise(0.0)
    words = "(?<![A-Za-z0-9_])(?:[A-Za-z][A-Za-z]{2,}|[aA]|[aA]n|[oO]r|[iI]f)(?![A-Za-z0-9_])"  # the whole pattern ignores case
    score = 0.25 + F.when(code >= 0.08, -0.15).otherwise(0.15) + some(words, 0.2) + some("[.!?](\\s|$)", 0.15) + F.when(text.rlike("[a-z]") & text.rlike("[A-Z]"), 0.1).otherwise(0.0) + some("[A-Za-z0-9_]", 0.15)
    return F.when(text.isNull() | (n < least) | text.rlike("^[\\s\\p{P}]+$"), 0.0).when(links / n >= 0.5, 0.1).otherwise(T.clamp01(F.round(score, 10)))


#: Words of a relation and the reason they stand for.
VERBS = {
    "depends_on": "depends_on",
    "depends on": "depends_on",
    "requires": "depends_on",
    "needs": "depends_on",
    "blocked_by": "depends_on",
    "blocked by": "depends_on",
    "uses": "depends_on",
    "consumes": "depends_on",
    "mentions": "mentions",
    "mentioned_in": "mentions",
    "mentioned in": "mentions",
    "mentioned_with": "mentions",
    "mentioned with": "mentions",
    "references": "mentions",
    "referenced by": "mentions",
    "includes commit": "mentions",
    "extends": "extends",
    "enhances": "extends",
    "augments": "extends",
    "replaces": "replaces",
    "supersedes": "replaces",
    "migrates_from": "replaces",
    "derived_from": "derived_from",
    "derived from": "derived_from",
    "extracted_from": "derived_from",
    "extracted from": "derived_from",
    "generated_from": "derived_from",
    "opposes": "opposes",
    "contradicts": "opposes",
    "blocks": "opposes",
    "conflicts_with": "opposes",
}


def relation_reason(verb: Column, given: Column | None = None) -> Column:
    """The reason of a relation: the given one if it is one of the known, else by its verb, else unknown."""
    by = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])
    own = F.try_element_at(by, F.lower(F.trim(verb)))
    if given is not None:
        told = F.lower(F.trim(given))
        own = F.coalesce(F.when(told.isin(*set(VERBS.values())), told), own)
    return F.coalesce(own, F.lit("unknown"))


#: Sources of a write with confidence and provenance.
DEFAULTS = {
    "entity-compiled": (0.9, "declared"),
    "entity-frontmatter": (0.9, "declared"),
    "entity-timeline": (0.95, "observed"),
    "markdown": (0.8, None),
    "graphify": (0.7, "derived"),
    "kg-extract": (0.65, "inferred"),
    "consolidate": (0.75, "derived"),
    "crystallize": (0.85, "derived"),
    "cli-explicit": (0.8, None),
}


def write_defaults(source: Column) -> list[Column]:
    """confidence and provenance_kind of a write by its source; an unknown source is like markdown."""
    sure = F.create_map(*[F.lit(x) for k, (c, _) in DEFAULTS.items() for x in (k, c)])
    kind = F.create_map(*[F.lit(x) for k, (_, p) in DEFAULTS.items() if p for x in (k, p)])
    return [F.coalesce(F.try_element_at(sure, source), F.lit(0.8)).alias("confidence"), F.try_element_at(kind, source).alias("provenance_kind")]


#: An ASCII word boundary, which a letter with a mark does not make.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_NAME = "[A-ZÁÉÍÓÚÂÊÎÔÛÀÃÕÇ][a-záéíóúâêîôûàãõç]+"
#: Structured kinds of entities in order, and the type of entity of each.
FAST = {
    "value_brl": "(?i)R\\$\\s?\\d[\\d.,]*(?:\\s?(?:mil|milh[ãa]o|milh[õo]es|bi|bilh[ãa]o|k|m|b))?",
    "value_usd": "(?i)US?\\$\\s?\\d[\\d.,]*(?:\\s?(?:k|m|b|million|thousand|billion))?",
    "value_eur": "€\\s?\\d[\\d.,]*",
    "cnpj": f"{EDGE}\\d{{2}}\\.\\d{{3}}\\.\\d{{3}}/\\d{{4}}-\\d{{2}}{EDGE}",
    "cpf": f"{EDGE}\\d{{3}}\\.\\d{{3}}\\.\\d{{3}}-\\d{{2}}{EDGE}",
    "date": f"{EDGE}\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}{EDGE}",
    "phone": "\\+?55[\\s-]?\\(?\\d{2}\\)?[\\s-]?\\d{4,5}[\\s-]?\\d{4}",
    "email": "[A-Za-z0-9_.+\\-]+@[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-.]+",
    "url": "https?://[^\\s)]+",
    "percent": f"{EDGE}\\d+(?:[.,]\\d+)?\\s?%",
    "proper_noun": f"{EDGE}{_NAME}(?:\\s+(?:de|da|do|das|dos|e)\\s+)?(?:\\s+{_NAME})+{EDGE}",
}
TYPES = {"email": "person", "phone": "person", "cnpj": "organization", "cpf": "person", "value_brl": "metric", "value_usd": "metric", "value_eur": "metric", "url": "document", "percent": "metric", "proper_noun": "person"}


#: What a text must hold for a kind to be in it, and how each match begins: plain searches that spare most texts and places the pattern.
HOLDS = {"value_brl": "$", "value_usd": "$", "value_eur": "€", "cnpj": "/", "cpf": "-", "date": "/", "phone": "55", "email": "@", "url": "://", "percent": "%"}
BEGINS = {**dict.fromkeys(("cnpj", "cpf", "date", "percent"), "(?=\\d)"), "proper_noun": "(?=[A-ZÁÉÍÓÚÂÊÎÔÛÀÃÕÇ])"}


def _hits(text: Column, kinds: list[str]) -> Column:
    def of(kind):
        found = F.regexp_extract_all(text, F.lit(BEGINS.get(kind, "") + FAST[kind]), F.lit(0))
        found = F.when(F.contains(text, F.lit(HOLDS[kind])), found).otherwise(F.array().cast("array<string>")) if kind in HOLDS else found
        return F.transform(found, lambda v: F.struct(F.lit(kind).alias("kind"), F.trim(F.regexp_replace(v, "^\\s+|\\s+$", "")).alias("value")))

    return F.concat(*[of(k) for k in kinds])


def fast_hits(text: Column) -> Column:
    """array<struct<kind, value>>: the structured parts of a text by kind and place, repeats included."""
    return _hits(text, list(FAST))


def fast_path(rows: DataFrame, text: str = "text", least: int = 3, cap: int = 20) -> DataFrame:
    """(id, kind, name, type): the entities of texts with ``least`` structured parts besides names, which need no model.

    Each kind and value once, ``cap`` a text; dates are parts but no entities.  Names are looked for in these texts only.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    names = _hits(whole, ["proper_noun"])
    kept = lambda hits: F.slice(F.filter(F.array_distinct(hits), lambda h: h.kind != "date"), 1, cap)
    # an element of its own, so that what it is made of is computed once
    parts = F.transform(F.array(_hits(whole, [k for k in FAST if k != "proper_noun"])), lambda hits: F.when(F.size(hits) >= least, kept(F.concat(hits, names))))
    types = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    own = rows.select("id", F.get(parts, F.lit(0)).alias("hits")).select("id", F.explode_outer("hits").alias("h")).where("h is not null")
    return own.select("id", "h.kind", F.col("h.value").alias("name"), F.element_at(types, F.col("h.kind")).alias("type"))


def ambiguous(text: Column, kind: Column, found: Column, entities: Column) -> Column:
    """Whether patterns do not suffice for a text: free forms, nothing found in more than 50 characters, or no entity in more than 200."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.coalesce(kind.isin("conversation", "daily_log", "freeform"), F.lit(False)) | ((found == 0) & (n > 50)) | ((entities == 0) & (n > 200))
