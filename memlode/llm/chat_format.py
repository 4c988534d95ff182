"""Chat formatting by token-level assembly.

Texts are escaped and encoded one by one, without special tokens; the template's control tokens are
reserved ids above the vocabulary that are spliced in between.  Offsets are prefix sums of segment
lengths, and so are the bounds of the loss mask.  A text can thus never turn into a control token, and
the escape keeps the same true of the formatted string.

Template, by role (control strings in capitals or angle brackets):
    user        [INST] text [/INST]          assistant   [ASST] text </s>
    system      [SYS] text [/SYS]            others      [ROLE] role [/ROLE] text </s>
without the blanks shown here; a conversation starts with <s>.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from memlode.session import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenizer pattern of this byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ASST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
BOS, EOS, INST, INST_END, ASST, SYS, SYS_END, ROLE, ROLE_END = range(len(CONTROL))
ROLES = {"user": (INST, INST_END), "assistant": (ASST, EOS), "system": (SYS, SYS_END)}
_OPEN = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_SHUT = re.compile(r"\\([\\|])")
#: Fixed value: what the pre-tokenizer takes for white space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs of white space of this length are cut out before the pattern, whose backtracking they would exhaust.
_RUN = 2_000
_loaded: dict[str, tuple[tiktoken.Encoding, tiktoken.Encoding, int]] = {}


def escape(text: str) -> str:
    r"""Doubles backslashes and breaks each control string after its first character with \| ."""
    return _OPEN.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def shipped(spark: SparkSession, path: str):
    """A vocabulary file of the driver, sent to the executors; stands for the path in the functions below."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((path, f.read()))


def _load(vocabulary) -> tuple[tiktoken.Encoding, tiktoken.Encoding, int]:
    path = vocabulary if isinstance(vocabulary, str) else vocabulary.value[0]
    if path not in _loaded:
        if isinstance(vocabulary, str):
            with open(path, "rb") as f:
                raw = f.read()
        else:
            raw = vocabulary.value[1]
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        words, whole = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("words", PATTERN), ("whole", r"[\s\S]+")))
        _loaded[path] = words, whole, max(ranks.values()) + 1
    return _loaded[path]


def encoding(vocabulary) -> tuple[tiktoken.Encoding, int]:
    """The encoding of a vocabulary (a path, or what shipped() gives), once a process, and the first reserved id."""
    return _load(vocabulary)[::2]


def encode(text: str, vocabulary) -> list[int]:
    """The ids of the pre-tokenizer's pieces, whatever the length of the text.

    A long run of white space is a piece but for its last character, which the next word may take; at
    the end of the text it is a piece whole.
    """
    words, whole, _ = _load(vocabulary)
    out: list[int] = []
    at = 0
    for m in re.finditer(f"[{_SPACE}]{{{_RUN},}}", text):
        till = m.end() - (m.end() < len(text))
        out += words.encode_ordinary(text[at : m.start()])
        out += whole.encode_ordinary(text[m.start() : till])
        at = till
    return out + words.encode_ordinary(text[at:])


def segment(role: str | None, text: str | None, path) -> tuple[list[int], int, int, int]:
    """A turn's ids, the bounds of its loss within them and the length of its formatted string."""
    first = encoding(path)[1]
    body = escape(text or "")
    if role in ROLES:
        start, end = ROLES[role]
        ids, size = [first + start], len(CONTROL[start]) + len(CONTROL[end])
    else:
        name = escape(role or "")
        end = EOS
        ids = [first + ROLE, *encode(name, path), first + ROLE_END]
        size = len(CONTROL[ROLE]) + len(name) + len(CONTROL[ROLE_END]) + len(CONTROL[EOS])
    lo = len(ids)
    ids += encode(body, path)
    hi = len(ids)
    ids.append(first + end)
    return ids, lo if role == "assistant" else 0, hi if role == "assistant" else 0, size + len(body)


def assemble(conversations: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The formatted conversations as token segments: (conv_id, segment, at, ids, loss_from, loss_to, chars).

    Segments follow each other by ``at``, the prefix sum of lengths; loss_from/loss_to bound the loss
    mask in the same count (equal: none).  Turns stand in order of turn (nulls first), equal turns by
    role, then tokens.  Null text and role count as empty; null conv_id is a conversation of its own.
    Texts are encoded before the shuffle, row by row; what orders a conversation streams through its
    partition and holds one segment at a time, however long the conversation is.
    """
    kind = {f.name: f.dataType for f in conversations.schema}["conv_id"]
    own = StructType([StructField("conv_id", kind), StructField("turn", LongType()), StructField("role", StringType()), StructField("ids", ArrayType(IntegerType())), StructField("lo", IntegerType()), StructField("hi", IntegerType()), StructField("chars", LongType())])
    out = StructType([StructField("conv_id", kind), StructField("segment", LongType()), StructField("at", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("loss_from", LongType()), StructField("loss_to", LongType()), StructField("chars", LongType())])
    own_a, out_a = to_arrow_schema(own), to_arrow_schema(out)
    path = shipped(conversations.sparkSession, path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles = b.column(2).to_pylist()
            got = [segment(r, t, path) for r, t in zip(roles, b.column(3).to_pylist())]
            cols = [b.column(0), b.column(1), roles, *([g[k] for g in got] for k in range(4))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(cols, own_a)], schema=own_a)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, at = object(), 0, 0
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for conv, ids, lo, hi, chars in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist()):
                if conv != now:
                    now, n, at = conv, 0, 0
                    ids, lo, hi, chars = [encoding(path)[1] + BOS, *ids], lo + (hi > 0), hi + (hi > 0), chars + len(CONTROL[BOS])
                for c, v in zip(cols, (conv, n, at, ids, at + lo, at + hi, chars)):
                    c.append(v)
                n, at = n + 1, at + len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out_a)], schema=out_a)

    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").mapInArrow(rows, own)
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids").mapInArrow(chained, out)


def read_turn(ids: list[int], path=VOCABULARY) -> tuple[str, str]:
    """(role, text) of one segment."""
    enc, first = encoding(path)
    text = lambda part: unescape(enc.decode_bytes(part).decode())
    body = ids[1:] if ids[0] == first + BOS else ids
    for role, (start, _) in ROLES.items():
        if body[0] == first + start:
            return role, text(body[1:-1])
    cut = body.index(first + ROLE_END)
    return text(body[1:cut]), text(body[cut + 1 : -1])


def read_back(segments: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row a conversation, from the segments alone: turns and loss text as digests, and lengths.

    Expects the order in which assemble() gives them.
    """
    kind = {f.name: f.dataType for f in segments.schema}["conv_id"]
    schema = StructType([StructField("conv_id", kind), StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])
    fields = to_arrow_schema(schema)
    path = shipped(segments.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        state: list | None = None

        def row(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for b in batches:
            enc = enc or encoding(path)[0]
            done = []
            for conv, n, at, ids, lo, hi, chars in zip(*(b.column(k).to_pylist() for k in range(7))):
                if n == 0:
                    if state:
                        done.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(ids, path)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if hi > lo:
                    loss = unescape(enc.decode_bytes(ids[lo - at : hi - at]).decode())
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += chars
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done), fields)], schema=fields)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row(state), fields)], schema=fields)

    return segments.mapInArrow(run, schema)


def op6_chat_format(spark, sf_dir) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(assemble(convs.union(extra)))
