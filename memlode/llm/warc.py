"""WARC derivatives: linked metadata and plain-text conversion records from response records.

Each response gives a ``conversion`` record (its text) and a ``metadata`` record (a JSON envelope with
the source's headers, digests, title and links).  Both refer to the response by its record id and
repeat its target URI and date; digests are SHA-1 in base 32 as WARC files write them.  One row in,
two rows out, without a shuffle.  A response that is neither text nor without a type gives its metadata
only.

Files are read as streams, record by record: gzip members one after the other, and after a broken member
or record from the next one on.  They are written with one gzip member a record.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as _html
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from memlode.session import table

#: A response record: its WARC headers as JSON, HTTP headers as text, payload as bytes.
RESPONSE = "record_id string, target_uri string, date string, warc_headers string, http_headers string, payload binary"
DATE = "2024-01-01T00:00:00Z"
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|svg|title)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*+(?:>|\Z)", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?][^>]*+(?:>|\Z)")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LINK = re.compile(r"<(a|link|img|script|iframe)\b[^>]*?\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_META = re.compile(rb"<meta\b[^>]*?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_TEXT_TYPE = re.compile(r"text/|application/(?:[\w.-]+\+)?(?:xml|xhtml|json)\b|application/xhtml", re.I)
_CHUNK = re.compile(rb"(?:\r\n)?([0-9A-Fa-f]{1,8})[^\r\n]*\r\n")
_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")
_HEAD_END = re.compile(rb"</head\b|<body\b", re.I)
_COMMENT = re.compile(rb"<!--.*?-->", re.S)
_READ, _STEP, _BATCH_BYTES = 1 << 20, 1 << 16, 32 << 20
_CUT, _BROKEN = object(), object()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """A name-based urn:uuid, the same at every run; a part that is None differs from every text."""
    h = hashlib.sha1("".join("-" if p is None else f"{len(str(p))}:{p}" for p in parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:32]}>"


def plain_text(page: str) -> str:
    """Visible text: one line a block, entities decoded, white space single, blank lines left out."""
    text = _html.unescape(_TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page).replace("\n", " ").replace("\r", " "))))
    return "\n".join(line for x in text.split("\n") if (line := " ".join(x.split())))


def links(page: str) -> list[dict]:
    return [{"path": f"{m[1].lower()}@/{m[2].lower()}", "url": _html.unescape(m[3] or m[4] or m[5] or "")} for m in _LINK.finditer(_HIDDEN.sub(lambda m: "" if m[0].startswith("<!--") else m[0], page))]


def from_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records (RESPONSE, and page_id) for pages (page_id, url, html).

    Null html is an empty payload; null url stays null.  The id follows from page_id, url and html.
    """
    html = F.coalesce("html", F.lit(""))
    key = F.sha1(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce("url", F.lit("null")), F.sha1(html)))
    uuid = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", key.substr(1, 8), key.substr(9, 4), F.concat(F.lit("5"), key.substr(14, 3)), F.concat(F.lit("a"), key.substr(18, 3)), key.substr(21, 12)), F.lit(">"))
    raw = F.encode(html, "utf-8")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(raw).cast("string"), F.lit("\r\n\r\n"))
    head = F.to_json(F.create_map(F.lit("WARC-Type"), F.lit("response"), F.lit("WARC-Date"), F.lit(date), F.lit("Content-Type"), F.lit("application/http; msgtype=response")))
    return pages.select("page_id", uuid.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("warc_headers"), http.alias("http_headers"), raw.alias("payload"))


def _headers(block: bytes) -> dict[str, str]:
    """Header lines after the first; a line that starts with a blank continues the one before."""
    out: dict[str, str] = {}
    last = None
    for line in block.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, sep, value = line.partition(":")
        if sep:
            last = name.strip()
            out[last] = value.strip()
    return out


class _Window:
    """Bytes of a file by their place; a part of it stays in memory."""

    def __init__(self, f: BinaryIO):
        self.f, self.base, self.held = f, 0, b""

    def at(self, place: int) -> bytes:
        """Some bytes from a place on; none at the end of the file."""
        if not self.base <= place < self.base + len(self.held):
            self.f.seek(place)
            self.base, self.held = place, self.f.read(_READ)
        return self.held[place - self.base : place - self.base + _STEP]

    def find(self, mark: bytes, place: int) -> int:
        """The next place of a mark, -1 if there is none."""
        tail = b""
        while part := self.at(place):
            if (got := (tail + part).find(mark)) >= 0:
                return place - len(tail) + got
            tail = (tail + part)[1 - len(mark) :]
            place += len(part)
        return -1


def _inflate(z, part: bytes) -> Iterator:
    """What a part decompresses to; up to a broken place byte by byte, then ``_BROKEN``."""
    spare = z.copy()
    try:
        got = z.decompress(part)
    except zlib.error:
        try:
            for k in range(len(part)):
                yield spare.decompress(part[k : k + 1])
        except zlib.error:
            pass
        got = _BROKEN
    yield got


def _chunks(f: BinaryIO) -> Iterator:
    """The bytes of a plain or gzipped file; ``_CUT`` where a gzip member ends early, ``_BROKEN`` where its data are wrong."""
    w, place = _Window(f), 0
    if not w.at(0).startswith(_GZIP):
        while part := w.at(place):
            place += len(part)
            yield part
        return
    start = 0
    while start >= 0:
        z, place, broken = zlib.decompressobj(31), start, False
        while not z.eof and not broken and (part := w.at(place)):
            place += len(part)
            for got in _inflate(z, part):
                broken = got is _BROKEN
                yield got
        if z.eof and not broken:
            start = w.find(_GZIP, place - len(z.unused_data))
            continue
        if not broken:
            yield _CUT
        start = w.find(_GZIP, start + 1)


def records(f: BinaryIO) -> Iterator[dict]:
    """The records of a WARC file (gzip members or plain) as headers and block.

    Every record whose bytes are there is given, however large its gzip member is and wherever it ends;
    only the record next to wrong data (a failed check of a member included) is left out, as it may hold
    them.  What a broken member decompresses to before the break shows counts as its bytes.  Left out, too, are records without a length or cut short; reading goes on at the next start of a record.
    """
    chunks = _chunks(f)
    buf, last, seek = bytearray(), None, 0

    def more() -> bool:
        nonlocal last, seek
        got = next(chunks, None)
        if got is _BROKEN or got is _CUT:
            buf.clear()
            seek = 0
            last = None if got is _BROKEN else last
        elif got is not None:
            buf.extend(got)
        return got is not None

    while True:
        at = buf.find(b"WARC/")
        if at < 0:
            del buf[: max(0, len(buf) - 4)]
            if more():
                continue
            if last:
                yield last
            return
        if last:  # more bytes of a record have come after it
            yield last
            last = None
        del buf[:at]
        if len(buf) < 16 and more():
            continue
        if not _VERSION.match(buf[:16]):
            del buf[:5]
            continue
        stop = buf.find(b"\r\n\r\n", max(0, seek - 3))
        seek = len(buf)
        if stop < 0 and more():
            continue
        seek = 0
        head = _headers(bytes(buf[: max(0, stop)]))
        length = head.get("Content-Length", "")
        if not length.isdecimal():
            del buf[:5]
            continue
        till = stop + 4 + int(length)
        if len(buf) < till:
            seek = stop
            if more():
                continue
            seek = 0
            del buf[:5]
            continue
        last = {"headers": head, "block": bytes(buf[stop + 4 : till])}
        del buf[:till]


def parse(data: bytes) -> Iterator[dict]:
    """records() of bytes."""
    import io

    return records(io.BytesIO(data))


def open_file(path: str) -> BinaryIO:
    """Opens, for reading at any place, a file of any file system that Arrow knows, by its URI."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def read_warc(spark: SparkSession, path: str, opener: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """The response records (RESPONSE) of all WARC files under ``path``; a file is one task's stream.

    Spark lists the files; ``opener`` opens one on an executor, where Arrow does not know the file system.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["record_id", "target_uri", "date", "warc_headers", "http_headers", "payload"]
        for f in frames:
            for name in f["path"]:
                rows, size = [], 0
                with opener(name) as stream:
                    for r in records(stream):
                        h = r["headers"]
                        if h.get("WARC-Type") == "response":
                            http, _, body = r["block"].partition(b"\r\n\r\n")
                            rows.append((h.get("WARC-Record-ID"), h.get("WARC-Target-URI"), h.get("WARC-Date"), json.dumps(h, sort_keys=True), http.decode("utf-8", "replace") + "\r\n\r\n", body))
                            size += len(body)
                        if size > _BATCH_BYTES:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(max(1, files.count())).mapInPandas(run, RESPONSE)


def body_of(http: dict[str, str], raw: bytes) -> bytes:
    """The body without chunked transfer and gzip or deflate encoding; as it is where these do not hold."""
    low = {k.lower(): v.lower() for k, v in http.items()}
    if "chunked" in low.get("transfer-encoding", ""):
        out, at = [], 0
        while (m := _CHUNK.match(raw, at)) and (n := int(m[1], 16)):
            out.append(raw[m.end() : m.end() + n])
            at = m.end() + n
        raw = b"".join(out) if out else raw
    kind = low.get("content-encoding", "")
    for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(kind, ()):
        try:
            return zlib.decompressobj(bits).decompress(raw)
        except zlib.error:
            continue
    return raw


def decode(content_type: str, raw: bytes) -> str:
    """The text of a body: by its byte order mark, the charset of its header, that of a meta tag of its head, else UTF-8."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    head, end = _CHARSET.search(content_type), _HEAD_END.search(raw)
    meta = None if head else _META.search(_COMMENT.sub(b"", raw[: end.start()] if end else raw))
    name = head[1] if head else meta[1].decode("ascii", "replace") if meta else "utf-8"
    name = {"iso-8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252"}.get(name.lower(), name)
    try:
        return raw.decode(name, "replace")
    except (LookupError, ValueError):  # an unknown charset, or a codec that is none of text
        return raw.decode("utf-8", "replace")


def _json(text: str | None) -> object:
    try:
        return json.loads(text) if text else {}
    except ValueError:
        return {"Malformed": text}


def derive_one(rid: str | None, uri: str | None, date: str | None, warc: str | None, http: str | None, payload: bytes | None) -> list[tuple]:
    """The conversion (if the response is text) and the metadata record, as (type, id, refers_to, uri, date, content type, source digest, block)."""
    raw = bytes(payload or b"")
    http = http or ""
    headers = _headers(http.encode("utf-8", "replace"))
    kind = next((v for k, v in headers.items() if k.lower() == "content-type"), "")
    plain, is_text = kind.lower().startswith("text/plain"), not kind or bool(_TEXT_TYPE.match(kind.strip()))
    page = decode(kind, body_of(headers, raw)) if is_text else ""
    source = digest(raw)
    title = None if plain else _TITLE.search(page)
    envelope = {
        "Envelope": {
            "WARC-Header-Metadata": _json(warc),
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": http.split("\r\n", 1)[0],
                    "Headers": headers,
                    "HTML-Metadata": {"Title": " ".join(_html.unescape(title[1]).split()) if title else "", "Links": [] if plain else links(page)},
                    "Entity-Length": len(raw),
                    "Entity-Digest": source,
                },
                "Block-Digest": digest(http.encode("utf-8", "replace") + raw),
            },
        },
    }
    out = []
    if is_text:
        text = "\n".join(line for x in page.splitlines() if (line := " ".join(x.split()))) if plain else plain_text(page)
        envelope["Conversion"] = {"WARC-Record-ID": record_id(rid, "conversion"), "WARC-Block-Digest": digest(text.encode("utf-8", "replace"))}
        out.append(("conversion", record_id(rid, "conversion"), rid, uri, date, "text/plain", source, text))
    return [*out, ("metadata", record_id(rid, "metadata"), rid, uri, date, "application/json", source, json.dumps(envelope, ensure_ascii=False, sort_keys=True))]


def derive(responses: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Two rows for each response row (one where it is not text); columns named in ``carry`` are passed on.

    Null payload is empty: the conversion is '' and the metadata has no links.  Other nulls stay null;
    repeated responses give repeated records with equal ids.  WARC headers that are no JSON stand in the
    metadata as they are; bytes that no charset reads become U+FFFD.
    """
    carry = carry or []
    names = ["record_id", "target_uri", "date", "warc_headers", "http_headers", "payload"]
    own = ["record_type", "derived_id", "refers_to", "target_uri", "date", "content_type", "source_digest", "block"]
    kept = [f for f in responses.schema if f.name in carry]
    schema = StructType([*kept, *[StructField(c, StringType()) for c in own], StructField("block_digest", StringType()), StructField("content_length", LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [(i, r) for i, x in enumerate(zip(*(f[c] for c in names))) for r in derive_one(*x)]
            out = f[[k.name for k in kept]].iloc[[i for i, _ in got]].reset_index(drop=True)
            for k, c in enumerate(own):
                out[c] = [r[k] for _, r in got]
            raw = [r[7].encode("utf-8", "replace") for _, r in got]
            out["block_digest"], out["content_length"] = [digest(b) for b in raw], [len(b) for b in raw]
            yield out

    return responses.select(*[k.name for k in kept], *names).mapInPandas(run, schema)


def serialised(records: DataFrame) -> DataFrame:
    """Adds ``record``: the WARC/1.0 record as text, without the closing blank lines."""
    lines = [("WARC-Type", "record_type"), ("WARC-Record-ID", "derived_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    head = F.concat_ws("\r\n", F.lit("WARC/1.0"), *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}: "), F.col(c).cast("string"))) for k, c in lines])
    return records.withColumn("record", F.concat(head, F.lit("\r\n\r\n"), F.col("block")))


def write_warc(records: DataFrame, path: str) -> DataFrame:
    """Writes derivative records as WARC files, one for each partition: a warcinfo record and the records, each
    a gzip member.  Returns (file, records, bytes) of what was written.

    A task writes under a name of its own and moves the file when it is whole, so repeated attempts
    leave one file of the same records.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        temp = f"{root}/.{name}.{uuid.uuid4().hex}"
        n = 0
        with fs.open_output_stream(temp, compression=None) as out:
            info = b"software: memlode\r\nformat: WARC File Format 1.0\r\n"
            out.write(gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: %s\r\nWARC-Filename: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (record_id("warcinfo", name).encode(), name.encode(), len(info), info), mtime=0))
            for f in frames:
                for record in f["record"]:
                    out.write(gzip.compress(record.encode("utf-8", "replace") + b"\r\n\r\n", mtime=0))
                    n += 1
            size = out.tell()
        fs.move(temp, f"{root}/{name}")
        yield pd.DataFrame({"file": [name], "records": [n], "bytes": [size]})

    done = serialised(records).select("record").mapInPandas(run, "file string, records long, bytes long")
    rows = done.collect()  # one row a file
    return records.sparkSession.createDataFrame(rows, done.schema)


def op4_warc_derivatives(spark, sf_dir) -> DataFrame:
    return derive(from_pages(table(spark, sf_dir, "pages")), ["page_id"])
