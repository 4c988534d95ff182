import gzip
import html
import html.parser
import json

import pytest

from memlode.llm import html_blocks as B
from memlode.llm import html_extract as H
from memlode.llm import warc as W

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p><article>no</article>";</script></head><body>
<div class="cookie-notice"><p>We use cookies on this site, please agree to go on.</p><button>OK</button></div>
<header><h1>The Site</h1></header><nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy this thing now, it is cheap.</div>
<article><h1>A &lt;title&gt; here</h1><p><b>First paragraph of the story, with some text.<br><p>Second&nbsp;paragraph &amp; more
   text, that goes on for a while.</p><p>Third.</p><div class="share"><a href="/f">Share</a></div></article>
<aside><h3>Related</h3><p>Other stories that you may want to read as well.</p></aside><form><label>Search the site</label><input></form>
<section class="comments"><div class="comment"><p>I do not agree with this at all, said the reader.</p></div></section><footer>&copy; site 2020</footer></body></html>"""


def test_main_text():
    want = "A <title> here First paragraph of the story, with some text. Second paragraph & more text, that goes on for a while. Third."
    assert H.main_text(PAGE, H.default_model()) == want


@pytest.mark.parametrize("page,want", [
    ('<body class="post main"><div class="cookiebar"><p>We value your privacy, so agree.</p></div><article><p>Only this text counts here, really.</p></article><div><p>More from our partners on the web.</p></div></body>', "Only this text counts here, really."),
    ('<div id="content"><h1>Head</h1><p>Some first text, with enough words in it to count.</p><div class="newsletter-signup"><p>Subscribe to our letter today.</p></div><p>And a second part of the same story, also long.</p><div id="comments"><p>I liked it a lot, thank you for it.</p></div></div>', "Head Some first text, with enough words in it to count. And a second part of the same story, also long."),
    ("<article><p>Short.</p><p>x</p><nav><a href='/'>Home</a></nav><p>Z.</p>", "Short. x Z."),
])
def test_variants(page, want):
    assert H.main_text(page, H.default_model()) == want


STORY = "<h1>The head of it</h1>" + "".join(f"<p>Paragraph {k} of the story, with words enough to be one.</p>" for k in range(4))
TOLD = "The head of it " + " ".join(f"Paragraph {k} of the story, with words enough to be one." for k in range(4))
AROUND = '<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="sidebar"><p>Other things to read on this site.</p></div>'


@pytest.mark.parametrize("page", [
    f'<form id="aspnetForm">{AROUND}<article>{STORY}</article><footer>&copy; 2020</footer></form>',
    f'<div id="page" class="has-sidebar"><main>{STORY}</main>{AROUND}</div>',
    f'{AROUND}<div class="post comments-open">{STORY}</div>',
    f'<div class="main-content no-banner">{STORY}</div>{AROUND}',
    f'{AROUND}<article class="article search-result">{STORY}</article>',
    f'<div class="popup-layout"><div class="content">{STORY}</div></div>{AROUND}',
    f'<div id="sidebar-left-layout"><article>{STORY}</article><section class="comments"><div class="comment"><p>{"Nobody asked for this, said one reader. " * 40}</p></div></section></div>',
    f"{AROUND}<!--><article>{STORY}</article><!-- x --!><footer>&copy; 2020</footer>",
    f"{AROUND}<!---><article>{STORY}<!-- x --!></article>",
])
def test_wrapped_articles_and_odd_comments(page):
    assert H.main_text(page, H.default_model()) == TOLD


@pytest.mark.parametrize("page", [
    f'<article>{STORY}</article><aside class="related"><article><h3>Another one</h3><p>Teaser of another story that is not this one.</p></article></aside>',
    f'<article>{STORY}</article><div class="comments"><article class="comment"><p>A remark of a reader, longer than it should be.</p></article></div>',
    f'<article>{STORY}<form class="newsletter"><p>Subscribe to our letter today.</p></form></article><dialog><p>Agree to all of it, please.</p></dialog>',
])
def test_articles_within_other_parts_stay_out(page):
    assert H.main_text(page, H.default_model()) == TOLD


def test_a_form_with_a_long_text_and_no_article():
    page = f'<form id="f1"><div id="wrap"><h1>Head</h1><p>{"Long text that goes on. " * 20}</p></div></form>'
    assert H.main_text(page, H.default_model()) == "Head " + ("Long text that goes on. " * 20).strip()


def test_held_out_pages():
    m = H.default_model()
    pages = [H.labelled(p) for p in H.training_pages(150, seed=77)]
    right = sum(a == b for bs, ls in pages for a, b in zip(m.decode(bs), ls))
    assert right / sum(len(ls) for _, ls in pages) > 0.99


def test_viterbi_is_the_best_labelling():
    from itertools import product

    m = H.default_model()
    bs = B.blocks(PAGE)[3:12]
    main = H.has_main(bs)
    e = [m._score(0, b.mask) + m._score(1, H.text_mask(b, i, len(bs), main)) for i, b in enumerate(bs)]

    def total(ls):
        return (m.start if ls[0] else 0) + sum(x for x, y in zip(e, ls) if y) + sum(m.step[a, b] for a, b in zip(ls, ls[1:]))

    best = max(product((0, 1), repeat=len(bs)), key=total)
    assert m.decode(bs) == [bool(x) for x in best]


@pytest.mark.parametrize("page", [None, "", "plain words only", "<p>open <b>never closed", "<<<>>> a < b", "<div " + "x" * 1000, "<" * 5000, "<div>" * 20000 + "deep", "<!-- never closed <p>x</p>", "<script>x", "&#0; &bogus; &#x41;", "<a title='>'>q</a>", "<p a=\"unclosed>text"])
def test_broken_pages_do_not_crash(page):
    for b in B.blocks(page):
        assert b.text == " ".join(b.text.split())
    H.main_text(page, H.default_model())


def test_extract_awkward_rows(spark):
    d = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 5), (None, "v", "", 5), (3, "w", "<article><p>" + "long words " * 100_000 + "</p></article>", 5)], "page_id long, url string, html string, n_chars long")
    rows = H.extract(d).collect()
    assert len(rows) == 5 and all(r.n_chars == len(r.text) for r in rows)
    assert [r.n_chars for r in rows if r.page_id == 3] == [1_099_999] and [r.text for r in rows if r.page_id is None] == [""]
    assert H.extract(d.where("false")).count() == 0


def test_derivatives_link_back(spark):
    d = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None)], "page_id long, url string, html string")
    src = {r.page_id: r for r in W.from_pages(d).collect()}
    rows = W.derive(W.from_pages(d), ["page_id"]).collect()
    assert len(rows) == 4 and len({r.derived_id for r in rows}) == 4
    for r in rows:
        s = src[r.page_id]
        assert r.refers_to == s.record_id and r.source_digest == W.digest(bytes(s.payload)) and r.target_uri == s.target_uri
        assert r.block_digest == W.digest(r.block.encode()) and r.content_length == len(r.block.encode())
    text = next(r.block for r in rows if r.page_id == 1 and r.record_type == "conversion")
    assert "Second paragraph & more text" in text and "margin" not in text and "var t" not in text
    meta = json.loads(next(r.block for r in rows if r.page_id == 1 and r.record_type == "metadata"))
    http = meta["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert http["HTML-Metadata"]["Title"] == "T & t" and {"path": "a@/href", "url": "/a"} in http["HTML-Metadata"]["Links"]
    assert http["Headers"]["Content-Type"].startswith("text/html") and meta["Envelope"]["WARC-Header-Metadata"]["WARC-Type"] == "response"
    assert W.derive(W.from_pages(d.where("false"))).count() == 0


def test_files_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "http://a/", PAGE), (2, "http://b/", "<p>two</p>")], "page_id long, url string, html string").coalesce(1)
    out = W.derive(W.from_pages(d))
    done = W.write_warc(out, f"file://{tmp_path}/out").collect()
    files = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".gz" and not p.name.startswith(".")]
    assert [(r.file, r.records, r.bytes) for r in done] == [(p.name, 4, p.stat().st_size) for p in files]
    got = [r for f in files for r in W.parse(f.read_bytes())]
    want = {r.derived_id: r for r in out.collect()}
    assert [r["headers"]["WARC-Type"] for r in got].count("warcinfo") == len(files) and files[0].read_bytes().count(W._GZIP) >= 5
    got = [r for r in got if r["headers"]["WARC-Type"] != "warcinfo"]
    assert {r["headers"]["WARC-Record-ID"] for r in got} == set(want)
    for r in got:
        w = want[r["headers"]["WARC-Record-ID"]]
        assert r["block"].decode() == w.block and r["headers"]["WARC-Refers-To"] == w.refers_to and r["headers"]["WARC-Block-Digest"] == W.digest(r["block"])
    (tmp_path / "in.warc").write_bytes(response("1", b"<p>hello</p>"))
    one = W.read_warc(spark, str(tmp_path / "in.warc")).collect()
    assert len(one) == 1 and bytes(one[0].payload) == b"<p>hello</p>" and one[0].record_id == "<urn:uuid:1>"
    assert [r.block for r in W.derive(W.read_warc(spark, str(tmp_path / "in.warc"))).collect() if r.record_type == "conversion"] == ["hello"]


def response(name, body, kind="text/html", extra=b"", length=True):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: " + kind.encode() + b"\r\n" + extra + b"\r\n"
    size = b"Content-Length: %d\r\n" % (len(http) + len(body)) if length else b""
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:" + name.encode() + b">\r\nWARC-Target-URI: http://c/\r\nWARC-Date: 2024-02-02T00:00:00Z\r\n" + size + b"\r\n" + http + body + b"\r\n\r\n"


def names(data):
    return [r["headers"]["WARC-Record-ID"][10:-1] for r in W.parse(data)]


def test_broken_files_lose_the_broken_records_only(spark, tmp_path, monkeypatch):
    one, two, three = (gzip.compress(response(n, rng_bytes(n))) for n in "abc")
    plain = [response(n, rng_bytes(n)) for n in "abc"]
    bad = two[: len(two) // 2] + bytes(40) + two[len(two) // 2 + 40 :]
    for read in (1 << 20, 97, 1000):
        monkeypatch.setattr(W, "_READ", read)
        monkeypatch.setattr(W, "_STEP", min(W._STEP, read))
        assert names(one + two + three) == ["a", "b", "c"] and names(one + two + three[:-30]) == ["a", "b"]
        assert names(one + bad + three) == ["a", "c"] and names(one + two[: len(two) // 2] + three) == ["a", "c"]
        assert names(b"".join(plain)) == ["a", "b", "c"] and names(plain[0] + plain[1][:-100]) == ["a"]
        assert names(plain[0] + response("x", b"y", length=False) + plain[2]) == ["a", "c"]
        assert names(b"") == names(b"no warc") == names(b"\x1f\x8b") == names(b"\x1f\x8b\x08" + bytes(50)) == []
        got = list(W.parse(one + two))
        assert got[1]["block"].endswith(rng_bytes("b"))
    monkeypatch.undo()
    (tmp_path / "x.warc.gz").write_bytes(one + bad + three)
    (tmp_path / "y.warc.gz").write_bytes(one + two[:-20])
    rows = W.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in rows) == ["<urn:uuid:a>", "<urn:uuid:a>", "<urn:uuid:c>"]


def test_whole_records_at_every_size_of_a_member(monkeypatch):
    plain = [response(str(k), rng_bytes(str(k)) * (1 + 40 * (k == 3))) for k in range(10)]
    ends = [0]
    for r in plain:
        ends.append(ends[-1] + len(r))
    member = gzip.compress(b"".join(plain))
    for step in (1 << 16, 1000):
        monkeypatch.setattr(W, "_STEP", step)
        for cut in (8, 9, 500, len(member) // 2, len(member) - 300):
            got = __import__("zlib").decompressobj(31).decompress(member[:-cut])
            there = [str(k) for k in range(10) if ends[k + 1] - 4 <= len(got)]  # but for the two line ends after it
            assert names(member[:-cut]) == there, (step, cut)
            every = [str(k) for k in range(10)]  # what follows is wrong data to the broken member: the record next to it may go, or be garbled
            got = [r["headers"].get("WARC-Record-ID", "")[10:-1] for r in W.parse(member[:-cut] + member)]
            assert got[-10:] == every and got[: max(0, len(there) - 1)] == there[:-1], (step, cut)
        wrong = member[:-8] + bytes([member[-8] ^ 1]) + member[-7:]
        assert names(wrong) == [str(k) for k in range(9)]  # the check fails: the last record may be wrong
    many = b"".join(gzip.compress(p) for p in plain)
    assert names(many[:-8]) == [str(k) for k in range(10)]


def test_long_headers_and_a_late_charset():
    long = response("a", b"x").replace(b"WARC-Date", b"X-Long: " + b"y" * (2 << 20) + b"\r\nWARC-Date")
    assert names(long + response("b", b"y")) == ["a", "b"] and names(b"WARC/ no WARC/1.0 none" + response("b", b"y")) == ["b"]
    late = b"<html><head><!-- <meta charset=koi8-r> --><style>" + b"p{}" * 3000 + b"</style><meta charset='latin-1'></head><body><meta charset='koi8-r'><p>caf\xe9</p>"
    assert W.decode("text/html", late).endswith("<p>café</p>")
    assert W.decode("text/html; charset=utf-8", late.replace(b"\xe9", "é".encode())).endswith("<p>café</p>")


def rng_bytes(seed):
    import random

    return random.Random(seed).randbytes(5000).hex().encode()


@pytest.mark.parametrize(("kind", "body", "extra", "want"), [
    ("text/html; charset=iso-8859-1", "<p>café</p>".encode("latin-1"), b"", "café"),
    ("text/html", '<meta charset="windows-1251"><p>мир</p>'.encode("cp1251"), b"", "мир"),
    ("text/html", '<meta http-equiv="Content-Type" content="text/html; charset=shift_jis"><p>日本</p>'.encode("shift_jis"), b"", "日本"),
    ("text/html", "<p>mark</p>".encode("utf-16"), b"", "mark"),
    ("text/html; charset=nonsense", "<p>é</p>".encode(), b"", "é"),
    ("text/html; charset=base64", "<p>é</p>".encode(), b"", "é"),
    ("text/html", gzip.compress(b"<p>packed</p>"), b"Content-Encoding: gzip\r\n", "packed"),
    ("text/html", b"5\r\n<p>ab\r\n6\r\ncd</p>\r\n0\r\n\r\n", b"Transfer-Encoding: chunked\r\n", "abcd"),
    ("text/plain", b"a < b\n\n  c <p>", b"", "a < b\nc <p>"),
    ("image/png", b"\x89PNG", b"", None),
])
def test_bodies_are_decoded(kind, body, extra, want):
    r = next(W.parse(response("1", body, kind, extra)))
    http, _, payload = r["block"].partition(b"\r\n\r\n")
    got = W.derive_one("<r>", "u", "d", json.dumps(r["headers"]), http.decode() + "\r\n\r\n", payload)
    assert [x[7] for x in got if x[0] == "conversion"] == ([] if want is None else [want])
    meta = json.loads(got[-1][7])
    assert got[-1][6] == W.digest(payload) and ("Conversion" in meta) == (want is not None)


def test_headers_that_are_no_json():
    got = W.derive_one("<r>", None, None, "{not json", None, b"<p>\xff\xfe</p>")
    assert json.loads(got[-1][7])["Envelope"]["WARC-Header-Metadata"] == {"Malformed": "{not json"}


class Visible(html.parser.HTMLParser):
    """A brute-force conversion by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.hidden = [""], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "title"):
            self.hidden.append(tag)
        elif W._BREAK.fullmatch(f"<{tag}>"):
            self.lines.append("")

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
            self.lines[-1] += " "
        elif W._BREAK.fullmatch(f"</{tag}>"):
            self.lines.append("")

    def handle_data(self, data):
        if not self.hidden:
            self.lines[-1] += data

    def text(self):
        return "\n".join(x for line in self.lines if (x := " ".join(line.split())))


def test_conversions_match_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.block for r in W.derive(W.from_pages(pages), ["page_id"]).where("record_type = 'conversion'").collect()}
    rows = pages.collect()
    for r in rows:
        v = Visible()
        v.feed(r.html or "")
        v.close()
        assert got[r.page_id] == v.text(), r.page_id
    assert len(got) == len(rows) > 100


def test_plain_text_decodes():
    assert W.plain_text("<p>a&amp;b</p><p>c<b>d</b></p>") == "a&b\ncd" and html.unescape("&lt;") == "<"


def test_elements_without_end_take_no_blocks_with_them():
    texts = lambda h: [b.text for b in B.blocks(h)]
    for tag in "button svg object select title canvas textarea template noscript iframe".split():
        got = texts(f"<article><p>first para</p><{tag}>x<p>second para</p></article><p>third</p>")
        assert [t for t in got if t != "x"] == ["first para", "second para", "third"], tag
        assert texts(f"<p>a <{tag}>x</{tag}> b</p>") == (["a x b"] if tag in ("object", "canvas") else ["a b"]), tag
    assert texts("<p>a<button>x<p>b</p><button>y</button><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>a</p><button><div>x</div></button><p>b</p>") == ["a", "b"]
    assert texts("<p>a</p><script>x<p>y</p>") == ["a"] and texts("<p>a</p><SCRIPT>x</p></Script ><p>y</p>") == ["a", "y"]


def test_ancestors_end_under_many_open_elements():
    for n in (5, 250, 5000):
        one, two = B.blocks("<nav>" + "<b>" * n + "x</nav><article>y</article>")
        assert one.mask == B.blocks("<nav>x</nav>")[0].mask and two.mask == B.blocks("<article>y</article>")[0].mask


def test_training_maximises_the_likelihood():
    """The regularised likelihood, by summing over all labellings, is higher at the fit than around it."""
    from itertools import product

    import numpy as np

    pages = [(bs[:7], ls[:7]) for bs, ls in (H.labelled(p) for p in H.training_pages(12, seed=3))]
    m = H.fit(pages, epochs=1500, l2=0.05)

    def objective(theta):
        a, t, step, start = theta[: H.N_ANCESTOR], theta[H.N_ANCESTOR : -5], theta[-5:-1].reshape(2, 2), theta[-1]
        total, n = 0.0, 0
        for bs, ls in pages:
            main = H.has_main(bs)
            e = []
            for i, b in enumerate(bs):
                own = H.text_mask(b, i, len(bs), main)
                e.append(sum(a[k] for k in range(H.N_ANCESTOR) if b.mask >> k & 1) + sum(t[k] for k in range(len(H.TEXT_FEATURES)) if own >> k & 1))
            value = lambda y: start * y[0] + sum(x for x, on in zip(e, y) if on) + sum(step[p, q] for p, q in zip(y, y[1:]))
            every = [value(y) for y in product((0, 1), repeat=len(bs))]
            total += value([int(x) for x in ls]) - np.logaddexp.reduce(every)
            n += len(bs)
        return total / n - 0.05 / 2 * (theta**2).sum()

    best = np.r_[m.ancestor, m.text, m.step.ravel(), m.start]
    top, rng = objective(best), np.random.default_rng(1)
    for _ in range(25):
        assert objective(best + rng.normal(0, 0.05, len(best))) < top
    for k in (0, 5, H.N_ANCESTOR, H.N_ANCESTOR + 4, len(best) - 5, len(best) - 2, len(best) - 1):
        d = np.zeros(len(best))
        d[k] = 1e-4
        assert abs(objective(best + d) - objective(best - d)) / 2e-4 < 2e-3  # the gradient is zero
