"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

Every leaf block is main text or not.  Its features are the tags and names (class, id, role) of its
ancestors and statistics of its text; the chain adds how labels follow each other.  The field is trained
by maximum likelihood on labelled pages (``training_pages``: templates whose parts are labelled by
construction, filled with seeded filler text) and decoded by Viterbi.  Each page is one row's work.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from memlode.llm.html_blocks import FEATURES, Block, blocks
from memlode.session import table

TEXT_FEATURES = ["bias", "len<25", "len<80", "len<200", "len>=200", "words<4", "link>.2", "link>.6", "stop end", "commas", "copyright", "first", "last", "in main", "beside main", "in other"]
N_ANCESTOR = len(FEATURES)
PAGES, EPOCHS, SEED = 400, 150, 11


_OTHER_TAGS = ("nav", "header", "footer", "aside", "form", "dialog", "menu")
_OTHER_NAMES = ("ad", "nav", "header", "footer", "side", "comment", "notice", "form", "share", "hidden")
MAIN = sum(1 << FEATURES.index(f) for f in ("tag:article", "tag:main", "name:main"))
OTHER = sum(1 << FEATURES.index(f) for f in [f"tag:{t}" for t in _OTHER_TAGS] + [f"name:{t}" for t in _OTHER_NAMES])


def has_main(bs: list[Block]) -> bool:
    """Whether some block stands in an article-like ancestor and in nothing else that matters."""
    return any(b.mask & MAIN and not b.mask & OTHER for b in bs)


def text_mask(b: Block, i: int, n: int, main: bool) -> int:
    """Bit mask of a block's own features; ``main`` is has_main() of its page."""
    t = b.text
    size, share = len(t), b.linked / max(1, len(t))
    on = (
        True, size < 25, 25 <= size < 80, 80 <= size < 200, size >= 200, t.count(" ") < 3, share > 0.2, share > 0.6, t[-1] in ".!?…\"”»",
        t.count(",") + t.count(". ") > 1, "©" in t[:60] or "copyright" in t[:60].lower(), i == 0, i == n - 1,
        bool(b.mask & MAIN and not b.mask & OTHER), main and not (b.mask & MAIN and not b.mask & OTHER), bool(b.mask & OTHER),
    )
    return sum(1 << k for k, x in enumerate(on) if x)


@dataclass
class Chain:
    """Weights: one score for each feature (for main against not), a transition matrix and a start score."""

    ancestor: np.ndarray
    text: np.ndarray
    step: np.ndarray
    start: float
    seen: dict = field(default_factory=dict)

    def _score(self, kind: int, mask: int) -> float:
        key = (kind, mask)
        got = self.seen.get(key)
        if got is None:
            w = self.text if kind else self.ancestor
            got = float(sum(w[k] for k in range(len(w)) if mask >> k & 1))
            if len(self.seen) < 100_000:
                self.seen[key] = got
        return got

    def decode(self, bs: list[Block]) -> list[bool]:
        """Viterbi: the most probable labels of a page's blocks."""
        if not bs:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = 0.0, self.start
        back: list[tuple[bool, bool]] = []
        main = has_main(bs)
        for i, x in enumerate(bs):
            e = self._score(0, x.mask) + self._score(1, text_mask(x, i, len(bs), main))
            if i:
                fa, fb = b + s10 > a + s00, b + s11 > a + s01
                a, b = (b + s10 if fa else a + s00), (b + s11 if fb else a + s01)
                back.append((fa, fb))
            b += e
        label = b > a
        out = [label]
        for fa, fb in reversed(back):
            label = fb if label else fa
            out.append(label)
        return out[::-1]


def _filler(rng: random.Random, lo: int, hi: int) -> str:
    syl = "re ti an en on er ou la de st mi ka lo na su vi po ga el ra".split()
    words = ["".join(rng.choices(syl, k=rng.choice((1, 1, 2, 2, 3)))) for _ in range(rng.randint(lo, hi))]
    out, at = [], 0
    while at < len(words):
        n = rng.randint(5, 16)
        s = words[at : at + n]
        if len(s) > 8:
            s[4] += ","
        out.append(" ".join(s).capitalize() + rng.choice(".....!?"))
        at += n
    return " ".join(out)


def _links(rng: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{_filler(rng, 1, 3).rstrip(".!?")}</a></li>' for i in range(n))


def training_pages(n: int = PAGES, seed: int = SEED) -> list[list[tuple[str, bool]]]:
    """Labelled pages: lists of (html piece, is main text); a page is the pieces in order."""
    rng = random.Random(seed)
    pick = rng.choice
    pages = []
    for _ in range(n):
        f = lambda lo=6, hi=40: _filler(rng, lo, hi)
        noise = {
            "nav": lambda: pick(["<nav><ul>{0}</ul></nav>", '<div class="menu"><ul>{0}</ul></div>', '<div id="nav-bar" role="navigation"><ul>{0}</ul></div>', '<ul class="breadcrumbs">{0}</ul>']).format(_links(rng, rng.randint(2, 9))),
            "ad": lambda: pick(['<div class="ad">{0}</div>', '<div class="advert"><p>{0}</p></div>', '<div id="ad-slot-3"><a href="/x">{0}</a></div>', '<aside class="sponsored">{0}</aside>', '<section class="promo banner"><p>{0}</p></section>', '<ins class="ads"><div>{0}</div></ins>']).format(f(3, 40)),
            "header": lambda: pick(["<header><h1>{0}</h1><p>{1}</p></header>", '<div class="header"><span>{0}</span></div>', '<div id="masthead"><a href="/">{0}</a><p>{1}</p></div>', '<header class="site-header"><div class="logo">{0}</div></header>']).format(f(2, 4), f(3, 12)),
            "footer": lambda: pick(["<footer>&copy; {0}</footer>", '<div class="footer"><p>{0}</p></div>', "<footer><p>{0}</p><ul>{1}</ul></footer>", '<div id="copyright">© 2020 {0}</div>']).format(f(3, 30), _links(rng, 3)),
            "side": lambda: pick(["<aside><h3>{1}</h3><p>{0}</p></aside>", '<div class="sidebar"><h4>{1}</h4><p>{0}</p></div>', '<div class="related"><h2>{1}</h2><ul>{2}</ul></div>', '<section class="recommended"><p>{0}</p></section>', '<div class="widget trending"><p>{0}</p></div>']).format(f(6, 50), f(1, 3), _links(rng, 4)),
            "comment": lambda: pick(['<section class="comments"><h2>{1}</h2><div class="comment"><p>{0}</p></div><div class="comment"><p>{2}</p></div></section>', '<div id="comments"><ol><li><p>{0}</p></li><li><p>{2}</p></li></ol></div>', '<ul class="comment-list"><li>{0}</li><li>{2}</li></ul>', '<article class="comment"><p>{0}</p></article>']).format(f(6, 60), f(1, 3), f(6, 60)),
            "notice": lambda: pick(['<div class="cookie-notice"><p>{0}</p><button>ok</button></div>', '<div id="consent-banner">{0}</div>', '<div class="alert" role="alert"><p>{0}</p></div>', '<dialog><p>{0}</p></dialog>', '<div class="modal popup"><p>{0}</p></div>']).format(f(5, 40)),
            "form": lambda: pick(["<form><label>{0}</label><input></form>", '<div class="newsletter"><p>{0}</p><form><input></form></div>', '<form class="search"><p>{0}</p><button>go</button></form>', '<div class="login-form"><div>{0}</div></div>']).format(f(2, 25)),
            "share": lambda: pick(['<div class="share"><a href="/f">{0}</a></div>', '<ul class="social">{1}</ul>']).format(f(1, 3), _links(rng, 3)),
        }
        draw = lambda kinds, p: [(noise[k](), False) for k in kinds if rng.random() < p]
        shut = pick([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div class="post-body entry">', "</div>"), ("<main><article>", "</article></main>"), ('<div id="story">', "</div>"), ('<section class="article">', "</section>"), ("<div>", "</div>"), ("<article>", "")])
        body: list[tuple[str, bool]] = []
        if rng.random() < 0.8:
            body.append((f"<h1>{f(3, 10)}</h1>", True))
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.08:
                body.append((f"<h2>{f(2, 6)}</h2>", True))
            elif r < 0.13:
                body.append((f"<ul><li>{f(4, 20)}</li><li>{f(4, 20)}</li></ul>", True))
            elif r < 0.17:
                body.append((f"<blockquote><p>{f(6, 40)}</p></blockquote>", True))
            elif r < 0.2:
                body.append((f"<pre>{f(6, 30)}</pre>", True))
            elif r < 0.24:
                body.append((f"<table><tr><td>{f(2, 8)}</td><td>{f(2, 8)}</td></tr></table>", True))
            elif r < 0.3:
                body.append((f"<p><b>{f(4, 20)}<br><p>{f(4, 60)}</p>", True))
            elif r < 0.34:
                body.append((f'<p>{f(6, 30)} <a href="/y">{f(1, 3)}</a> {f(6, 30)}</p>', True))
            elif r < 0.42:
                body += draw([pick(["ad", "share", "side", "form", "notice", "comment"])], 1)
            else:
                body.append((f"<p>{f(1, 120)}</p>", True))
        body += draw(["comment", "share", "form", "side"], 0.12)
        page = draw(["notice", "header", "nav", "form", "ad", "side"], 0.45)
        rng.shuffle(page)
        page.append((shut[0], False))
        page += body
        page.append((shut[1], False))
        tail = draw(["share", "comment", "side", "ad", "form", "nav", "notice"], 0.35)
        rng.shuffle(tail)
        whole = page + tail + draw(["footer"], 0.85)
        if rng.random() < 0.25:  # what a page is wrapped in says nothing about its parts
            head, end = pick([('<form id="aspnetForm">', "</form>"), ('<div id="page" class="has-sidebar">', "</div>"), ('<div class="wrapper no-banner comments-open">', "</div>"), ('<section class="layout sidebar-left">', "</section>")])
            whole = [(head, False), *whole, (end, False)]
        pages.append(whole)
    return pages


def labelled(page: list[tuple[str, bool]]) -> tuple[list[Block], list[bool]]:
    """The blocks of a labelled page and their labels; blocks that a piece adds to the page carry its label."""
    labels: list[bool] = []
    total = ""
    for piece, main in page:
        total += piece
        labels += [main] * (len(blocks(total)) - len(labels))
    return blocks(total), labels


def fit(pages: list[tuple[list[Block], list[bool]]], epochs: int = EPOCHS, l2: float = 1e-3) -> Chain:
    """Maximum likelihood by full-batch Adam on the forward-backward gradient, all pages at once."""
    pages = [p for p in pages if p[0]]
    n, most = len(pages), max(len(b) for b, _ in pages)
    dim = N_ANCESTOR + len(TEXT_FEATURES)
    x, y, live = np.zeros((n, most, dim)), np.zeros((n, most), int), np.zeros((n, most), bool)
    for i, (bs, ls) in enumerate(pages):
        for j, (b, lab) in enumerate(zip(bs, ls)):
            t = text_mask(b, j, len(bs), has_main(bs))
            x[i, j] = [b.mask >> k & 1 for k in range(N_ANCESTOR)] + [t >> k & 1 for k in range(len(TEXT_FEATURES))]
            y[i, j], live[i, j] = lab, True
    total = live.sum()
    theta, m, v = np.zeros(dim + 5), np.zeros(dim + 5), np.zeros(dim + 5)
    both = live[:, 1:] & live[:, :-1]
    for it in range(1, epochs + 1):
        w, step, start = theta[:dim], theta[dim : dim + 4].reshape(2, 2), theta[dim + 4]
        e = np.stack([np.zeros((n, most)), x @ w], axis=2)
        e[:, 0, 1] += start
        fwd, bwd = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        fwd[:, 0] = e[:, 0]
        for j in range(1, most):
            nxt = np.logaddexp.reduce(fwd[:, j - 1, :, None] + step, axis=1) + e[:, j]
            fwd[:, j] = np.where(live[:, j, None], nxt, fwd[:, j - 1])
        for j in range(most - 2, -1, -1):
            nxt = np.logaddexp.reduce(step + (e[:, j + 1] + bwd[:, j + 1])[:, None, :], axis=2)
            bwd[:, j] = np.where(live[:, j + 1, None], nxt, 0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p = np.exp(fwd + bwd - z[:, None, None])[:, :, 1] * live
        gap = (y - p) * live
        pair = np.exp(fwd[:, :-1, :, None] + step + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        true = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)])
        grad = np.r_[np.einsum("ij,ijk->k", gap, x), (true - pair.sum(axis=(0, 1))).ravel(), gap[:, 0].sum()] / total - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.999**it)) + 1e-8)
    return Chain(theta[:N_ANCESTOR], theta[N_ANCESTOR:dim], theta[dim : dim + 4].reshape(2, 2), float(theta[dim + 4]))


@lru_cache(maxsize=1)
def default_model() -> Chain:
    return fit([labelled(p) for p in training_pages()])


def main_text(page: str | None, model: Chain) -> str:
    bs = blocks(page)
    return " ".join(b.text for b, keep in zip(bs, model.decode(bs)) if keep)


def extract(pages: DataFrame, model: Chain | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; null html and pages without main text give ''."""
    model = model or default_model()
    kinds = {f.name: f.dataType for f in pages.schema}
    schema = StructType([StructField("page_id", kinds["page_id"]), StructField("url", kinds["url"]), StructField("text", StringType()), StructField("n_chars", LongType())])
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text = [main_text(h, sent.value) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, schema)


def op10_html_extract(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
