"""A forgiving HTML scanner that yields leaf blocks with the features of their ancestors."""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup up to their end tag; without one the first two take the rest of the page.
RAW = ("script", "style", "textarea", "title", "iframe")
#: Elements whose text is no text of the page.
MUTE = frozenset((*RAW, "noscript", "template", "select", "button", "svg"))
#: Those of them that do not hold each other: the next tag of their name is their end, or they have none.
FLAT = ("noscript", "select", "button")

TAG_FEATURES = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "figure", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "dialog", "td", "dl", "menu", "address", "figcaption", "details")
#: What class, id and role attributes say: feature and pattern of a name's parts.
NAME_FEATURES = {
    "name:main": "article|content|post|entry|story|main|maincontent|text|articlebody|body",
    "name:ad": "ad|ads|advert|adverts|advertisement|sponsor|sponsored|promo|promoted|promotion|banner|adsense|dfp|adbox|adslot",
    "name:nav": "nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|toc|pagination|pager|tabs|topbar",
    "name:header": "header|masthead|head|site-title|logo|brand",
    "name:footer": "footer|foot|bottom|copyright|legal|colophon|contentinfo",
    "name:side": "sidebar|side|aside|related|widget|widgets|recommend|recommended|recommendations|trending|popular|more|complementary|rail|teaser|teasers",
    "name:comment": "comment|comments|reply|replies|respond|discussion|disqus|commentlist|feedback|reactions",
    "name:notice": "cookie|cookies|consent|notice|alert|popup|modal|overlay|gdpr|warning|disclaimer|announcement|toast|message",
    "name:form": "form|login|search|signup|subscribe|newsletter|register|contact",
    "name:share": "share|sharing|social|follow|facebook|twitter",
    "name:meta": "byline|author|date|tags|tag|meta|timestamp|info",
    "name:hidden": "hidden|invisible|sr-only|screen-reader",
}
#: Such a part at the head or end of a class name tells a state of the element, not what it is: has-sidebar, comments-open.
STATE_HEADS = frozenset("has no with without is not hide show enable disable js".split())
STATE_TAILS = frozenset("open closed opened enabled disabled on off active inactive visible hidden shown count".split())
FEATURES = [f"tag:{t}" for t in TAG_FEATURES] + list(NAME_FEATURES)
_BIT = {f: 1 << i for i, f in enumerate(FEATURES)}
_NAMES = [(_BIT[f], frozenset(p.split("|"))) for f, p in NAME_FEATURES.items()]
#: What an element is that holds an article, and what it stays whatever it holds.
_MAIN = _BIT["tag:article"] | _BIT["tag:main"] | _BIT["name:main"]
_TAG_BITS = sum(_BIT[f"tag:{t}"] for t in TAG_FEATURES)
_STAYS = _BIT["name:comment"] | _BIT["name:hidden"]
_SELF_STAYS = _STAYS | _BIT["name:ad"] | _BIT["name:notice"]
_SIDE = sum(_BIT[f] for f in ("tag:nav", "tag:header", "tag:footer", "tag:aside", "tag:form", "tag:dialog", "tag:menu", "name:ad", "name:nav", "name:header", "name:footer", "name:side", "name:comment", "name:notice", "name:form", "name:share", "name:hidden"))
#: A paragraph of so many characters stands for an article where a page names none.
_LONG = 200
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDE = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_end_tags: dict[tuple[str, str], re.Pattern] = {}
_masks: dict[tuple[str, str], int] = {}


def _parts(value: str) -> set[str]:
    """The parts of the names in a class, id or role; of a hyphenated name that tells a state, none."""
    out: set[str] = set()
    for name in value.split():
        parts = [p for p in _PARTS.split(name) if p]
        if len(parts) < 2 or not (parts[0] in STATE_HEADS or parts[-1] in STATE_TAILS):
            out.update(parts, (name,))
    return out


def _mask(tag: str, attrs: str) -> int:
    """What an element's own tag and attributes say."""
    key = (tag, attrs)
    got = _masks.get(key)
    if got is None:
        got = _BIT.get(f"tag:{tag}", 0)
        if attrs and tag not in ("html", "body"):  # what they are called says nothing about a block
            for m in _ATTR.finditer(attrs):
                parts = _parts((m[1] or m[2] or m[3] or "").lower())
                for bit, names in _NAMES:
                    if not names.isdisjoint(parts):
                        got |= bit
            if _HIDE.search(re.sub(r"\"[^\"]*\"|'[^']*'", '""', attrs) if "style" not in attrs.lower() else attrs):
                got |= _BIT["name:hidden"]
        if len(_masks) < 50_000:
            _masks[key] = got
    return got


@dataclass(slots=True)
class Block:
    """Text of a leaf block, the bit mask of its ancestors' features and how many characters stand in links."""

    text: str
    mask: int
    linked: int


class _Elements:
    """All elements that say something: parent, own features and, once the page is read, what they hold.

    An element may be called a form, a banner or a sidebar and yet hold the page: one with at least half
    of the text outside comments that holds (or is) an article is a wrapper, and then only its tag as an
    article, comments and what is hidden count.  On a page without articles a long paragraph stands for one.
    """

    def __init__(self) -> None:
        self.parent, self.own = [-1], [0]

    def add(self, parent: int, bits: int) -> int:
        self.parent.append(parent)
        self.own.append(bits)
        return len(self.own) - 1

    def masks(self, texts: list[tuple[int, int, bool]]) -> list[int]:
        """The features of each element and its ancestors; ``texts`` is (element, characters, paragraph) of each block."""
        n = len(self.own)
        size, article, said, long = [0] * n, [False] * n, [False] * n, [False] * n
        for k in range(1, n):
            said[k] = said[self.parent[k]] or bool(self.own[k] & _BIT["name:comment"])
        for k, chars, paragraph in texts:
            size[k] += 0 if said[k] else chars
            long[k] |= paragraph and chars >= _LONG and not said[k]
        for k in range(n - 1, 0, -1):
            p, own = self.parent[k], self.own[k]
            article[k] |= bool(own & _MAIN) and not said[k] and not own & (_SELF_STAYS if own & _TAG_BITS & _MAIN else _SIDE)
            article[p] |= article[k]
            size[p] += size[k]
            long[p] |= long[k]
        holds = article if article[0] else long
        out = [0] * n
        for k in range(1, n):
            own = self.own[k]
            if own & _SIDE and holds[k] and 2 * size[k] >= size[0]:
                own &= _MAIN | _SELF_STAYS if own & _TAG_BITS & _MAIN else _MAIN & ~_TAG_BITS | _STAYS
            out[k] = out[self.parent[k]] | own
        return out


class _Open:
    """The open elements: closing looks up the place of a name, however many are open."""

    def __init__(self, elements: _Elements) -> None:
        self.elements = elements
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.element = self.links = self.muted = 0

    def push(self, tag: str, bits: int) -> None:
        if bits:
            self.element = self.elements.add(self.element, bits)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.block_places.append(len(self.stack))
        self.stack.append((tag, self.element))
        self.links += tag == "a"
        self.muted += tag in MUTE

    def cut(self, place: int) -> None:
        """Closes the element at a place and all within it."""
        while len(self.stack) > place:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.block_places.pop()
            self.links -= tag == "a"
            self.muted -= tag in MUTE
        self.element = self.stack[-1][1] if self.stack else 0

    def end(self, tag: str) -> None:
        """An end tag closes the nearest element of its name; that of an inline element only within its block."""
        own = self.places.get(tag)
        if own and (tag in BLOCK or not self.block_places or own[-1] > self.block_places[-1]):
            self.cut(own[-1])

    def begin_block(self, tag: str) -> None:
        """The start of a block closes an open p, and that of an item an open item of its kind, if nothing is between."""
        if self.block_places:
            last = self.stack[self.block_places[-1]][0]
            if last == "p" or (last == tag and tag in ("li", "td", "th", "tr", "dt", "dd")):
                self.cut(self.block_places[-1])


def _ends(tag: str, slash: str = "/") -> re.Pattern:
    got = _end_tags.get((tag, slash))
    if got is None:
        got = _end_tags[tag, slash] = re.compile(f"<{slash}{tag}\\b[^>]*>?", re.I)
    return got


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; entities decoded, white space made single, empty blocks left out.

    The text of script, style, form controls and the like is left out.  Where such an element has no end
    tag its text goes up to the next start or end of a block only (script and style: to the end of the page).
    """
    page = page or ""
    out: list[Block] = []
    elements = _Elements()
    now = _Open(elements)
    buf: list[tuple[str, bool]] = []
    last_end: dict[str, int] = {}
    hush = False  # in the text of an element that is never closed
    pos, end = 0, len(page)

    def flush() -> None:
        if buf:
            text = " ".join(_html.unescape("".join(t for t, _ in buf)).split())
            if text:
                linked = sum(len(t.strip()) for t, a in buf if a)
                out.append(Block(text, now.element, min(linked, len(text))))
            buf.clear()

    def say(text: str) -> None:
        if not now.muted and not hush:
            buf.append((text, now.links > 0))

    def closed_after(tag: str, at: int) -> bool:
        if tag in FLAT:
            m = _ends(tag, "/?").search(page, at)
            return bool(m) and m[0][1] == "/"
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in _ends(tag).finditer(page)), default=-1)
        return last_end[tag] >= at

    while pos < end:
        m = _TAG.search(page, pos)
        if not m:
            say(page[pos:])
            break
        if m.start() > pos:
            say(page[pos : m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            if page.startswith("<![CDATA[", m.start()):
                say(page[m.start() + 9 : pos].removesuffix("]]>"))
            continue
        tag, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in BLOCK:
            flush()
            hush = False
        if closing:
            now.end(tag)
        elif tag in MUTE:
            buf.append((" ", False))
            if not closed_after(tag, pos):
                if tag in RAW[:2]:
                    break
                hush = True
            elif tag in RAW:
                pos = _ends(tag).search(page, pos).end()
            else:
                now.push(tag, 0)
        elif tag in VOID:
            if tag == "br":
                say(" ")
        else:
            if tag in BLOCK:
                now.begin_block(tag)
            now.push(tag, _mask(tag, attrs))
    flush()
    masks = elements.masks([(b.mask, len(b.text), bool(elements.own[b.mask] & _BIT["tag:p"])) for b in out])
    for b in out:
        b.mask = masks[b.mask]
    return out
