"""HTML extraction: containers are scored on each page, paths are voted on by host, and the winning path is extracted."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.staging import sized, staged

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile(r"""[>"']""")
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")

# Fixed lists of HTML: elements without content, with raw content, that never hold the article, that end a block.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "annotation", "annotation-xml"}
NEVER = {"head", "nav", "footer", "aside", "button", "select", "dialog", "menu", "label", "fieldset"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINER = {"article", "main", "section", "div", "td", "body", "center", "blockquote"}
#: Fixed: a new one of these ends an open one (before an element of the second set).
ENDS = {"p": ("p", BLOCK - {"br"}), "li": ("li", {"li"}), "dt": ("dt", {"dt", "dd"}), "dd": ("dd", {"dt", "dd"}), "tr": ("tr", {"tr"}), "td": ("td", {"td", "th", "tr"}), "th": ("th", {"td", "th", "tr"}), "option": ("option", {"option"})}
#: Fixed: words of a class, id or role that mark what isn't the article, whatever stands beside them in a name.
SURE = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "nav", "navbar", "navigation", "sidebar", "footer", "comments", "disqus",
    "breadcrumb", "breadcrumbs", "newsletter", "subscribe", "signup", "pagination", "pager", "popup", "modal", "contentinfo", "complementary",
}
#: Fixed: words that mark it where the rest of the name is about layout, or where the part is mostly links.
LIKELY = {
    "promo", "promotion", "notice", "notices", "alert", "banner", "overlay", "menu", "side", "aside", "comment", "respond", "reply", "replies", "share", "sharing", "social", "related",
    "recommended", "widget", "toolbar", "search", "login", "form", "skip", "copyright",
}
#: Fixed: words of names about layout.
LAYOUT = {
    "area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "count", "field", "fixed", "float", "follow", "global", "header", "icon",
    "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "media", "message", "module", "outer", "page", "panel", "post", "posts", "primary", "right", "row", "secondary",
    "section", "site", "slot", "sticky", "stories", "text", "title", "to", "tools", "top", "unit", "us", "wrap", "wrapper",
}
HEADS = {"header", "masthead"}
_MARKS = LIKELY | LAYOUT | SURE | HEADS
#: Of the marks, what readers wrote; they can be longer than the article.
COMMENTS = {"comment", "comments", "disqus", "respond", "reply", "replies"}
WITH = {"no", "has", "with", "without"}
#: Names that a path spells out; of a deeper one the names above are a digest.
SPELLED = 64


def _words(attributes: str) -> tuple[dict[str, str], list[list[str]]]:
    """The class, id and role of a tag, and the words of each name in them."""
    found: dict[str, str] = {}
    for k, a, b, c in _NAMES.findall(attributes):
        found.setdefault(k.lower(), a or b or c)
    # A name like has-sidebar or no-ads tells of a part that is elsewhere.
    names = (re.split(r"[^a-z]+", name) for name in " ".join(found.values()).lower().split())
    return found, [[w for w in own if w] for own in names if WITH.isdisjoint(own)]


class _Element:
    __slots__ = ("tag", "name", "digest", "never", "mark", "maybe", "below", "remarks", "out", "link", "parent", "depth", "held", "linked", "clear", "block", "container", "inside")

    def __init__(self, tag: str, attributes: str, parent: _Element | None) -> None:
        found, names = _words(attributes) if attributes else ({}, [])
        words = {w for own in names for w in own}
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.inside = (parent is not None and parent.inside) or tag in ("article", "main")
        head = tag == "header" or bool(words & HEADS)
        body = tag in ("body", "html", "article", "main")
        self.never = (parent is not None and parent.never) or tag in NEVER
        likely = [own for own in names if not LIKELY.isdisjoint(own)]
        if self.inside:  # a word marks only with nothing but layout beside it, and a likely one only by its links
            likely = [own for own in names if not LIKELY.union(SURE).isdisjoint(own)]
            sure = any(_MARKS.issuperset(own) and not SURE.isdisjoint(own) or _MARKS.issuperset(own) and len(own) > 1 for own in likely)
        else:
            sure = bool(words & SURE) or any(_MARKS.issuperset(own) for own in likely)
        self.mark = tag == "form" or (not body and sure) or (head and not self.inside)
        self.maybe = not self.mark and not body and bool(likely)
        self.remarks = (parent is not None and parent.remarks) or (not body and bool(words & COMMENTS))
        self.below = self.out = False
        self.held = self.linked = self.clear = 0
        self.link = tag == "a" or (parent is not None and parent.link)
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.container = self if tag in CONTAINER else parent.container if parent else None
        self.name = ".".join([tag, *sorted(re.sub(r"\d+", "#", c) for c in found.get("class", "").lower().split())])
        self.digest: str | None = None

    def path(self) -> str:
        names, e = [], self
        while e is not None and len(names) < SPELLED:
            names.append(e.name)
            e = e.parent
        return ">".join([*([e.all_names()] if e else []), *reversed(names)])

    def all_names(self) -> str:
        """A digest of the names down to this element, kept for those below."""
        way, e = [], self
        while e is not None and e.digest is None:
            way.append(e)
            e = e.parent
        for x in reversed(way):
            x.digest = hashlib.blake2b(f"{x.parent.digest if x.parent else ''}>{x.name}".encode("utf-8", "replace"), digest_size=16).hexdigest()
        return self.digest


def _leave_out(elements: list[_Element], plain: int) -> None:
    """Set out of each element, given in page order with held and linked of their own texts.

    A name that may be a mark is one where the part's text is mostly links. A mark counts unless its element
    holds the page's largest main element, the largest article (if no less than all that is outside marks; those
    in comments only where no other is outside marks), or, unless it marks comments, more than half of the page's
    text while no article outside marks has a tenth.
    """
    own = [e.held for e in elements]
    for e in reversed(elements):
        e.mark = e.mark or (e.maybe and e.linked > e.held)
        if e.parent is not None:
            e.parent.held += e.held
            e.parent.linked += e.linked
    if not any(e.mark for e in elements):
        return
    for e in elements:
        e.below = e.mark or (e.parent is not None and e.parent.below)
    free = plain - sum(n for e, n in zip(elements, own, strict=True) if e.below)
    for e, n in zip(reversed(elements), reversed(own), strict=True):
        e.clear += 0 if e.below else n
        if e.parent is not None:
            e.parent.clear += e.clear
    solid = max((e.clear for e in elements if e.tag in ("article", "main")), default=0)
    spared: set[_Element] = set()
    for tag, least in (("main", 1), ("article", max(1, free))):
        e = max((e for e in elements if e.tag == tag and not e.never and not (e.remarks and solid)), key=lambda e: e.held, default=None)
        if e is not None and e.held >= least:
            while e is not None:
                spared.add(e)
                e = e.parent
    for e in elements:
        kept = e in spared or (2 * e.held > plain and 10 * solid < plain and not e.remarks)
        e.out = (e.parent is not None and e.parent.out) or (e.mark and not kept)


class Page:
    """A parsed page: its elements in order, and its blocks outside marked parts as (text, nearest container, characters outside links).

    Where marks would leave no text, none counts.
    """

    def __init__(self, page: str) -> None:
        self.elements, texts = _parsed(page)
        plain = 0
        for e, text in texts:
            if text is not None and not text.isspace():
                if e is None or not e.link:
                    plain += len(text)
                if e is not None:
                    if e.link:
                        e.linked += len(text)
                    else:
                        e.held += len(text)
        _leave_out(self.elements, plain)
        if all(t is None or t.isspace() or (e is not None and e.out) for e, t in texts):
            for e in self.elements:
                e.out = False
        self.blocks = list(_blocks(texts))

    def scores(self) -> dict[str, int]:
        """Scores from 0 to some 1300 of the generalised paths of the page's containers.

        A container's share is that of the page's characters outside links that it holds. One with most of them
        scores, the more the deeper it is; an article or main element scores from two fifths on.
        """
        held: Counter[_Element] = Counter()
        total = 0
        for _, owner, plain in self.blocks:
            total += plain
            if owner is not None:
                held[owner] += plain
        for e in reversed(self.elements):
            if e.container is e and e.parent is not None and e.parent.container is not None and held[e]:
                held[e.parent.container] += held[e]
        by_path: Counter[str] = Counter()
        of: dict[str, _Element] = {}
        for e in self.elements:
            if held[e] > 0:
                path = e.path()
                by_path[path] += held[e]
                of.setdefault(path, e)
        out = {}
        for path, n in by_path.items():
            main = of[path].tag in ("article", "main")
            if total and n >= (0.4 if main else 0.7) * total:
                out[path] = 1000 * n // total + 5 * min(of[path].depth, 20) + 200 * main
        return out

    def text(self, path: str | None) -> str:
        """The blocks inside containers with this path, joined by \\n; without such a container, those of the page's best one."""
        for choose in (lambda: path, lambda: _best(self.scores())):
            wanted = choose()
            if not wanted:
                continue
            within: dict[_Element, bool] = {}
            for e in self.elements:
                if e.container is e:
                    above = e.parent.container if e.parent is not None else None
                    within[e] = (above is not None and within[above]) or e.path() == wanted
            if found := [t for t, owner, _ in self.blocks if owner is not None and within[owner]]:
                return "\n".join(found)
        return "\n".join(t for t, _, _ in self.blocks)


def _blocks(texts: list[tuple[_Element | None, str | None]]) -> Iterator[tuple[str, _Element | None, int]]:
    pieces: list[str] = []
    plain = 0
    owner: _Element | None = None
    for top, text in [*texts, (None, None)]:
        if text is None:
            if pieces:
                whole = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
                if whole:
                    yield whole, owner, plain
            pieces, plain, owner = [], 0, None
        elif top is None or not top.out:
            pieces.append(text)
            if not text.isspace():
                if owner is None and top is not None:
                    owner = top.container
                if top is None or not top.link:
                    plain += len(text)


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", tag, attributes) of each tag; comments and declarations have an empty tag.

    One pass: a tag ends at the first > outside quotes. Where quotes don't match up to the page's end, quotes mean
    nothing in this tag and all later ones. What has no > after it is text. send(at) goes on from there.
    """
    at, quotes = 0, True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            end, closing, tag, attributes = close + 3 if close >= 0 else len(page), "", "", ""
        elif m := _OPEN.match(page, start):
            end, i = -1, m.end()
            while quotes and (q := _QUOTE.search(page, i)):
                if q[0] == ">":
                    end = q.end()
                    break
                i = page.find(q[0], q.end()) + 1
                if not i:
                    break
            if end < 0:
                quotes = False
                end = page.find(">", m.end()) + 1
            if not end:
                return
            closing, tag, attributes = m[1], m[2].lower(), page[m.end() : end - 1]
        elif page.startswith(("<!", "<?", "</"), start):
            end, closing, tag, attributes = page.find(">", start) + 1, "", "", ""
            if not end:
                return
        else:
            at = start + 1
            continue
        at = (yield start, end, closing, tag, attributes) or end


def _parsed(page: str) -> tuple[list[_Element], list[tuple[_Element | None, str | None]]]:
    """The elements in page order, and each text with its element; a text of None ends a block."""
    low = None
    top: _Element | None = None
    elements: list[_Element] = []
    texts: list[tuple[_Element | None, str | None]] = []
    open_: Counter[str] = Counter()
    at, go_on = 0, None
    tags = _tags(page)

    def close(e: _Element) -> _Element | None:
        """Close elements up to and with e."""
        x = top
        while x is not e:
            open_[x.tag] -= 1
            x = x.parent
        open_[e.tag] -= 1
        return e.parent

    while True:
        try:
            start, end, closing, tag, attributes = tags.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > at and (top is None or not top.never):
            texts.append((top, page[at:start]))
        at = end
        if not tag:
            continue
        if tag in BLOCK:
            texts.append((None, None))
        if closing:
            if open_[tag]:
                e = top
                while e.tag != tag:
                    e = e.parent
                top = close(e)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                low = page.lower() if low is None else low
                low = low if len(low) == len(page) else "".join(c.lower() if c.isascii() else c for c in page)
                found = low.find(f"</{tag}", end)
                stop = page.find(">", found) if found >= 0 else -1
                at = go_on = stop + 1 if stop >= 0 else len(page)
            continue
        while top is not None and top.tag in ENDS and tag in ENDS[top.tag][1]:
            top = close(top)
        if tag in BLOCK and top is not None and top.tag not in BLOCK and top.block.tag == "p":
            # An open inline element inside a paragraph doesn't keep a new block in the paragraph.
            top = close(top.block)
        top = _Element(tag, attributes, top)
        open_[tag] += 1
        elements.append(top)
    if at < len(page) and (top is None or not top.never):
        texts.append((top, page[at:]))
    return elements, texts


def blocks(page: str) -> list[tuple[str, _Element | None, int]]:
    """(text, nearest container, characters outside links) of each block that isn't in a part marked as other than the article."""
    return Page(page).blocks


def scored(page: str) -> dict[str, int]:
    """The scores of a page's container paths."""
    return Page(page).scores()


def text_of(page: str, path: str | None) -> str:
    """The text of a page inside the containers with this path."""
    return Page(page).text(path)


def _best(scores: dict[str, int]) -> str | None:
    return max(sorted(scores), key=scores.__getitem__) if scores else None


def _vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        votes: Counter[tuple[str, str]] = Counter()
        for host, page in zip(b.column("_host").to_pylist(), b.column("html").to_pylist(), strict=True):
            for path, score in scored(page or "").items():
                votes[host, path] += score
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array(votes.values(), pa.int64())], names=["_host", "path", "votes"])


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [text_of(page or "", path) for page, path in zip(b.column("html").to_pylist(), b.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), b.column("path")], names=["page_id", "url", "text", "path"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, path): the main text of each of pages, from its whole html.

    Every page scores its containers; the scores add up by host and generalised path (tags with their classes,
    digits as #) in Spark, and each host's best path (ties: the smaller one) is extracted from its pages. A page
    without it uses its own best container, one without any all its blocks. Menus, headers outside the article,
    footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out by their elements,
    classes, ids and roles; a form, class, id or role around the page's article or most of its text marks nothing. A block's character references are decoded and its white space becomes single
    spaces; blocks are joined by \\n in page order.

    Votes are summed in each task before they are shuffled. The winners are broadcast within a counted bound,
    and joined by host beyond it. Nulls: a null html gives an empty text; pages with a null url share a host.
    Each row has its result, repeated ones too. An empty table gives an empty result.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("_host"))
    votes = p.select("_host", "html").mapInArrow(_vote, "_host string, path string, votes long").groupBy("_host", "path").agg(F.sum("votes").alias("votes"))
    best = votes.groupBy("_host").agg(F.max_by("path", F.struct("votes", F.length("path") * -1, "path")).alias("path"))
    rows = p.join(sized(staged(best, "host-paths")), "_host", "left").select("page_id", "url", "html", "path")
    d = rows.mapInArrow(_extract, "page_id long, url string, text string, path string")
    return d.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
