"""Main text of web pages by tree scoring.

A forgiving parser builds the element tree (implied ends of paragraphs, items and cells; raw text of scripts and
styles; comments; a page cut off anywhere). Subtrees that are boilerplate by element, role or visibility are left out,
and those marked by a word of their class or id, unless what they hold speaks against it: the page's only article, half
of the characters of a page without another, or a paragraph of prose inside an article. An unclear mark (`page-menu`,
`has-sidebar`) counts where links are over a quarter of the characters or no block is prose. The header of an article with its heading stays. If nothing
is left, only whole words of a class count. Every remaining paragraph passes points, one plus one a comma plus one per hundred
characters up to three, to its parent and half of them to its grandparent; an element's score is its points
discounted by the share of its characters that stand in links. The best element, lifted to the article that holds it,
and those of its siblings that score a fifth of it, are running prose, hold a heading with text that is not links, or
stand between two such ones make up the text, with the headings before them; nothing inside them is dropped. Where that has
no first heading of the page, the nearest one before it, level by level upwards, is put in front.

Blocks: character references decoded, white space runs made one space, trimmed, joined by one line feed in page
order. Line breaks inside a block are white space.

Defined results: a null or empty page, or one with nothing but boilerplate, gives the empty string and 0; repeated
rows give repeated rows, an empty table an empty one; no other columns are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is never text of a page.
RAW = frozenset(["script", "style", "noscript", "template", "iframe", "svg", "annotation", "annotation-xml", "canvas", "object", "audio", "video", "xmp", "noembed", "noframes"])
#: Elements that frame a page or take input.
FRAME = frozenset(["nav", "header", "footer", "aside", "form", "button", "select", "textarea", "fieldset", "label", "input", "dialog", "menu", "head", "title"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
BLOCK = frozenset(
    ["html", "body", "main", "article", "section", "div", "p", "pre", "blockquote", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption", "address", "hr", "details", "summary", "hgroup", "center"]
    + sorted(FRAME - {"input", "label", "button"})
)
PARAGRAPH = frozenset(["p", "pre", "blockquote", "li", "dd", "dt", "td", "th", "figcaption"])
HEADING = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: A start tag of the key ends an open element of the value, unless one of the bounds stands between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Words that mark boilerplate in a class or id, alone or with others (`site-footer`, `ad-slot`).
MARKS = frozenset(
    """ad ads advert adverts advertisement banner banners breadcrumb breadcrumbs comment comments consent cookie cookies
    disqus footer foot gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices pagination
    popup promo promos promotion related replies reply respond share sharing sidebar skip social sponsor sponsored
    subscribe toolbar topbar widget widgets""".split()
)
#: A mark joined with one of these is the mark, too (`commentlist`, `sidebarbox`).
JOINED = re.compile(rf"({'|'.join(sorted(MARKS, key=len, reverse=True))})(?:list|box|area|section|form|bar|links?|block|thread|item|holder|container)")
#: A name that holds one of these may speak of the marked thing and not be it (`has-sidebar`, `content-with-header`).
ABOUT = frozenset("has no not with without is hide article content main page post entry story text body layout wrap wrapper enabled disabled".split())
NAMES = re.compile(r"[\s]+")
WORDS = re.compile(r"[_\W\d]+|(?<=[a-z])(?=[A-Z])")
ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form", "toolbar"])
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
SIBLING_SHARE = 0.2
#: Prose has so many characters and at most this share of them in links.
PROSE_CHARS, PROSE_LINKS = 40, 0.25
#: What stands around a page's title has no more characters.
TITLE_CHARS = 400
#: What an element's tag and attributes say of it.
TEXT, HINT, WEAK, MARKED, GONE = range(5)


def _verdict(tag: str, raw_attributes: str) -> int:
    """TEXT, HINT (a word of a class or id may mark it), WEAK (one marks it), MARKED (a whole class or id does, or its role), or GONE (not shown)."""
    if tag in FRAME:
        return GONE
    if not raw_attributes or tag in ("html", "body"):
        return TEXT
    found = TEXT
    for m in ATTRIBUTE.finditer(raw_attributes):
        name = m[1].lower()
        value = unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            for one in NAMES.split(value.strip()):
                words = {m[1] if (m := JOINED.fullmatch(w.lower())) else w.lower() for w in WORDS.split(one) if w}
                if words & MARKS:
                    found = max(found, HINT if words & ABOUT else MARKED if words <= MARKS else WEAK)
        elif name == "role" and value.strip().lower() in ROLES:
            found = max(found, MARKED)
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return GONE
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return GONE
    return found


class _Page:
    """Elements as parallel lists; blocks of text with the element that holds each."""

    def __init__(self) -> None:
        self.tag, self.parent, self.verdict = ["#root"], [-1], [TEXT]
        self.stack = [0]
        self.open_at: dict[str, list[int]] = {}  # depths of the open elements of each tag
        self.open_blocks = [0]
        self.links = 0
        self.text: list[str] = []
        self.linked: list[str] = []
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((self.stack[self.open_blocks[-1]], text, len(" ".join("".join(self.linked).split()))))
            self.text, self.linked = [], []

    def put(self, raw: str) -> None:
        text = unescape(raw)
        self.text.append(text)
        if self.links:
            self.linked.append(text)

    def _depth(self, tag: str) -> int:
        held = self.open_at.get(tag)
        return held[-1] if held else 0

    def _pop_to(self, depth: int) -> None:
        for i in self.stack[depth:]:
            self.open_at[self.tag[i]].pop()
            self.links -= self.tag[i] == "a"
        while self.open_blocks[-1] >= depth:
            self.open_blocks.pop()
        del self.stack[depth:]

    def open(self, tag: str, attributes: str) -> None:
        frame = tag in FRAME
        if tag in BLOCK or frame:
            self.flush()
        if tag in BLOCK and tag not in ("html", "body"):  # block starts end an open paragraph
            depth = self.open_blocks[-1]
            if self.tag[self.stack[depth]] == "p":
                self._pop_to(depth)
        if tag in ENDS:
            bound = max(map(self._depth, BOUNDS[tag]))
            depth = self._depth("tr") if tag == "tr" else 0
            if depth <= bound:
                depth = max(map(self._depth, ENDS[tag]))
            if depth > bound:
                self._pop_to(depth)
        if tag == "a" and self.links:
            self.close("a")
        if tag in ("br", "wbr", "hr", "img"):
            if tag != "wbr":
                self.put(" ")
            return
        if tag in VOID:
            return
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.verdict.append(_verdict(tag, attributes))
        self.open_at.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK or frame:
            self.open_blocks.append(len(self.stack))
        self.stack.append(len(self.tag) - 1)
        self.links += tag == "a"

    def close(self, tag: str) -> None:
        depth = self._depth(tag)
        if not depth or tag not in BLOCK and tag not in FRAME and depth < self.open_blocks[-1]:
            return  # never opened, or an inline end, which does not close a block
        if tag in BLOCK or tag in FRAME:
            self.flush()
        self._pop_to(depth)


def parse(html: str) -> _Page:
    page, at, size = _Page(), 0, len(html)
    while at < size:
        m = TAG.search(html, at)
        if m is None:
            page.put(html[at:])
            break
        if m.start() > at:
            page.put(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            page.close(tag)
        elif tag in RAW:
            if not m[3].rstrip().endswith("/") or tag in ("script", "style"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else size
        else:
            page.open(tag, m[3])
    page.flush()
    return page


def _sums(page: _Page, blocks: list[tuple[int, str, int]]) -> tuple[list[int], list[int]]:
    """Characters, and those in links, of each element with all it holds. Children come after their parents."""
    chars, linked = [0] * len(page.tag), [0] * len(page.tag)
    for element, text, in_links in blocks:
        chars[element] += len(text)
        linked[element] += in_links
    for i in range(len(page.tag) - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
        linked[page.parent[i]] += linked[i]
    return chars, linked


def _left_out(page: _Page, least: int) -> list[bool]:
    """For each element: is it, or what holds it, boilerplate? Marks below `least` do not count."""
    tag, parent, verdict = page.tag, page.parent, page.verdict
    n = len(tag)
    chars, linked = _sums(page, page.blocks)
    article, heading = [False] * n, [False] * n  # an unmarked article inside, a heading inside
    for i in range(n - 1, 0, -1):
        if verdict[i] < least and tag[i] in ("article", "main") and chars[i]:
            article[i] = True
        article[parent[i]] |= article[i]
        heading[parent[i]] |= heading[i] or tag[i] in HEADING
    out, within = [False] * n, [False] * n
    for i in range(1, n):
        out[i] = out[parent[i]] or verdict[i] == GONE
    shown, _ = _sums(page, [b for b in page.blocks if not out[b[0]]])
    beside = [0] * n  # articles that no marked element holds
    for i in range(1, n):
        beside[i] = max(beside[parent[i]], int(least <= verdict[i]))
    proses = [False] * n  # a block of prose inside
    for element, text, in_links in page.blocks:
        proses[element] |= len(text) >= PROSE_CHARS and in_links <= PROSE_LINKS * len(text)
    for i in range(n - 1, 0, -1):
        proses[parent[i]] |= proses[i]
    free = any(article[i] and tag[i] in ("article", "main") and not beside[i] for i in range(1, n))
    out = [False] * n
    for i in range(1, n):
        up = parent[i]
        within[i] = within[up] or tag[up] in ("article", "main")
        gone = verdict[i] == GONE
        prose = chars[i] >= PROSE_CHARS and linked[i] <= PROSE_LINKS * chars[i]
        if gone and tag[i] == "header" and within[i] and heading[i] and linked[i] <= PROSE_LINKS * chars[i]:
            gone = False
        elif gone and tag[i] == "form" and article[i]:
            gone = False
        elif verdict[i] == HINT:
            gone = least <= WEAK and not (article[i] or 2 * shown[i] > shown[0]) and (linked[i] > PROSE_LINKS * chars[i] or not proses[i])
        elif not gone and least <= verdict[i] < GONE:
            half = 2 * shown[i] > shown[0]
            holds = article[i] and half or (article[i] or half) and not free
            gone = not (holds or verdict[i] == WEAK and within[i] and tag[i] in PARAGRAPH | HEADING and prose)
        out[i] = out[up] or gone
    return out


def main_text(html: str | None) -> str:
    page = parse(html or "")
    for least in (WEAK, MARKED):
        out = _left_out(page, least)
        blocks = [b for b in page.blocks if not out[b[0]]]
        if blocks:
            return _best(page, out, blocks)
    return ""


def _best(page: _Page, out: list[bool], blocks: list[tuple[int, str, int]]) -> str:
    parent, tag = page.parent, page.tag
    n = len(tag)
    points = [0.0] * n
    chars, linked = _sums(page, blocks)
    for element, text, in_links in blocks:
        if tag[element] in HEADING:
            continue
        share = 1 + text.count(",") + min(len(text) / 100, 3)
        share *= 1 - in_links / len(text)
        to = parent[element] if tag[element] in PARAGRAPH and element else element
        points[to] += share
        if parent[to] >= 0:
            points[parent[to]] += share / 2
    score = [p * (1 - linked[i] / chars[i]) if chars[i] else 0.0 for i, p in enumerate(points)]
    best = max(range(n), key=lambda i: (score[i], -i))
    lifted = best
    while lifted > 0:
        if tag[lifted] in ("article", "main"):
            best = lifted
            break
        lifted = parent[lifted]
    headed = [False] * n  # a heading inside
    first = [False] * n  # a heading of the first rank inside
    for element, _, _ in blocks:
        headed[element] |= tag[element] in HEADING
        first[element] |= tag[element] == "h1"
    for i in range(n - 1, 0, -1):
        headed[parent[i]] |= headed[i]
        first[parent[i]] |= first[i]
    children: dict[int, list[int]] = {}
    for i in range(1, n):
        if chars[i]:
            children.setdefault(parent[i], []).append(i)
    last = {element: text for element, text, _ in blocks}

    def prose(i: int) -> bool:
        return tag[i] in PARAGRAPH and (chars[i] > 80 and linked[i] < 0.25 * chars[i] or chars[i] <= 80 and not linked[i] and last.get(i, "")[-1:] in tuple(".!?"))

    kept = {best}
    plain = lambda i: linked[i] <= PROSE_LINKS * chars[i]
    if best:
        row = children[parent[best]]
        chosen = [i == best or score[i] >= SIBLING_SHARE * score[best] and score[i] > 0 or prose(i) or tag[i] not in HEADING and headed[i] and plain(i) for i in row]
        ends = [k for k, yes in enumerate(chosen) if yes]
        for k, i in enumerate(row):
            if chosen[k] or ends[0] < k < ends[-1] and plain(i):
                kept.add(i)
        for k in range(ends[0] - 1, -1, -1):  # headings right before
            if tag[row[k]] not in HEADING:
                break
            kept.add(row[k])
        # the page's title, if it is not among them: the nearest before, on the way up
        at = best
        if not any(first[i] for i in kept):
            while at > 0:
                before = [i for i in children[parent[at]] if i < at and first[i] and plain(i) and chars[i] <= TITLE_CHARS]
                if before:
                    kept.add(before[-1])
                    break
                at = parent[at]
    inside = [False] * n
    for i in range(n):  # parents come before their children
        inside[i] = i in kept or (parent[i] >= 0 and inside[parent[i]])
    return "\n".join(text for element, text, _ in blocks if inside[element])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns id, url, text, n_chars (code points) of every page."""
    narrow = pages.select(id_col, url_col, html_col)
    names = [id_col, url_col, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    kind = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")
