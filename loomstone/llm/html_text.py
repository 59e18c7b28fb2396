"""HTML extraction by composite text density.

A page becomes a flat DOM (nodes in page order, each with its parent). What can't be article text is marked first: menus,
page headers and footers, sidebars, notices, adverts, forms, scripts, styles, comments by readers. Then each node gets
its link-adjusted characters per tag,

    density = C / T * log(C / max(LC, 1) * T / max(LT, 1)) / (1 + log(log(C / max(C - LC, 1) * LC + LCb / Cb * C + e)))

(C, T: characters and tags of the subtree, LC, LT: those in links, b: of the body; the 1 keeps pages without links
defined), and the sum of its children's densities, texts being children of one tag without links. The subtree with the
largest sum is the content; if it is only a part of a text (a paragraph, a list), the container around it is. The
smallest density on its path up to the body is the threshold at which neighbouring containers and lists count as content
too; neighbouring paragraphs and headings do if they aren't mostly links. An `article` or `main` around the densest
subtree is taken as a whole. All text of the content is kept.

Rules of the output: character references are decoded, each run of white space in a block is one space, blocks are
trimmed, empty blocks vanish, and blocks are joined in page order by an empty line.

Defined cases: a null or empty page, and one without article text, gives an empty text; broken markup is read as far as
it goes, an unclosed comment or tag ends the page; text outside any tag is body text. Nesting may be of any depth.
Repeated rows give repeated rows, null ids stay null; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "head script style noscript template iframe object embed svg canvas form button input select textarea option nav footer aside dialog menu "
    "title audio video map noembed noframes xmp".split()
)
ENDS_P = BLOCKS - {"body", "html", "head", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
#: Words of class, id and role that mark what is no article.
HINTS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related "
    "reply replies respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget complementary contentinfo search alert".split()
)
#: Words by which a class speaks of another part ("has-sidebar").
NOT_A_HINT = frozenset("no has with without".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class Page:
    """Nodes in page order: tag, parent, end (one past the subtree), own marks; and the texts with their node."""

    def __init__(self, source: str):
        self.tag, self.parent, self.end, self.off = ["#page"], [0], [0], [False]
        self.parts: list[tuple[int, str | None]] = []  # (node, text), or (node, None) where a block begins or ends
        self.hinted: list[int] = []
        self.headers: list[int] = []  # named a header: the page's own unless it holds a heading
        self.stack = [0]
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # by tag: where its open elements are in the stack
        self._read(source)
        while self.stack:
            self._close()

    def _open(self, tag: str) -> int:
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.off.append(tag in NEVER or self.off[self.stack[-1]])
        self.end.append(0)
        node = len(self.tag) - 1
        if tag in BLOCKS or tag == "br":
            self.parts.append((node, None if tag != "br" else " "))
        if tag not in VOID:
            self.at[tag].append(len(self.stack))
            self.stack.append(node)
        else:
            self.end[node] = node + 1
        return node

    def _close(self) -> None:
        node = self.stack.pop()
        if self.stack:
            self.at[self.tag[node]].pop()
        self.end[node] = len(self.tag)
        if self.tag[node] in BLOCKS:
            self.parts.append((node, None))

    def _innermost(self, tags: set[str] | frozenset[str]) -> int:
        """Where in the stack the innermost open element of `tags` is; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def _close_until(self, tags: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> None:
        """Closes the outermost open element of `tags` above the innermost barrier."""
        bar, first = self._innermost(barrier), []
        for t in tags:
            k = bisect_right(self.at[t], bar)
            first += self.at[t][k : k + 1]
        while first and len(self.stack) > min(first):
            self._close()

    def _start(self, tag: str, attrs: str) -> None:
        if self.open_p and tag in ENDS_P:
            self._close_until({"p"}, {"table", "td", "th", "button"})
            self.open_p = 0
        if tag in SIBLINGS:
            self._close_until(*SIBLINGS[tag])
        if tag == "p":
            self.open_p = 1
        node = self._open(tag)
        if attrs:
            self._marks(node, tag, attrs)

    def _marks(self, node: int, tag: str, attrs: str) -> None:
        words: set[str] = set()
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                words.update(w.lower() for w in _WORDS.findall(value))
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                self.off[node] = True
        if tag in ("html", "body", "article", "main") or words & NOT_A_HINT:
            return
        if words & HINTS:
            self.hinted.append(node)
        elif "header" in words:
            self.headers.append(node)

    def _read(self, s: str) -> None:
        at, n, self.open_p = 0, len(s), 0
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self.parts.append((self.stack[-1], entities.unescape(s[at:lt])))
            if lt >= n:
                return
            if s.startswith("<!--", lt):
                end = s.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif s.startswith(("<!", "<?"), lt):
                end = s.find(">", lt)
                at = n if end < 0 else end + 1
            elif s.startswith("</", lt):
                end = s.find(">", lt)
                m = _NAME.match(s, lt + 2)
                at = n if end < 0 else end + 1
                if m:
                    self._end_tag(m[0].lower())
            elif m := _NAME.match(s, lt + 1):
                tag, stop = m[0].lower(), self._tag_end(s, m.end())
                self._start(tag, s[m.end() : stop - 1])
                at = stop
                if tag in RAW:
                    close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(s, at)
                    at = close.start() if close else n
            else:
                self.parts.append((self.stack[-1], "<"))
                at = lt + 1

    @staticmethod
    def _tag_end(s: str, at: int) -> int:
        """One past the > that ends the tag, outside quoted values."""
        while True:
            end = s.find(">", at)
            if end < 0:
                return len(s) + 1
            quote = min((i for i in (s.find('="', at, end), s.find("='", at, end)) if i >= 0), default=-1)
            if quote < 0:
                return end + 1
            close = s.find(s[quote + 1], quote + 2)
            if close < 0:
                return end + 1
            at = close + 1

    def _end_tag(self, tag: str) -> None:
        if tag == "br":
            self.parts.append((self.stack[-1], " "))
            return
        barrier = {"article", "main", "table", "body"} if tag not in BLOCKS else {"body"} if tag not in ("html", "body") else set()
        mine = self._innermost({tag})
        if mine and mine < self._innermost(barrier - {tag}):
            return
        while mine and len(self.stack) > mine:
            self._close()
        if tag == "p":
            self.open_p = 0


def _counts(page: Page, tags: frozenset[str]) -> list[int]:
    """How many elements of `tags` come before each node: a subtree holds some where its ends differ."""
    out = [0]
    for tag in page.tag:
        out.append(out[-1] + (tag in tags))
    return out


_CONTENT = frozenset(("article", "main", "h1"))
_HEADINGS = _CONTENT | frozenset(("h2", "h3", "h4", "h5", "h6"))
_WHOLE = frozenset(("article", "main"))
#: Elements that hold a part of a text: the text itself is around them.
_PARTS = frozenset("p li h1 h2 h3 h4 h5 h6 pre blockquote dt dd td th tr tbody thead tfoot ul ol dl hr figcaption".split())
#: Those that are text however short they are.
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())


def mark_off(page: Page) -> None:
    """Spreads the marks: hinted parts that hold no article, page headers, and all below what is marked."""
    off, content, whole = page.off, _counts(page, _CONTENT), _counts(page, _WHOLE)
    in_article = [False] * len(off)
    for i in range(1, len(off)):
        in_article[i] = in_article[page.parent[i]] or page.tag[i] in ("article", "main")
    for i in page.hinted:
        if not off[i] and content[i] == content[page.end[i]]:
            off[i] = True
    headings = _counts(page, _HEADINGS)
    for i in page.headers:
        if not in_article[i] and headings[i] == headings[page.end[i]]:
            off[i] = True
    for i in range(1, len(off)):
        if page.tag[i] == "header" and not in_article[i] and whole[i] == whole[page.end[i]]:
            off[i] = True
        off[i] = off[i] or off[page.parent[i]]


def densities(page: Page) -> tuple[list[float], list[float], list[int], list[int]]:
    """Density and sum of the children's densities of each node (texts are children too), its characters, and those in links."""
    n = len(page.tag)
    chars, link, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    sums, loose = [0.0] * n, [0.0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[page.parent[i]] or page.tag[i] == "a"
    for node, text in page.parts:
        if text and not page.off[node]:
            c = len(_SPACE.sub(" ", text).strip(" "))
            chars[node] += c
            if in_link[node]:
                link[node] += c
            elif c:
                loose[node] += c * math.log(c)  # a text's own density: one tag, no links
    for i in range(n - 1, 0, -1):
        if not page.off[i]:
            p = page.parent[i]
            chars[p] += chars[i]
            link[p] += link[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (page.tag[i] == "a")
    body = next((i for i, t in enumerate(page.tag) if t == "body"), 0)
    share = link[body] / max(1, chars[body])
    density = [0.0] * n
    for i in range(n):
        c = chars[i]
        if c and not page.off[i]:
            t, lc, lt = max(1, tags[i]), link[i], link_tags[i]
            base = math.log(math.log(c / max(1, c - lc) * lc + share * c + math.e))
            top = math.log(max(1.0, c / max(1, lc) * t / max(1, lt)))
            # Without links the base is 1 and its logarithm 0: the adjustment is then the logarithm alone.
            density[i] = c / t * top / (1 + base)
    for i in range(n - 1, 0, -1):
        sums[page.parent[i]] += density[i]
    return density, [x + y for x, y in zip(sums, loose, strict=True)], chars, link


def content_nodes(page: Page) -> tuple[list[int], int | None]:
    """The tops of the kept subtrees, and the node whose own text is kept beside them."""
    density, sums, chars, link = densities(page)
    live = [i for i in range(len(page.tag)) if chars[i] and not page.off[i]]
    if not live:
        return [], None
    best = max(live, key=lambda i: (sums[i], -i))
    path = [best]
    while path[-1] != 0:
        path.append(page.parent[path[-1]])
    inner = path[: next((k for k, i in enumerate(path) if page.tag[i] == "body"), len(path) - 1) + 1]
    threshold = min(density[i] for i in inner)
    for tag in ("article", "main"):
        # The outermost such element around the densest subtree is the article as a whole.
        if around := [i for i in path if page.tag[i] == tag]:
            return [around[-1]], None
    inside = _counts(page, BLOCKS)
    blocks = lambda i: inside[page.end[i]] > inside[i + 1]
    part = lambda i: page.tag[i] in _PARTS or page.tag[i] not in BLOCKS and i != 0
    # A part of a text, or a block of nothing but text, stands for the text around it.
    top = next((i for i in path if i == 0 or not part(i) and (blocks(i) or page.tag[i] == "body")), 0)
    outer = page.tag[top] in ("body", "html", "#page")
    beside = [i for i in live if i and page.parent[i] == (top if outer else page.parent[top])]
    plain = lambda i: page.tag[i] in _TEXTS and link[i] * 2 <= chars[i]
    kept = [i for i in beside if i == top or plain(i) or density[i] >= threshold and (part(i) or blocks(i))]
    if not outer:
        return kept, None
    # The text lies in the body itself: beside paragraphs and containers of blocks, blocks of bare text are no part of it.
    return (kept if any(page.tag[i] in BLOCKS for i in kept) else beside), top


def extract(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    mark_off(page)
    tops, own = content_nodes(page)
    keep = [False] * len(page.tag)
    for i in tops:
        keep[i] = True
    for i in range(1, len(keep)):
        keep[i] = keep[i] or (keep[page.parent[i]] and page.parent[i] != own)
        if i == own:
            keep[i] = True
    if own == 0:
        keep[0] = True
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(now)).strip(" ")
        now.clear()
        if text:
            blocks.append(text)

    for node, text in page.parts:
        if text is None:
            flush()
        elif keep[node] and not page.off[node]:
            now.append(text)
    flush()
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("source"))
    return rows.mapInArrow(each, "page_id long, url string, text string, n_chars long")
