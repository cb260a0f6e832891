"""Main text of web pages by tag-path ratios.

Every text node counts toward its root-to-leaf tag path. For each path the text length and the punctuation per node are aggregated, smoothed over
neighbouring paths in page order, and fused into one ratio, in which the share of text outside links and what the page itself says of an element (see below) are
factors. The ratio, cut at a threshold, is all that decides: see extract().

What an element says of itself: by its name, ARIA role or class and id it may be marked as furniture (nav, footer, aside, comments, cookie-notice), which makes
the ratio of its paths MARKED times as great; within article and main elements it is ARTICLE times as great, and links count as text. Marks that the page's own text belies don't count: see marked().
Only what a browser doesn't show (scripts, styles, hidden elements) and controls have no ratio at all.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import in_arrow

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe noembed noframes xmp".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "legend", "body", "html", "head", "title"}
#: A new element of the kind closes an open one of these, up to the nearest of the scopes.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "thead": ({"caption", "tr"}, {"table"})}
#: Elements without text of the page: controls, embedded things, the head.
NO_TEXT = set("button select option svg canvas object audio video head input label".split())
#: Elements that are marked as furniture by name, by ARIA role, or by the words of class and id.
FURNITURE = set("nav footer aside form menu dialog fieldset".split())
ROLES = set("navigation banner contentinfo complementary search menu menubar toolbar alert alertdialog dialog form status".split())
HINTS = set("ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices notification alert banner popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login search searchbox form widget skip pagination pager toolbar masthead topbar copyright legal disclaimer".split())
_CONTENT = {"article", "main"}
#: Elements too small to be an article.
_PARTS = {"p", "li", "td", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "a", "b", "span"}
_NEVER_HINTED = {"html", "body", *_CONTENT}
#: An element with a hint word in a longer token is the article's if it holds this share of the content.
HINTED_SHARE = 0.1
#: Factors of the ratio of paths in marked elements, and of those in article and main elements.
MARKED, ARTICLE = 1e-10, 2.0
#: What a path without punctuation counts for, beside the logarithm of its marks; the width of the smoothing in paths; powers of the share of text outside links and of all the path's text.
BASE_MARKS, WIDTH, LINK_POWER, TEXT_POWER = 0.05, 0.6, 6, 0.75
#: Within the article's region a path is kept from this part of the threshold on.
LOW = 1e-6

_MARK = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")
_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("content", "hinted", "name", "out", "parent", "path", "plain", "tokens", "weak")

    def __init__(self, name: str, parent: _Node | None, attributes: str = ""):
        self.name, self.parent = name, parent
        self.path = f"{parent.path}/{name}" if parent else name
        a = _attributes(attributes) if attributes.strip() else {}
        self.out = bool(parent and parent.out) or name in NO_TEXT or _unseen(name, a)
        self.plain, self.tokens = _hints(a)  # a whole token says it; tokens with a hint word among others
        self.weak = name in ("form", "fieldset")  # page-wide in some systems
        if name not in _NEVER_HINTED:
            self.plain |= name in FURNITURE or a.get("role", "").lower() in ROLES or name == "header" and not (parent and parent.content)  # an article's header holds its title
        self.content = name in _CONTENT and not self.plain or bool(parent and parent.content)
        self.hinted: tuple[_Node, ...] = parent.hinted if parent else ()  # the element and those around it that have marks
        if (self.plain or self.tokens) and name not in _NEVER_HINTED or self.plain and name == "article":
            self.hinted += (self,)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _inside(node: _Node | None, names: set[str]) -> bool:
    while node:
        if node.name in names:
            return True
        node = node.parent
    return False


def _unseen(name: str, a: dict[str, str]) -> bool:
    return bool(a) and name not in _NEVER_HINTED and ("hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", ""))))


def _hints(a: dict[str, str]) -> tuple[bool, frozenset[str]]:
    """Whether a token of class or id has hint words only, and the tokens that have a hint word and others."""
    plain, mixed = False, set()
    for token in f"{a.get('class', '')} {a.get('id', '')}".lower().split() if a else ():
        found = [w in HINTS for w in _WORD.findall(token)]
        if any(found):
            plain |= all(found)
            mixed |= set() if all(found) else {token}
    return plain, frozenset(mixed)


def parsed(page: str) -> Iterator[tuple[str, _Node, str]]:
    """('text' | 'break' | 'open' | 'media', node, text) in page order; unclosed, misnested and cut-off markup is tolerated."""
    node = root = _Node("", None)
    at = 0
    while at < len(page):
        m = _MARK.search(page, at)
        if not m:
            yield "text", node, page[at:]
            return
        if m.start() > at:
            yield "text", node, page[at : m.start()]
        at = m.end()
        end, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if m[0].startswith("<![CDATA["):
                yield "text", node, entities.unescape("") + m[0][9:].removesuffix("]]>").replace("&", "&amp;")
            continue
        name = name.lower()
        if end:
            up = node
            while up is not root and up.name != name:
                up = up.parent
            if up is not root:
                node = up.parent
            if name in BLOCK:
                yield "break", node, name
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at) if not raw.rstrip().endswith("/") else None
            at = close.end() if close else (len(page) if not raw.rstrip().endswith("/") else at)
            continue
        if name in CLOSES_P:
            up = node
            while up is not root and up.name != "p" and up.name not in ("td", "th", "button", "caption", "object", "div", "section", "article", "body"):
                up = up.parent
            if up.name == "p":
                node = up.parent
        if name in IMPLIED:
            closed, scopes = IMPLIED[name]
            up, last = node, None
            while up is not root and up.name not in scopes:
                if up.name in closed:
                    last = up
                up = up.parent
            if last:
                node = last.parent
        if name in BLOCK:
            yield "break", node, name
        elif name == "br":
            yield "text", node, " "
        if name == "img":
            yield "media", node, raw
        if name not in VOID and not (raw.endswith("/") and name not in BLOCK):
            if name in ("html", "body") and _inside(node, {name}):
                continue
            node = _Node(name, node, raw)
            yield "open", node, ""


def blocks_of(page: str) -> tuple[list[tuple[str, _Node, int, int]], list[_Node]]:
    """(text, its element, characters, characters in links) for each block that has text, and the article and main elements."""
    out, parts, nodes, linked, articles = [], [], [], 0, []

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            first = nodes[0]
            while first.name not in BLOCK and first.parent and first.parent.name:
                first = first.parent
            out.append((text, first, len(text), linked))
        parts.clear()
        nodes.clear()
        linked = 0

    for kind, node, text in parsed(page):
        if kind == "break":
            flush()
        elif kind == "open":
            if node.name in _CONTENT and not node.out and not node.plain:
                articles.append(node)
        elif kind == "text" and not node.out:
            value = entities.unescape(text)
            if value.strip():
                nodes.append(node)
                if _inside(node, {"a"}):
                    linked += len(value)
            if nodes or parts:
                parts.append(value)
    flush()
    return out, articles


def path_ratios(blocks: list, marks: list[bool]) -> tuple[list[int], np.ndarray]:
    """Each block's path, as a number in page order, and the ratio of each path: the root of its characters by node and the logarithm of its punctuation by node, both smoothed, with all characters of the path.

    Paths in marked elements are apart from others of the same names.
    """
    paths: dict[tuple[str, bool, bool], int] = {}
    rows = [paths.setdefault((b[1].path, m, b[1].content), len(paths)) for b, m in zip(blocks, marks, strict=True)]
    n = len(paths)
    nodes, chars, stops, linked = (np.zeros(n) for _ in range(4))
    for r, b in zip(rows, blocks, strict=True):
        nodes[r] += 1
        chars[r] += b[2]
        linked[r] += 0 if b[1].content else min(b[2], b[3])
        stops[r] += len(_PUNCTUATION.findall(b[0]))
    kernel = np.exp(-0.5 * (np.arange(-2, 3) / WIDTH) ** 2)
    kernel /= kernel.sum()
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="constant"), kernel, "valid")
    says = np.array([(MARKED if m else 1.0) * (ARTICLE if content else 1.0) for _, m, content in paths])
    free = ((chars - linked + 1) / (chars + 1)) ** LINK_POWER
    return rows, np.sqrt(smooth((chars - linked) / nodes)) * (BASE_MARKS + np.log1p(smooth(stops / nodes))) * chars**TEXT_POWER * free * says


def decided(blocks: list, marks: list[bool], strength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block: whether its path is above the threshold and has punctuation of its own (or none above it has), whether it is above LOW of the threshold, and its
    characters outside links if the former holds (else 0)."""
    rows, ratio = path_ratios(blocks, marks)
    rows = np.array(rows)
    limit = min(strength * ratio.std(), ratio.max())
    content = ratio >= limit
    stopped = np.zeros(len(ratio), bool)
    stopped[rows[[bool(_PUNCTUATION.search(b[0])) for b in blocks]]] = True
    sure = content & stopped
    sure = (sure if sure.any() else content)[rows]
    mass = np.where(sure, [max(0, b[2] - b[3]) for b in blocks], 0)
    return sure, (ratio >= LOW * limit)[rows], mass


def marked(blocks: list, articles: list[_Node], strength: float) -> list[bool]:
    """For each block whether it is in an element that is furniture by a mark that counts.

    A whole mark (by name, role, or a token of hint words only, such as comments) counts, unless the element holds all article and main elements and half of the
    content, as the ratios without marks have it; a form need only hold half of the content. Such a mark on an article element (a comment) counts if there are others. A hint word in a longer token (has-sidebar,
    legal-text) counts if the element holds no article or main element and, with all elements of the same token, less than HINTED_SHARE of the content
    outside whole marks.
    """
    if not any(b[1].hinted for b in blocks):
        return [False] * len(blocks)
    holds: dict[int, int] = {}
    for x in articles:
        for h in x.hinted:
            holds[id(h)] = holds.get(id(h), 0) + 1
    *_, mass = decided(blocks, [False] * len(blocks), strength)
    own: dict[int, float] = {}
    plain: dict[int, _Node] = {}
    for b, w in zip(blocks, mass, strict=True):
        for h in b[1].hinted:
            own[id(h)] = own.get(id(h), 0) + w
            if h.plain and (articles or h.name != "article"):
                plain[id(h)] = h
    half = mass.sum() / 2
    counts = {k for k, h in plain.items() if own[k] < half or not (h.weak or articles and holds.get(k, 0) == len(articles))}
    out = [any(id(h) in counts for h in b[1].hinted) for b in blocks]
    groups = {h.tokens for b, m in zip(blocks, out, strict=True) if not m for h in b[1].hinted if not h.plain}
    if groups:
        *_, mass = decided(blocks, out, strength)
        share = dict.fromkeys(groups, 0.0)
        for b, w, m in zip(blocks, mass, out, strict=True):
            for t in {h.tokens for h in b[1].hinted if not h.plain} if not m else ():
                share[t] += w
        little = {t for t in groups if share[t] < HINTED_SHARE * mass.sum()}
        out = [m or any(not h.plain and h.tokens in little and id(h) not in holds for h in b[1].hinted) for b, m in zip(blocks, out, strict=True)]
    return out


def extract(page: str | None, strength: float = 0.4) -> str:
    """The article's blocks, joined by newlines; '' for null, empty and textless pages.

    A path is content if its ratio is at least `strength` times the standard deviation over the page's paths (or if it is the best one). Blocks on a content path
    are kept wherever they stand, if the path has punctuation of its own and isn't only lifted by its neighbours. Within the article's region blocks whose path has
    LOW of the threshold are kept too (titles, short lines, lists). The region is all article and main elements with content if these hold half of the content, or else the
    innermost element around it all (the parent, within the body, of one that has text of its own).
    """
    blocks, articles = blocks_of(page or "")
    if not blocks:
        return ""
    sure, maybe, mass = decided(blocks, marked(blocks, articles, strength), strength)
    weight: dict[int, float] = {}
    outer: dict[int, _Node | None] = {}  # the outermost article or main element around a block's element

    def article_of(x: _Node) -> _Node | None:
        if id(x) not in outer:
            found, up = None, x
            while up:
                found = up if up.name in _CONTENT and not up.plain else found
                up = up.parent
            outer[id(x)] = found
        return outer[id(x)]

    common: list[_Node] | None = None  # from the root to the innermost element that holds all content
    for (_, node, *_), w in zip(blocks, mass, strict=True):
        if not w:
            continue
        if x := article_of(node):
            weight[id(x)] = weight.get(id(x), 0) + w
        if common is None:
            common, up = [], node
            while up:
                common.append(up)
                up = up.parent
            common.reverse()
        else:
            above, up = set(), node
            while up:
                above.add(id(up))
                up = up.parent
            while len(common) > 1 and id(common[-1]) not in above:
                common.pop()
    in_articles = 2 * sum(weight.values()) >= mass.sum() and bool(weight)
    while common and common[-1].name in _PARTS:
        common.pop()
    if common and len(common) > 1 and common[-2].name not in ("", "html", "body") and any(b[1] is common[-1] for b, w in zip(blocks, mass, strict=True) if w):
        common.pop()  # one block of text, such as a div: what stands beside it
    best = common[-1] if common else None

    def within(x: _Node | None) -> bool:
        if in_articles:
            return (found := article_of(x)) is not None and id(found) in weight
        while x:
            if x is best:
                return True
            x = x.parent
        return best is None

    return "\n".join(b[0] for b, yes, may in zip(blocks, sure, maybe, strict=True) if yes or may and within(b[1]))


def media_sequence(page: str) -> list[tuple[str, str | None, str | None, str | None]]:
    """(kind, text, src, caption) of a page's text blocks and images, in page order; furniture counts too. A figure's caption goes to its images."""
    out: list[list] = []
    parts: list[str] = []
    figures: dict[int, list[int]] = {}

    def flush(node) -> None:
        text = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            out.append(["text", text, None, None])

    def figure(node):
        while node and node.name != "figure":
            node = node.parent
        return node

    captions: dict[int, str] = {}
    alive = []
    for kind, node, text in parsed(page):
        if kind == "break":
            flush(node)
        elif kind == "text":
            if _inside(node, {"figcaption"}) and (f := figure(node)):
                alive.append(f)
                captions[id(f)] = captions.get(id(f), "") + entities.unescape(text)
            else:
                parts.append(entities.unescape(text))
        elif kind == "media":
            flush(node)
            a = _attributes(text)
            out.append(["media", None, a.get("src") or None, a.get("alt") or None])
            if f := figure(node):
                alive.append(f)
                figures.setdefault(id(f), []).append(len(out) - 1)
    flush(None)
    for key, rows in figures.items():
        if caption := _SPACE.sub(" ", captions.get(key, "")).strip():
            for r in rows:
                out[r][3] = caption
    return [tuple(x) for x in out]


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars: one row for each row, null html gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(v.as_py()) for v in b["html"]]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return in_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), run, "page_id long, url string, text string, n_chars long")
