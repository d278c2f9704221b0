"""Operator 5, main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. A line counts its characters outside links. Lines of elements that say what they are
not (menus, page headers and footers, sidebars, notices, adverts, forms, comments) are left out, and the lines around them
join; where article or main hold the larger part of the text, only their lines count. The sums over windows of WINDOW lines rise (surge) where text begins and fall to
nothing (dive) where it ends; the lines between are kept, in page order. Where nothing surges, the heaviest run that is no list is the text.

What an element is not is told by its tag, or by a word of its class, id, role or label: the word itself ("sidebar") is believed, a compound ("ad-box") unless the element
holds more than MOST of the page's text, a state of a wrapper ("has-sidebar", "fixed-header") never. A notice inside an article is a notice.

Null html and pages without text give an empty string. Whole pages are read, however long. Repeated rows and ids stay separate rows;
null ids and urls are kept. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import re

from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table

WINDOW = 3
SURGE = 86
BONUS = 1000
MOST = 0.8
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe|object|select|math)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[|\]\]>", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>")
_ATTR = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
# Names that HTML and common templates give to what is not the article.
_NAMES = (
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|menu\w*|nav\w*|breadcrumbs?|sidebar\w*|side|aside|footer|header|masthead|topbar|toolbar|"
    r"cookies?|consent|gdpr|notice\w*|alert|popup|modal|overlay|comments?|commentlist|disqus\w*|respond|reply|replies|share\w*|sharing|social\w*|related|recommend\w*|"
    r"newsletter|subscri\w*|signup|login|search\w*|form|pagination|pager|widget\w*|copyright|contentinfo|complementary|navigation|skip)"
)
_NOT_TEXT = re.compile(_NAMES, re.I)
_COMPOUND = re.compile(rf"(?:^|[_-]){_NAMES}(?:$|[_-])", re.I)
# First parts of class names that tell a state or a part of a wrapper.
_STATE = re.compile(r"(?:has|have|with|without|no|not|is|fixed|sticky|show|hide|enable|disable|js|page|site|main|entry|post|article|layout|theme|wp)[_-]", re.I)
_SKIP = frozenset("nav footer aside form button dialog menu fieldset audio video canvas map datalist".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BODY = frozenset(("article", "main"))
# Elements whose end tag may be omitted -> start tags that end them; the end tag of a parent ends them too.
_OMIT = {"p": _BLOCK - {"td", "th", "body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}}


def told(attributes: str) -> int:
    """2 if a word of the class, id, role or label names what is not the article, 1 if a compound does, else 0."""
    most = 0
    for a in _ATTR.findall(attributes):
        for word in a.strip("\"'").split():
            if _NOT_TEXT.fullmatch(word):
                return 2
            if not most and not _STATE.match(word) and _COMPOUND.search(word):
                most = 1
    return most


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters that count, in an article, in a list) per line; an empty line stands where something was left out. Elements left out for a
    compound name that hold more than MOST of the text are believed after all."""
    trusted: set[int] = set()
    while True:
        lines, doubtful = _parsed(page, trusted)
        total = sum(x[1] for x in lines) + sum(doubtful.values())
        wrong = {at for at, n in doubtful.items() if n > MOST * total}
        if not wrong:
            return lines
        trusted |= wrong


def _parsed(page: str, trusted: set[int]) -> tuple[list[tuple[str, int, bool, bool]], dict[int, int]]:
    """Lines, and the characters in every element (by its place) that was left out for a compound name."""
    src = _RAW.sub(" ", page)
    out: list[tuple[str, int, bool, bool]] = []
    text: list[str] = []
    linked = links = body = at = items = 0
    skip, depth, inner = "", 0, 0
    doubtful: dict[int, int] = {}
    doubt = -1

    def close():
        nonlocal linked
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if line:
                out.append((line, max(0, len(line) - linked), body > 0, items > 0))
            text.clear()
        linked = 0

    for m in _TAG.finditer(src):
        if not skip and m.start() > at:
            piece = src[at : m.start()]
            text.append(piece)
            if links:
                linked += len(piece)
        elif skip and doubt >= 0:
            doubtful[doubt] += len(src[at : m.start()].strip())
        at = m.end()
        if m[2] is None:
            continue
        name, shut = m[2].lower(), m[1]
        if name in _BODY and skip and not shut:
            skip = ""  # something left out was never closed
        if skip in _OMIT and not inner and (name in _BLOCK and name != skip if shut else name in _OMIT[skip]):
            skip = ""
        if skip in _OMIT:
            if shut and name == skip and not inner:
                skip = ""
            elif name in _BLOCK and name not in _OMIT and name not in _VOID:
                inner = max(0, inner - 1) if shut else inner + 1
            continue
        if skip:
            if name == skip:
                depth += -1 if shut else 1
                if not depth:
                    skip = ""
            continue
        if name == "a":
            links = 0 if shut else 1
        elif name == "br":
            text.append(" ")
        elif name in ("td", "th"):
            text.append(" ")
        if name in _BLOCK and name not in ("td", "th"):
            links = 0
            if name in ("ul", "ol", "menu"):
                close()
                items = max(0, items + (-1 if shut else 1))
            if shut and name in _BODY:
                close()
                body = max(0, body - 1)
            else:
                close()
        if not shut and name not in _VOID:
            attrs, doubt = m[3], -1
            leave = name in _SKIP or name == "header" and not body
            if not leave and attrs and (name not in ("html", "body", "article", "main", "h1") or name == "article" and body):
                leave = name != "article" and bool(_HIDDEN.search(attrs))
                if not leave and (sure := told(attrs)):
                    leave = sure == 2 or m.start() not in trusted
                    if sure == 1 and leave:
                        doubt = m.start()
                        doubtful[doubt] = 0
            if leave:
                if name in _BLOCK:
                    close()
                    out.append(("", 0, False, False))
                skip, depth, inner = name, 1, 0
            elif name in _BODY:
                body += 1
    if not skip and at < len(src):
        text.append(src[at:])
    close()
    return out, doubtful


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between surge and dive points of the line-block distribution."""
    if not page:
        return ""
    lines = lines_of(page)
    if not any(x[0] for x in lines):
        return ""
    inside = sum(n for _, n, b, _ in lines if b)
    marked = inside > 0 and 2 * inside >= sum(x[1] for x in lines)
    weight = [(n + BONUS if b else 0) if marked else n for _, n, b, _ in lines]
    following = lambda i: itertools.islice((j for j in range(i, len(lines)) if lines[j][0]), window)
    spans, begin = [], None  # runs between surge and dive
    for i, (t, _, b, _) in enumerate(lines):
        if not t:  # something left out ends no span
            continue
        gap = marked and not b
        if begin is None and not gap:
            block = 0
            for j in following(i):
                block += weight[j]
            if block > surge:
                begin = i
        elif begin is not None and (gap or not sum(weight[j] for j in following(i))):
            spans.append((begin, i))
            begin = None
    if begin is not None:
        spans.append((begin, len(lines)))
    if not spans:  # nothing surges: the heaviest run outside lists, if it weighs anything
        edges = [-1, *(i for i, x in enumerate(lines) if not x[0] or x[3]), len(lines)]
        best = max(((a + 1, b) for a, b in zip(edges, edges[1:])), key=lambda s: sum(weight[s[0] : s[1]]))
        spans = [best] if sum(weight[best[0] : best[1]]) else []
    return "\n".join(x[0] for a, b in spans for x in lines[a:b] if x[0])


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    def extract(batches):
        for b in batches:
            texts = [main_text(h) for h in b[page]]
            yield {"page_id": b[page_id], "url": b[url], "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(pages.select(page_id, url, page), extract, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
