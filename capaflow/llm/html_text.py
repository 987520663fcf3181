"""Main-text extraction by line-block distribution.

1. Markup is stripped into *lines*: the text of one block element each, white
   space inside it made one space, character references decoded. Elements that
   never hold article text (scripts, styles, forms, menus, page headers and
   footers, side bars, adverts, notices, comments: by tag, role or the words of their class
   and id) leave a gap of empty lines as wide as the window instead.
2. The text length of each sliding window of ``window`` lines is the sum of its lines'
   lengths outside links. A *surge* is a line from which the windows are filled
   up to ``surge`` characters or more; a *dive* is where a window becomes
   empty. Between them all lines are kept, short ones too.
   If no window reaches ``surge``, the fullest stretch is kept: a short article.
3. What the article is cut into by removed elements belongs together: of the other
   stretches, lines are kept that lie in a *box* (a block that is not itself a paragraph, list,
   heading or section) whose own lines in the stretches kept make ``surge`` characters, or anywhere
   inside it unless it is the page. A block of one line counts as a line of the box around it.
   An ``h1`` also counts in any box around. Headings right before a stretch are of it, even as links.
4. Lines inside an ``article`` or ``main`` element, if there is one with text, are the only ones
   looked at; surge and dive decide among them too. Lines directly in the element are its own, and fewer than
   ``window`` lines of links next to a stretch, in its box, are no list of links. An article of links only is kept whole.
   If class names and ids leave nothing at all, they are disregarded.

Blocks are joined by one newline in page order. Defined results: null and
empty pages give the empty text; an element left open ends with its parent
or the page, a paragraph with the next block; a reference cut off at the end stays as it is.
A page of any length is processed whole; extra columns are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capaflow.llm.common import in_batches, kept_beside

WINDOW = 3
SURGE = 80

# Element names of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
          "sup", "time", "tt", "u", "var", "wbr", "picture", "source"}
CLOSES_PARAGRAPH = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure",
                    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre",
                    "section", "table", "ul"}
NEVER_TEXT = {"head", "nav", "aside", "footer", "form", "button", "select", "option", "svg", "canvas", "object", "audio", "video",
              "dialog", "menu", "map", "applet", "frameset", "math"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar",
         "form", "toolbar", "tablist", "tooltip", "status"}
# Words of class names and ids that mark what is not the article.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adslot", "banner", "banners",
         "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright",
         "disqus", "footer", "gdpr", "header", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter",
         "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related",
         "replies", "reply", "respond", "reviews", "search", "share", "sharing", "sidebar", "signup", "sitenav", "social",
         "sponsor", "sponsored", "subscribe", "subscription", "tags", "toolbar", "topbar", "widget", "widgets"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Blocks whose lines belong to the box around them.
LINES = CLOSES_PARAGRAPH - {"article", "aside", "div", "main", "nav"} | INLINE | {"html", "body", "li", "dd", "dt", "hgroup", "caption",
                                                                                  "summary", "tbody", "thead", "tfoot", "tr"}
STATE = {"has", "with", "no", "without", "is", "js"}
OWN = {"article", "entry", "post", "story", "content"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _attributes(text: str) -> dict[str, str]:
    if not text or "=" not in text:
        return {k.lower(): "" for k in text.split()} if text else {}
    out = {}
    for k, v in _ATTRIBUTE.findall(text):
        out.setdefault(k.lower(), html.unescape(v.strip("\"'")))
    return out


def _marked(named: str) -> set[str]:
    """Mark words of a class or id; names such as has-sidebar say something of the page, entry-header is the article's own."""
    found: set[str] = set()
    for name in named.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words or words[0] in STATE:
            continue
        own = {"header"} if OWN & {*words} else set()
        found |= MARKS & {*words} - own
    return found


def _apart(tag: str, attributes: dict[str, str], in_article: bool, by_name: bool) -> bool:
    """Whether an element holds something other than article text."""
    if tag in NEVER_TEXT or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main"):
        return False
    if not attributes:
        return False
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    found = _marked(f"{attributes.get('class', '')} {attributes.get('id', '')}") if by_name else set()
    return bool(found) and not (tag == "article" and not found & {"comment", "comments", "reply", "ad", "advert", "promo"})


class Line(NamedTuple):
    text: str
    plain: int       # length outside links
    inside: bool     # an article or main element
    box: int         # place in the boxes
    level: int       # of the heading it is in, or 0


class Box(NamedTuple):
    around: int      # the box it lies in; the page is box 0, in itself
    article: bool


GAP = Line("", 0, False, 0, 0)


def lines(page: str, by_name: bool = True) -> tuple[list[Line], list[Box]]:
    """Every line, and the boxes they lie in, outer ones first; gaps are WINDOW empty lines."""
    out: list[Line] = []
    boxes = [Box(0, False)]
    stack: list[tuple[str, bool, bool, bool, int, int]] = []  # tag, apart, article, link, box, heading level
    # places in the stack of each open tag, of elements that are no inline ones, and of those that </p> and the like do not
    # cross: whether an end tag closes something is known without a walk down the stack
    places: dict[str, list[int]] = {}
    blocks: list[int] = []
    walls: list[int] = []
    held: list[str] = []
    plain = [0]
    apart = articles = links = 0

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close_line() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            box, level = stack[-1][4:] if stack else (0, 0)
            out.append(Line(text, plain[0], articles > 0, box, level))
        plain[0] = 0

    def add(text: str) -> None:
        if apart or not text:
            return
        held.append(text)
        if not links or stack[-1][5] == 1:  # titles are often links to their own page
            plain[0] += len("".join(text.split()))

    def pop(to: int) -> None:
        nonlocal apart, articles, links
        while len(stack) > to:
            was, was_apart, was_article, was_link, *_ = stack.pop()
            places[was].pop()
            for list_ in (blocks, walls):
                if list_ and list_[-1] == len(stack):
                    list_.pop()
            apart -= was_apart
            articles -= was_article
            links -= was_link

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            close_line()
        if m[1]:
            k = last(tag)
            inner = blocks[-1] if tag in INLINE and blocks else walls[-1] if tag in ("p", "li") and walls else -1
            if k >= 0 and k >= inner:   # an inline end tag does not close blocks
                pop(k)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in CLOSES_PARAGRAPH and blocks and stack[blocks[-1]][0] == "p":
            pop(blocks[-1])
        if tag == "li" and (k := last("li")) > last("ul", "ol", "menu"):
            pop(k)
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        attributes = _attributes(m[3])
        is_apart = _apart(tag, attributes, articles > 0, by_name)
        if is_apart and not apart:
            close_line()
            out += [GAP] * WINDOW
        is_article = tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")
        box, level = stack[-1][4:] if stack else (0, 0)
        if not apart and not is_apart and (is_article or tag not in LINES):
            boxes.append(Box(box, is_article))
            box, level = len(boxes) - 1, 0
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        if tag in ("article", "main", "body", "td"):
            walls.append(len(stack))
        stack.append((tag, is_apart, is_article and not is_apart, tag == "a", box, int(tag[1]) if tag in HEADINGS else level))
        apart += is_apart
        articles += is_article and not is_apart
        links += tag == "a"
    close_line()
    return out, boxes


def stretches(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Surge and dive points: (first line, last line exclusive) of the stretches to keep."""
    n = len(lengths)
    sums = [sum(lengths[k:k + window]) for k in range(n)]
    found, k = [], 0
    while k < n:
        if not sums[k] or not lengths[k]:
            k += 1
            continue
        end = k
        while end < n and sums[end]:  # the dive: a whole window without text
            end += 1
        found.append((k, end, max(sums[k:end])))
        k = end
    full = [(a, b) for a, b, top in found if top >= surge]
    if full or not found:
        return full
    best = max(found, key=lambda f: (sum(lengths[f[0]:f[1]]), -f[0]))
    return [best[:2]]


def _belongs(found: list[Line], boxes: list[Box], kept: list[tuple[int, int]], surge: int) -> list[bool]:
    """Per line, whether its box makes it a part of the article that the stretches kept are of."""
    held = Counter(x.box for x in found if x.text)
    outer = {b.around for b in boxes[1:]}
    # the box that a line counts in: the one around, if it has its own to itself
    alone = [held[k] == 1 and k not in outer and not b.article for k, b in enumerate(boxes)]
    home = [boxes[x.box].around if alone[x.box] else x.box for x in found]
    own, paragraphs = Counter(), Counter()
    for a, b in kept:
        for k in range(a, b):
            own[found[k].box] += found[k].plain
            paragraphs[home[k]] += found[k].box != home[k] and found[k].plain >= surge
    if kept and max(own.values()) < surge:  # of a short article, the fullest box
        full = {max(own, key=lambda k: (own[k], -k))}
    else:
        full = {k for k, n in own.items() if n >= surge} | {k for k, n in paragraphs.items() if n > 1}
    within, around = [False] * len(boxes), [False] * len(boxes)
    for k, box in enumerate(boxes):
        within[k] = k > 0 and (k in full or within[box.around])
    for k in range(len(boxes) - 1, -1, -1):
        around[k] |= k in full
        around[boxes[k].around] |= around[k]
    return [within[h] or h == 0 and 0 in full or boxes[h].article or x.level == 1 and around[x.box] for x, h in zip(found, home)]


def _ends(found: list[Line], a: int, b: int, few: int) -> tuple[int, int]:
    """A stretch with the headings before it, and with at most ``few`` lines of links at either end, of the same box."""
    def link(k: int, edge: int) -> bool:
        return 0 <= k < len(found) and found[k].text != "" and not found[k].plain and found[k].box == found[edge].box

    lo, hi = a, b
    while link(lo - 1, a):
        lo -= 1
    while link(hi, b - 1):
        hi += 1
    if a - lo > few:
        lo = a
        while link(lo - 1, a) and found[lo - 1].level:
            lo -= 1
    return lo, (hi if hi - b <= few else b)


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's text of a page, its blocks joined by newlines."""
    if not page:
        return ""
    found, boxes = lines(page)
    if not any(x.text for x in found):  # a name too many: go by elements and roles only
        found, boxes = lines(page, by_name=False)
    inside = any(x.inside and x.text for x in found)
    if inside:
        found = [x if x.inside else GAP for x in found]
        if not any(x.plain for x in found):
            found = [x._replace(plain=len(x.text)) for x in found]
    lengths = [x.plain for x in found]
    kept = stretches(lengths, window, surge)
    belongs = _belongs(found, boxes, kept, surge)
    full = {a for a, _ in kept}
    every = stretches(lengths, window, 1)
    ends = [_ends(found, a, b, window - 1 if inside else 0) for a, b in every]
    take = sorted({k for (a, _), (lo, hi) in zip(every, ends) for k in range(lo, hi) if found[k].text and (a in full or belongs[k])})
    return "\n".join(found[k].text for k in take)


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row the kept columns, text and n_chars."""
    keep = kept_beside(keep, ("text", "n_chars"))
    rows = pages.select(F.col(f"`{html_column}`").cast("string").alias("_html"), *[F.col(f"`{c}`") for c in keep])
    fields = [f"`{c}` {t}" for c, t in rows.dtypes[1:]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(v.as_py()) for v in part.column(0)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*keep, "text", "n_chars"])

    return in_batches(rows, work, ", ".join([*fields, "text string, n_chars long"]))
