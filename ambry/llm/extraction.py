"""The main text of web pages, by the distribution of text over line blocks.

Markup is stripped first: block elements end a line, and lines in parts of a
page that are never its text (menus, scripts, notices, ...) count as empty.
The lengths of the remaining lines are summed over a sliding window. The text
starts where the sum surges and ends where it dives to nothing; between them
every line is kept. This curve decides on every page. Tags weigh its lines:
where a page marks articles, lines outside them weigh nothing, a surge is any
text, and all stretches count. Elsewhere lines that are mostly links weigh nothing, and
of the stretches, joined where only such lines part them, the one with most text is the text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ambry.llm.batches import map_columns

WINDOW = 3
#: characters in a window from which on it is text, where a page marks no article
SURGE = 80

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

#: fixed values: elements whose content is not text of the page, and ends only with their end tag
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "xmp"}
#: fixed values: elements that hold other things than an article's text
APART = {
    "nav", "footer", "aside", "form", "head", "menu", "dialog", "select", "button", "fieldset", "audio", "video",
    "map", "datalist",
}
#: fixed values: elements that begin and end a block
BLOCKS = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "dir", "div", "dl", "dt", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
} | APART
#: fixed values: elements without an end tag
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
#: fixed values: words in class, id and role that mark other parts of a page
MARKS = {
    "ad", "ads", "adv", "advert", "advertisement", "adverts", "advertising", "banner", "banners", "sponsor", "sponsored",
    "sponsors", "promo", "promos", "promotion", "sidebar", "sidebars", "aside", "nav", "navbar", "navigation", "menu", "menus",
    "breadcrumb", "breadcrumbs", "footer", "foot", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "alert", "popup", "modal", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments", "commentlist",
    "disqus", "reply", "replies", "respond", "share", "sharing", "social", "related", "recommended", "widget", "widgets",
    "pagination", "pager", "skip", "toolbar", "copyright", "disclaimer", "contentinfo", "search", "complementary",
}
#: fixed values: those that may as well name what a part of an article is about, and words that show they do not
WEAK = {"search", "related", "top", "skip", "notice", "notices", "alert", "reply", "share", "copyright", "disclaimer", "menu", "foot"}
PART = {"box", "bar", "block", "form", "links", "link", "posts", "articles", "stories", "list", "section", "button", "buttons", "icons", "wrapper"}
#: fixed values: words in class, id and role that mark the top of a page, but also that of an article
TOP = {"header", "topbar", "top"}
CONTENT = {"article", "content", "entry", "post", "story", "headline", "title"}
#: fixed values: elements and marks of the part that holds the article
MAIN = {"article", "main"}

_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}


@dataclass
class Line:
    text: str
    #: characters outside links
    plain: int
    #: whether it lies in a part that is never text
    apart: bool
    #: whether it lies in an article
    article: bool
    heading: bool


def _marked(attributes: str, in_article: bool) -> bool:
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = next((v for v in values if v), "")
        if name in ("class", "id", "role"):
            said = set(re.split(r"[^a-z0-9]+", _hyphened(value)))
            marks = MARKS & said
            if in_article and marks and marks <= WEAK and len(marks) == 1 and not said - marks & PART:
                continue
            if marks or (TOP & said and not CONTENT & said and not in_article):
                return True
        if name == "aria-hidden" and value.lower() == "true":
            return True
    # the attribute of that name, not a word in a value
    return bool(re.search(r"(?:^|\s)hidden(?=[\s=/]|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)))


def _hyphened(value: str) -> str:
    """Small letters, with a hyphen where a capital follows a small one."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()


def lines(page: str) -> list[Line]:
    """The lines of a page's body, in order; empty ones stand for parts that were skipped."""
    out: list[Line] = []
    pieces: list[str] = []
    plain: list[str] = []
    #: open elements: (name, whether it is apart, whether it is an article)
    open_elements: list[tuple[str, bool, bool]] = []
    apart = links = articles = 0

    def end_line() -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        if text and apart:
            if not (out and out[-1].apart):  # one line stands for all of a part
                out.append(Line("", 0, True, articles > 0, False))
        elif text:
            outside = " ".join(html.unescape("".join(plain)).split())
            heading = any(re.fullmatch(r"h[1-6]", e[0]) for e in open_elements)
            out.append(Line(text, len(outside), False, articles > 0, heading))
        pieces.clear()
        plain.clear()

    def add(text: str) -> None:
        pieces.append(text)
        if not links:
            plain.append(text)

    def leave(depth: int) -> None:
        nonlocal apart, links, articles
        while len(open_elements) > depth:
            name, was_apart, was_article = open_elements.pop()
            apart -= was_apart
            links -= name == "a"
            articles -= was_article

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            if name in BLOCKS or name in APART:
                end_line()
            # an end tag closes the nearest element of its name, inline ones only inside their block
            for k in range(len(open_elements) - 1, -1, -1):
                if open_elements[k][0] == name:
                    leave(k)
                    break
                if name not in BLOCKS and open_elements[k][0] in BLOCKS:
                    break
            continue
        if name in RAW:
            # past the end tag; without one nothing more is shown
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            if not m["attributes"].rstrip().endswith("/"):
                at = end.end() if end else len(page)
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            end_line()
            if any(e[0] == "p" for e in open_elements[-3:]) and name != "p" or name == "p":
                # a block ends an open paragraph, and with it what was left open inside
                for k in range(len(open_elements) - 1, -1, -1):
                    if open_elements[k][0] == "p":
                        leave(k)
                        break
                    if open_elements[k][0] in BLOCKS:
                        break
            if name in _CLOSED_BY:
                for k in range(len(open_elements) - 1, -1, -1):
                    if open_elements[k][0] in _CLOSED_BY[name]:
                        leave(k)
                        break
                    if open_elements[k][0] in ("ul", "ol", "dl", "table", "select"):
                        break
        if name in VOID or m["attributes"].rstrip().endswith("/"):
            if name == "hr":
                end_line()
            continue
        is_article = name in MAIN or 'role="main"' in m["attributes"]
        # a header belongs to an article where one is open, else to the page
        is_apart = name in APART or (name == "header" and not articles) or (
            name not in ("html", "body") and not is_article and _marked(m["attributes"], articles > 0)
        )
        open_elements.append((name, is_apart, is_article))
        if is_apart:
            if not apart:
                end_line()
            apart += 1
        links += name == "a"
        articles += is_article
    end_line()
    return out


def stretches(sums: list[int], surge: int) -> list[tuple[int, int]]:
    """From each surge of the window sums to the dive after it: half-open ranges of lines."""
    out = []
    begun = None
    for i, size in enumerate(sums):
        if begun is None and size >= surge:
            begun = i
        elif begun is not None and size == 0:
            out.append((begun, i))
            begun = None
    if begun is not None:
        out.append((begun, len(sums)))
    return out


def window_sums(weights: list[int], window: int) -> list[int]:
    """The weight of each line and the ``window - 1`` after it: a surge is seen where the text begins."""
    total, sums = 0, []
    for i in range(len(weights) - 1, -1, -1):
        total += weights[i] - (weights[i + window] if i + window < len(weights) else 0)
        sums.append(total)
    return sums[::-1]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The page's text, a block to a line; empty for null, for no markup with text, and for boilerplate alone.

    On pages with articles all of them are text, side by side or apart. Of
    equally long stretches elsewhere the first is.
    """
    found = lines(page or "")
    if any(x.article and x.text for x in found):
        weights = [len(x.text) if x.article else 0 for x in found]
        inside = stretches(window_sums(weights, window), 1)
        return "\n".join(found[i].text for begin, end in inside for i in range(begin, end) if weights[i])
    # lines that are mostly links are menus
    weights = [x.plain if 2 * x.plain >= len(x.text) else 0 for x in found]
    ahead = window_sums(weights, window)
    surge = min(surge, max([1, *ahead]))
    joined: list[tuple[int, int]] = []
    for begin, end in stretches(ahead, surge):
        # links that stand between two parts of a text belong to it, unless a skipped part is there too
        if joined and not any(x.apart for x in found[joined[-1][1]:begin]):
            begin = joined.pop()[0]
        joined.append((begin, end))
    begin, end = max(joined, key=lambda s: sum(weights[s[0]:s[1]]), default=(0, 0))
    # a short line that a skipped part cuts off from the text is no text, unless it is a heading
    while begin < end and _stray(found, weights, range(begin, end), surge):
        begin += 1
    while begin < end and _stray(found, weights, range(end - 1, begin - 1, -1), surge):
        end -= 1
    return "\n".join(x.text for x in found[begin:end] if x.text)


def _stray(found: list[Line], weights: list[int], order: range, surge: int) -> bool:
    """Whether the first line of a stretch, or the last, read inwards, is empty or cut off and short."""
    first = order[0]
    if not weights[first]:
        return True
    size = 0
    for i in order:
        if found[i].apart:
            return size < surge < sum(weights[k] for k in order)
        size += weights[i]
        if found[i].heading or size >= surge:
            return False
    return False


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Null and empty pages have the empty text. Pages are read one by one, so
    repeated rows repeat their answer; other columns are dropped.
    """

    def make():
        def apply(ids, urls, bodies):
            texts = [main_text(b) for b in bodies]
            return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

        return apply

    return map_columns(
        pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long", text="html"
    )
