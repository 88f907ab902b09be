"""Main text of web pages from parser events, text-to-tag ratios and smoothing.

The standard library's parser streams over the page. Each block of text is one line of
the page; its ratio is its characters over the tags met since the block before. A Gaussian
smooths the ratios along the page, and a threshold clusters them into content and the rest.

Elements that are page furniture by what they are (menus, footers, sidebars, by tag or role) never count. Forms and those
whose whole name (a class or id) is that of some are furniture unless they hold nearly all content. A name that
only has such a word in it is a weak vote that the ratio overrules: they are furniture where most of their text
is thin. What is left is smoothed and clustered again, and the clusters select the content region: the
innermost element around them, or the articles around them, if several hold as much. All lines of that region but
furniture are the main text, so short paragraphs between long ones stay.

The parser gets a page up to the first tag or comment that never ends, which is what such a page has for a browser
as well; the search for that looks at each byte once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Elements by what they are.
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "canvas", "select", "option", "textarea", "button"}
FURNITURE = {"nav", "footer", "aside", "menu", "dialog", "header"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
MAIN = {"article", "main"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
_PARTS = r"(?:^|[\s_-])(?:{})(?:$|[\s_-])"
# Words in class and id. Names that are one of WHOLE, or an advert's, count wherever they stand. Those with one of
# AMBIGUOUS say something of their own block only, those with one of NAMED too, but strike out thin text outside articles as well.
WHOLE = {"sidebar", "side-bar", "footer", "site-footer", "page-footer", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "newsletter", "subscribe", "popup", "modal", "consent", "cookie-banner", "cookie-notice", "cookie-consent"}
ADVERTS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*)(?:$|[\s_-])", re.I)
AMBIGUOUS = re.compile(_PARTS.format(r"related|recommend\w*|notice\w*|share|sharing|social|widget\w*|promo\w*|banner"), re.I)
NAMED = re.compile(_PARTS.format(r"nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side-bar|footer|cookie\w*|consent|newsletter|subscribe|popup|modal|pagination|pager"), re.I)
#: Heads of pages, outside articles; not those of what is on the page.
HEADS, TITLES = re.compile(_PARTS.format(r"header|masthead"), re.I), re.compile(_PARTS.format(r"(?:page|entry|post|article|story|content|section|title)-header"), re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
COMMENTS = re.compile(_PARTS.format(r"comment\w*|disqus\w*|respond|replies"), re.I)
PLAIN, BY_SIGHT, BY_VOTE, BY_NAME, BY_COMMENTS, ALWAYS = range(6)
#: Share of the content that a named element holds if it is a frame around the page; of an element's text that makes it
#: thick; of the largest article's content that another one has beside it.
FRAME, THICK, BESIDE = 0.9, 0.5, 0.5

SIGMA, RADIUS = 1.0, 3
KERNEL = [math.exp(-(k**2) / (2 * SIGMA**2)) for k in range(-RADIUS, RADIUS + 1)]


class _Lines(HTMLParser):
    """Elements (parent, name, kind of furniture, whether in an article) and lines [text, tags, element].
    An element's number is larger than its parent's; 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.names, self.kinds, self.in_main, self.hidden = [0], [""], [PLAIN], [False], [False]
        self.stack = [0]
        self.open: Counter[str] = Counter()
        self.lines: list[tuple[str, int, int]] = []
        self.text: list[str] = []
        self.tags = 1

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.lines.append((text, self.tags, self.stack[-1]))
            self.tags = 1

    def _kind(self, tag: str, get, inside: bool) -> int:
        if tag in MAIN or tag in ("body", "html"):
            return PLAIN
        if (tag in FURNITURE and not (tag == "header" and inside)) or (get("role") or "").lower() in FURNITURE_ROLES:
            return ALWAYS
        names = f"{get('class') or ''} {get('id') or ''}"
        if COMMENTS.search(names):
            return BY_COMMENTS
        if tag in HEADINGS and not ADVERTS.search(names):
            return PLAIN
        if tag == "form" or ADVERTS.search(names) or not WHOLE.isdisjoint(names.lower().split()):
            return BY_NAME
        if not inside and HEADS.search(names) and not TITLES.search(names):
            return BY_NAME
        return BY_VOTE if NAMED.search(names) else BY_SIGHT if AMBIGUOUS.search(names) else PLAIN

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag not in INLINE:
                self._flush()
            elif tag == "br":
                self.text.append(" ")
            return
        if tag in INLINE:
            return
        self._flush()
        if tag in CLOSES_P and self.open["p"]:
            self._pop("p")
        elif tag in ("li", "tr", "td", "th", "dt", "dd", "option") and self.names[self.stack[-1]] == tag:
            self._pop(tag)
        up, given = self.stack[-1], dict(attrs)
        self.parent.append(up)
        self.names.append(tag)
        self.kinds.append(self._kind(tag, given.get, self.in_main[up]))
        self.in_main.append(self.in_main[up] or tag in MAIN)
        self.hidden.append(self.hidden[up] or tag in HIDDEN or "hidden" in given)
        self.stack.append(len(self.names) - 1)
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _pop(self, tag: str) -> None:
        while len(self.stack) > 1:
            name = self.names[self.stack.pop()]
            self.open[name] -= 1
            if name == tag:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in INLINE or tag in VOID:
            return
        self._flush()
        if self.open[tag]:
            self._pop(tag)

    def handle_data(self, data):
        if not self.hidden[self.stack[-1]]:
            self.text.append(data)

    def close(self):
        super().close()
        self._flush()

    def sums(self, values) -> list[int]:
        """Of each element the sum of (element, value) pairs in it and below."""
        out = [0] * len(self.names)
        for element, value in values:
            out[element] += value
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out


def _content(ratios: list[float]) -> tuple[list[int], float]:
    """Numbers of the lines whose smoothed ratio is in the upper cluster, and where that begins."""
    if not any(ratios):
        return [], 0.0
    smooth = []
    for i in range(len(ratios)):
        reach = [(KERNEL[k + RADIUS], ratios[i + k]) for k in range(-RADIUS, RADIUS + 1) if 0 <= i + k < len(ratios)]
        smooth.append(sum(w * r for w, r in reach) / sum(w for w, _ in reach))
    mean = sum(smooth) / len(smooth)
    spread = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    # Low enough that text next to furniture still counts, high enough to leave link lists out.
    threshold = min(0.75 * mean, max(mean - spread, 0.1 * max(smooth)))
    return [i for i, x in enumerate(smooth) if x >= threshold * (1 - 1e-9) and ratios[i] > 0], threshold


def _furniture(page: _Lines) -> list[bool]:
    """Which elements are furniture, or in some."""
    always = [False] * len(page.names)
    for e in range(1, len(always)):
        always[e] = always[page.parent[e]] or page.kinds[e] == ALWAYS
    lines = page.lines
    ratios = [0.0 if always[e] else len(t) / n for t, n, e in lines]
    chosen, threshold = _content(ratios)
    weight = page.sums((lines[i][2], len(lines[i][0])) for i in chosen)
    main = page.sums((lines[i][2], len(lines[i][0])) for i in chosen if page.in_main[lines[i][2]])
    size = page.sums((e, len(t)) for t, _, e in lines)
    thick = page.sums((lines[i][2], len(lines[i][0])) for i in chosen if ratios[i] >= threshold)  # by themselves, not for their neighbours
    out = always
    for e in range(1, len(out)):
        kind, frame = page.kinds[e], weight[e] >= FRAME * weight[0] > 0 and main[e] == main[0]
        if out[page.parent[e]] or kind == ALWAYS:
            out[e] = True
        elif kind == BY_COMMENTS:
            out[e] = weight[e] < weight[0] or not weight[0]
        elif kind == BY_VOTE:
            out[e] = not frame and thick[e] < THICK * size[e]
        elif kind == BY_NAME or (kind == BY_SIGHT and not page.in_main[e]):
            out[e] = not frame
        elif kind == BY_SIGHT:
            out[e] = not thick[e]
    return out


_OPENS = re.compile(r"<(?:!--|[a-zA-Z/!?])")


def _ended(html: str) -> str:
    """The page up to the first tag or comment that never ends."""
    last_tag, last_comment = html.rfind(">"), html.rfind("-->")
    at = 0
    while (m := _OPENS.search(html, at)) is not None:
        comment = m[0] == "<!--"
        if m.start() > (last_comment if comment else last_tag):
            return html[: m.start()]
        at = html.find("-->" if comment else ">", m.start()) + 1
    return html


def main_text(html: str | None) -> str:
    page = _Lines()
    page.feed(_ended(html or ""))
    page.close()
    furniture, lines = _furniture(page), page.lines
    ratios = [0.0 if furniture[e] else len(t) / n for t, n, e in lines]
    chosen = _content(ratios)[0]
    if not chosen:
        return ""
    weight = page.sums((lines[i][2], len(lines[i][0])) for i in chosen)
    main = [e for e, w in enumerate(weight) if w and page.names[e] in MAIN and 2 * w >= weight[0]]
    region = max(main, key=lambda e: (weight[e], -e)) if main else max(e for e, w in enumerate(weight) if w == weight[0])
    around = {region}
    while (up := page.parent[min(around)]) not in around:
        around.add(up)
    inside = [e == region or (bool(main) and e not in around and page.names[e] in MAIN and weight[e] >= BESIDE * weight[region]) for e in range(len(weight))]
    for e in range(1, len(inside)):
        inside[e] = inside[e] or inside[page.parent[e]]
    # With no element of its own around it, content lies between its first line and its last.
    part = range(len(lines)) if region else range(chosen[0], chosen[-1] + 1)
    return "\n".join(lines[i][0] for i in part if ratios[i] > 0 and inside[lines[i][2]])


def _extract(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h) for h in b.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: page_id, url, text (blocks joined by one newline).

    A null or empty page, and one of furniture alone, has an empty text. Null ids and
    urls stay null, repeated rows stay, other columns are not looked at. Pages are
    independent of each other, so there is no shuffle."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
ORACLE_SQL: dict[str, str] = {}
