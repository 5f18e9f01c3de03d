"""HTML extraction: parser events give lines of text with their tags; smoothed text-to-tag ratios choose the content region."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodemap.llm.common import arrow_map, batch, table

#: Elements whose text is never part of an article.
DROPPED = {
    "nav", "footer", "aside", "script", "style", "noscript", "template", "head", "title", "svg", "iframe", "button", "select", "option",
    "textarea", "label", "dialog", "menu", "object", "canvas", "audio", "video", "map", "datalist", "legend", "search",
}
#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that end a line of text.
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
    "tr", "ul", "br", "form", "fieldset",
} | DROPPED
#: Elements that may enclose an article.
CONTAINERS = {"article", "main", "section", "div", "body", "html", "td", "center"}
#: An open paragraph ends where one of these begins.
_ENDS_P = BLOCKS - {"br", "label", "button", "select", "option", "textarea", "map", "object", "canvas", "audio", "video", "svg", "iframe", "script", "style"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What may stand in a head; all else, and text, begins the body, also where the head has no end tag.
_IN_HEAD = {"html", "head", "title", "base", "basefont", "bgsound", "link", "meta", "style", "script", "noscript", "noframes", "template"}
#: Elements of a head whose contents don't end it.
_HEAD_HOLDS = {"title", "style", "script", "noscript", "noframes", "template"}
#: Elements whose text is boilerplate unless they hold the article.
SUSPECT = {"form", "fieldset"}
#: Words of a class, id or role that mark boilerplate.
BOILERPLATE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie",
    "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "alertdialog", "popup", "modal", "overlay", "sidebar", "aside", "side",
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "header", "masthead", "topbar",
    "toolbar", "comment", "comments", "disqus", "respond", "replies", "reply", "related", "recommended", "recommendations", "share", "sharing", "social",
    "subscribe", "subscription", "newsletter", "signup", "login", "search", "form", "widget", "widgets", "toc", "contentinfo", "complementary",
    "skip", "disclaimer",
}
#: Words that say where or of what kind such an element is. Any other word beside a mark makes it doubtful ("has-sidebar", "market-share").
PLACES = {
    "site", "page", "main", "left", "right", "top", "bottom", "container", "wrapper", "wrap", "box", "list", "section", "area", "block", "inner", "outer", "bar",
    "link", "links", "item", "items", "global", "primary", "secondary", "user", "users", "reader", "readers", "title", "row", "text", "message", "policy", "unit", "slot",
    "panel", "module", "group", "buttons", "button", "icons", "media", "posts", "articles", "stories", "thread", "legal", "to", "us", "you", "also", "content",
}
_WORD = re.compile(r"[a-z]+")
#: A tag that the page's end cuts off: no text.
_CUT_TAG = re.compile(r"<[/!?]?[A-Za-z][^>]*\Z")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(
        name == "hidden" or (name == "aria-hidden" and (value or "").lower() == "true") or (name == "style" and value and _HIDDEN.search(value.lower()))
        for name, value in attrs
    )


def _mark(attrs: list[tuple[str, str | None]]) -> int:
    """2 for an element that names boilerplate, 1 where the name has other words beside it, else 0."""
    mark = 0
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for token in value.lower().split():
                words = _WORD.findall(token)
                if not BOILERPLATE.isdisjoint(words):
                    mark = max(mark, 2 if all(w in BOILERPLATE or w in PLACES for w in words) else 1)
    return mark


class Lines(HTMLParser):
    """Streams parser events into lines: (text, tags met in it, number of the innermost open container, of the innermost open
    suspect; -1 outside)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.open: list[tuple[str, bool, bool]] = []  # (tag, begins dropped content, is a suspect)
        self.count: Counter[str] = Counter()  # open elements by tag
        self.dropped = 0
        self.containers: list[int] = []  # numbers of the open ones
        self.kinds: list[tuple[str, int]] = []  # of each container: tag, number of the one around it
        self.suspects: list[int] = []  # numbers of the open ones
        self.marks: list[tuple[int, int, bool]] = []  # of each suspect: mark, number of the one around it, whether within an article or main
        self.words: list[str] = []
        self.tags = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.words).split()) if self.words else ""
        if text:
            self.lines.append((text, self.tags, self.containers[-1] if self.containers else -1, self.suspects[-1] if self.suspects else -1))
            self.tags = 0
        self.words = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if self.count["head"] and tag not in _IN_HEAD:
            self._close("head", inside={"template"} if tag == "body" else _HEAD_HOLDS)
        if tag in VOID:
            return
        if tag in _ENDS_P and self.count["p"]:
            self._close("p", inside=CONTAINERS)
        for other in _SAME.get(tag, ()):
            self._close(other, inside={"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "tr"} - {other} if tag != "tr" else {"table", "tbody", "thead", "tfoot"})
        drops = tag in DROPPED or _hidden(attrs) and tag not in ("html", "body", "article", "main")
        named = bool(self.count["article"] or self.count["main"])
        if tag == "header" and not named:
            drops = True
        mark = 0 if tag in ("html", "body", "article", "main") else 2 if tag in SUSPECT else _mark(attrs)
        self.open.append((tag, drops, mark > 0))
        self.count[tag] += 1
        self.dropped += drops
        if mark:
            self.end_line()
            self.marks.append((mark, self.suspects[-1] if self.suspects else -1, named))
            self.suspects.append(len(self.marks) - 1)
        if tag in CONTAINERS:
            self.kinds.append((tag, self.containers[-1] if self.containers else -1))
            self.containers.append(len(self.kinds) - 1)

    def _close(self, tag: str, inside: set[str] = frozenset()) -> None:
        """Ends the last open ``tag``, and all that is open in it, unless one of ``inside`` stands between."""
        for i in range(len(self.open) - 1, -1, -1) if self.count[tag] else ():
            name = self.open[i][0]
            if name == tag:
                for t, drops, suspect in self.open[i:]:
                    self.dropped -= drops
                    self.count[t] -= 1
                    if suspect:
                        self.end_line()
                        self.suspects.pop()
                    if t in CONTAINERS:
                        self.containers.pop()
                del self.open[i:]
                return
            if name in inside:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag not in VOID:
            # An inline end tag doesn't reach out of its block.
            self._close(tag, inside=frozenset() if tag in BLOCKS else CONTAINERS)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_data(self, data: str) -> None:
        if self.dropped and self.open[-1][0] == "head" and not data.isspace():
            self._close("head")
        if not self.dropped:
            self.words.append(data)


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, weights renormalised at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    ones = np.ones(len(values))
    return np.convolve(values, kernel, "same")[: len(values)] / np.convolve(ones, kernel, "same")[: len(values)] if len(values) > 2 * reach else (
        np.array([(values * w).sum() / w.sum() for i in range(len(values)) for w in [np.exp(-0.5 * ((np.arange(len(values)) - i) / sigma) ** 2)]])
    )


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Lines above the cut between two clusters of smoothed ratios (two means on a line), never below a fifth of the mean."""
    low, high = float(ratios.min()), float(ratios.max())
    for _ in range(50):
        cut = (low + high) / 2
        above = ratios >= cut
        if above.all() or not above.any():
            break
        new = float(ratios[~above].mean()), float(ratios[above].mean())
        if new == (low, high):
            break
        low, high = new
    return ratios >= max((low + high) / 2, float(ratios.mean()) / 5)


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article: all lines of the innermost container that holds all lines chosen by their ratios.

    Text that no container holds (a fragment) is held by the page. Null, empty and text-free pages give "".
    """
    if not html:
        return ""
    parser = Lines()
    last = html.rfind("<")
    parser.feed(html[:last] if last >= 0 and _CUT_TAG.match(html, last) else html)
    parser.close()
    parser.end_line()
    lines = _kept_lines(parser)
    if not lines:
        return ""
    ratios = smooth(np.array([len(t) / max(1, n) for t, n, _ in lines], float), sigma)
    chosen = content_lines(ratios).tolist()
    kinds = parser.kinds
    own, text = np.zeros(len(kinds) + 1, np.int64), np.zeros(len(kinds) + 1, np.int64)  # the last: outside of all containers
    for (line, _, around), is_content in zip(lines, chosen, strict=True):
        own[around] += len(line) * is_content
        text[around] += len(line)
    need = own.sum()
    held = own.copy()
    for c in range(len(kinds) - 1, -1, -1):  # a container's number is over that of the one around it
        held[kinds[c][1]] += held[c]
    good = [c for c in range(len(kinds)) if held[c] >= need]
    # An article or main element beats a plain container within or around it.
    named = [c for c in good if kinds[c][0] in ("article", "main")]
    regions = {max(named or good, default=-1)}
    articles = {c for c, (tag, _) in enumerate(kinds) if tag == "article"}
    if not named:
        elements = {c for c, (tag, _) in enumerate(kinds) if tag in ("article", "main")}
        within = _inside(kinds, elements)
        if text[within].sum() and not own[within].sum():
            regions = elements  # longer lines elsewhere on the page don't outdo what it calls its article
        else:  # sibling articles may hold the content together
            within = _inside(kinds, articles)
            if articles and own[within].sum() >= need:
                regions = articles
    elif kinds[next(iter(regions))][0] == "article":
        # Shorter articles beside it belong to it.
        regions |= {c for c in articles if any(kinds[c][1] == kinds[r][1] for r in regions)}
    if regions == {-1}:
        return " ".join(t for t, _, _ in lines)
    within = _inside(kinds, regions)
    return " ".join(t for t, _, around in lines if within[around])


def _kept_lines(parser: Lines) -> list[tuple[str, int, int]]:
    """Lines without those of suspects that are boilerplate.

    A suspect is none if it holds half of all text in article and main elements, or, on a page without such, nearly all of its
    text (half of it where its name is doubtful). Within an article a doubtful name means nothing.
    """
    marks = parser.marks
    if not marks:
        return [line[:3] for line in parser.lines]
    named = _inside(parser.kinds, {c for c, (tag, _) in enumerate(parser.kinds) if tag in ("article", "main")})
    held, held_named = np.zeros(len(marks) + 1, np.int64), np.zeros(len(marks) + 1, np.int64)
    for text, _, around, suspect in parser.lines:
        held[suspect] += len(text)
        held_named[suspect] += len(text) * named[around]
    for s in range(len(marks) - 1, -1, -1):
        held[marks[s][1]] += held[s]
        held_named[marks[s][1]] += held_named[s]
    total, total_named = held[-1], held_named[-1]
    gone = np.zeros(len(marks) + 1, bool)
    for s, (mark, around, in_named) in enumerate(marks):
        if in_named:
            boilerplate = mark == 2
        elif total_named:
            boilerplate = 2 * held_named[s] < total_named
        else:
            boilerplate = held[s] < (0.9 if mark == 2 else 0.5) * total
        gone[s] = boilerplate or gone[around]
    return [line[:3] for line in parser.lines if not gone[line[3]]]


def _inside(kinds: list[tuple[str, int]], regions: set[int]) -> np.ndarray:
    """Per container, and at the end for what is outside of all: whether it is one of ``regions`` or within one."""
    found = np.zeros(len(kinds) + 1, bool)
    for c, (_, around) in enumerate(kinds):
        found[c] = c in regions or found[around]
    return found


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages of boilerplate only, have an empty text. Null ids and urls stay; repeated rows are
    parsed one by one; other columns are ignored; no rows give no rows.
    """

    def extract(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in rows.column(2).to_pylist()]
        return batch(_SCHEMA, page_id=rows.column(0), url=rows.column(1), text=texts, n_chars=[len(t) for t in texts])

    picked = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"),
    )
    return arrow_map(picked, extract, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_text": (op2_html_text, None)}
