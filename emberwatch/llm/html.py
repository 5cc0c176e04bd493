"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession

from emberwatch.llm.text import per_batch

#: Lines in a sliding window; characters of a window at which text surges.
WINDOW, SURGE = 3, 80

#: Elements whose content is never text of the article, whatever their length.
_OPAQUE = frozenset("script style noscript template svg math iframe object canvas head title".split())
_ASIDE = frozenset(
    "nav header footer aside form button select textarea dialog menu option label fieldset".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Elements whose own text is judged by whole class names only: a name's part may mean anything.
_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figcaption".split())
_ADS = r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|related|recommend\w*"
_TALK = r"comments?|comment-?list|replies|reply|respond|disqus|user-(?:comments?|responses?|reviews?)"
_SITE = (
    r"nav\w*|menu\w*|sidebar\w*|side-?bar|breadcrumbs?|footer|copyright|cookies?|consent|gdpr|"
    r"notices?|popup|modal|overlay|newsletter|subscribe|signup|login|share\w*|social\w*|widgets?|"
    r"toolbar|pagination|pager|skip-?link|complementary|contentinfo|navigation|dialog"
)
_BOX = (
    r"areas?|articles?|bars?|blocks?|box|buttons?|container|icons?|inner|items?|links?|lists?|"
    r"media|posts?|sections?|slots?|thread|units?|wrap|wrapper"
)
#: Words of a class, id or role that mark what stands beside the article.
_BESIDE = re.compile(
    rf"(?:^|[\s_-])(?:{_ADS}|{_TALK}|{_SITE}|banner|masthead|search|alert|alertdialog|form|"
    r"(?<!entry[_-])(?<!post[_-])(?<!article[_-])(?<!content[_-])header|"
    r"discussion|responses?)(?=$|[\s_-])",
    re.I,
)
#: The same within an article: the word ends a name, or goes before a word for a box.
_WITHIN = re.compile(
    rf"(?:^|[\s_-])(?:{_ADS}|{_TALK}|{_SITE})(?:[_-](?:{_BOX}))*(?=$|\s)", re.I
)
#: Whole names that mark a paragraph or heading as none of the article.
_SURE = re.compile(
    rf"(?:^|\s)(?:{_ADS}|{_TALK}|breadcrumbs?|copyright|cookies?|consent|gdpr|newsletter|subscribe|"
    r"skip-?link|cookie-notice)(?=$|\s)",
    re.I,
)
#: Of those, the words of what is never the article, also where it is made of article elements.
_SHUT = re.compile(rf"(?:^|[\s_-])(?:{_ADS}|{_TALK})(?=$|[\s_-])", re.I)
#: Short lines at the edge of a stretch that speak of the site.
_IMPRINT = re.compile(
    r"(?:\xa9|\(c\)\s|copyright\b).{0,80}|.{0,80}\ball rights reserved\W*|skip to (?:main )?content",
    re.I,
)
_MAIN = {"main": 1, "article": 2}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s>\"']+)))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


def _told(attributes: str) -> tuple[str, bool]:
    """The names in class, id and role, and whether the element is hidden; by the attribute's name."""
    marks, hidden = [], False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            marks.append(value)
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.strip().lower() == "true"
        elif name == "style":
            hidden |= bool(_NOT_SHOWN.search(value))
    return " ".join(marks), hidden


class Line:
    """A block's text, its characters outside of links, and whether it lies in a main element (1)
    or an article element (2)."""

    __slots__ = ("text", "length", "main")

    def __init__(self, text: str, length: int, main: int):
        self.text, self.length, self.main = text, length, main


def page_lines(page: str) -> list[Line]:
    """The page without markup: a line for each run of text between block elements.

    Elements that hold no article text, by their name or by the words of their class, id or
    role, are left out with all they contain. Inside an article or main element, and for headings
    and paragraphs anywhere, only such words count as surely mark none of its text. An article or main element in such a wrapper is
    taken nevertheless, unless it lies in an opaque or hidden element, in an aside, nav or footer,
    or among comments, advertisements or related texts.
    """
    lines: list[Line] = []
    parts: list[str] = []
    linked = 0
    open_tags: list[tuple[str, bool, int, bool, bool]] = []  # name, beside, main, link, shut
    beside = in_link = shut = False
    main = at = 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            lines.append(Line(text, max(0, len(text) - linked), main))
        parts, linked = [], 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw and not beside:
            text = html.unescape(raw)
            parts.append(text)
            if in_link:
                linked += len(" ".join(text.split()))

    def refresh() -> None:
        nonlocal beside, main, in_link, shut
        last = open_tags[-1] if open_tags else ("", False, 0, False, False)
        _, beside, main, in_link, shut = last

    while tag := _TAG.search(page, at):
        take(page[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if name in _BLOCK:
            flush()
        if tag[1]:
            for depth in range(len(open_tags) - 1, -1, -1):
                if open_tags[depth][0] == name:
                    del open_tags[depth:]
                    refresh()
                    break
            continue
        if name in _OPAQUE and not tag[0].endswith("/>"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end or name not in ("head", "title"):
                at = end.end() if end else len(page)
            continue
        if name in _VOID or tag[0].endswith("/>"):
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):  # end where the next begins
            stop = {"p": _BLOCK - {"p", "br"}, "li": {"ul", "ol", "menu"}}.get(name, {"table", "dl"})
            for depth in range(len(open_tags) - 1, -1, -1):
                if open_tags[depth][0] == name:
                    del open_tags[depth:]
                    refresh()
                    break
                if open_tags[depth][0] in stop:
                    break
        marks, hidden = _told(tag[3]) if tag[3] else ("", False)
        listed = _SURE if name in _TEXT else _WITHIN if main else _BESIDE
        off = name in _ASIDE or bool(marks and listed.search(marks)) or hidden
        if name == "header" and main:  # an article's own head holds its title
            off = hidden
        inner = name in _MAIN and not (marks and _BESIDE.search(marks))
        lifted = inner and not shut and (beside or not main)
        closes = hidden or name in ("aside", "nav", "footer")
        closes = closes or (bool(marks and _SHUT.search(marks)) and (off or name in _MAIN))
        open_tags.append((
            name,
            (beside or off) and name not in ("html", "body") and not lifted,
            max(main, _MAIN[name]) if inner else main,
            in_link or name == "a",
            (shut or closes) and name not in ("html", "body") and not lifted,
        ))
        refresh()
    take(page[at:])
    flush()
    return lines


def main_ranges(lengths: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """Stretches (first line, end) of text by the sums of `window` lines from each line on.

    Text surges where a sum reaches `surge` and the line has text, and dives where a sum comes
    to none. If no sum reaches `surge`, the greatest is the surge.
    """
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    least = max(1, min(surge, max(sums, default=0)))
    out = []
    i = 0
    while i < len(sums):
        if sums[i] < least or not lengths[i]:
            i += 1
            continue
        end = i
        while end < len(sums) and sums[end]:
            end += 1
        out.append((i, end))
        i = end
    return out


def _stretches(lines: list[Line], window: int, surge: int) -> list[tuple[int, int]]:
    """The stretches of text among neighbouring lines, those which only links part made one."""
    lengths = [len(line.text) if line.main else line.length for line in lines]
    kept: list[tuple[int, int]] = []
    for first, end in main_ranges(lengths, window, surge):
        if not kept:
            while first and lengths[first - 1]:
                first -= 1
        elif not any(lengths[kept[-1][1] : first]):
            first = kept.pop()[0]
        kept.append((first, end))
    out = []
    for first, end in kept:
        while end > first and not (lengths[end - 1] and _is_text(lines[end - 1])):
            end -= 1
        while first < end and not _is_text(lines[first]):
            first += 1
        out.append((first, end))
    return out


def _is_text(line: Line) -> bool:
    return bool(line.main or not _IMPRINT.fullmatch(line.text))


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's blocks in page order with one space between; empty if there is none.

    Windows slide over the lines of an article element (of a main element, where the page has no
    article), and over those between such elements, never across an edge. A line counts with its
    characters outside of links, in such an element with all of them. Every stretch of an element
    is kept. One beside them is only if its own windows surge and it holds more text than all of
    them together, as the body of a page does whose element is a teaser. Stretches parted by
    lines of links only are one with these lines; the first begins with the short lines right
    before it; lines that speak of the site's rights are taken off its ends.
    """
    lines = page_lines(page or "")
    level = max((line.main for line in lines), default=0)
    for line in lines:
        line.main = int(line.main == level > 0)
    weight = sum(len(line.text) for line in lines if line.main)
    kept: list[Line] = []
    for is_main, group in groupby(lines, key=lambda line: line.main):
        own = list(group)
        for first, end in _stretches(own, window, surge):
            stretch = own[first:end]
            size = sum(line.length for line in stretch)
            if is_main or not weight or size > max(weight, surge - 1):
                kept += stretch
    return " ".join(line.text for line in kept)


def extract_text(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """Per row of `pages`: page_id, url, text (the main text), n_chars (its code points).

    The whole page is read. A null or empty page, and one without text, gives an empty text.
    Broken markup is read as far as it goes: an element that is never closed ends with the page.
    Repeated rows each give a row; an empty table gives none.
    """

    def extract(rows: dict[str, list]) -> dict[str, list]:
        texts = [main_text(page, window, surge) for page in rows["html"]]
        return {
            "page_id": rows["page_id"],
            "url": rows["url"],
            "text": texts,
            "n_chars": [len(text) for text in texts],
        }

    return per_batch(
        pages.select("page_id", "url", "html"),
        extract,
        "page_id long, url string, text string, n_chars long",
    )


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{folder}/pages.parquet"))
