"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its path of block-level tags from the root.  For every path
text length and punctuation per block are aggregated, their product is given to the path's blocks and
smoothed over neighbouring blocks in page order; the path's mean of that is compared with the deviation over
the page.  The lowest element that holds all blocks of the paths over the threshold is the content, or the
outermost article or main around it; its blocks are returned, short ones too, but for those on paths under
the threshold whose text stands in links alone (menus without a name; not inside article or main).

Elements that never hold an article's text (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) are left out before, by tag name, role, or class and id.  A class that
is such a word drops its element unless an article or main is inside; one with such a word as a part of a
compound also keeps it if a heading of the first level or most of the text is inside, and doesn't count if
the compound tells a state (``has-sidebar``, ``header-fixed``).  A header inside article or main stays if
it has a heading.

Defined results: a null, empty or textless page gives the empty text; repeated rows are treated one by
one; other columns are ignored; an empty table gives no rows; unclosed elements end with their parent;
a page of any length and depth is read to its end, in time that follows its length; a tag that is never
closed is text.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Tags by role (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg"))
DROPPED = RAW | frozenset(("head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "object", "canvas", "audio", "video"))
BLOCKS = frozenset("html body address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul center caption".split())
HOLDERS = frozenset(("html", "body", "main", "article", "section", "div", "td", "center"))
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
#: Words in class, id or role that mark what isn't an article, and words that make a compound with them a state (fixed values).
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside widget cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus respond replies contentinfo complementary search form toolbar pagination pager copyright".split()
)
STATES = frozenset("has no not with without is enabled disabled fixed sticky open closed on off hidden visible".split())

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
# a quote opens a value only after =, any other is an ordinary character
_REST = re.compile(r"((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)>")
_MARKED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
#: Part of the deviation that is the threshold; part of a path's text that makes it one of links.
DEVIATIONS, LINKED = 0.5, 0.9

_NOT, _MAYBE, _SURELY, _HEADER = 0, 1, 2, 3


def mark(attributes: str) -> int:
    """Whether class, id or role say that an element isn't part of an article: as a word of their own, or as part of a compound."""
    found = _NOT
    for m in _MARKED.finditer(attributes):
        for word in (m[1] or m[2] or m[3] or "").lower().split():
            if word in MARKS:
                return _SURELY
            parts = re.split(r"[_-]+", word)
            if not MARKS.isdisjoint(parts) and STATES.isdisjoint(parts):
                found = _MAYBE
    return found


class Page:
    """A page's elements in the order of their start tags, and its blocks of text."""

    def __init__(self, page: str):
        self.tag, self.parent, self.mark, self.end = [""], [0], [_NOT], [0]  # 0: the page itself
        self.path_of: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, int, list[tuple[int, bool, str]]]] = []  # path, element, pieces: element, in a link, text
        self._read(page)
        self.end[0] = len(self.tag)

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, bool, int]] = []  # tag, element, dropped, path
        opened: dict[str, int] = {}  # of the tags in the stack
        pieces: list[tuple[int, bool, str]] = []
        at, dropped = 0, 0

        def flush() -> None:
            nonlocal pieces
            if pieces:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] not in BLOCKS:
                    k -= 1
                self.blocks.append((stack[k][3] if k >= 0 else 0, stack[k][1] if k >= 0 else 0, pieces))
                pieces = []

        def pop_to(k: int) -> None:
            nonlocal dropped
            if any(x[0] in BLOCKS for x in stack[k:]):
                flush()
            for tag, element, drop, _ in stack[k:]:
                dropped -= drop
                opened[tag] -= 1
                self.end[element] = len(self.tag)
            del stack[k:]

        def text(a: int, b: int) -> None:
            if not dropped and a < b:
                pieces.append((stack[-1][1] if stack else 0, bool(opened.get("a")), page[a:b]))

        while at < len(page):
            m = _OPEN.search(page, at)
            if not m:
                text(at, len(page))
                break
            text(at, m.start())
            if m[1] or m[2]:
                end = page.find("-->" if m[1] else ">", m.end())
                at = len(page) if end < 0 else end + (3 if m[1] else 1)
                continue
            rest = _REST.match(page, m.end())
            if not rest:
                text(m.start(), len(page))
                break
            at, tag, attributes = rest.end(), m[4].lower(), rest[1]
            if m[3]:
                if opened.get(tag):
                    pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br" and not dropped:
                    pieces.append((stack[-1][1] if stack else 0, False, " "))
                continue
            if tag in BLOCKS:
                flush()
                if opened.get("p"):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == "p":
                            pop_to(k)
                            break
                        if stack[k][0] in BLOCKS:
                            break
            if tag in CLOSES:
                ends, stops = CLOSES[tag]
                if any(opened.get(t) for t in ends):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in stops:
                            break
                        if stack[k][0] in ends:
                            pop_to(k)
                            if tag != "tr":
                                break
            if tag == "body" and opened.get("head"):
                pop_to(next(k for k, x in enumerate(stack) if x[0] == "head"))
            if attributes.rstrip().endswith("/"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            inside = opened.get("article") or opened.get("main")
            marked = (_HEADER if inside else _SURELY) if tag == "header" else mark(attributes) if attributes and tag not in ("html", "body", "article", "main") else _NOT
            drop = tag in DROPPED
            dropped += drop
            opened[tag] = opened.get(tag, 0) + 1
            path = stack[-1][3] if stack else 0
            if tag in BLOCKS:
                path = self.path_of.setdefault((path, tag), len(self.path_of) + 1)
            self.tag.append(tag)
            self.parent.append(stack[-1][1] if stack else 0)
            self.mark.append(marked)
            self.end.append(0)
            stack.append((tag, len(self.tag) - 1, drop, path))
        flush()
        pop_to(0)

    def summed(self, values: list[int]) -> list[int]:
        """For each element the sum over all in it."""
        out = list(values)
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out

    def left_out(self) -> list[bool]:
        """For each element whether it, or one around it, is marked as no part of an article."""
        size = [0] * len(self.tag)
        for _, _, pieces in self.blocks:
            for element, _, text in pieces:
                size[element] += len(text) - text.count(" ")
        size = self.summed(size)
        cores = self.summed([t in ("article", "main") for t in self.tag])
        titles = self.summed([t == "h1" for t in self.tag])
        out = [False] * len(self.tag)
        for k in range(1, len(out)):
            kind = self.mark[k]
            if out[self.parent[k]]:
                out[k] = True
            elif kind == _SURELY:
                out[k] = not cores[k] and size[k] < size[0]
            elif kind == _MAYBE:
                out[k] = not cores[k] and not titles[k] and 2 * size[k] <= size[0]
            elif kind == _HEADER:
                out[k] = not titles[k]
        return out


def scores(found: list[tuple[int, int, str, int]]) -> list[float]:
    """For each block (path, element, text, characters in links) what its path scores: length times punctuation, smoothed in page order, the mean of its blocks."""
    totals: dict[int, list[int]] = {}
    for path, _, text, _ in found:
        t = totals.setdefault(path, [0, 0, 0])
        t[0] += len(text)
        t[1] += len(_PUNCTUATION.findall(text))
        t[2] += 1
    fused = [t[0] / t[2] * (1 + t[1] / t[2]) for t in (totals[path] for path, _, _, _ in found)]
    wide = [fused[0], *fused, fused[-1]]
    smooth = [(wide[k] + 2 * wide[k + 1] + wide[k + 2]) / 4 for k in range(len(fused))]
    sums: dict[int, float] = {}
    for (path, _, _, _), x in zip(found, smooth, strict=True):
        sums[path] = sums.get(path, 0.0) + x
    return [sums[path] / totals[path][2] for path, _, _, _ in found]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    read = Page(page)
    out = read.left_out()
    found = []
    for path, element, pieces in read.blocks:
        kept = [(linked, x) for e, linked, x in pieces if not out[e]]
        if text := " ".join(html.unescape("".join(x for _, x in kept)).split()):
            found.append((path, element, text, sum(len(" ".join(html.unescape(x).split())) for linked, x in kept if linked)))
    if not found:
        return ""
    scored = scores(found)
    mean = sum(scored) / len(scored)
    limit = DEVIATIONS * (sum((x - mean) ** 2 for x in scored) / len(scored)) ** 0.5
    high = [0] * len(read.tag)
    for (_, element, _, _), x in zip(found, scored, strict=True):
        high[element] += x >= limit
    high = read.summed(high)
    best = max((k for k, n in enumerate(high) if n == high[0] and (not k or read.tag[k] in HOLDERS)), default=0)
    outer = [k for k in _around(read, best) if read.tag[k] in ("article", "main")]
    if outer:
        best = outer[-1]
    # paths of links alone under the threshold
    linked: dict[int, list[int]] = {}
    for (path, _, text, links), x in zip(found, scored, strict=True):
        t = linked.setdefault(path, [0, 0, 0])
        t[0], t[1], t[2] = t[0] + len(text), t[1] + links, t[2] + (x >= limit)
    menus = set() if outer else {p for p, (n, links, over) in linked.items() if links >= LINKED * n and not over}
    if len(menus) == len(linked):
        menus = set()
    return "\n".join(text for path, element, text, _ in found if best <= element < read.end[best] and path not in menus)


def _around(page: Page, element: int):
    """The element and those around it, from the inside."""
    while element:
        yield element
        element = page.parent[element]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its code points."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return df.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html": op8_html}
ORACLE_SQL: dict[str, str] = {}
