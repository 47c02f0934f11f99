"""Index pages of a daily gazette to entries, through a tree of their elements.

Pages come in three layouts, and each is tried only if the one before found nothing: headings of sections and authorities with links below them, in document
order; table rows; links anywhere, whose section and authority are sought in what stands above and before them. A page is a tree in its task,
bounded by the page; the rest of a job is Spark's.

Defined cases: null and empty pages give nothing; unclosed and void tags are closed as browsers do; text in scripts, styles and comments isn't text of the page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

#: Section headings, links to entries, tags that hold an authority's name, and the least length of one.
SECTION = re.compile(r"(PRIMERA|SEGUNDA|TERCERA|CUARTA|QUINTA)\s+SECCI[OÓ]N", re.IGNORECASE)
ENTRY = ("nota_detalle", "nota_to_doc")
AUTHORITY_TAGS, AUTHORITY_LENGTH = ("h3", "h4", "strong", "b"), 6

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags that end an open element of the same kind, and where the search for it stops.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "a": {"a"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def first_text(self) -> str:
        """Text before the first element inside."""
        out = []
        for child in self.children:
            if isinstance(child, Element):
                break
            out.append(child)
        return "".join(out)

    def text(self) -> str:
        """All text inside; without recursion, as pages may be nested deeply."""
        out, open_ = [], [iter(self.children)]
        while open_:
            child = next(open_[-1], None)
            if child is None:
                open_.pop()
            elif isinstance(child, Element):
                open_.append(iter(child.children))
            else:
                out.append(child)
        return "".join(out)

    def walk(self) -> Iterator[Element]:
        """This element and those inside, in document order."""
        open_ = [self]
        while open_:
            e = open_.pop()
            yield e
            open_.extend(c for c in reversed(e.children) if isinstance(c, Element))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("", {}, None)

    def _end(self, tags: set[str], scope: set[str]) -> None:
        """Close up to the innermost open element of these tags, if the scope has one."""
        e = self.now
        while e is not self.root and e.tag not in scope:
            if e.tag in tags:
                self.now = e.parent
                return self._end(tags, scope)
            e = e.parent
        return None

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end({"p"}, {"td", "th", "li", "table", "div", "button"})
        if tag in ENDS:
            self._end(ENDS[tag], SCOPES.get(tag, set()) | ({"td", "th"} if tag in ("p", "a", "li") else set()))
        e = Element(tag, dict(attrs), self.now)
        self.now.children.append(e)
        if tag not in VOID:
            self.now = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        e = self.now
        while e is not self.root:
            if e.tag == tag:
                self.now = e.parent
                return
            e = e.parent

    def handle_data(self, data):
        if self.now.tag not in ("script", "style"):
            self.now.children.append(data)


def tree(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _clean(text: str) -> str:
    return " ".join(text.split())


def _section(text: str) -> str | None:
    m = SECTION.search(text)
    return _clean(m.group()).upper().replace("Ó", "O") if m else None


def _authority(text: str) -> str | None:
    text = _clean(text)
    return text if len(text) >= AUTHORITY_LENGTH and text.isupper() else None


def _is_entry(e: Element) -> bool:
    return e.tag == "a" and any(x in (e.attrs.get("href") or "") for x in ENTRY)


def _below_headings(root: Element) -> Iterator[tuple]:
    section = authority = ""
    for e in root.walk():
        said = e.first_text()
        if found := _section(said):
            section = found
        elif e.tag in AUTHORITY_TAGS and _authority(said):
            authority = _authority(said)
        elif _is_entry(e) and (title := _clean(e.text())):
            yield title, section, authority, e.attrs["href"]


def _in_rows(root: Element) -> Iterator[tuple]:
    section = authority = ""
    for row in (e for e in root.walk() if e.tag == "tr"):
        section = _section(row.text()) or section
        cells = [c for c in row.children if isinstance(c, Element) and c.tag == "td"]
        if len(cells) == 1 and _authority(cells[0].text()):
            authority = _authority(cells[0].text())
        elif cells:
            for e in row.walk():
                if _is_entry(e) and (title := _clean(e.text())):
                    yield title, section, authority, e.attrs["href"]


def _context(link: Element) -> tuple[str, str]:
    section, authority, above = "", "", link.parent
    while above is not None and above.tag and not (section and authority):
        section = section or _section(above.first_text()) or ""
        if not authority:
            siblings = [c for c in above.parent.children if isinstance(c, Element)]
            before = siblings[: next(i for i, c in enumerate(siblings) if c is above)]
            authority = next((a for s in reversed(before) if (a := _authority(s.text()))), "")
        above = above.parent
    return section, authority


def _anywhere(root: Element) -> Iterator[tuple]:
    for e in root.walk():
        if _is_entry(e) and (title := _clean(e.text())):
            yield title, *_context(e), e.attrs["href"]


STRATEGIES = (("headings", _below_headings), ("rows", _in_rows), ("links", _anywhere))


def page_entries(html: str | None, base: str) -> list[tuple]:
    """(title, section, authority, url, strategy) of a page."""
    root = tree(html or "")
    for name, find in STRATEGIES:
        if found := list(find(root)):
            return [(t, s, a, h if h.startswith(("http://", "https://")) else urljoin(base + "/", h), name) for t, s, a, h in found]
    return []


def entries(pages: DataFrame, id_: str, html: str, base: str) -> DataFrame:
    """(id, position, title, section, authority, url, strategy) of the entries of index pages."""
    kind = pages.schema[id_].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, *e) for i, text in zip(batch[id_], batch[html], strict=True) for n, e in enumerate(page_entries(text, base))]
            yield pd.DataFrame(rows, columns=[id_, "position", "title", "section", "authority", "url", "strategy"])

    return pages.select(id_, html).mapInPandas(read, f"{id_} {kind}, position int, title string, section string, authority string, url string, strategy string")
