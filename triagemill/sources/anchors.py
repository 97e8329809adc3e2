"""The anchors of a page with the text around them, by one Arrow UDF; all that reads fields out of them is expressions."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagemill.sources.batches import pieces

ANCHOR = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("ord", T.IntegerType()), ("href", T.StringType()), ("text", T.StringType()), ("fragments", T.ArrayType(T.StringType())),
        ("card", T.IntegerType()), ("cell", T.IntegerType()), ("block", T.IntegerType()),
        ("block_first", T.StringType()), ("block_from", T.IntegerType()), ("block_links", T.IntegerType()),
    )]
)
#: `card`, `cell` and `block` of an anchor are places in `texts`, so that a text shared by many anchors is held once.
PAGE = T.StructType([T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("anchors", T.ArrayType(ANCHOR))])

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))
CARD_TAGS = frozenset(("tr", "table", "li", "div", "td"))
CLIMB = 8
CARD_CHARS = (30, 900)


class _Outline(HTMLParser):
    """Elements in document order, each as a range of the page's strings and of the elements below it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.strings: list[str] = []
        self.tag, self.parent, self.href = ["#page"], [0], [None]
        self.first, self.end, self.below = [0], [0], [0]
        #: The closest table, row and cell of each element, -1 where there is none.
        self.near: list[dict[str, int]] = [{}]
        self.open = [0]
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        i, up = len(self.tag), self.open[-1]
        self.tag.append(tag)
        self.parent.append(up)
        self.href.append(next((v or "" for k, v in attrs if k == "href"), None))
        self.first.append(len(self.strings))
        self.end.append(-1)
        self.below.append(-1)
        around = self.near[up]
        self.near.append({**around, self.tag[up]: up} if self.tag[up] in ("table", "tr", "td") else around)
        if tag in VOID:
            self._close(i)
        else:
            self.open.append(i)
            self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, i: int):
        self.end[i], self.below[i] = len(self.strings), len(self.tag)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[at]] == tag:
                for i in self.open[at:]:
                    self._close(i)
                    self.silent -= self.tag[i] in SILENT
                del self.open[at:]
                return

    def handle_data(self, data):
        if not self.silent and data.strip():
            self.strings.append(data.strip())

    def close(self):
        super().close()
        for i in self.open:
            self._close(i)


def outline(html: str | None) -> dict:
    page = _Outline()
    page.feed(html or "")
    page.close()
    flat = [" ".join(s.split()) for s in page.strings]
    size = [0, *accumulate(len(s) + 1 for s in flat)]
    texts: list[str] = []
    places: dict[int, int] = {}

    def length(i: int) -> int:
        return max(0, size[page.end[i]] - size[page.first[i]] - 1)

    def place(i: int | None) -> int | None:
        if i is None:
            return None
        if i not in places:
            places[i] = len(texts)
            texts.append(" ".join(flat[page.first[i] : page.end[i]]))
        return places[i]

    def card(i: int) -> int | None:
        """The first row, table, item or box of a card's length among the closest elements; else the last long enough one."""
        best = None
        for _ in range(CLIMB):
            if length(i) >= CARD_CHARS[0]:
                best = i
                if page.tag[i] in CARD_TAGS and length(i) <= CARD_CHARS[1]:
                    break
            if i == 0:
                break
            i = page.parent[i]
        return best

    linked = [i for i, (tag, href) in enumerate(zip(page.tag, page.href)) if tag == "a" and href is not None]
    anchors = []
    for n, i in enumerate(linked):
        near = page.near[i]
        block = near.get("table", near.get("tr"))
        low, high = (bisect_left(linked, block), bisect_left(linked, page.below[block])) if block is not None else (0, 0)
        filled = block is not None and page.end[block] > page.first[block]
        anchors.append({
            "ord": n, "href": page.href[i], "text": " ".join(flat[page.first[i] : page.end[i]]), "fragments": page.strings[page.first[i] : page.end[i]],
            "card": place(card(i)), "cell": place(near.get("td", near.get("tr", page.parent[i]))), "block": place(block),
            "block_first": page.strings[page.first[block]] if filled else None, "block_from": low, "block_links": high - low,
        })
    return {"texts": texts, "anchors": anchors}


@F.pandas_udf(PAGE)
def anchors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        for part in pieces(pages):
            yield pd.DataFrame([outline(p) for p in pages[part]], columns=["texts", "anchors"])
