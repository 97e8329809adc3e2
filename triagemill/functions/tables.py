"""Table functions for SQL: a text's pieces, a page's links, and the lines before a line, which need the order of a whole text."""

from __future__ import annotations

from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from triagemill.operators.models import pieces
from triagemill.sources.anchors import outline


@udtf(returnType="pos int, chunk string")
class TextChunks:
    """SELECT ... FROM t, LATERAL text_chunks(t.text, 500): the pieces that a translator gets."""

    def eval(self, text: str, limit: int):
        yield from enumerate(pieces(text or "", limit))


@udtf(returnType="ord int, href string, text string")
class PageLinks:
    """SELECT ... FROM pages, LATERAL page_links(pages.html): the anchors of a page in order."""

    def eval(self, html: str):
        for a in outline(html)["anchors"]:
            yield a["ord"], a["href"], a["text"]


@udtf(returnType="id long, pos int, candidates string")
class LineContext:
    """SELECT * FROM line_context(TABLE(lines) PARTITION BY id ORDER BY pos), lines: id, pos, line. Of each line the usable ones among the ten
    before; no more than those are held."""

    def __init__(self):
        self.before: deque[str | None] = deque(maxlen=10)

    def eval(self, row):
        yield row["id"], row["pos"], "|".join(x for x in self.before if x is not None)
        line = (row["line"] or "").strip(" ")
        self.before.append(line if line and "http" not in line.lower() else None)


FUNCTIONS = {"text_chunks": TextChunks, "page_links": PageLinks, "line_context": LineContext}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
