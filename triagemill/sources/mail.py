"""Files of mail and web pages as tables: one Arrow UDF parses what SQL can't, the rest is expressions."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagemill.sources.batches import pieces

PARSED = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StringType())), T.StructField("html", T.StringType())])


class _Page(HTMLParser):
    """Visible text by line, hrefs in order, the title or else the first heading."""

    HIDDEN = ("script", "style", "noscript")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[str] = []
        self.lines: list[str] = []
        self.titles: dict[str, str] = {}
        self.open: list[str] = []
        self.closed: set[str] = set()

    def handle_starttag(self, tag, attrs):
        href = dict(attrs).get("href")
        if tag == "a" and href:
            self.links.append(href)
        if tag in (*self.HIDDEN, "title", "h1") and tag not in self.closed - set(self.HIDDEN):
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            self.closed.add(tag)
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data):
        if any(t in self.HIDDEN for t in self.open) or not data.strip():
            return
        self.lines.append(data.strip())
        for tag in self.open:
            # A heading is all its pieces, up to its end.
            if tag not in self.closed:
                self.titles[tag] = f"{self.titles.get(tag, '')} {data.strip()}".strip()


def parse_html(html: str) -> dict:
    page = _Page()
    page.feed(html)
    return {"title": page.titles.get("title") or page.titles.get("h1", ""), "text": "\n".join(page.lines), "links": page.links, "html": html}


def parse_mail(content: bytes) -> dict:
    """Subject or first line as title; the plain text, or else the HTML part's; links of the text, then new ones of the HTML."""
    import re

    message = email.message_from_bytes(content, policy=email.policy.default)
    plain, html = [], []
    for part in message.walk():
        if part.get_content_type() in ("text/plain", "text/html"):
            body = part.get_payload(decode=True) or b""
            try:
                text = body.decode(part.get_content_charset() or "utf-8", errors="ignore")
            except LookupError:
                text = body.decode("utf-8", errors="ignore")
            (plain if part.get_content_type() == "text/plain" else html).append(text)
    page = parse_html("\n".join(html))
    text = "\n".join(plain).strip()
    if text:
        found = [x.rstrip(").,;]") for x in re.findall(r"https?://[^\s<>'\"]+", text)]
        links = list(dict.fromkeys(found + page["links"]))
    else:
        text, links = page["text"], page["links"]
    title = str(message.get("subject") or "").strip() or next((x.strip() for x in text.split("\n") if x.strip()), "")[:180]
    return {"title": title, "text": text, "links": links, "html": page["html"]}


def parse_any(path: str, content: bytes | None) -> dict | None:
    """Null where the file can't be parsed."""
    if content is None:
        return None
    try:
        return parse_mail(bytes(content)) if path.lower().endswith(".eml") else parse_html(bytes(content).decode("utf-8", errors="ignore"))
    except Exception:  # noqa: BLE001 - a broken file is skipped, whatever breaks it
        return None


@F.pandas_udf(PARSED)
def parse_file(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for paths, contents in batches:
        for part in pieces(contents):
            rows = [parse_any(p, c) or {"title": None, "text": None, "links": None, "html": None} for p, c in zip(paths[part], contents[part])]
            yield pd.DataFrame(rows, columns=["title", "text", "links", "html"])


def load_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("html", "htm", "eml")) -> DataFrame:
    """(path, title, text, links, html) of the files below a folder; files that can't be parsed are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.where(F.lower("path").rlike(rf"\.({'|'.join(extensions)})$"))
    return files.select("path", parse_file("path", "content").alias("p")).select("path", "p.*").where("text IS NOT NULL")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
