"""Pages of postings and texts of files: a caller's fetcher is asked once a distinct link; the rest is expressions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagemill.functions import text as X
from triagemill.scratch import shared_folder
from triagemill.sources.fetching import Fetcher, fetch_new
from triagemill.sources.mail import parse_html

#: What a page holds whose posting can be applied to with ease, characters kept of a page, seconds, the mark of a page's text.
EASY_MARK = "public_jobs_apply-link-onsite"
PAGE_CHARS, TIMEOUT, PAGE_MARK = 3000, 8, "[POSITION_PAGE_CONTEXT"
#: Endings of files that a CV folder is read from (files without one, too).
CV_ENDINGS = (".txt", ".md", ".rst", ".html", ".htm", ".eml")


def web(link: str) -> tuple[str, bytes] | None:
    """Over HTTP; not asked unless a caller passes it."""
    with urlopen(Request(link, headers={"User-Agent": "Mozilla/5.0", "Accept": "text/html,application/xhtml+xml"}), timeout=TIMEOUT) as answer:  # noqa: S310 - http links alone reach this
        return answer.headers.get("Content-Type") or "", answer.read()


def visible_text(html: str, limit: int = PAGE_CHARS) -> str:
    """A page's visible text on one line, told if it offers an easy application."""
    text = " ".join(parse_html(html)["text"].split())
    return (f"Easy Apply {text}" if EASY_MARK in html.lower() else text)[:limit]


def fetch_pages(rows: DataFrame, link: str, fetcher: Fetcher | None, limit: int = PAGE_CHARS, cache: str | None = None, **options) -> DataFrame:
    """Adds page_text and easy_apply of each row's link; empty and false where there is no fetcher, no web link, no page or an error. Pages are
    fetched host by host (see fetching.py), and those that the table `cache` has are not."""
    if fetcher is None:
        return rows.withColumns({"page_text": F.lit(""), "easy_apply": F.lit(False)})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for target, kind, body in zip(frame["link"], frame["kind"], frame["body"]):
                html = bytes(body).decode("utf-8", errors="ignore") if not kind or "html" in kind.lower() or "text" in kind.lower() else ""
                out.append((target, visible_text(html, limit) if html else "", EASY_MARK in html.lower()))
            yield pd.DataFrame(out, columns=["_link", "page_text", "_easy"])

    kept = cache or f"{shared_folder(rows.sparkSession)}/triagemill/pages-{uuid.uuid4().hex}"
    pages = fetch_new(rows.select(F.col(link).alias("link")), fetcher, kept, **options).mapInPandas(read, "_link string, page_text string, _easy boolean")
    linkedin = F.lower(X.present(F.col(link))).contains("linkedin.com/")
    joined = rows.join(pages, rows[link] == pages["_link"], "left")
    return joined.withColumns({"page_text": X.present(F.col("page_text")), "easy_apply": linkedin & F.coalesce("_easy", F.lit(False))}).drop("_link", "_easy")


def append_page(raw: Column, page: Column, limit: int = 9000) -> Column:
    """A raw text with its page's text under a mark, once."""
    whole = F.concat(F.trim(X.present(raw)), F.lit(f"\n\n{PAGE_MARK}]\n"), page)
    return F.left(F.when((X.present(page) == "") | X.present(raw).contains(PAGE_MARK), X.present(raw)).otherwise(whole), F.lit(limit))


def cv_text(spark: SparkSession, path: str, budget: int = 40_000) -> str:
    """The text of a CV: a file's start, or those of a folder's files in the order of their paths, each under its name, up to `budget`
    characters together; unreadable ones are left out."""
    if not path:
        return ""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return ""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if fs.getFileStatus(fs_path).isDirectory():
        ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
        files = files.where((ending == "") | ending.isin(*CV_ENDINGS))
        head = F.concat(F.lit("\n\n[CV_FILE "), "path", F.lit("]\n"))
    else:
        head = F.lit("")
    # A character has four bytes at most, so no file sends more than the budget's; a CV's folder is small, its order whole.
    parts = files.select("path", F.left(F.concat(head, F.decode(F.substring("content", 1, 4 * budget), "UTF-8")), F.lit(budget)).alias("part")).where("length(part) > 0")
    before = F.coalesce(F.sum(F.length("part")).over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = parts.withColumn("before", before).where(F.col("before") < budget).select("path", F.left("part", (budget - F.col("before")).cast("int")).alias("part"))
    return "".join(r.part for r in kept.orderBy("path").collect())
