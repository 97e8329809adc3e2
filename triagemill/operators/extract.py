"""Job entries out of pages and mails: (key, link, title, company, place, work_type, raw_text, source), one row a link of a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.functions import text as X
from triagemill.functions import urls as U
from triagemill.operators.offsets import work_types
from triagemill.scratch import cut
from triagemill.sources.anchors import anchors

FIELDS = ("title", "company", "place", "work_type", "raw_text")
#: What links of a listing are called that aren't its title, and how a card and its place are written.
LABELS = ("view job", "apply", "about the company", "save job", "settings")
WORK = r"(?i)\((Hybrid|Remote|On-?site)\)"
CARD = r"(?i)^(.+?)\s+([^·(]{2,}?)\s*·\s*([^(]{2,}?)\s*\((Hybrid|Remote|On-?site)\)"
AGO = r"\d+\s+(?:minutes?|hours?|days?|weeks?)\s+ago\b"
#: What every job link holds, or a tracking link that may hide one.
LIKELY = r"(?i)jobs?/|jobannonce/|jobid=|[?&][tp]="
PUBLISHED = r"\s*(.*?)\s*PUBLISHED\s*:"
#: Where a listing's description stands before its date, how a title carries its place, and a cell its company and place.
ABOUT = (r"(?i)settings\s*\)" + PUBLISHED, r"(?i)\d+\s+min\s*\(.*?\)" + PUBLISHED)
TITLE_PLACE = r"^(.+?)\s*-\s*(.+)$"
COMPANY_PLACE = rf"(?i)^([^–-]{{2,80}}?)\s*[–-]\s*(.+?)(?:\s+{AGO}|$)"
#: What a mail's line of a posting holds, lines around it that are no part of the posting, words that tell titles,
#: companies and places, and phrases of LinkedIn's own cards.
TRIGGER = "view job:"
STOP_PHRASES = ("this company is actively hiring", "apply with resume", "view job", "new jobs match your preferences", "job alert")
TITLE_WORDS = ("developer", "engineer", "specialist", "manager", "scientist", "lead", "architect", "analyst", "consultant", ".net", "software")
COMPANY_WORDS = ("group", "inc", "aps", "a/s", "ltd", "gmbh", "company", "danmark")
PLACE_WORDS = ("aarhus", "copenhagen", "odense", "lystrup", "humleb", "denmark", "municipality")
BOILERPLATE = ("jobs similar to", "new jobs match your preferences", "job alert", "viewed jobs")
#: Lines before a posting's that may name it, and those around it that tell its work type and its text.
BACK, AROUND, SNIPPET = 10, (20, 4), (4, 1)
#: Words of the work types, those asked first first, and characters that they may be away from a link.
WORK_WORDS = {"Hybrid": ("hybrid",), "Remote": ("remote",), "On-site": ("on-site", "onsite")}
REACH = 6000


def _short(c: Column) -> Column:
    return F.left(F.btrim(c, F.lit(" -|:")), F.lit(180))


def _work(tag: Column, otherwise: Column) -> Column:
    t = F.lower(tag)
    return F.when(t == "hybrid", "Hybrid").when(t == "remote", "Remote").when(t.startswith("on"), "On-site").otherwise(otherwise)


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, ord, href, link, text, fragments, card, cell, block, block_first, block_links) of each job link of the pages.

    Only anchors that may be job links are made rows and get the texts around them; links are then read as plain columns."""

    def around(page: Column, a: Column) -> Column:
        text = lambda name: F.get(page["texts"], a[name])
        inside = F.slice(page["anchors"], a["block_from"] + 1, a["block_links"])
        return F.struct(
            a["ord"].alias("ord"), a["href"].alias("href"), a["text"].alias("text"), a["fragments"].alias("fragments"),
            text("card").alias("card"), text("cell").alias("cell"), text("block").alias("block"), a["block_first"].alias("block_first"),
            F.transform(inside, lambda x: F.struct(x["href"].alias("href"), x["text"].alias("text"))).alias("block_links"),
        )

    parsed = pages.select(key, anchors(html).alias("page"))
    # Links are written anew inside the array, step by step, so that no later condition repeats the whole expression.
    likely = F.transform(F.filter("page.anchors", lambda a: a["href"].rlike(LIKELY)), lambda a: F.struct(a.alias("a"), U.unwrap_tracker(a["href"]).alias("target")))
    named = F.filter(F.transform(likely, lambda x: F.struct(x["a"].alias("a"), U.normalize(x["target"]).alias("link"))), lambda x: U.is_job_link(x["link"]))
    rows = parsed.select(key, F.col("page.texts").alias("texts"), F.col("page.anchors").alias("anchors"), F.explode(named).alias("x"))
    page = {"texts": F.col("texts"), "anchors": F.col("anchors")}
    return rows.select(key, around(page, F.col("x.a")).alias("r"), F.col("x.link").alias("link")).select(key, "r.*", "link")


def card_entries(found: DataFrame, key: str) -> DataFrame:
    """Entries by the strings of the anchor itself, its card filling what they leave out; the fullest anchor of a link counts."""
    dot = F.array_position(F.transform("fragments", lambda f: f.contains("·")), True).cast("int")
    head = F.when(dot > 1, F.array_join(F.slice("fragments", F.lit(1), F.greatest(dot - 1, F.lit(0))), " ")).otherwise(X.present(F.get("fragments", F.lit(0))))
    rows = found.withColumns({"_dot": dot, "_title": _short(head), "_detail": X.present(F.get("fragments", dot - 1)), "_card": X.present(F.col("card"))})
    after = F.regexp_extract("_detail", r"(?s)^[^·]*·(.*)$", 1)
    rows = rows.withColumns({
        "_has": F.col("_dot") > 0,
        "company": F.when(F.col("_dot") > 0, _short(F.substring_index("_detail", "·", 1))).otherwise(""),
        "_place": F.when(F.col("_dot") > 0, _short(F.trim(F.regexp_replace(after, WORK, "")))).otherwise(""),
        "work_type": _work(F.regexp_extract(after, WORK, 1), X.work_type(F.array_join("fragments", " "))),
        "_tail": F.substring_index("_title", " - ", -1),
    })
    start = F.left("_title", F.length("_title") - F.length("_tail") - 3)
    low = F.lower("_tail")
    placed = (F.col("_place") == "") & F.col("_title").contains(" - ") & (F.col("_tail") != "") & (start != "") & (F.col("_tail").contains(",") | low.endswith(" dk") | low.contains("denmark"))
    rows = rows.withColumns({"title": F.when(placed, _short(start)).otherwise(F.col("_title")), "place": F.when(placed, _short(F.col("_tail"))).otherwise(F.col("_place"))})
    lacking = F.col("_has") & ((F.col("company") == "") | (F.col("place") == ""))
    card = {n: _short(F.regexp_extract("_card", CARD, i)) for i, n in enumerate(("title", "company", "place"), 1)}
    card["work_type"] = _work(F.regexp_extract("_card", CARD, 4), X.work_type(F.col("_card")))
    rows = rows.select(key, "link", "ord", "_has", "fragments", "_card", *[F.when(lacking & (F.col(n) == ""), c).otherwise(F.col(n)).alias(n) for n, c in card.items()])
    raw = F.left(F.when(F.size("fragments") > 0, F.array_join("fragments", " | ")).otherwise(F.col("_card")), F.lit(800))
    filled = reduce(lambda a, b: a + b, [(F.col(n) != "").cast("int") for n in card])
    rich = F.length("title") + F.length("company") + F.length("place")
    best = F.max_by(F.struct(*card, raw.alias("raw_text")), F.struct("_has", filled, rich, -F.col("ord")))
    return rows.groupBy(key, "link").agg(best.alias("e")).select(key, "link", "e.*", U.provider(F.col("link")).alias("source"))


def _last(rows: DataFrame, key: str, source: str, title: Column, company: Column, place: Column, raw: Column) -> DataFrame:
    entry = F.struct(F.left(title, F.lit(180)).alias("title"), company.alias("company"), place.alias("place"), F.lit("Unknown").alias("work_type"), F.left(raw, F.lit(2500)).alias("raw_text"))
    return rows.groupBy(key, "link").agg(F.max_by(entry, "ord").alias("e")).select(key, "link", "e.*", F.lit(source).alias("source"))


def jobindex_entries(found: DataFrame, key: str) -> DataFrame:
    """Entries by the table (or row) around a listing's link: the longest name it goes by, the first link off the site, the place
    before the travel time, the description before the date of publication."""
    rows = found.withColumn("_id", U.jobindex_id(F.col("href"))).where(U.host(F.col("href")).contains("jobindex.dk") & (F.col("_id") != "") & (F.length("block") >= 30))
    named = F.filter("block_links", lambda x: (U.jobindex_id(x["href"]) == F.col("_id")) & (x["text"] != "") & ~F.lower(x["text"]).isin(*LABELS))
    longest = F.array_max(F.transform(named, lambda x, i: F.struct(F.length(x["text"]).alias("n"), (-i).alias("i"), x["text"].alias("text"))))["text"]
    off_site = F.get(F.filter("block_links", lambda x: (x["text"] != "") & ~F.lower(x["href"]).contains("jobindex.dk")), F.lit(0))["text"]
    rows = rows.withColumns({"_title": F.left(X.present(longest), F.lit(180)), "_company": F.left(X.present(F.coalesce(off_site, F.col("block_first"))), F.lit(180))})
    quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace("_title", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\s+(.{2,80}?)\s+\d+\s+min\b"))
    place = F.when(F.col("_title") != "", _short(F.call_function("regexp_extract", "block", quoted, F.lit(1)))).otherwise("")
    first, second = ABOUT
    about = F.trim(F.when(F.col("block").rlike(first), F.regexp_extract("block", first, 1)).otherwise(F.regexp_extract("block", second, 1)))
    raw = F.when(about != "", F.concat(about, F.lit("\n\n"), F.left("block", F.lit(2500)))).otherwise(F.col("block"))
    rows = rows.withColumn("link", F.concat(F.lit("https://www.jobindex.dk/jobannonce/"), "_id"))
    return _last(rows, key, "Jobindex", F.col("_title"), F.col("_company"), place, raw)


def demant_entries(found: DataFrame, key: str) -> DataFrame:
    rows = found.where(U.host(F.col("href")).contains("careers.demant.com") & F.lower("href").contains("/job/") & (F.col("text") != ""))
    title = F.when(F.col("text").rlike(TITLE_PLACE), F.trim(F.regexp_extract("text", TITLE_PLACE, 1))).otherwise(F.col("text"))
    return _last(rows, key, "Demant", title, F.lit("Demant Group"), F.left(F.trim(F.regexp_extract("text", TITLE_PLACE, 2)), F.lit(180)), F.col("text"))


def danfoss_entries(found: DataFrame, key: str) -> DataFrame:
    rows = found.where(U.host(F.col("href")).contains("jobs.danfoss.com") & F.lower("href").contains("/job/") & (F.col("text") != ""))
    return _last(rows, key, "Danfoss", F.col("text"), F.lit("Danfoss"), F.lit(""), F.col("text"))


def google_entries(found: DataFrame, key: str) -> DataFrame:
    """Entries by the cell around the link: after the title `company – place`, up to the age of the posting."""
    rows = found.where((U.provider(F.col("link")) == "Google Careers") & (F.col("text") != "")).withColumn("_cell", F.left(F.coalesce("cell", "text"), F.lit(2500)))
    rest = F.when(F.startswith("_cell", "text"), F.trim(F.substring("_cell", F.length("text") + 1, F.lit(2500)))).otherwise(F.col("_cell"))
    rows = rows.withColumns({"_company": _short(F.regexp_extract(rest, COMPANY_PLACE, 1)), "_fits": rest.rlike(COMPANY_PLACE), "_place": _short(F.regexp_extract(rest, COMPANY_PLACE, 2))})
    return _last(rows, key, "Google Careers", F.col("text"), F.when(F.col("_fits"), F.col("_company")).otherwise("Google"), F.col("_place"), F.col("_cell"))


#: Extractors, whose fields count first first.
EXTRACTORS = (google_entries, danfoss_entries, demant_entries, jobindex_entries, card_entries)
_GOOGLE, _DANFOSS, _DEMANT, _JOBINDEX, _CARD = range(len(EXTRACTORS))


def by_site(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """The fields of all extractors, with `_rank`, the number of the extractor."""
    # Pages are parsed once for all extractors.
    found = cut(links(pages, key, html))
    return reduce(DataFrame.unionByName, [f(found, key).withColumn("_rank", F.lit(i)) for i, f in enumerate(EXTRACTORS)])


def entries(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One row a job link of a page: every field from the first extractor that fills it, by one aggregation."""
    known = by_site(pages, key, html)
    fill = [F.coalesce(F.min(F.when(~F.col(n).isin("", "Unknown"), F.struct("_rank", n)))[n], F.lit("Unknown" if n in ("place", "work_type") else "")).alias(n) for n in FIELDS]
    return known.groupBy(key, "link").agg(*fill).withColumn("source", U.provider(F.col("link")))


def _score(line: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.lower(line).contains(w).cast("int") for w in words])


def text_entries(mails: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, link, title, company, place, work_type, raw_text) of each job link that a line of a mail's text offers to view; the last
    line of a link counts. Fields are the lines before that score best, else those at fixed places, and no line stands twice."""
    lines = F.transform(F.split(X.present(F.col(text)), "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), lambda x: F.trim(x))
    offered = F.filter(F.transform("_lines", lambda x, i: F.struct(x.alias("line"), i.alias("at"))), lambda x: F.lower(x["line"]).contains(TRIGGER))
    target = lambda x: U.normalize(U.unwrap_tracker(F.regexp_extract(x["line"], r"https?://\S+", 0)))
    linked = F.filter(F.transform(offered, lambda x: F.struct(x["at"].alias("at"), target(x).alias("link"))), lambda x: U.is_job_link(x["link"]))
    rows = mails.select(key, lines.alias("_lines")).select(key, "_lines", F.explode(linked).alias("_x"))
    rows = rows.select(key, "_lines", F.col("_x.at").alias("_at"), F.col("_x.link").alias("link"))
    first = lambda back: F.greatest(F.lit(1), F.col("_at") + 1 - back)
    span = lambda back, on: F.slice("_lines", first(back), F.col("_at") + 2 + on - first(back))
    usable = lambda x: (x != "") & ~F.lower(x).contains("http") & ~X.holds_any(F.lower(x), STOP_PHRASES) & ~x.contains("----")
    rows = rows.select(
        key, "_at", "link", F.filter(span(BACK, -1), usable).alias("_some"), F.lower(F.array_join(span(*AROUND), " ")).alias("_near"),
        F.array_join(F.filter(span(*SNIPPET), lambda x: x != ""), "\n").alias("raw_text"),
    )
    scored = lambda words, sign, more=None: F.array_max(F.transform("_some", lambda x, i: F.struct((_score(x, words) + (more(x) if more else 0)).alias("s"), (sign * F.length(x)).alias("n"), (-i).alias("i"), x.alias("x"))))
    back = lambda n: F.element_at("_some", -n)
    n = F.size("_some")
    best = {"_t": scored(TITLE_WORDS, 1), "_c": scored(COMPANY_WORDS, 1), "_p": scored(PLACE_WORDS, -1, lambda x: x.contains(",").cast("int"))}
    rows = rows.withColumns(best).withColumns({
        "title": F.when(n == 0, "").when(F.col("_t.s") > 0, F.col("_t.x")).when(n >= 3, back(3)).otherwise(F.get("_some", F.lit(0))),
        "company": F.when(n == 0, "").when(F.col("_c.s") > 0, F.col("_c.x")).when(n >= 2, back(2)).otherwise(""),
        "place": F.when(n == 0, "").when(F.col("_p.s") > 0, F.col("_p.x")).when(n >= 3, back(1)).otherwise(""),
    })
    unused = lambda *names: F.get(F.filter("_some", lambda x: ~reduce(lambda a, b: a | b, [x == F.col(m) for m in names])), F.lit(0))
    rows = rows.withColumn("company", F.when((n > 1) & (F.col("company") == F.col("title")), F.coalesce(unused("title"), "company")).otherwise(F.col("company")))
    rows = rows.withColumn("place", F.when((n > 0) & ((F.col("place") == F.col("title")) | (F.col("place") == F.col("company"))), F.coalesce(unused("title", "company"), "place")).otherwise(F.col("place")))
    near = F.col("_near")
    work = F.when(near.contains("remote"), "Remote").when(near.contains("hybrid"), "Hybrid").when(near.rlike("on-?site") | (F.col("place") != ""), "On-site").otherwise("Unknown")
    entry = F.struct(*[F.left(c, F.lit(180)).alias(c) for c in ("title", "company", "place")], work.alias("work_type"), "raw_text")
    return rows.groupBy(key, "link").agg(F.max_by(entry, "_at").alias("e")).select(key, "link", "e.*")


def boilerplate(source: Column, *fields: Column) -> Column:
    """A card of LinkedIn's that is no posting."""
    return (F.lower(source) == "linkedin") & reduce(lambda a, b: a | b, [X.holds_any(F.lower(X.present(f)), BOILERPLATE) for f in fields])


def job_entries(docs: DataFrame, key: str) -> DataFrame:
    """The entries of parsed files (key, title, text, links, html): those that the text offers, and those of all other links.

    An entry of the text takes each field from the last extractor of the page that fills it, and keeps its own where none does; an
    entry of a link alone takes it from the first one that fills it, or else from what subject and text say. The work type is that of
    the card, or of the nearest word in the page."""
    sites = by_site(docs.select(key, "html"), key).select(key, "link", "_rank", *FIELDS)
    texts = text_entries(docs, key).withColumn("_rank", F.lit(-1)).select(key, "link", "_rank", *FIELDS)
    targets = F.transform("links", lambda x: F.struct(x.alias("raw"), U.unwrap_tracker(x).alias("target")))
    named = F.transform(targets, lambda x: F.struct(x["raw"].alias("raw"), U.normalize(x["target"]).alias("link")))
    wanted = F.filter(named, lambda x: U.is_job_link(x["link"]) & ~U.is_reference_link(x["raw"], x["link"]))
    none = [F.lit(None).cast("string").alias(n) for n in FIELDS]
    raw = docs.select(key, F.explode(F.array_distinct(F.transform(wanted, lambda x: x["link"]))).alias("link")).select(key, "link", F.lit(-2).alias("_rank"), *none)
    every = sites.unionByName(texts).unionByName(raw)
    # One aggregation a document's link: what each extractor, the text and the links have.
    given = F.struct(*FIELDS)
    grouped = every.groupBy(key, "link").agg(
        *[F.max(F.when(F.col("_rank") == i, given)).alias(f"_{i}") for i in range(len(EXTRACTORS))], F.max(F.when(F.col("_rank") == -1, given)).alias("_text"), F.max(F.when(F.col("_rank") == -2, 1)).alias("_listed"),
    ).where("_text IS NOT NULL OR _listed = 1")
    header = X.company_title(F.col("text"), F.col("title"))
    grouped = grouped.join(docs.select(key, header.alias("_header"), F.left(X.present(F.col("text")), F.lit(2500)).alias("_start")), key)
    grouped = grouped.withColumn("_number", F.regexp_extract("link", r"(?i)/jobs/view/(\d+)", 1))
    around = work_types(docs, key, F.col("html"), grouped.where("_number <> ''").select(key, F.col("_number").alias("number")), WORK_WORDS, REACH)
    grouped = grouped.join(around.withColumnsRenamed({"number": "_number", "work_type": "_near"}), [key, "_number"], "left")
    near = F.col("_near")
    value = lambda i, n: F.nullif(F.col(f"_{i}.{n}"), F.lit(""))
    seen = F.col("_text").isNotNull()
    guess = {"title": F.col("_header.title"), "company": F.col("_header.company"), "place": F.lit(""), "raw_text": F.col("_start")}
    order, out = range(len(EXTRACTORS)), {}
    for n in ("title", "company", "place", "raw_text"):
        out[n] = F.when(seen, F.coalesce(*[value(i, n) for i in reversed(order)], F.col(f"_text.{n}"))).otherwise(F.coalesce(*[value(i, n) for i in order], guess[n]))
    sited = [value(i, "work_type") for i in (_GOOGLE, _DANFOSS, _DEMANT)]
    card = F.coalesce(value(_CARD, "work_type"), near)
    out["work_type"] = F.when(seen, F.coalesce(card, *reversed(sited), F.col("_text.work_type"))).otherwise(F.coalesce(*sited, card, F.lit("Unknown")))
    rows = grouped.select(key, "link", *[c.alias(n) for n, c in out.items()], U.provider(F.col("link")).alias("source"))
    rows = rows.withColumn("company", F.when(F.col("source") == "Getinge", "Getinge").otherwise(F.col("company")))
    return rows.where(~boilerplate(F.col("source"), F.col("title"), F.col("company"), F.col("place")))
