"""Entries out of pages, models behind the interface, and the report."""

import collections
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from triagemill.operators import extract, models
from triagemill.plans import queries, report

SF = "/root/testdata/sf0.01"

VIEW = "https://www.linkedin.com/comm/jobs/view/"
PAGES = {
    "card": f'<table><tr><td><a href="{VIEW}42?x=1"><b>Data Engineer</b><i>Acme · Aarhus (Remote)</i></a></td></tr></table><a href="{VIEW}42">Data Engineer</a>',
    "dash": f'<div><a href="{VIEW}7">Analyst - Aarhus, Denmark</a><script>hybrid</script></div>',
    "filled": f'<ul><li>Engineer Acme Corp · Odense (Hybrid) promoted by us <a href="{VIEW}8">Engineer · </a></li></ul>',
    "index": '<table><tr><td><a href="https://www.jobindex.dk/c?t=h123">View job</a><a href="https://www.jobindex.dk/jobannonce/h123">Data (C++) Engineer</a><a href="https://acme.dk">Acme</a>'
    '<a href="https://www.jobindex.dk/bruger/dine-job/h123">Engineer</a></td></tr></table>',
    "place": '<table><tr><td><a href="https://acme.dk">Acme</a><a href="https://www.jobindex.dk/jobannonce/r9">Nurse</a> Aarhus C 12 min (settings) We need you. PUBLISHED: today</td></tr></table>',
    "demant": '<a href="https://careers.demant.com/x/job/a?q=1">Engineer - Smørum - Denmark</a>',
    "danfoss": '<a href="https://jobs.danfoss.com/job/1">Old</a><a href="https://jobs.danfoss.com/job/1/">Welder</a><a href="https://jobs.danfoss.com/job/2"></a>',
    "google": '<tr><td><a href="https://careers.google.com/about/jobs/results/123-x">Writer</a> Google – Copenhagen, Denmark 3 days ago Apply</td></tr>',
    "none": '<a href="https://example.com/job/1">Nothing</a><a name="x">y</a><p>unclosed <b>',
    "empty": "",
    "null": None,
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame(list(PAGES.items()), "id string, html string").withColumn("title", F.lit("clash"))
    return extract.links(rows, "id").cache()


def by_link(df, *fields):
    return {(r.id, r.link.rsplit("/", 1)[1]): tuple(r[f] for f in fields) for r in df.collect()}


def test_cards(found):
    got = by_link(extract.card_entries(found.where("id IN ('card', 'dash', 'filled')"), "id"), "title", "company", "place", "work_type", "raw_text")
    assert got == {
        ("card", "42"): ("Data Engineer", "Acme", "Aarhus", "Remote", "Data Engineer | Acme · Aarhus (Remote)"),
        ("dash", "7"): ("Analyst", "", "Aarhus, Denmark", "", "Analyst - Aarhus, Denmark"),
        ("filled", "8"): ("Engineer ·", "Engineer", "Odense", "Hybrid", "Engineer ·"),
    }


def test_sites(found):
    got = by_link(extract.jobindex_entries(found, "id"), "title", "company", "place", "raw_text")
    assert got[("index", "h123")][:3] == ("Data (C++) Engineer", "Acme", "")
    assert got[("place", "r9")] == ("Nurse", "Acme", "Aarhus C", "We need you.\n\nAcme Nurse Aarhus C 12 min (settings) We need you. PUBLISHED: today")
    assert by_link(extract.demant_entries(found, "id"), "title", "company", "place") == {("demant", "a"): ("Engineer", "Demant Group", "Smørum - Denmark")}
    assert by_link(extract.danfoss_entries(found, "id"), "title", "company", "place") == {("danfoss", "1"): ("Welder", "Danfoss", "")}
    assert by_link(extract.google_entries(found, "id"), "title", "company", "place") == {("google", "123-x"): ("Writer", "Google", "Copenhagen, Denmark")}


def test_entries_of_all_sites(spark):
    rows = spark.createDataFrame(list(PAGES.items()), "id string, html string")
    got = by_link(extract.entries(rows, "id"), "title", "company", "source")
    assert set(got) == {("card", "42"), ("dash", "7"), ("filled", "8"), ("index", "h123"), ("place", "r9"), ("demant", "a"), ("danfoss", "1"), ("danfoss", "2"), ("google", "123-x")}
    assert got[("demant", "a")] == ("Engineer", "Demant Group", "Demant")
    assert extract.entries(rows.limit(0), "id").count() == 0


def test_page_entries_keeps_every_link(spark):
    class Anchors(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a" and dict(attrs).get("href") is not None:
                self.found.add(dict(attrs)["href"])

    expected = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        parser = Anchors()
        parser.found = set()
        parser.feed(r.html)
        if parser.found:
            expected[r.page_id] = len(parser.found)
    rows = queries.page_entries(spark, SF).collect()
    assert collections.Counter(r.page_id for r in rows) == expected and len({(r.page_id, r.link) for r in rows}) == len(rows)
    assert {r.source for r in rows} == {"Google Careers", "Danfoss", "Demant", "Jobindex", "LinkedIn"}


def test_models(spark):
    # Made here, so that workers needn't import this module.
    detector = lambda: lambda texts: ["da" if "og" in t.split() else "en" for t in texts]
    shout = lambda: lambda texts: [t.upper() for t in texts]
    rows = spark.createDataFrame([(1, "kat og hund"), (2, "cat and dog"), (3, None), (4, "og"), (5, "kat og hund")], "id int, text string")
    assert [r.text for r in models.translate(rows, "text", detector, shout).orderBy("id").collect()] == ["KAT OG HUND", "cat and dog", None, "og", "KAT OG HUND"]
    titled = models.translate_titles(rows, "text", lambda: lambda texts: ["Cat and mouse" if "kat" in t else t for t in texts]).orderBy("id").collect()
    assert [r.title_english for r in titled] == ["Cat and mouse", "", "", "", "Cat and mouse"]
    told = models.describe(rows, "text", lambda: lambda texts: ["go go go go go" if "cat" in t else "fine" for t in texts]).orderBy("id").collect()
    assert [r.description for r in told] == ["fine", "cat and dog", "", "fine", "fine"]


@pytest.mark.parametrize("text", ["", "one two", "a " * 900, "x" * 1200 + " y", "Some words. " * 90 + "\n\nmore"])
def test_pieces_keep_words(text):
    parts = models.pieces(text)
    assert " ".join(parts).split() == text.split()
    assert all(len(p) <= models.CHUNK or " " not in p for p in parts)


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([("A <b>", "https://x/1", 1.25, 1), (None, "javascript:x", 0.0, 0)], "title string, position_link string, relevance_score double, viewed int")
    path = str(tmp_path / "r.html")
    report.write(path, "Jobs & more", [("Relevant", rows, 9)])
    page = open(path, encoding="utf-8").read()
    assert "Jobs &amp; more" in page and "A &lt;b&gt;" in page and "1.25" in page and "2/9" in page and "javascript" not in page and "(untitled)" in page
