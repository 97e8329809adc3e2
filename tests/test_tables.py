"""Patterns as a table, nearest tokens, upserts by buckets, table functions and formats."""

import collections
import random
import re
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from triagemill.functions import tables
from triagemill.functions import text as X
from triagemill.operators import models, offsets, state
from triagemill.operators import patterns as P
from triagemill.operators import triage as T
from triagemill.profile import Profile
from triagemill.scratch import numbered
from triagemill.sources import fetching
from triagemill.sources.anchors import outline


def test_required_strings_are_held_by_every_match():
    rng = random.Random(2)
    atoms = ["a", "b", "K", "s", "k", "\\b", "\\.", ".", "[ab]", "(?:ab|c)", "a*", "b+", "c?", "s{2}", "a{0,1}", "^", "$", "|", "é", "i", "\\s", " ", "(c)", "(?=a)", "(?!b)", "_", "1"]
    for n in range(6000):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 7))) if n % 3 else rf"\b{''.join(rng.choice('abk s_1i') for _ in range(rng.randrange(1, 4)))}\b"
        text = "".join(rng.choice("abcsk ſıikKé.SA_1²") for _ in range(rng.randrange(0, 9)))
        try:
            found = re.compile(pattern, re.I).search(text.lower()) if text else None
        except re.error:
            found = None
        assert P.Matcher([pattern]).find(text) == ([(found.start(), 0)] if found else []), (pattern, text)


PATTERNS = [(0, "SQL", r"\bSQL\b", 5), (1, "sql ", r"\bsql\b", 4), (2, "Broken", "(x", 1), (3, "C++", r"\bc\+\+", 2), (4, "any", r"\w+", 3), (5, "é", "É", 6), (6, " ", "know", 0)]


def test_pattern_table_by_broadcast_and_by_shards(spark):
    rows = spark.createDataFrame([(1, "I know SQL and C++"), (2, None), (3, ""), (4, "CAFÉ sql"), (5, "x" * 5000 + " sql")], "id long, text string")
    patterns = spark.createDataFrame(PATTERNS, "pid long, name string, pattern string, ord long")
    expected = {1: ["any", "sql ", "SQL", "C++"], 2: [], 3: [], 4: ["any", "é", "sql ", "SQL"], 5: ["any", "sql ", "SQL"]}
    names = {1: ["any", "sql", "C++"], 2: [], 3: [], 4: ["any", "é", "sql"], 5: ["any", "sql"]}
    for most in (None, 2):
        found = P.find_patterns(rows, "id", F.col("text"), patterns, most, part_texts=2)
        got = {r.id: [x.name for x in r._found if x.name != " "] for r in found.collect()}
        assert got == expected
        assert {r.id: r.n for r in found.select("id", P.names_found(F.col("_found")).alias("n")).collect()} == names
    scored = T.scored(rows, Profile(include_keywords=(), exclude_keywords=(), user_skills=("sql",)), F.col("text"), patterns=patterns)
    assert {r.id: round(r.relevance_score, 6) for r in scored.collect()} == {1: 0.9, 2: 0.0, 3: 0.0, 4: 0.9, 5: 1.05}


def test_very_many_patterns(spark):
    rows = spark.range(200).select("id", F.concat(F.lit("Word"), F.col("id"), F.lit("x and WORD"), F.col("id") * 7, F.lit("x")).alias("text"))
    patterns = spark.range(100_000).select(F.col("id").alias("pid"), F.concat(F.lit("w"), "id").alias("name"), F.concat(F.lit(r"\bword"), "id", F.lit(r"x\b")).alias("pattern"), F.col("id").alias("ord"))
    found = P.with_skills(rows, "id", F.col("text"), patterns, "skills").collect()
    assert {r.id: r.skills for r in found} == {i: [f"w{i}", f"w{7 * i}"] if i else ["w0"] for i in range(200)}


def test_pattern_table_of_the_state(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    none = spark.createDataFrame([], state.SKILL_PATTERNS)
    profile = Profile(blocked_skills=("rust",))
    assert state.pattern_table(none, profile).count() == len(profile.known_skill_patterns) - 1
    stored, links = state.set_job_skills(none, spark.createDataFrame([], state.JOB_SKILLS), spark.createDataFrame([(1, "C++ templates"), (1, "node.js")], "job_id long, name string"), now)
    table = state.pattern_table(stored, profile)
    found = P.with_skills(spark.createDataFrame([(1, "We use C++  Templates, NODE.JS and nodexjs")], "id long, text string"), "id", F.col("text"), table, "s").first().s
    assert found == ["c++ templates"] or found == ["c++ templates", "node.js"]
    assert links.count() == 2


def brute_nearest(text, needle, tokens, reach):
    low, best = text.lower(), None
    for i, words in enumerate(tokens.values()):
        places = [m.start() for w in words for m in re.finditer(rf"\b{re.escape(w)}\b", low)]
        for m in re.finditer(re.escape(needle), low):
            for p in places:
                best = min(best or (1 << 60, 0), (abs(p - m.start()), i))
    return list(tokens)[best[1]] if best and best[0] <= reach else None


def test_nearest_token(spark):
    rng, tokens = random.Random(4), {"H": ("hy",), "R": ("re",), "O": ("on-site", "onsite")}
    texts = [" ".join(rng.choice(["hy", "RE", "on-site", "onsite", "x.y", "zz", "hyre", "long word here"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, "", "x.y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.token for r in offsets.nearest_token(rows, "id", F.col("text"), F.lit("x.y"), tokens, 25).collect()}
    expected = {i: brute_nearest(t or "", "x.y", tokens, 25) for i, t in enumerate(texts)}
    assert got == {i: t for i, t in expected.items() if t}


def test_nearest_token_of_very_many_places_takes_seconds(spark):
    text = "needle and the " * 100_000
    start = time.time()
    assert offsets.nearest_token(spark.createDataFrame([(1, text)], "id long, text string"), "id", F.col("text"), F.lit("needle"), {"the": ("the",), "and": ("and",)}).collect() == [(1, "the")]
    assert time.time() - start < 60


def test_work_types_of_links_whose_numbers_begin_alike(spark):
    html = "hybrid /jobs/view/12" + " " * 50 + "/comm/jobs/view/123 remote" + " " * 9000 + "/jobs/view/77"
    wanted = spark.createDataFrame([(1, "12"), (1, "123"), (1, "77"), (1, "9")], "id long, number string")
    pages = spark.createDataFrame([(1, html)], "id long, html string")
    found = offsets.work_types(pages, "id", F.col("html"), wanted, {"Hybrid": ("hybrid",), "Remote": ("remote",)}, 6000)
    assert {(r.number, r.work_type) for r in found.collect()} == {("12", "Hybrid"), ("123", "Remote")}


def job_rows(spark, n):
    columns = [f"{e} AS {c}" for c, e in {"source": "'LinkedIn'", "company": "concat('C', id)", "title": "concat('T', id)", "place": "''", "work_type": "''", "position_link": "concat('https://x.dk/job/', id)", "raw_text": "'r'"}.items()]
    return spark.range(n).selectExpr("id AS ord", *columns)


def test_few_links_rewrite_few_buckets(spark, tmp_path):
    now, path = F.lit("2024-01-01").cast("timestamp"), str(tmp_path / "jobs")
    state.write_buckets(spark.createDataFrame([], state.JOBS), path, 64)
    Path(path).mkdir(exist_ok=True)
    written, outcomes = state.upsert_buckets(spark, path, job_rows(spark, 500), now, 64)
    assert written == 64 and outcomes.where("outcome = 'inserted'").count() == 500
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(path).glob("bucket=*/*.parquet")}
    before = files()
    # Ten links: eight new ones, a known one, and another source's posting of a known job.
    batch = job_rows(spark, 510).where("ord >= 499").where("ord <> 508")
    batch = batch.withColumn("company", F.when(F.col("ord") == 509, "C3").otherwise(F.col("company"))).withColumn("title", F.when(F.col("ord") == 509, "T3").otherwise(F.col("title"))).withColumn("source", F.when(F.col("ord") == 509, "Jobindex").otherwise(F.col("source")))
    written, outcomes = state.upsert_buckets(spark, path, batch, now, 64)
    after = files()
    changed = {p.parent.name for p in before.keys() ^ after.keys()} | {p.parent.name for p in before.keys() & after.keys() if before[p] != after[p]}
    assert len(changed) == written <= 10
    assert {r.outcome: r["count"] for r in outcomes.groupBy("outcome").count().collect()} == {"inserted": 8, "known": 1, "merged": 1}
    table = state.read_buckets(spark, path)
    assert table.count() == 508 and table.select("id").distinct().count() == 508 and table.agg(F.max("id")).first()[0] == 508
    assert table.where("title = 'T3'").first().source == "Jobindex"
    # What is applied twice changes nothing.
    state.apply_changes(spark, path, table.where("id < 5").drop("bucket"), 64)
    assert state.read_buckets(spark, path).count() == 508


def test_upsert_of_one_hot_link_and_of_rows_without_a_key(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    rows = job_rows(spark, 60).withColumn("position_link", F.when(F.col("ord") % 3 == 0, "https://x.dk/job/hot").otherwise(F.col("position_link"))).withColumn("company", F.when(F.col("ord") % 2 == 0, "").otherwise(F.col("company")))
    after, outcomes = state.upsert(spark.createDataFrame([], state.JOBS), rows, now)
    assert after.count() == 41 and sorted(r.id for r in after.select("id").collect()) == list(range(1, 42))
    assert outcomes.where("outcome = 'known'").count() == 19


def test_rows_without_a_merge_key_stay(spark):
    rows = spark.createDataFrame([(1, None), (2, "k"), (3, "k"), (4, "")], "id long, key string").withColumns({c: F.lit("") for c in ("company", "title", "place", "work_type", "raw_text")} | {c: F.lit(0) for c in ("viewed", "applied")})
    assert sorted(r.id for r in T.merge_duplicates(rows, "key", F.lit(1)).collect()) == [1, 2, 4]


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select(F.xxhash64("id").alias("x"))
    got = [r.n for r in numbered(rows, [F.col("x")], "n").orderBy("x").collect()]
    assert got == list(range(1, 1001))


@pytest.mark.parametrize("x", [2.25, 2.35, 0.15, -0.04, 0.0, 1e6 + 0.05, -2.25, 0.25, 0.35, 123.45, 9.95, -9.95])
def test_one_decimal(spark, x):
    assert spark.range(1).select(X.one_decimal(F.lit(x))).first()[0] == f"{x:.1f}"


def test_quoted(spark):
    words = ["a", "it's", 'say "x"', "both ' and \"", "back\\slash", "line\nbreak"]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(X.quoted(F.col("w"))).collect()] == [repr(w) for w in words]


def test_table_functions_say_what_the_expressions_say(spark):
    tables.register(spark)
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(["", " ", "a line", "see HTTP://x", "more words here. And so on!"]) for _ in range(rng.randrange(1, 30))) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines.createOrReplaceTempView("lines_in")
    docs.createOrReplaceTempView("docs_in")
    told = spark.sql("SELECT id, pos, candidates FROM line_context(TABLE(lines_in) PARTITION BY id ORDER BY pos)")
    assert sorted(told.collect()) == sorted(T.line_candidates(docs).select("id", "pos", "candidates").collect())
    chunks = spark.sql("SELECT id, pos, chunk FROM docs_in, LATERAL text_chunks(text, 40) ORDER BY id, pos").collect()
    assert [(r.id, r.chunk) for r in chunks] == [(i, c) for i, t in enumerate(texts) for c in models.pieces(t, 40)]
    spark.createDataFrame([(1, '<a href="x">A <b>b</b></a><a>no</a><p><a href="y"></a>')], "id long, html string").createOrReplaceTempView("pages_in")
    found = spark.sql("SELECT ord, href, text FROM pages_in, LATERAL page_links(html) ORDER BY ord").collect()
    assert [(r.ord, r.href, r.text) for r in found] == [(a["ord"], a["href"], a["text"]) for a in outline('<a href="x">A <b>b</b></a><a>no</a><p><a href="y"></a>')["anchors"]]


def test_pieces_of_a_text():
    assert models.pieces("one\ntwo\r\n\r\n  \nthree", 500) == ["one\ntwo", "three"]
    assert models.pieces("Aa bb. Cc dd. Ee", 10) == ["Aa bb.", "Cc dd. Ee"]
    # Words that fill a piece come before the sentences that wait, and these before the last words.
    assert models.pieces("Hi. aaaa bbbb cccc dddd", 10) == ["aaaa bbbb", "Hi.", "cccc dddd"]
    assert models.pieces("", 10) == [] and models.pieces("w" * 30, 10) == ["w" * 30]


def test_each_link_is_fetched_once_and_at_its_hosts_pace(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def stub(link):
        import time
        import uuid

        (log / uuid.uuid4().hex).write_text(f"{time.time()} {link}")
        if link.endswith("flaky") and sum(link in p.read_text() for p in log.iterdir()) < 2:
            raise OSError("later")
        return None if link.endswith("gone") else ("text/html", f"<p>page of {link}</p>".encode())

    links = [f"https://h{h}.dk/{i}" for h in range(3) for i in range(8)] + ["https://h1.dk/flaky", "https://h2.dk/gone", "ftp://x", None]
    rows = spark.createDataFrame([(x,) for x in [*links, *links]], "link string")
    cache = str(tmp_path / "pages")
    for extra in ([], ["https://h0.dk/new"]):
        asked = rows.unionByName(spark.createDataFrame([(x,) for x in extra], "link string"))
        got = {r.link: (bytes(r.body).decode(), r.ok) for r in fetching.fetch_new(asked, stub, cache, per_second=5.0, tries=3, tasks=2, rest=0.1).collect()}
        assert set(got) == {x for x in [*links, *extra] if x and x.startswith("http")}
        assert all(ok == (not x.endswith("gone")) and (not ok or body == f"<p>page of {x}</p>") for x, (body, ok) in got.items())
    said = sorted((float(t), x) for t, x in (p.read_text().split(" ", 1) for p in log.iterdir()))
    assert collections.Counter(x for _, x in said) == collections.Counter({**{x: 1 for x in links if x and x.startswith("http")}, "https://h1.dk/flaky": 2, "https://h2.dk/gone": 2, "https://h0.dk/new": 1})
    for host in ("h0", "h1", "h2"):
        times = [t for t, x in said if x.startswith(f"https://{host}.")]
        assert all(b - a > 0.15 for a, b in zip(times, times[1:]))


def test_keywords_by_broadcast_and_by_shards(spark):
    rng = random.Random(8)
    words = ["c++", "data", "at", "ata", "(x)", "é", "a b", "data data"]
    texts = ["".join(rng.choice(["data", " ", "C++", "(X)", "É", "a b", "zz"]) for _ in range(rng.randrange(0, 12))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    keywords = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "keyword string, ord long")
    expected = {i: [w for _, _, w in sorted((t.lower().find(w), k, w) for k, w in enumerate(words) if w in t.lower())] for i, t in enumerate(texts)}
    for most in (None, 3):
        assert {r.id: [x.name for x in r._found] for r in P.find_keywords(rows, "id", F.col("text"), keywords, most).collect()} == expected


def test_parts_get_the_patterns_their_texts_call_for(spark):
    """Beyond one automaton: rows without a key, patterns of more than one word, inside words, of several strings and of none, and orders that are structs."""
    listed = ["\\bmachine learning\\b", "(?<!\\w)KAFKA(?!\\w)", "sql", "rust|c\\+\\+", "\\bx\\d\\b", "\\w{9}", "[", "\\bdeep\\s+nets\\b", "é", "zzz"]
    texts = ["Machine Learning, MySQL and ſQL", "kafkas Kafka", None, "", "C++ x7", "deep \n nets", "É" * 3, "machinelearning rust"] * 3
    rows = spark.createDataFrame([(None if i % 3 else i, t) for i, t in enumerate(texts)], "id long, text string")
    patterns = spark.createDataFrame([(i, f"n{i}", p, (-(i % 3), f"{i}")) for i, p in enumerate(listed)], "pid long, name string, pattern string, ord struct<w:int,n:string>")
    spots = lambda t: sorted((m.start(), -(i % 3), i) for i, p in enumerate(listed) if p != "[" and (m := re.compile(p, re.I).search(t.lower())))
    expected = collections.Counter((t, tuple((at, f"n{i}") for at, _, i in spots(t or ""))) for t in texts)
    for most, part_texts in ((None, 2), (1, 5), (4, 2)):
        found = P.find_patterns(rows, "id", F.col("text"), patterns, most, part_texts=part_texts).collect()
        assert collections.Counter((r.text, tuple((x["at"], x["name"]) for x in r._found)) for r in found) == expected


def test_keywords_are_plain_strings(spark):
    """A letter that patterns take for another one without regard to case is not that one; copies in capitals are found, each by its name."""
    rows = spark.createDataFrame([(1, "ſql"), (2, "my SQL x.y"), (3, "xzy")], "id long, text string")
    keywords = spark.createDataFrame([(w, i) for i, w in enumerate(["sql", "SQL", "x.y", "ſ"])], "keyword string, ord long")
    for most in (None, 1):
        found = P.find_keywords(rows, "id", F.col("text"), keywords, most).collect()
        assert {r.id: [(x["at"], x["name"], x["first"]) for x in r._found] for r in found} == {1: [(0, "ſ", True)], 2: [(3, "sql", True), (3, "SQL", False), (7, "x.y", True)], 3: []}


def test_pages_are_handed_on_by_size(spark):
    """A batch of many pages is parsed and handed on in pieces, in order, and a large page alone."""
    from triagemill.sources import anchors, batches, mail

    pages = [None, "", *(f'<title>t{i}</title><a href="https://x.dk/{i}">{"w" * 5000}</a>' for i in range(1000)), "<p>" + "y" * (3 << 20), "z"]
    for out, size in (([*anchors.anchors.func(iter([pd.Series(pages)]))], "anchors"), ([*mail.parse_file.func(iter([(pd.Series(["a.html"] * len(pages)), pd.Series([p and p.encode() for p in pages]))]))], "links")):
        assert len(out) >= 6 and sum(map(len, out)) == len(pages) and max(map(len, out)) < 250
        assert [len(x or []) for frame in out for x in frame[size]] == [0, 0, *[1] * 1000, 0, 0]
    assert [*batches.pieces(pd.Series([], dtype=object))] == []
    rows = spark.createDataFrame(list(enumerate(pages)), "id long, html string").coalesce(1)
    found = rows.select("id", anchors.anchors("html").alias("p"), mail.parse_file(F.lit("a.html"), F.encode("html", "UTF-8")).alias("f")).select("id", F.size("p.anchors").alias("n"), "f.title").collect()
    assert {r.id: (r.n, r.title) for r in found if 1 < r.id < 1002} == {i + 2: (1, f"t{i}") for i in range(1000)} and len(found) == len(pages)
