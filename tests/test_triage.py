"""The triage engine: golden cases, and every registered query with SQL against DuckDB."""

import collections

import duckdb
import pytest
from pyspark.sql import functions as F

from triagemill.functions import text as X
from triagemill.functions import urls as U
from triagemill.operators import triage as T
from triagemill.plans import queries as Q
from triagemill.profile import Profile, skill_regex
from triagemill.sources import mail
from triagemill.streaming import inbox

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (X.title_key, "Senior Data-Engineer (m/f)", "seniordataengineermf"), (X.company_key, "Acme Group A/S", "acme"), (X.company_key, "Group A/S", "groupas"),
        (X.clean_title, "Data Engineer (Data Engineer)", "Data Engineer"), (X.clean_title, "Engineer (Cph", "Engineer"), (X.clean_title, "Engineer Original title: X", "Engineer"),
        (X.skill_name, "- Strong experience with Python (3+ years)", "python"), (X.skill_name, "3d modelling", "d modelling"), (X.split_skills, "Python; SQL/ETL\nPython", ["python", "sql", "etl"]),
        (lambda c: X.learning_tokens(c, ("and",)), "C++ and node.js developers, AI.", ["c++", "node.js", "developers"]), (X.work_type, "hybrid or remote", "Hybrid"),
        (U.normalize, "https://www.linkedin.com/comm/jobs/view/42?x=1", "https://www.linkedin.com/jobs/view/42"), (U.normalize, "https://x.dk/a/b/?q=1#f", "https://x.dk/a/b"), (U.normalize, "https://www.jobindex.dk/c?t=h123", "https://www.jobindex.dk/jobannonce/h123"),
        (U.provider, "https://www.example.com/a", "example.com"), (U.provider, "", "Unknown"), (X.low_quality, "go go go go go", True), (X.title_key, None, ""), (U.is_job_link, None, False),
        (U.links_in, "see http://a.b/c). and http://a.b/c", ["http://a.b/c"]),
    ],
)
def test_golden(spark, f, given, expected):
    assert one(spark, f, given) == expected


def test_score(spark):
    profile = Profile(include_keywords=("data", "ai"), exclude_keywords=("sales",), user_skills=("python",), known_skill_patterns=(("python", r"\bpython\b"), ("sql", r"\bsql\b")))
    assert one(spark, lambda c: T.score(c, profile), "Data engineer, Python and SQL; no sales") == pytest.approx(0.55)


def test_profile():
    profile = Profile.load('{"user_skills": ["Go", "go ", ""], "min_score": "x", "known_skill_patterns": [{"name": "a", "pattern": "("}, {"name": "b", "pattern": "b"}], "other": 1}')
    assert (profile.user_skills, profile.min_score, profile.known_skill_patterns) == (("go",), 2.0, (("a", "("), ("b", "b")))
    assert Profile.load(profile.dump()) == profile and Profile.load("{").min_score == 2.0
    assert skill_regex("Data  Science") == r"\bdata\s+science\b"


def test_learn_keywords(spark):
    rows = spark.createDataFrame([(1, "spark etl", 1), (2, "spark", 1), (3, "nurse", 0), (4, "nurse etl", 0)], "id long, text string, relevant int")
    assert {(r.kind, r.token) for r in T.learn_keywords(rows, ()).collect()} == {("include", "spark"), ("exclude", "nurse")}


def test_merge_duplicates(spark):
    rows = [(1, "k", "Acme", "Data Engineer", "Unknown", "abc", 1, 0, 1), (2, "k", "Acme A/S", "Data engineer", "Aarhus", "ab", 0, 0, 2), (3, "", "B", "T", "X", "r", 0, 0, 0)]
    jobs = spark.createDataFrame(rows, "id long, key string, company string, title string, place string, raw_text string, viewed int, applied int, rank int")
    found = {r.id: r for r in T.merge_duplicates(jobs, "key", F.col("rank")).collect()}
    assert set(found) == {2, 3}
    assert (found[2].company, found[2].place, found[2].raw_text, found[2].viewed, found[2].rows) == ("Acme A/S", "Aarhus", "abc", 1, 2)


def test_feedback_fold_batch_and_stream_agree(spark, tmp_path):
    log = [(1, 1, 1, "applied_on"), (1, 2, 2, "viewed_off"), (2, 1, 3, "applied_on"), (2, 2, 4, "not_relevant"), (3, 5, 5, "applied_off"), (3, 4, 6, "applied_on")]
    frame = spark.createDataFrame(log, "job_id long, ts long, event_id long, event string")
    batch = {tuple(r) for r in T.fold_feedback(frame).collect()}
    assert batch == {(1, 0, 0, 1, "relevant", "manual_feedback=relevant"), (2, 1, 0, 0, "not relevant", "manual_feedback=not relevant"), (3, 1, 0, 1, "relevant", "manual_feedback=relevant")}
    frame.orderBy(F.rand(3)).repartition(3).write.parquet(str(tmp_path / "log"))
    stream = inbox.fold_state(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")))
    running = stream.writeStream.format("memory").queryName("fold").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert {tuple(r) for r in spark.table("fold").collect()} == batch


def test_mail_and_pages(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"Subject: =?utf-8?q?Job_=C3=A9?=\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nHello http://x.dk/1). bye\r\n")
    (tmp_path / "b.HTML").write_text("<html><head><title>T</title><style>x{}</style></head><body><h1>H</h1><a href='u'>one</a><a href='u'>two</a></body></html>")
    (tmp_path / "c.txt").write_text("no")
    rows = {r.path.rsplit("/", 1)[1]: r for r in mail.load_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.eml", "b.HTML"}
    assert (rows["a.eml"].title, rows["a.eml"].links) == ("Job é", ["http://x.dk/1"])
    assert (rows["b.HTML"].title, rows["b.HTML"].links, rows["b.HTML"].text) == ("T", ["u", "u"], "T\nH\none\ntwo")


def test_merge_patterns(spark):
    schema = "name_key string, name string, pattern string, source string, occurrences long, weight double"
    old = spark.createDataFrame([("a", "A", "pa", "", 2, 1.0), ("b", "B", "pb", "seed", 1, 1.0)], schema)
    change = spark.createDataFrame([("a", "a2", " ", "learned", -3, 2.0), ("c", "C", "pc", "learned", 1, 1.0)], schema)
    assert {tuple(r) for r in T.merge_patterns(old, change).collect()} == {("a", "a2", "pa", "learned", 2, 3.0), ("b", "B", "pb", "seed", 1, 1.0), ("c", "C", "pc", "learned", 1, 1.0)}


def test_missing_skills_behind_many_own(spark, monkeypatch):
    own = tuple(f"skill{i:02d}" for i in range(30))
    profile = Profile(user_skills=tuple(x.upper() for x in own), blocked_skills=("Barred",), known_skill_patterns=tuple((x, ".") for x in own) + (("barred", "."), ("rest", "rest"), ("license", "license")))
    monkeypatch.setattr(Q, "PROFILE", profile)
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1"), "doc_id")
    expected = {w: docs.where(F.lower("text").contains(w)).count() for w in ("rest", "license")}
    assert {tuple(r) for r in Q.missing_skills(spark, SF).collect()} == {(w, n) for w, n in expected.items() if n} != set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    found = Q.QUERIES[name](spark, SF)
    if name not in Q.ORACLE_SQL:
        assert found.count() > 0
        return
    expected = duck.execute(Q.ORACLE_SQL[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    rows = lambda frame: collections.Counter(tuple(str(x) for x in r) for r in frame[columns].itertuples(index=False))
    assert rows(found.toPandas()) == rows(expected)
