"""The commands, the store and the server on small folders."""

import json
import threading
import urllib.request
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from triagemill import commands, serve
from triagemill.operators import skills, state
from triagemill.profile import Profile
from triagemill.sources import pages
from triagemill.store import Conflict, Store

MAIL = b"""Subject: New jobs in Beta today
Content-Type: multipart/alternative; boundary=b

--b
Content-Type: text/plain; charset=utf-8

Job alert
Data Engineer 7
Acme Group
Aarhus, Denmark
Remote with Python
View job: https://www.linkedin.com/comm/jobs/view/7?trk=x
--b
Content-Type: text/html; charset=utf-8

<a href="https://jobs.danfoss.com/job/9/">Nurse</a><a href="https://x.dk/">other</a>
--b--
"""


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("commands")
    (root / "inbox").mkdir()
    (root / "inbox" / "a.eml").write_bytes(MAIL)
    profile = Profile(include_keywords=("data", "python"), user_skills=("python",), known_skill_patterns=(("python", r"\bpython\b"), ("(", "(")))
    commands.save_profile(str(root / "p.json"), profile)
    args = ["--profile", str(root / "p.json"), "--db", str(root / "db")]
    assert commands.run(spark, ["process-inbox", *args, "--inbox", str(root / "inbox"), "--report-dir", str(root / "out"), "--delete-processed"]) == 0
    return root


def jobs_of(spark, folder):
    return {r.position_link.rsplit("/", 1)[1]: r for r in Store(spark, str(folder / "db")).read("jobs").collect()}


def test_process_inbox(spark, folder):
    found = jobs_of(spark, folder)
    assert (found["7"].title, found["7"].company, found["7"].place, found["7"].work_type, found["7"].source) == ("Data Engineer 7", "Acme Group", "Aarhus, Denmark", "Remote", "LinkedIn")
    assert found["7"].relevant == 1 and found["7"].relevance_score == pytest.approx(1.5 * 2 + 1.2) and "matched_skills=['python']" in found["7"].relevance_reason
    assert (found["9"].title, found["9"].company, found["9"].category) == ("Nurse", "Danfoss", "not relevant") and found["7"].description
    assert not (folder / "inbox" / "a.eml").exists()
    page = (folder / "out" / "report.html").read_text()
    assert "Data Engineer 7" in page and "1/1" in page and "Skills" in page


def test_taken_twice_changes_nothing(spark, folder):
    store, before = Store(spark, str(folder / "db")), jobs_of(spark, folder)
    (folder / "again").mkdir()
    (folder / "again" / "a.eml").write_bytes(MAIL)
    counted = commands.process_inbox(spark, store, str(folder / "again"), commands.load_profile(str(folder / "p.json")))
    assert [tuple(r)[1:] for r in counted.collect()] == [(2, 0, 2)] and {k: r.id for k, r in jobs_of(spark, folder).items()} == {k: r.id for k, r in before.items()}


def test_server(spark, folder):
    app = serve.App(Store(spark, str(folder / "db")), str(folder / "p.json"), str(folder / "out"))
    number = jobs_of(spark, folder)["7"].id
    assert app.post("/api/none", {})[0] == 404 and app.post("/api/viewed", {"job_id": number, "viewed": 1})[0] == 400 and app.post("/api/viewed", {"viewed": True})[0] == 400
    assert app.post("/api/viewed", {"job_id": -1, "viewed": True})[0] == 404 and app.post("/api/feedback", {"job_id": number, "signal": "x"})[0] == 400
    assert app.post("/api/applied/raw-text", {"job_id": number, "text": "more"})[0] == 404
    with serve.server(app, "127.0.0.1", 0) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()
        root = f"http://127.0.0.1:{http.server_address[1]}"
        call = lambda path, body: json.load(urllib.request.urlopen(urllib.request.Request(root + path, json.dumps(body).encode())))
        assert call("/api/applied", {"job_id": number, "applied": True})["ok"]
        assert "Data Engineer 7" in urllib.request.urlopen(root + "/company.html?company=acme%20GROUP").read().decode()
        http.shutdown()
    r = jobs_of(spark, folder)["7"]
    assert (r.applied, r.viewed, r.relevance_reason) == (1, 1, "manual_feedback=relevant")
    assert app.post("/api/applied/raw-text", {"job_id": number, "text": "They want Python."})[1]["manual_text_added"]
    assert state.MANUAL_MARK in jobs_of(spark, folder)["7"].raw_text
    assert app.post("/api/skill/user", {"skill": "Go", "has_skill": True})[1]["changed"] and "go" in app.profile().user_skills
    assert app.post("/api/skill/block", {"skill": "Python"})[1]["deleted_patterns"] == 1 and "python" in app.profile().blocked_skills


def test_rebuilds_are_put_together():
    begun, go, runs = threading.Event(), threading.Event(), []

    def job():
        runs.append(1)
        begun.set()
        go.wait(10)
        if len(runs) == 1:
            raise OSError

    r = serve.Rebuilder(job, pause=0)
    r.ask()
    begun.wait(10)
    for _ in range(5):
        r.ask()
    go.set()
    while r.running:
        pass
    assert r.runs == 2 and len(runs) == 3 and r.error is None


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read("jobs").isEmpty() and store.version() == 0
    first = store.commit({"job_skills": spark.createDataFrame([(1, 2)], state.JOB_SKILLS)})
    store.commit({"job_skills": spark.createDataFrame([(3, 4)], state.JOB_SKILLS)}, first)
    assert [tuple(r) for r in store.read("job_skills").collect()] == [(3, 4)] and [tuple(r) for r in store.read("job_skills", first).collect()] == [(1, 2)]
    with pytest.raises(Conflict):
        store.commit({}, first)


def test_other_commands(spark, folder, tmp_path, capsys):
    args = ["--profile", str(folder / "p.json"), "--db", str(folder / "db")]
    (tmp_path / "CV").mkdir()
    (tmp_path / "CV" / "a.md").write_text("Requirements: Kafka and SQL.")
    (tmp_path / "CV" / "b.png").write_text("Requirements: Images.")
    assert commands.run(spark, ["sync-user-skills", *args, "--cv", str(tmp_path / "CV")]) == 0 and {"kafka", "sql"} <= set(commands.load_profile(str(folder / "p.json")).user_skills)
    assert pages.cv_text(spark, str(tmp_path / "CV"), 12).startswith("\n\n[CV_FILE") and pages.cv_text(spark, "") == ""
    assert commands.run(spark, ["dedupe-jobs", *args]) == 0 and commands.run(spark, ["cleanup-skills", *args, "--dry-run"]) == 0 and commands.run(spark, ["refresh-descriptions", *args, "--overwrite"]) == 0
    (tmp_path / "mails").mkdir()
    (tmp_path / "mails" / "a.eml").write_bytes(MAIL)
    assert commands.run(spark, ["report-links", "--profile", "", str(tmp_path / "mails")]) == 0 and "danfoss" in capsys.readouterr().out
    assert commands.run(spark, ["init-profile", "--path", str(folder / "p.json")]) == 1 and commands.run(spark, ["summarize-file", "--path", "x"]) == 1
    (tmp_path / "in.jsonl").write_text('{"title": "A <b>"}\n\nbroken\n')
    assert commands.run(spark, ["render-html", "--input", str(tmp_path / "in.jsonl"), "--out", str(tmp_path / "o.html")]) == 0 and "A &lt;b&gt;" in (tmp_path / "o.html").read_text()
    assert commands.remaining(1, 10, 400.0) == "1h00m" and commands.remaining(5, 10, 5.0) == "5s" and not commands.model_file_fits("detect", str(tmp_path / "in.jsonl"))


def test_pages(spark):
    rows = spark.createDataFrame([(1, "https://www.linkedin.com/jobs/view/1"), (2, "https://www.linkedin.com/jobs/view/1"), (3, "ftp://x"), (4, "https://broken"), (5, None)], "id int, link string")
    fetch = lambda x: ("text/html", b"<p>Hi</p><script>x</script><a class='public_jobs_apply-link-onsite'>go</a>") if "linkedin" in x else 1 / 0
    found = {r.id: (r.page_text, r.easy_apply) for r in pages.fetch_pages(rows, "link", fetch).collect()}
    assert found == {1: ("Easy Apply Hi go", True), 2: ("Easy Apply Hi go", True), 3: ("", False), 4: ("", False), 5: ("", False)}
    assert {r.page_text for r in pages.fetch_pages(rows, "link", None).collect()} == {""}


def test_skills_of_answers(spark):
    answer = '{"matched_known": ["Python", "unknown"], "new_candidates": [{"name": "Rust", "confidence": 0.95, "evidence": ""}, {"name": "Cobol", "confidence": 0.5, "evidence": ""}]}'
    profile = Profile(known_skill_patterns=(("python", r"\bpython\b"), ("sql", r"\bsql\b")), blocked_skills=("sql",))
    rows = spark.createDataFrame([(1, "Requirements: Python, Rust and Cobol"), (2, "SQL is required"), (3, "cached")], "id int, text string")
    cached = spark.createDataFrame([(3, ["kept"])], "id int, skills array<string>")
    model = lambda: lambda texts: [answer if "Rust" in t else "no" for t in texts]
    found = {r.id: r.skills for r in skills.skills_of(rows, "text", profile, model, cached).collect()}
    assert found[1] == ["python", "rust"] and found[3] == ["kept"] and "sql" not in found[2]


def test_the_rest_stands_without_the_corpus_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    for pipeline in (True, False):
        copy = tmp_path / str(pipeline)
        shutil.copytree(root / "triagemill", copy / "triagemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(root / "__spark_entry__.py", copy)
        if pipeline:
            shutil.copy(root / "corpus_pipeline.py", copy)
        said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(x.startswith('op') for x in e.queries()), 'pipeline' in e.queries())"], cwd=copy, capture_output=True, text=True)
        n, n_sql, corpus, there = said.stdout.split()
        assert int(n) >= 71 and int(n_sql) >= 60 and corpus == "0" and there == "False", said.stderr


def test_one_run_learns_skills_titles_and_patterns(spark, tmp_path, monkeypatch):
    (tmp_path / "inbox").mkdir()
    for i, name in enumerate(("Sygeplejerske", "Pilot", "Kok")):
        (tmp_path / "inbox" / f"{i}.eml").write_bytes(f'Subject: Jobs\nContent-Type: text/html\n\n<p><a href="https://jobs.danfoss.com/job/{i}">{name}</a></p>'.encode())
    answer = '{"matched_known": ["Python"], "new_candidates": []}'
    # Of the skills' model every job asks for Python and for something new.
    monkeypatch.setitem(commands.MODELS, "skills", lambda: lambda texts: [answer if "Kok" in t else "Python, COBOL" for t in texts])
    monkeypatch.setitem(commands.MODELS, "translate", lambda: lambda texts: ["Nurse" if "Syge" in t else t for t in texts])
    store, profile = Store(spark, str(tmp_path / "db")), Profile(include_keywords=("sygeplejerske", "pilot", "kok"), exclude_keywords=(), min_score=1.0)
    counted = commands.process_inbox(spark, store, str(tmp_path / "inbox"), profile)
    assert counted.count() == 3
    jobs = {r.title: r for r in store.read("jobs").collect()}
    assert {t: r.title_english for t, r in jobs.items()} == {"Sygeplejerske": "Nurse", "Pilot": "", "Kok": ""} and all(r.relevant for r in jobs.values())
    assert sorted(r.id for r in jobs.values()) == [1, 2, 3]
    found = {r.job_id: r.skills for r in state.job_skills(store.read("job_skills"), store.read("skill_patterns")).collect()}
    assert all("python" in [s.lower() for s in found[r.id]] for r in jobs.values())
    python = store.read("skill_patterns").where("name_key = 'python'").first()
    assert (python.occurrences, python.weight, python.enabled) == (3, 3.0, 1)
    # Blocked or unwanted ones go by one join.
    patterns, links = state.delete_skills(store.read("skill_patterns"), store.read("job_skills"), spark.createDataFrame([("PYTHON",), ("none",)], "name string"))
    assert patterns.where("name_key = 'python'").count() == 0 and links.count() == store.read("job_skills").count() - 3
