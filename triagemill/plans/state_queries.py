"""Registered queries of links, titles, skills, mails and state, each with the SQL that says the same.

Bindings: rows of the test tables are dealt over lists of cases, whose expected values are written beside them; a job is a document
with fields made of its id, by expressions that both engines read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagemill.functions import text as X
from triagemill.functions import urls as U
from triagemill.operators import extract, skills, state
from triagemill.operators import triage as T
from triagemill.plans.registry import query, table
from triagemill.profile import Profile
from triagemill.scratch import numbered, shared_folder

#: (link, written anew, provider, is a job link); # is a number of 12 digits.
LINKS = (
    ("https://www.linkedin.com/comm/jobs/view/#?trk=a", "https://www.linkedin.com/jobs/view/#", "LinkedIn", True), ("https://thehub.io/jobs/#?x=1", "https://thehub.io/jobs/#", "The Hub", True),
    ("https://careers.google.com/About/jobs/results/#-Xy/?q=1", "https://careers.google.com/About/jobs/results/#-Xy", "Google Careers", True), ("https://www.google.com/about/careers/applications/jobs/results/#", "https://careers.google.com/about/careers/applications/jobs/results/#", "Google Careers", True),
    ("https://www.google.com/search?q=#", "https://www.google.com/search", "google.com", False), ("https://www.jobindex.dk/c?t=h#", "https://www.jobindex.dk/jobannonce/h#", "Jobindex", False),
    ("https://www.jobindex.dk/bruger/dine-job/r#?x", "https://www.jobindex.dk/jobannonce/r#", "Jobindex", True), ("https://www.jobindex.dk/img?ttid=#", "", "Jobindex", False), ("https://www.jobindex.dk/vis?jobid=H#&a=1", "https://www.jobindex.dk/jobannonce/h#", "Jobindex", True),
    ("https://careers.nordea.com/job/Oslo-X/#/?s=1", "https://careers.nordea.com/job/Oslo-X/#", "Nordea", True), ("http://careers.novonordisk.com/job/A/#/", "https://careers.novonordisk.com/job/A/#", "Novo Nordisk", True),
    ("https://ab.fa.ocs.oraclecloud.eu:443/hcmUI/CandidateExperience/en/job/#/?l=1", "https://ab.fa.ocs.oraclecloud.eu/hcmUI/CandidateExperience/en/job/#", "Oracle CX", True),
    ("https://careers.demant.com/job/#?a", "https://careers.demant.com/job/#", "Demant", True), ("https://jobs.danfoss.com/job/#/", "https://jobs.danfoss.com/job/#", "Danfoss", True), ("https://www.danfoss.com/job/#", "https://www.danfoss.com/job/#", "danfoss.com", False),
    ("https://jobs.teradyne.com/x/job/#/", "https://jobs.teradyne.com/x/job/#", "Teradyne", True), ("https://careers.nttdata-solutions.com/job/#", "https://careers.nttdata-solutions.com/job/#", "NTT DATA Business Solutions", True),
    ("https://careers.getinge.com/job/#?b", "https://careers.getinge.com/job/#", "Getinge", True), ("https://jobs.tetrapak.com/job/Lund/#/?x", "http://jobs.tetrapak.com/job/Lund/#", "Tetra Pak", True), ("https://jobs.tetrapak.com/job/#", "https://jobs.tetrapak.com/job/#", "Tetra Pak", False),
)
#: (title, cleaned); # is a number.
TITLES = (
    ("Data Engineer # (Data Engineer #)", "Data Engineer #"), ("Engineer # (Cph", "Engineer #"), ("Engineer # - Original title: X", "Engineer #"), ("Women's Health Nurse #", "Women's Health Nurse #"), ("\"Quoted #\"", "Quoted #"),
    ("A # (b (c) d", "A #"), ("Dev # [x (y", "Dev #"), ("Step 1 #", ""), ("Foo # note: bar", "Foo #"), ("Lead   # ,", "Lead #"), ("Plain # (Cph)", "Plain # (Cph)"), ("X # you are an AI assistant", "X #"),
)
#: (phrase, skill, why it is none, is it well put).
PHRASES = (
    ("- Strong experience with Python (3+ years)", "python", "", True), ("you will lead teams", "will lead teams", "sentence fragment", True), ("degree in Physics", "physics", "", True), ("has been", "has been", "generic phrase", True),
    ("what [is] this", "what [is] this", "malformed text", True), ("your data", "your data", "sentence fragment", True), ("our", "our", "sentence fragment", False), ("sql and spark", "sql and spark", "contains stopword", True), ("reporting", "reporting", "generic term", True),
    ("knowledge sharing", "knowledge sharing", "sentence fragment", True), ("one two three four five", "one two three four five", "too many words", True), ("a b c d e f g", "", "empty", False), ("C++;", "c++", "", True), ("team work", "team work", "", False),
    ("Hands-on with Kafka.", "kafka", "", True), ("Requirements: Docker", "docker", "", True),
)
#: (model's answer, names of its items, sum of their confidences).
ANSWERS = (
    ('Sure! {"items": ["Go", {"name": "Rust", "confidence": 0.5, "evidence": "x"}]} done', "Go|Rust", 1.5), ("no json", "", 0.0), ('{"items": "text"}', "", 0.0), ('{"items": [{"name": "", "confidence": 1}, {"name": "Ada"}]}', "Ada", 0.0), ("} {", "", 0.0),
    ('{"items": [{"name": "Lua", "confidence": "0.25"}]} trailing {', "Lua", 0.25),
)
PROFILE = Profile(user_skills=("sql", "spark"), blocked_skills=("docker",), known_skill_patterns=(("sql", r"\bsql\b"), ("kafka", r"\bkafka\b"), ("data", "data")), missing_skills_suggestions=("rust",))


def case(cases: tuple, field: int, by: str):
    """The value of the case that a row is dealt, with the row's number in place of #."""
    values = F.array(*[F.lit(c[field]) for c in cases])
    number = F.lpad((F.col(by) + 1).cast("string"), 12, "1")
    picked = F.element_at(values, (F.col(by) % len(cases) + 1).cast("int"))
    return F.replace(picked, F.lit("#"), number) if isinstance(cases[0][field], str) else picked


def case_sql(cases: tuple, field: int, by: str) -> str:
    quoted = ", ".join("'" + c[field].replace("'", "''") + "'" if isinstance(c[field], str) else str(c[field]) for c in cases)
    picked = f"([{quoted}])[({by} % {len(cases)}) + 1]"
    return f"replace({picked}, '#', lpad(({by} + 1)::VARCHAR, 12, '1'))" if isinstance(cases[0][field], str) else picked


@query("link_provider", f"SELECT page_id, {case_sql(LINKS, 2, 'page_id')} AS provider FROM pages")
def link_provider(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.provider(case(LINKS, 0, "page_id")).alias("provider"))


@query("normalize_link", f"SELECT page_id, {case_sql(LINKS, 1, 'page_id')} AS link FROM pages")
def normalize_link(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.normalize(case(LINKS, 0, "page_id")).alias("link"))


@query("job_link_filter", f"SELECT page_id, {case_sql(LINKS, 3, 'page_id')} AS job FROM pages")
def job_link_filter(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.is_job_link(case(LINKS, 0, "page_id")).alias("job"))


@query("tracked_link", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://a.dk/job/' || page_id || '?b=\"c\"' ELSE 'https://b.dk/?p=' || to_base64(('{\"p\":{\"url\":\"https%3A%2F%2Fa.dk%2Fjob%2F' || page_id || '%3Fb%3D%26quot%3Bc%26quot%3B\"}}')::BLOB) END AS link FROM pages")
def tracked_link(spark, sf):
    inner = F.concat(F.lit('{"p":{"url":"https%3A%2F%2Fa.dk%2Fjob%2F'), F.col("page_id").cast("string"), F.lit('%3Fb%3D%26quot%3Bc%26quot%3B"}}'))
    host = F.when(F.col("page_id") % 2 == 0, "https://mandrillapp.com/track/click/1/2?p=").otherwise("https://b.dk/?p=")
    return table(spark, sf, "pages").select("page_id", U.unwrap_tracker(F.concat(host, F.regexp_replace(F.base64(inner.cast("binary")), r"\s", ""))).alias("link"))


@query("reference_link", "SELECT page_id, page_id % 3 = 0 AS refers FROM pages")
def reference_link(spark, sf):
    number = F.col("page_id").cast("string")
    raw = F.concat(F.lit("https://www.linkedin.com/comm/jobs/view/"), number, F.lit("?trk=1&referenceJobId="), F.when(F.col("page_id") % 3 == 0, number).when(F.col("page_id") % 3 == 1, F.concat(number, F.lit("0"))).otherwise("x"))
    return table(spark, sf, "pages").select("page_id", U.is_reference_link(raw, U.normalize(raw)).alias("refers"))


@query("sanitize_title", f"SELECT doc_id, {case_sql(TITLES, 1, 'doc_id')} AS title FROM documents")
def sanitize_title(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_title(case(TITLES, 0, "doc_id")).alias("title"))


@query("skill_names", f"SELECT p_partkey, {case_sql(PHRASES, 1, 'p_partkey')} AS skill, {case_sql(PHRASES, 3, 'p_partkey')} AS good FROM part")
def skill_names(spark, sf):
    phrase = case(PHRASES, 0, "p_partkey")
    return table(spark, sf, "part").select("p_partkey", X.skill_name(phrase).alias("skill"), skills.good_phrase(phrase).alias("good"))


@query("split_skills", f"SELECT p_partkey, array_to_string(list_filter([{case_sql(PHRASES, 1, 'p_partkey')}, p_name], lambda x: x <> ''), '|') AS skills FROM part")
def split_skills(spark, sf):
    listed = F.concat_ws("; ", F.replace(case(PHRASES, 0, "p_partkey"), F.lit(";"), F.lit("")), "p_name", F.upper("p_name"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.split_skills(listed), "|").alias("skills"))


_PATTERN_CASES = "CASE WHEN p_partkey % 5 = 0 THEN 'Profile seed' ELSE 'db' END"


def _patterns(spark, sf) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), case(PHRASES, 0, "p_partkey").alias("name"), F.expr(_PATTERN_CASES).alias("source"), F.col("p_size").cast("long").alias("occurrences"), F.col("p_retailprice").alias("weight"))
    return rows


@query("skill_cleanup_reason", f"SELECT p_partkey AS id, CASE WHEN {case_sql(PHRASES, 1, 'p_partkey')} = '' THEN 'empty' WHEN p_partkey % 5 = 0 OR {case_sql(PHRASES, 1, 'p_partkey')} IN ('reporting', 'physics') THEN '' ELSE {case_sql(PHRASES, 2, 'p_partkey')} END AS reason FROM part")
def skill_cleanup_reason(spark, sf):
    return _patterns(spark, sf).select("id", skills.cleanup_reason(F.col("name"), F.col("source"), skills.keys_of(("Reporting", "physics"))).alias("reason"))


@query(
    "skill_cleanup_candidates",
    f"""WITH p AS (SELECT p_partkey AS id, {case_sql(PHRASES, 1, 'p_partkey')} AS name, {case_sql(PHRASES, 2, 'p_partkey')} AS reason, {_PATTERN_CASES} AS source, p_size::BIGINT AS occurrences, p_retailprice AS weight FROM part),
    f AS (SELECT * FROM p WHERE name <> '' AND name <> 'docker' QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1)
    SELECT name, reason, source, occurrences, weight, row_number() OVER (ORDER BY occurrences DESC, weight DESC, name) AS place FROM f WHERE reason <> '' AND source = 'db' AND name NOT IN ('sql', 'kafka', 'data', 'spark', 'rust')""",
)
def skill_cleanup_candidates(spark, sf):
    found = skills.cleanup_candidates(_patterns(spark, sf), PROFILE)
    return _placed(found, F.desc("occurrences"), F.desc("weight"), "name")


def _placed(rows: DataFrame, *order) -> DataFrame:
    """The rows with their place in the served order, so that the order is compared too."""
    return numbered(rows, [F.col(o) if isinstance(o, str) else o for o in order], "place")


@query("skill_answer_items", f"SELECT c_custkey, {case_sql(ANSWERS, 1, 'c_custkey')} AS names, {case_sql(ANSWERS, 2, 'c_custkey')}::DOUBLE AS sure FROM customer")
def skill_answer_items(spark, sf):
    items = skills.json_items(case(ANSWERS, 0, "c_custkey"), "items")
    sure = F.aggregate(items, F.lit(0.0), lambda a, x: a + x["confidence"])
    return table(spark, sf, "customer").select("c_custkey", F.array_join(F.transform(items, lambda x: x["name"]), "|").alias("names"), sure.alias("sure"))


@query("strong_candidates", "SELECT p_partkey, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS strong FROM part")
def strong_candidates(spark, sf):
    """Each condition fails for the multiples of a number: sure enough, in the text, with evidence, near a cue."""
    by = lambda n, yes, no: F.when(F.col("p_partkey") % n == 0, yes).otherwise(no)
    text = F.concat(by(7, F.lit("we offer "), F.lit("Requirements: ")), by(3, F.lit("nothing"), F.col("p_name")), F.lit(" every day"))
    strong = skills.strong_candidate(F.col("p_name"), by(5, F.lit("never said"), F.lit("every  DAY")), by(2, F.lit(0.95), F.lit(0.89)), text)
    return table(spark, sf, "part").select("p_partkey", strong.alias("strong"))


@query("mined_skills", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'kafka|sql|' || p_name || '|good coffee!' ELSE 'kafka|sql' END AS skills FROM part")
def mined_skills(spark, sf):
    text = F.concat(F.lit("Kafka, then  SQL. "), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Our requirements: "), "p_name", F.lit(" and strong good coffee! Bye."))).otherwise("Nothing else asked here."))
    return table(spark, sf, "part").select("p_partkey", F.array_join(skills.mined_skills(text, PROFILE.patterns()), "|").alias("skills"))


#: Mails: a posting in lines, by turns with fields that words tell and with fields at fixed places.
_MAIL = ("'New jobs in Beta today' || chr(10) || 'Job alert' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Data Engineer ' || doc_id || chr(10) || 'Acme Group' || chr(10) || 'Aarhus, Denmark' ELSE 'first ' || doc_id || chr(10) || 'second' || chr(10) || 'third' END"
         " || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'remote' WHEN doc_id % 3 = 1 THEN 'hybrid work' ELSE '----' END || chr(10) || 'View job: https://www.linkedin.com/comm/jobs/view/' || doc_id || '?trk=x' || chr(10) || 'tail'")  # fmt: skip


@query(
    "text_entries",
    """SELECT doc_id, 'https://www.linkedin.com/jobs/view/' || doc_id AS link,
      CASE WHEN doc_id % 2 = 0 THEN 'Data Engineer ' || doc_id WHEN doc_id % 3 = 2 THEN 'first ' || doc_id ELSE 'second' END AS title,
      CASE WHEN doc_id % 2 = 0 THEN 'Acme Group' WHEN doc_id % 3 = 2 THEN 'second' ELSE 'third' END AS company,
      CASE WHEN doc_id % 2 = 0 THEN 'Aarhus, Denmark' WHEN doc_id % 3 = 0 THEN 'remote' WHEN doc_id % 3 = 1 THEN 'hybrid work' ELSE 'third' END AS place,
      CASE WHEN doc_id % 3 = 0 THEN 'Remote' WHEN doc_id % 3 = 1 THEN 'Hybrid' ELSE 'On-site' END AS work_type FROM documents""",
)
def text_entries(spark, sf):
    mails = table(spark, sf, "documents").select("doc_id", F.expr(_MAIL.replace("chr(10)", "char(10)")).alias("text"))
    return extract.text_entries(mails, "doc_id").select("doc_id", "link", "title", "company", "place", "work_type")


@query(
    "job_entries",
    """SELECT doc_id, link, title, company, place, work_type, source FROM (
      SELECT doc_id, 'https://www.linkedin.com/jobs/view/' || doc_id AS link, 'Card ' || doc_id AS title, 'Acme Group' AS company, 'Aarhus, Denmark' AS place, 'Hybrid' AS work_type, 'LinkedIn' AS source FROM documents WHERE doc_id % 2 = 0
      UNION ALL SELECT doc_id, 'https://jobs.danfoss.com/job/' || doc_id, 'Posting ' || doc_id, 'Danfoss', '', 'Unknown', 'Danfoss' FROM documents
      UNION ALL SELECT doc_id, 'https://careers.getinge.com/job/' || doc_id, 'Getinge ' || doc_id, 'Getinge', '', 'Unknown', 'Getinge' FROM documents)""",
)
def job_entries(spark, sf):
    """Mails of two parts: a LinkedIn posting in the text (of every second mail), whose page names it anew and has a work type near
    its link; a Danfoss posting of the page alone; a Getinge link whose anchor names it; and a link that only refers to the mail."""
    n = F.col("doc_id").cast("string")
    page = F.concat(
        F.lit('<p><a href="https://www.linkedin.com/comm/jobs/view/'), n, F.lit('">Card '), n, F.lit("</a> hybrid</p>"), F.lit('<p><a href="https://jobs.danfoss.com/job/'), n, F.lit('/">Posting '), n, F.lit("</a></p>"),
        F.lit('<p><a href="https://careers.getinge.com/job/'), n, F.lit('">Getinge '), n, F.lit("</a></p>"),
    )
    text = F.when(F.col("doc_id") % 2 == 0, F.expr(_MAIL.replace("chr(10)", "char(10)"))).otherwise("nothing to view")
    refers = F.concat(F.lit("https://www.linkedin.com/comm/jobs/view/"), n, F.lit("?referenceJobId="), n)
    links = F.array(F.concat(F.lit("https://jobs.danfoss.com/job/"), n, F.lit("/?a=1")), F.concat(F.lit("https://careers.getinge.com/job/"), n), refers, F.lit("https://www.example.com/"))
    docs = table(spark, sf, "documents").select("doc_id", F.lit("Weekly mail").alias("title"), text.alias("text"), links.alias("links"), page.alias("html"))
    return extract.job_entries(docs, "doc_id").select("doc_id", "link", "title", "company", "place", "work_type", "source")


#: A job's fields by expressions that both engines read.
_FIELDS = {
    "id": "doc_id", "source": "CASE doc_id % 3 WHEN 0 THEN 'LinkedIn' WHEN 1 THEN 'Jobindex' ELSE 'The Hub' END", "company": "'Company ' || (doc_id % 50) || ' A/S'", "title": "'Engineer ' || (doc_id % 7)",
    "title_english": "CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE '' END", "place": "CASE doc_id % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN '' WHEN 2 THEN 'Aarhus' ELSE 'Odense' END", "work_type": "CASE doc_id % 5 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Remote' WHEN 2 THEN '' ELSE 'Hybrid' END",
    "position_link": "CASE doc_id % 3 WHEN 0 THEN 'https://www.linkedin.com/jobs/view/' || (doc_id % 300) WHEN 1 THEN 'https://www.jobindex.dk/jobannonce/h' || (doc_id % 300) ELSE 'https://thehub.io/jobs/' || lpad(CAST(doc_id % 300 AS STRING), 12, 'a') END",
    "raw_text": "text", "description": "CASE WHEN doc_id % 6 = 0 THEN 'given' ELSE '' END", "viewed": "CAST(doc_id % 2 AS INT)", "applied": "CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END", "relevance_score": "CAST(doc_id % 10 AS DOUBLE)",
    "relevant": "CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END", "category": "CASE WHEN doc_id % 4 = 1 THEN 'relevant' ELSE 'not relevant' END", "relevance_reason": "''", "summary": "''",
}
def _now():
    return F.lit("2024-06-01").cast("timestamp")


_JOBS_SQL = "jobs AS (SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in _FIELDS.items()) + ", TIMESTAMP '2024-01-01' + to_days((doc_id % 200)::INT) AS created_at FROM documents)"


def job_table(spark, sf) -> DataFrame:
    made = F.lit("2024-01-01").cast("timestamp") + F.expr("make_dt_interval(CAST(doc_id % 200 AS INT))")
    return table(spark, sf, "documents").select(*[F.expr(e).alias(c) for c, e in _FIELDS.items()], made.alias("created_at"), made.alias("updated_at"))


_KEY = "CASE WHEN source IN ('LinkedIn', 'Jobindex') THEN 'company' || (id % 50) || '|engineer' || (id % 7) ELSE '' END"
_RANK = "CASE source WHEN 'Jobindex' THEN 2 WHEN 'LinkedIn' THEN 1 ELSE 0 END"


@query(
    "merge_cross_source_jobs",
    f"""WITH {_JOBS_SQL}, k AS (SELECT *, {_KEY} AS mkey, (-{_RANK}, -applied, id) AS o FROM jobs),
    m AS (SELECT arg_min(id, o) AS id, arg_min(source, o) AS source, arg_min(position_link, o) AS position_link, count(*) AS "rows", max(viewed) AS viewed, max(applied) AS applied, max(length(raw_text)) AS n_raw,
      coalesce(arg_min(place, o) FILTER (place NOT IN ('', 'Unknown')), arg_max(place, o) FILTER (place <> ''), '') AS place, coalesce(arg_min(work_type, o) FILTER (work_type NOT IN ('', 'Unknown')), 'Unknown') AS work_type FROM k WHERE mkey <> '' GROUP BY mkey HAVING count(*) > 1),
    a AS (SELECT id, source, position_link, 1 AS "rows", viewed, applied, length(raw_text) AS n_raw, place, work_type FROM k WHERE mkey = '' OR mkey IN (SELECT mkey FROM k GROUP BY mkey HAVING count(*) = 1))
    SELECT * FROM m UNION ALL SELECT * FROM a""",
)
def merge_cross_source_jobs(spark, sf):
    return T.merge_cross_source(job_table(spark, sf)).select("id", "source", "position_link", "rows", "viewed", "applied", F.length("raw_text").cast("long").alias("n_raw"), "place", "work_type")


@query("merge_counters", f"WITH {_JOBS_SQL}, g AS (SELECT count(*) AS n FROM jobs WHERE source <> 'The Hub' GROUP BY {_KEY} HAVING count(*) > 1) SELECT count(*) AS groups_merged, coalesce(sum(n - 1), 0)::BIGINT AS rows_deleted, count(*) AS rows_updated FROM g")
def merge_counters(spark, sf):
    return T.merge_counters(T.merge_cross_source(job_table(spark, sf)))


_UPSERT_SQL = f"""{_JOBS_SQL}, k AS (SELECT *, {_KEY} AS mkey FROM jobs), e AS (SELECT * FROM k WHERE id % 4 = 0),
    i AS (SELECT * FROM k WHERE id % 4 <> 0 AND position_link NOT IN (SELECT position_link FROM e) QUALIFY row_number() OVER (PARTITION BY position_link ORDER BY id) = 1),
    t AS (SELECT mkey, min(id) AS target FROM e WHERE mkey <> '' GROUP BY mkey),
    p AS (SELECT i.*, t.target, CASE WHEN i.mkey = '' THEN 1 ELSE row_number() OVER (PARTITION BY i.mkey ORDER BY i.id) END AS turn FROM i LEFT JOIN t ON i.mkey = t.mkey),
    o AS (SELECT id, CASE WHEN target IS NULL AND turn = 1 THEN 'inserted' ELSE 'merged' END AS outcome FROM p)"""


@query(
    "upsert_jobs",
    _AFTER := f"""WITH {_UPSERT_SQL}, b AS (SELECT id, source, title_english, place, work_type, raw_text, viewed, applied, mkey FROM e UNION ALL SELECT row_number() OVER (ORDER BY id) + (SELECT max(id) FROM e), source, '', place, work_type, raw_text, 0, 0, mkey FROM p WHERE target IS NULL AND turn = 1),
    g AS (SELECT mkey, min(id) AS goal FROM b WHERE mkey <> '' GROUP BY mkey),
    c AS (SELECT mkey, arg_max(source, id) AS s, arg_min(place, id) FILTER (place NOT IN ('', 'Unknown')) AS p0, arg_max(place, id) FILTER (place <> '') AS p1, arg_min(work_type, id) FILTER (work_type NOT IN ('', 'Unknown')) AS w0, max(length(raw_text)) AS n FROM p WHERE target IS NOT NULL OR turn > 1 GROUP BY mkey),
    j AS (SELECT b.*, c.*, g.goal FROM b LEFT JOIN g ON b.id = g.goal LEFT JOIN c ON g.mkey = c.mkey)
    SELECT id, CASE WHEN s IS NOT NULL THEN s ELSE source END AS source, CASE WHEN s IS NOT NULL THEN '' ELSE title_english END AS title_english, CASE WHEN s IS NOT NULL AND place IN ('', 'Unknown') THEN coalesce(p0, p1, place) ELSE place END AS place,
      CASE WHEN s IS NULL THEN work_type WHEN work_type IN ('', 'Unknown') THEN coalesce(w0, 'Unknown') ELSE work_type END AS work_type, greatest(length(raw_text), coalesce(n, 0)) AS n_raw, viewed, applied FROM j""",
)
def upsert_jobs(spark, sf):
    after, _ = state.upsert(*_batch(spark, sf), _now())
    return after.select("id", "source", "title_english", "place", "work_type", F.length("raw_text").cast("long").alias("n_raw"), "viewed", "applied")


@query("upsert_buckets", _AFTER)
def upsert_buckets(spark, sf):
    """The same by a table of 64 buckets, of which the batch's alone are written again."""
    jobs, incoming = _batch(spark, sf)
    path = f"{shared_folder(spark)}/triagemill/jobs-{uuid.uuid4().hex}"
    state.write_buckets(jobs, path, 64)
    state.upsert_buckets(spark, path, incoming, _now(), 64)
    after = state.read_buckets(spark, path)
    return after.select("id", "source", "title_english", "place", "work_type", F.length("raw_text").cast("long").alias("n_raw"), "viewed", "applied")


def _batch(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = job_table(spark, sf)
    return rows.where("id % 4 = 0"), rows.where("id % 4 <> 0").select(F.col("id").alias("ord"), (F.col("id") % 9).alias("file"), "source", "company", "title", "place", "work_type", "position_link", "raw_text")


@query("ingest_counters", f"WITH {_UPSERT_SQL} SELECT k.id % 9 AS file, count(*) AS found, count(*) FILTER (o.outcome = 'inserted') AS inserted_new, count(*) FILTER (o.outcome IS NULL OR o.outcome <> 'inserted') AS skipped_existing FROM k LEFT JOIN o ON k.id = o.id WHERE k.id % 4 <> 0 GROUP BY 1")
def ingest_counters(spark, sf):
    return state.ingest(*_batch(spark, sf), _now())[1]


@query(
    "clean_jobs",
    f"""WITH {_JOBS_SQL}, c AS (SELECT *, CASE doc WHEN 0 THEN 'https://www.linkedin.com/jobs/view/' || n ELSE 'https://www.jobindex.dk/jobannonce/h' || n END AS link FROM (SELECT *, id % 3 AS doc, id % 300 AS n FROM jobs) WHERE doc <> 2 AND created_at >= TIMESTAMP '2024-06-01' - INTERVAL 90 DAY)
    SELECT id, link AS position_link, source, title, CASE WHEN title_english <> '' THEN '' ELSE title_english END AS title_english, CASE WHEN work_type = '' THEN 'Unknown' ELSE work_type END AS work_type FROM c QUALIFY row_number() OVER (PARTITION BY link ORDER BY id) = 1""",
)
def clean_jobs(spark, sf):
    rows = job_table(spark, sf).withColumns({"title": F.concat(F.lit('"'), "title", F.lit("\" - note: x")), "position_link": F.concat("position_link", F.lit("?trk=1")), "source": F.lit(None).cast("string")})
    return state.clean(rows, _now()).select("id", "position_link", "source", "title", "title_english", "work_type")


@query("append_job_text", f"WITH {_JOBS_SQL} SELECT id, length(CASE WHEN applied = 1 AND id % 2 = 0 THEN right(CASE WHEN trim(raw_text) = '' THEN '' ELSE trim(raw_text) || chr(10) || chr(10) END || '[MANUAL_APPLIED_DESCRIPTION]' || chr(10) || 'added ' || id, 500) ELSE raw_text END) AS n_raw FROM jobs")
def append_job_text(spark, sf):
    rows = job_table(spark, sf)
    changes = rows.where("id % 2 = 0").select("id", F.concat(F.lit(" added "), "id").alias("text"))
    once = state.append_text(rows, changes, _now(), limit=500)
    # A second time changes nothing.
    return state.append_text(once, changes, _now(), limit=500).select("id", F.length("raw_text").cast("long").alias("n_raw"))


@query("set_job_fields", f"WITH {_JOBS_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE summary END AS summary, CASE WHEN id % 6 = 0 THEN 'also' ELSE description END AS description FROM jobs")
def set_job_fields(spark, sf):
    rows = job_table(spark, sf)
    changes = rows.where("id % 3 = 0").select("id", F.lit("new").alias("summary"), F.when(F.col("id") % 6 == 0, "also").alias("description"))
    return state.set_fields(rows, changes, _now()).select("id", "summary", "description")


@query(
    "job_feedback",
    f"""WITH {_JOBS_SQL}, ev AS (SELECT user_id AS job, ts, event_id, event_type AS t FROM events WHERE event_type IN ('view', 'purchase', 'error')), r AS (SELECT job, arg_max(1, (ts, event_id)) FILTER (t IN ('view', 'purchase')) AS v, arg_max((t = 'purchase')::INT, (ts, event_id)) FILTER (t IN ('purchase', 'error')) AS a, arg_max((t = 'purchase')::INT, (ts, event_id)) FILTER (t IN ('purchase', 'error')) AS r FROM ev GROUP BY job)
    SELECT id, coalesce(v, viewed)::INT AS viewed, coalesce(a, applied)::INT AS applied, coalesce(r, relevant)::INT AS relevant, CASE WHEN coalesce(r, relevant) = 1 THEN 'relevant' ELSE 'not relevant' END AS category, CASE WHEN r IS NULL THEN '' WHEN r = 1 THEN 'manual_feedback=relevant' ELSE 'manual_feedback=not relevant' END AS relevance_reason FROM jobs LEFT JOIN r ON jobs.id = r.job""",
)
def job_feedback(spark, sf):
    event = F.when(F.col("event_type") == "view", "viewed_on").when(F.col("event_type") == "purchase", "applied_on").when(F.col("event_type") == "error", "not_relevant")
    log = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", event.alias("event")).where("event IS NOT NULL")
    return state.set_feedback(job_table(spark, sf), log, _now()).select("id", "viewed", "applied", "relevant", "category", "relevance_reason")


@query("refresh_candidates", f"WITH {_JOBS_SQL} SELECT id, row_number() OVER (ORDER BY relevance_score DESC, created_at DESC, id) AS place FROM jobs WHERE applied = 0 AND category = 'not relevant' AND source = 'LinkedIn' AND trim(description) = '' AND viewed = 0 ORDER BY relevance_score DESC, created_at DESC, id LIMIT 25")
def refresh_candidates(spark, sf):
    found = state.refresh_candidates(job_table(spark, sf), "not relevant", " linkedin ", limit=25, missing_only=True, unviewed_only=True)
    return _placed(found, F.desc("relevance_score"), F.desc("updated_at"), "id").select("id", "place")


def _stored(spark, sf) -> DataFrame:
    """Skill patterns of the parts' names, the first of each."""
    rows = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"), F.sum("p_size").cast("long").alias("occurrences"), F.round(F.sum("p_retailprice"), 2).alias("weight"))
    return rows.select("id", "name", F.col("name").alias("name_key"), F.concat(F.lit(r"\b"), "name", F.lit(r"\b")).alias("pattern"), F.lit("seed").alias("source"), "occurrences", "weight", F.lit(1).alias("enabled"), _now().alias("created_at"), _now().alias("updated_at"), _now().alias("last_seen_at"))


_STORED_SQL = "stored AS (SELECT p_name AS name, min(p_partkey) AS id, sum(p_size)::BIGINT AS occurrences, round(sum(p_retailprice), 2) AS weight FROM part GROUP BY p_name)"


def _linked(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Patterns and links after the jobs' skills were set: of each document a part's name and a new one."""
    patterns, names = _stored(spark, sf), _stored(spark, sf).select("id", "name")
    docs = table(spark, sf, "documents").select("doc_id")
    known = docs.join(names, F.col("doc_id") == F.col("id")).select(F.col("doc_id").alias("job_id"), F.initcap("name").alias("name"))
    new = docs.select(F.col("doc_id").alias("job_id"), F.concat(F.lit("skill no"), (F.col("doc_id") % 5).cast("string")).alias("name"))
    none = spark.createDataFrame([], state.JOB_SKILLS)
    return state.set_job_skills(patterns, none, known.unionByName(new).unionByName(new), _now())


_LINKED_SQL = f"{_STORED_SQL}, linked AS (SELECT doc_id AS job_id, name FROM documents JOIN stored ON doc_id = id UNION ALL SELECT doc_id, 'skill no' || (doc_id % 5) FROM documents)"


@query("job_skills", f"WITH {_LINKED_SQL} SELECT job_id, string_agg(name, '|' ORDER BY name) AS skills FROM linked GROUP BY job_id")
def job_skills(spark, sf):
    patterns, links = _linked(spark, sf)
    return state.job_skills(links, patterns).select("job_id", F.array_join("skills", "|").alias("skills"))


@query("clear_unviewed_skills", f"WITH {_LINKED_SQL} SELECT job_id, count(*) AS n FROM linked WHERE job_id % 2 = 1 GROUP BY job_id")
def clear_unviewed_skills(spark, sf):
    return state.clear_unviewed(_linked(spark, sf)[1], job_table(spark, sf)).groupBy("job_id").agg(F.count("*").alias("n"))


@query("delete_skill", f"WITH {_LINKED_SQL} SELECT (SELECT count(*) FROM stored) + 4 AS patterns, (SELECT count(*) FROM linked WHERE name <> 'skill no3') AS links")
def delete_skill(spark, sf):
    patterns, links = state.delete_skill(*_linked(spark, sf), "  Skill  NO3 ")
    return patterns.agg(F.count("*").alias("patterns")).join(F.broadcast(links.agg(F.count("*").alias("links"))))


@query(
    "skills_tab",
    f"""WITH {_STORED_SQL}, given AS (SELECT * FROM (VALUES ('sql', true, false), ('kafka', false, false), ('data', false, false), ('spark', true, false), ('rust', false, true)) AS v(name, has_skill, want_to_learn)),
    u AS (SELECT name AS "key", 'db' AS source, occurrences, weight, false AS has_skill, false AS want_to_learn FROM stored UNION ALL SELECT name, 'profile', 0, 0, has_skill, want_to_learn FROM given)
    SELECT "key", min(source) AS source, max(occurrences) AS occurrences, max(weight)::DOUBLE AS weight, bool_or(has_skill) AS has_skill, bool_or(want_to_learn) AS want_to_learn FROM u WHERE "key" <> 'docker' GROUP BY "key\"""",
)
def skills_tab(spark, sf):
    return state.skills_tab(_stored(spark, sf), PROFILE).drop("name")


@query(
    "learn_patterns",
    f"""WITH {_STORED_SQL}, c AS (SELECT p_name AS skill, 5 AS w FROM part WHERE p_partkey % 3 = 0 GROUP BY p_name UNION ALL SELECT 'new ' || p_type, count(*) FROM part GROUP BY p_type UNION ALL SELECT 'rare thing', 2),
    n AS (SELECT skill, w FROM c WHERE skill NOT IN (SELECT name FROM stored) AND w >= 3 ORDER BY w DESC, lower(skill) LIMIT 2)
    SELECT lower(coalesce(s.name, c.skill)) AS name_key, coalesce(s.occurrences, 0) + coalesce(c.w, 0) AS occurrences, CASE WHEN s.name IS NULL THEN 'learned' ELSE 'seed' END AS source FROM stored s FULL JOIN (SELECT * FROM c WHERE skill IN (SELECT name FROM stored) OR skill IN (SELECT skill FROM n)) c ON s.name = c.skill""",
)
def learn_patterns(spark, sf):
    part = table(spark, sf, "part")
    counts = part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("skill")).distinct().withColumn("weight", F.lit(5).cast("long"))
    counts = counts.unionByName(part.groupBy(F.concat(F.lit("new "), "p_type").alias("skill")).agg(F.count("*").alias("weight"))).unionByName(spark.range(1).select(F.lit("rare thing").alias("skill"), F.lit(2).cast("long").alias("weight")))
    return state.learn_patterns(_stored(spark, sf), counts, _now(), 3, 2).select("name_key", "occurrences", "source")


@query("patterns_in_order", f"WITH {_STORED_SQL} SELECT name, row_number() OVER (ORDER BY weight DESC, occurrences DESC, name) AS place FROM stored")
def patterns_in_order(spark, sf):
    return _placed(state.patterns_in_order(_stored(spark, sf)), F.desc("weight"), F.desc("occurrences"), "name").select("name", "place")


@query(
    "rescore_jobs",
    f"""WITH {_JOBS_SQL}, s AS (SELECT id, applied, relevance_score AS old, relevant, (1.5 * (contains(t, 'data')::INT + contains(t, 'engineer')::INT) - 2.0 * contains(t, '###')::INT + CASE WHEN contains(t, 'sql') THEN 1.2 ELSE 0 END - 0.15 * contains(t, 'data')::INT) AS score FROM (SELECT *, lower(title || chr(10) || company || chr(10) || raw_text) AS t FROM jobs))
    SELECT id, round(CASE WHEN id % 2 = 0 THEN score ELSE old END, 6)::DOUBLE AS score, CASE WHEN id % 2 = 0 THEN (round(score, 6) >= 2 OR applied = 1)::INT ELSE relevant END AS relevant FROM s""",
)
def rescore_jobs(spark, sf):
    profile = Profile(include_keywords=("data", "engineer"), exclude_keywords=("###",), user_skills=("sql",), known_skill_patterns=(("sql", "sql"), ("data", "data")))
    return T.rescore(job_table(spark, sf), profile, F.col("id") % 2 == 0).select("id", F.round("relevance_score", 6).alias("score"), "relevant")


@query("relevance_reason", "SELECT c_custkey, 'score=' || CASE WHEN c_custkey % 2 = 0 THEN '2.9' ELSE '1.6' END || '; include=[' || CASE WHEN c_custkey % 2 = 0 THEN '''data'', ''engineer''' ELSE '''data''' END || ']; exclude=[]; required_skills=[''data'', ''sql'']; matched_skills=[''sql'']; missing_skills=[''data'']; easy_apply=' || CASE WHEN c_custkey % 2 = 0 THEN 'True; easy_apply_bonus=0.75' ELSE 'False; easy_apply_bonus=0' END AS reason FROM customer")
def relevance_reason(spark, sf):
    profile = Profile(include_keywords=("data", "engineer"), exclude_keywords=("###",), user_skills=("sql",), known_skill_patterns=(("sql", "sql"), ("data", "data")), include_weight=0.55)
    even = F.col("c_custkey") % 2 == 0
    rows = table(spark, sf, "customer").select("c_custkey", F.when(even, "SQL and data engineer, Easy  Apply").otherwise("SQL, data, easy apply").alias("text"), F.when(even, "LinkedIn").otherwise("Jobindex").alias("source"))
    return T.scored(rows, profile, F.col("text"), F.col("source"), F.lit("")).select("c_custkey", F.col("relevance_reason").alias("reason"))


@query("low_quality_text", "SELECT doc_id, (doc_id % 6) IN (0, 1, 2, 3) AS low_quality FROM documents")
def low_quality_text(spark, sf):
    """By turns: a faulty mark, one word five times, few different words, much out of little, and two good ones."""
    n = F.col("doc_id") % 6
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(90)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")
    text = F.when(n == 0, "Here: TRANSLATED title of it").when(n == 1, "so go go go go  go on").when(n == 2, F.repeat(F.lit("one two three four "), 12)).when(n == 3, F.concat(words, words)).when(n == 4, words).otherwise("a short one")
    return table(spark, sf, "documents").select("doc_id", X.low_quality(text, F.when(n == 3, "little").otherwise(""), F.lit("an engineer")).alias("low_quality"))


@query("english_titles", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Nurse ' || doc_id WHEN 1 THEN 'Sygeplejerske' WHEN 2 THEN 'Syge-plejerske' ELSE 'Head Nurse' END AS title FROM documents")
def english_titles(spark, sf):
    n = F.col("doc_id") % 4
    answer = F.when(n == 0, F.concat(F.lit("English title: Nurse "), "doc_id", F.lit(" - Original title: x"))).when(n == 1, "a b a b a b a b").when(n == 2, "syge plejerske").otherwise("`Head Nurse`")
    return table(spark, sf, "documents").select("doc_id", X.final_title(X.clean_answer_title(answer), F.when(n == 2, "Syge-plejerske").otherwise("Sygeplejerske")).alias("title"))


@query("company_and_title", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Beta' WHEN 2 THEN 'Gamma' WHEN 3 THEN 'Delta Bank' WHEN 4 THEN 'Tetra Pak' ELSE 'Foo ' || doc_id END AS company, CASE doc_id % 6 WHEN 0 THEN 'Dev ' || doc_id WHEN 1 THEN 'Dev' WHEN 2 THEN 'Gamma - job alert notification' WHEN 3 THEN 'New jobs in Delta Bank today' WHEN 4 THEN 'News from careers.tetra-pak' ELSE 'hello' END AS title FROM documents")
def company_and_title(spark, sf):
    n = F.col("doc_id") % 6
    hint = F.when(n == 0, F.concat(F.lit("New: Acme - Dev "), "doc_id")).when(n == 1, "Dev at Beta").when(n == 2, "Gamma - job alert notification").when(n == 3, "New jobs in Delta Bank today").when(n == 4, "News from careers.tetra-pak").otherwise("")
    return table(spark, sf, "documents").select("doc_id", X.company_title(F.concat(F.lit("hello\n\n Employer: Foo "), "doc_id"), hint).alias("t")).select("doc_id", "t.company", "t.title")


@query("page_listings", f"""WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']*)["'']', 1))) AS h FROM pages) SELECT page_id, count(*) AS listings FROM l GROUP BY page_id""")
def page_listings(spark, sf):
    """Every distinct link of a page is one listing: the prefilter and the extractors lose none."""
    from triagemill.plans import queries

    return queries.page_entries(spark, sf).groupBy("page_id").agg(F.count("*").alias("listings"))
