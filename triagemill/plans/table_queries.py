"""Registered queries of patterns kept as a table, formats, answers, and served orders, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagemill.functions import text as X
from triagemill.functions import urls as U
from triagemill.operators import patterns as P
from triagemill.operators import extract, learning, models, skills, state
from triagemill.operators import triage as T
from triagemill.plans.registry import query, table
from triagemill.plans.state_queries import _JOBS_SQL, PROFILE, _stored, job_table
from triagemill.profile import Profile

_WORD = r"[\p{L}\p{N}_]+"


def word_patterns(docs):
    """A pattern in capitals for each plain word of the texts, a second one at the same places for those of five letters, and one that can't be
    read for those of six."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("w")).distinct().where(F.col("w").rlike("^[a-z]{4,}$"))
    plain = F.struct(F.col("w").alias("name"), F.concat(F.lit(r"\b"), F.upper("w"), F.lit(r"\b")).alias("pattern"), F.concat("w", F.lit("0")).alias("ord"))
    second = F.struct(F.concat(F.upper("w"), F.lit(" two")).alias("name"), F.concat("w", F.lit(r"(?!\w)")).alias("pattern"), F.concat("w", F.lit("1")).alias("ord"))
    second = second.withField("pattern", F.concat(F.lit(r"(?<!\w)"), second["pattern"]))
    broken = F.struct(F.concat(F.lit("bad "), "w").alias("name"), F.concat(F.lit("["), "w").alias("pattern"), F.concat("w", F.lit("2")).alias("ord"))
    made = F.concat(F.array(plain), F.when(F.length("w") == 5, F.array(second)).otherwise(F.array().cast("array<struct<name:string,pattern:string,ord:string>>")), F.when(F.length("w") == 6, F.array(broken)).otherwise(F.array().cast("array<struct<name:string,pattern:string,ord:string>>")))
    return words.select(F.explode(made).alias("p")).select(F.xxhash64("p.ord").alias("pid"), "p.*")


@query(
    "pattern_table",
    rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '{_WORD}'), 1) AS i FROM documents),
    f AS (SELECT doc_id, w, min(i) AS i FROM t WHERE regexp_full_match(w, '[a-z]{{4,}}') GROUP BY ALL),
    n AS (SELECT doc_id, i, w || '0' AS o, w AS name FROM f UNION ALL SELECT doc_id, i, w || '1', upper(w) || ' two' FROM f WHERE length(w) = 5),
    g AS (SELECT doc_id, list(name ORDER BY i, o) AS names FROM n GROUP BY doc_id)
    SELECT d.doc_id, coalesce(len(names), 0)::INT AS n, coalesce(array_to_string(names[1:10], ','), '') AS first_ten, md5(coalesce(array_to_string(names, ','), '')) AS digest FROM documents d LEFT JOIN g USING (doc_id)""",
)
def pattern_table(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = P.with_skills(docs, "doc_id", F.col("text"), word_patterns(docs), "names")
    return found.select("doc_id", F.size("names").alias("n"), F.array_join(F.slice("names", 1, 10), ",").alias("first_ten"), F.md5(F.array_join("names", ",")).alias("digest"))


@query("skills_any_case", rf"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents),
    p AS (SELECT doc_id, list_position(w, 'and') AS a, list_position(w, 'the') AS b, list_position(w, 'this') AS c FROM t)
    SELECT doc_id, array_to_string(list_transform(list_sort(list_filter([{{i: a, k: 0, name: 'And'}}, {{i: least(coalesce(b, c), coalesce(c, b)), k: 1, name: 'THE'}}], lambda x: x.i IS NOT NULL)), lambda x: x.name), ',') AS skills FROM p""")
def skills_any_case(spark, sf):
    """Patterns in capitals, one that can't be read, and a second name of one key."""
    known = [("And", r"\bAND\b"), ("oops", "(and"), ("THE", r"\bThe\b|\btHIS\b"), ("and", r"\band\b")]
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.required_skills(F.col("text"), known), ",").alias("skills"))


@query("score_to_one_decimal", "SELECT l_orderkey, l_linenumber, printf('%.1f', floor(l_extendedprice * 10) / 8.0 - 5000) AS eighths, printf('%.1f', l_discount * 5 - l_tax) AS mixed FROM lineitem")
def score_to_one_decimal(spark, sf):
    """Eighths hold exact ties, sums of hundredths near ones."""
    rows = table(spark, sf, "lineitem")
    eighths = F.floor(F.col("l_extendedprice") * 10) / 8.0 - 5000
    return rows.select("l_orderkey", "l_linenumber", X.one_decimal(eighths).alias("eighths"), X.one_decimal(F.col("l_discount") * 5 - F.col("l_tax")).alias("mixed"))


@query("tracked_target", "SELECT page_id, 'https://a.dk/job/' || page_id || '?q=a+b&c=é\"å€&nosuch;&amp&d=100%/x' AS link FROM pages")
def tracked_target(spark, sf):
    """A plus, entities by name and number, one that is none, and a percent sign before no number."""
    inner = F.concat(F.lit('{"p":{"url":"https%3A%2F%2Fa.dk%2Fjob%2F'), F.col("page_id").cast("string"), F.lit('?q=a+b%26c=&eacute;&quot;&#229;&#x20AC;&nosuch;&amp;amp&d=100%\\\\/x"}}'))
    link = F.concat(F.lit("https://mandrillapp.com/track/click/1/2?p="), F.translate(F.regexp_replace(F.base64(inner.cast("binary")), r"\s", ""), "+/", "-_"))
    return table(spark, sf, "pages").select("page_id", U.unwrap_tracker(link).alias("link"))


@query("answer_kinds", "SELECT p_partkey, p_name || '|kafka|42' AS names, 2.0::DOUBLE AS sure FROM part")
def answer_kinds(spark, sf):
    """Of a list's items only texts and objects count; a number in an object's place of a name is one in letters."""
    answer = F.concat(F.lit('Sure: {"items": [7, true, null, "'), F.col("p_name"), F.lit('", [1], {"name": "kafka", "confidence": "0.75"}, {"name": 42, "confidence": 0.25}, {"evidence": "x"}, 1.5]} done'))
    items = skills.json_items(answer, "items")
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(items, lambda x: x["name"]), "|").alias("names"), F.aggregate(items, F.lit(0.0), lambda a, x: a + x["confidence"]).alias("sure"))


@query("refresh_in_order", f"""WITH {_JOBS_SQL}, c AS (SELECT id, relevance_score, created_at FROM jobs WHERE applied = 0 AND category = 'not relevant' AND source = 'Jobindex' AND trim(description) = '' AND viewed = 0)
    SELECT id, (SELECT count(*) FROM c d WHERE (-d.relevance_score, -epoch_us(d.created_at), d.id) < (-c.relevance_score, -epoch_us(c.created_at), c.id)) AS above FROM c ORDER BY relevance_score DESC, created_at DESC, id LIMIT 25""")
def refresh_in_order(spark, sf):
    """The candidates, each with the number of those served before it, of 25 rows at most."""
    found = state.refresh_candidates(job_table(spark, sf), "not relevant", " jobindex ", limit=25, missing_only=True, unviewed_only=True)
    served = found.agg(F.collect_list("id").alias("ids"))
    return served.select(F.posexplode("ids").alias("above", "id")).select("id", F.col("above").cast("long").alias("above"))


_APPLIED = Profile()


@query("default_patterns", "SELECT n_nationkey, 'Python,SQL,Rust,C#,CI/CD,Machine Learning' AS skills FROM nation")
def default_patterns(spark, sf):
    """The skills known from the start, in a text that names some in other forms."""
    text = F.concat(F.col("n_name"), F.lit(": PYTHON, MySQL and Rust; DotNet, continuous integration. AI!"))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(T.required_skills(text, _APPLIED.patterns()), ",").alias("skills"))


@query("keyword_table", """WITH k AS (SELECT DISTINCT left(lower(text), 6) AS w FROM documents WHERE trim(left(text, 6)) <> ''),
    f AS (SELECT doc_id, list(w ORDER BY strpos(lower(text), w), w) AS ws FROM documents JOIN k ON contains(lower(text), w) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(len(ws), 0)::INT AS n, md5(coalesce(array_to_string(ws, '|'), '')) AS digest FROM documents d LEFT JOIN f USING (doc_id)""")
def keyword_table(spark, sf):
    """The starts of all texts looked for in all texts."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    keywords = docs.select(F.left(F.lower("text"), F.lit(6)).alias("keyword")).where("trim(keyword) <> ''").distinct().withColumn("ord", F.col("keyword"))
    found = P.find_keywords(docs, "doc_id", F.col("text"), keywords)
    return found.select("doc_id", F.size("_found").alias("n"), F.md5(F.array_join(F.transform("_found", lambda x: x["name"]), "|")).alias("digest"))


def _served(rows, name: str = "id"):
    """A bounded view as rows, each with the number of those served before it."""
    return rows.agg(F.collect_list(name).alias("v")).select(F.posexplode("v").alias("above", name)).select(name, F.col("above").cast("long").alias("above"))


@query("applied_in_order", f"WITH {_JOBS_SQL} SELECT id, row_number() OVER (ORDER BY viewed, relevance_score DESC, created_at DESC, id) - 1 AS above FROM jobs WHERE applied = 1 ORDER BY above LIMIT 60")
def applied_in_order(spark, sf):
    order = (F.asc("viewed"), F.desc("relevance_score"), F.desc("updated_at"), F.asc("id"))
    return _served(T.ranked(job_table(spark, sf), where=F.col("applied") == 1, order=order, limit=60))


@query("company_in_order", f"WITH {_JOBS_SQL} SELECT id, row_number() OVER (ORDER BY applied DESC, relevance_score DESC, created_at DESC, id) - 1 AS above FROM jobs WHERE lower(trim(company)) = 'company 7 a/s' ORDER BY above LIMIT 15")
def company_in_order(spark, sf):
    order = (F.desc("applied"), F.desc("relevance_score"), F.desc("updated_at"), F.asc("id"))
    return _served(T.ranked(job_table(spark, sf), where=F.lower(F.trim("company")) == "company 7 a/s", order=order, limit=15))


@query("skills_in_order", "SELECT name, row_number() OVER (ORDER BY name) - 1 AS above FROM (SELECT p_name AS name FROM part UNION SELECT unnest(['sql', 'kafka', 'data', 'spark', 'rust'])) WHERE name <> 'docker' ORDER BY name LIMIT 80")
def skills_in_order(spark, sf):
    return _served(state.skills_tab(_stored(spark, sf), PROFILE).limit(80).withColumn("name", F.col("key")), "name")


@query("positions_to_learn_from", f"""WITH {_JOBS_SQL}, p AS (SELECT id, CASE WHEN applied = 1 THEN 3 ELSE 1 END AS weight, viewed, relevance_score, created_at FROM jobs WHERE applied = 1 OR category = 'relevant')
    SELECT id, weight::INT AS weight, row_number() OVER (ORDER BY weight DESC, viewed, relevance_score DESC, created_at DESC, id) - 1 AS above FROM p ORDER BY above LIMIT 180""")
def positions_to_learn_from(spark, sf):
    rows = learning.positions(job_table(spark, sf), 180)
    served = rows.agg(F.collect_list(F.struct("id", "weight")).alias("v")).select(F.posexplode("v").alias("above", "p"))
    return served.select("p.id", "p.weight", F.col("above").cast("long").alias("above"))


@query(
    "site_entries",
    """SELECT doc_id, link, title, company, place, source FROM (
      SELECT doc_id, 'https://careers.demant.com/job/' || doc_id AS link, 'Engineer ' || doc_id AS title, 'Demant Group' AS company, 'Aarhus' AS place, 'Demant' AS source FROM documents
      UNION ALL SELECT doc_id, 'https://careers.google.com/about/jobs/results/' || doc_id || '-x', 'Dev ' || doc_id, CASE WHEN doc_id % 2 = 0 THEN 'DeepThought' ELSE 'Google' END, CASE WHEN doc_id % 2 = 0 THEN 'Zurich' ELSE 'Unknown' END, 'Google Careers' FROM documents
      UNION ALL SELECT doc_id, 'https://www.jobindex.dk/jobannonce/h' || doc_id, 'Head Cook ' || doc_id, 'Acme', 'Odense', 'Jobindex' FROM documents)""",
)
def site_entries(spark, sf):
    """A page of three sites' listings: a title with its place, a cell with company and place (of every second page), and a table with a longer name
    of the link, a link off the site, and a place before a travel time."""
    n = F.col("doc_id").cast("string")
    cell = F.when(F.col("doc_id") % 2 == 0, " DeepThought – Zurich 3 days ago").otherwise(" 3 days ago")
    html = F.concat(
        F.lit('<p><a href="https://careers.demant.com/job/'), n, F.lit('">Engineer '), n, F.lit(" - Aarhus</a></p>"),
        F.lit('<table><tr><td><a href="https://careers.google.com/about/jobs/results/'), n, F.lit('-x">Dev '), n, F.lit("</a>"), cell, F.lit("</td></tr></table>"),
        F.lit('<table><tr><td><a href="https://www.jobindex.dk/vis?jobid=h'), n, F.lit('">Apply</a> <a href="https://www.jobindex.dk/jobannonce/h'), n, F.lit('">Head Cook '), n, F.lit("</a> Odense 25 min (settings ) PUBLISHED: today"),
        F.lit(' <a href="https://acme.dk/">Acme</a></td></tr></table>'),
    )
    pages = table(spark, sf, "documents").select("doc_id", html.alias("html"))
    return extract.entries(pages, "doc_id").select("doc_id", "link", "title", "company", "place", "source")


@query("skills_by_model", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'sql|cobol' WHEN 1 THEN 'kafka' WHEN 2 THEN 'sql' ELSE 'cached' END AS skills FROM part")
def skills_by_model(spark, sf):
    """By turns: an answer with known and new skills (one without evidence in the text), one that is no JSON, none (the text's own count), and skills
    that stand already."""
    def model():
        told = '{"matched_known": ["SQL", "nothing known"], "new_candidates": [{"name": "COBOL", "confidence": 0.95, "evidence": "cobol"}, {"name": "Fortran", "confidence": 0.99, "evidence": "fortran"}]}'
        return lambda texts: [told if "cobol" in t else "Kafka, and others" if "plain" in t else "" for t in texts]

    turn = F.col("p_partkey") % 4
    text = F.concat(F.when(turn == 0, "Required: cobol and SQL. ").when(turn == 1, "plain SQL. ").otherwise("just SQL. "), F.lit("No. "), "p_partkey")
    cached = table(spark, sf, "part").where("p_partkey % 4 = 3").select(F.col("p_partkey").alias("id"), F.array(F.lit("cached")).alias("skills"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))
    found = skills.skills_of(rows, "text", PROFILE, model, cached)
    return found.select(F.col("id").alias("p_partkey"), F.array_join("skills", "|").alias("skills"))


@query("translated_texts", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'KAT OG HUND ' || c_custkey WHEN 1 THEN 'cat and dog' ELSE 'og' END AS text FROM customer")
def translated_texts(spark, sf):
    """Danish texts are translated, others and very short ones are left."""
    def detector():
        return lambda texts: ["da" if "og" in t.split() else "en" for t in texts]

    def translator():
        return lambda texts: [t.upper() for t in texts]

    turn = F.col("c_custkey") % 3
    text = F.when(turn == 0, F.concat(F.lit("kat og hund "), "c_custkey")).when(turn == 1, "cat and dog").otherwise("og")
    return models.translate(table(spark, sf, "customer").select("c_custkey", text.alias("text")), "text", detector, translator)
