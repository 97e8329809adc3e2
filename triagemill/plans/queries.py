"""The registered triage queries over the test tables, each with the SQL that says the same.

Bindings: a job is a document (its first line the title, language and source the company), a label is its feedback, links come
from pages, paging runs over orders and the feedback log is the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.functions import text as X
from triagemill.functions import urls as U
from triagemill.operators import extract, offsets
from triagemill.operators import triage as T
from triagemill.plans.registry import ORACLE_SQL, QUERIES, query, table  # noqa: F401
from triagemill.profile import Profile
from triagemill.sources.mail import parse_file

#: Words that the test tables hold.
PROFILE = Profile(include_keywords=("data", "license", "rest"), exclude_keywords=("thre", "###"), user_skills=("data", "license"), known_skill_patterns=(("data", "data"), ("rest", "rest"), ("license", "license")))
TOKEN = r"[a-z][a-z0-9+#.\-]{2,}"
STOP = ", ".join(f"'{w}'" for w in PROFILE.stop_words)


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as job rows, with the state that their labels stand for."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), "source", "text", F.col("text").alias("raw_text"), F.concat_ws(" ", "lang", "source").alias("company"), F.left(X.first_line(F.col("text")), F.lit(180)).alias("title"),
        F.col("lang").alias("place"), F.coalesce("toxic", F.lit(0)).alias("applied"), (F.col("doc_id") % 3 == 0).cast("int").alias("viewed"), "quality",
    )
    return rows


def with_score(rows: DataFrame) -> DataFrame:
    return T.scored(rows, PROFILE, F.col("text")).withColumnRenamed("relevance_score", "score").drop("relevance_reason")


_HITS = lambda words: " + ".join(f"(contains(lower(text), '{w}'))::INT" for w in words)
_NEED = "((contains(lower(text), 'data'))::INT + (contains(lower(text), 'rest'))::INT + (contains(lower(text), 'license'))::INT)"
_MATCH = "((contains(lower(text), 'data'))::INT + (contains(lower(text), 'license'))::INT)"
_SCORE = f"(1.5::DOUBLE * ({_HITS(PROFILE.include_keywords)}) - 2.0::DOUBLE * ({_HITS(PROFILE.exclude_keywords)}) + 1.2::DOUBLE * {_MATCH} - 0.15::DOUBLE * ({_NEED} - {_MATCH}))"
_TITLE = r"left(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], ''), 180)"
_JOBS = f"""jobs AS (SELECT d.doc_id AS id, d.source, text, lang || ' ' || d.source AS company, {_TITLE} AS title, lang AS place, coalesce(toxic, 0) AS applied, (d.doc_id % 3 = 0)::INT AS viewed, quality, {_SCORE} AS score
  FROM documents d LEFT JOIN labels USING (doc_id))"""
_SIX = lambda c: F.round(c, 6)


@query("score_relevance", f"SELECT doc_id AS id, round({_SCORE}, 6) AS score, (round({_SCORE}, 6) >= 2.0) AS relevant FROM documents")
def score_relevance(spark, sf):
    docs = table(spark, sf, "documents")
    return T.scored(docs, PROFILE, F.col("text")).select(F.col("doc_id").alias("id"), _SIX(F.col("relevance_score")).alias("score")).withColumn("relevant", F.col("score") >= PROFILE.min_score)


@query("flagship_top_relevant", f"WITH {_JOBS} SELECT id, title, round(score, 6) AS score FROM jobs WHERE quality = 1 AND round(score, 6) >= 2.0 ORDER BY score DESC, id LIMIT 7")
def flagship_top_relevant(spark, sf):
    # Only those judged good are scored.
    rows = with_score(jobs(spark, sf).where("quality = 1").select("id", "title", "text")).select("id", "title", _SIX(F.col("score")).alias("score"))
    return T.ranked(rows, where=(F.col("score") >= PROFILE.min_score), order=(F.desc("score"), F.asc("id")), limit=PROFILE.report_max_relevant_positions)


_RELEVANCE = f"WITH {_JOBS}, scored AS (SELECT id, CASE WHEN quality IS NOT NULL THEN 0 ELSE round(score, 6) END AS score, CASE WHEN quality IS NOT NULL THEN quality ELSE (round(score, 6) >= 2.0)::INT END AS relevant FROM jobs)"


def _relevance(spark, sf):
    reason = F.when(F.col("quality") == 1, T.MANUAL[0]).when(F.col("quality") == 0, T.MANUAL[1])
    rows = jobs(spark, sf).withColumns({"relevance_reason": reason, "relevance_score": F.lit(0.0), "relevant": F.col("quality"), "title": F.lit(""), "company": F.lit(""), "position_link": F.lit("")})
    return T.apply_relevance(rows, PROFILE).select("id", _SIX(F.col("relevance_score")).alias("score"), F.col("relevant").cast("int").alias("relevant"), "category")


@query("apply_relevance_manual_override", _RELEVANCE + " SELECT id, score::DOUBLE AS score, relevant, CASE WHEN relevant = 1 THEN 'relevant' ELSE 'not relevant' END AS category FROM scored")
def apply_relevance_manual_override(spark, sf):
    return _relevance(spark, sf)


@query("prune_irrelevant", _RELEVANCE + " SELECT id, score::DOUBLE AS score FROM scored WHERE relevant = 1")
def prune_irrelevant(spark, sf):
    return _relevance(spark, sf).where("category <> 'not relevant'").select("id", "score")


@query("category_counts", _RELEVANCE + " SELECT CASE WHEN relevant = 1 THEN 'relevant' ELSE 'not relevant' END AS category, count(*) AS n FROM scored GROUP BY 1")
def category_counts(spark, sf):
    return _relevance(spark, sf).groupBy("category").agg(F.count("*").alias("n"))


@query("viewed_count", f"WITH {_JOBS} SELECT count(*) FILTER (viewed = 1) AS viewed, count(*) FILTER (applied = 1) AS applied, count(*) AS total FROM jobs")
def viewed_count(spark, sf):
    return jobs(spark, sf).agg(F.count_if(F.col("viewed") == 1).alias("viewed"), F.count_if(F.col("applied") == 1).alias("applied"), F.count("*").alias("total"))


@query("category_paged", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 42 OFFSET 84")
def category_paged(spark, sf):
    rows = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice", "o_orderdate")
    return T.ranked(rows, order=(F.desc("o_totalprice"), F.desc("o_orderdate"), F.asc("o_orderkey")), limit=42, offset=84).drop("o_orderdate")


@query("company_view", f"WITH {_JOBS} SELECT id, applied, round(score, 6) AS score FROM jobs WHERE lower(trim(company)) = 'en src1'")
def company_view(spark, sf):
    return T.ranked(with_score(jobs(spark, sf).where(F.lower(F.trim("company")) == "en src1")), where=F.lower(F.trim("company")) == " EN src1 ".strip().lower(), order=(F.desc("applied"), F.desc("score"), F.asc("id"))).select("id", "applied", _SIX(F.col("score")).alias("score"))


@query("applied_view", f"WITH {_JOBS} SELECT id, viewed, round(score, 6) AS score FROM jobs WHERE applied = 1")
def applied_view(spark, sf):
    return T.ranked(with_score(jobs(spark, sf).where("applied = 1")), where=F.col("applied") == 1, order=(F.asc("viewed"), F.desc("score"), F.asc("id"))).select("id", "viewed", _SIX(F.col("score")).alias("score"))


@query("unviewed_then_score", f"WITH {_JOBS} SELECT id, viewed, round(score, 6) AS score FROM jobs ORDER BY viewed, score DESC, id LIMIT 42")
def unviewed_then_score(spark, sf):
    rows = with_score(jobs(spark, sf)).select("id", "viewed", _SIX(F.col("score")).alias("score"))
    return T.ranked(rows, order=(F.asc("viewed"), F.desc("score"), F.asc("id")), limit=PROFILE.report_max_not_relevant_positions)


@query("union_first_wins", f"WITH {_JOBS}, u AS (SELECT id, 0 AS part FROM jobs WHERE applied = 1 UNION ALL SELECT id, 1 FROM jobs WHERE quality = 1 UNION ALL SELECT id, 2 FROM jobs WHERE quality = 0) SELECT id, min(part)::INT AS part FROM u GROUP BY id")
def union_first_wins(spark, sf):
    rows = jobs(spark, sf)
    parts = [rows.where(c).select("id", F.lit(i).alias("part")) for i, c in enumerate(("applied = 1", "quality = 1", "quality = 0"))]
    return T.union_first(parts)


@query("normalize_title_key", f"WITH {_JOBS} SELECT id, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS title_key FROM jobs")
def normalize_title_key(spark, sf):
    return jobs(spark, sf).select("id", X.title_key(F.col("title")).alias("title_key"))


_NOISE = ", ".join(f"'{w}'" for w in X.COMPANY_NOISE)
_COMPANY = f"CASE WHEN len(list_filter(t, lambda x: x NOT IN ({_NOISE}))) > 0 THEN array_to_string(list_filter(t, lambda x: x NOT IN ({_NOISE})), '') ELSE array_to_string(t, '') END"


@query("company_key", f"SELECT c_custkey, {_COMPANY} AS company_key FROM (SELECT c_custkey, regexp_extract_all(lower(c_name || ' A/S Group'), '[a-z0-9]+') AS t FROM customer)")
def company_key(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.company_key(F.concat("c_name", F.lit(" A/S Group"))).alias("company_key"))


@query("token_document_frequency", f"SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, trim(unnest(regexp_extract_all(lower(text), '{TOKEN}')), '.-') AS token FROM documents) WHERE length(token) >= 3 AND token NOT IN ({STOP}) GROUP BY token")
def token_document_frequency(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.explode(F.array_distinct(X.learning_tokens(F.col("text"), PROFILE.stop_words))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


@query(
    "learn_keywords",
    f"""WITH tok AS (SELECT DISTINCT doc_id, quality, token FROM (SELECT doc_id, quality, trim(unnest(regexp_extract_all(lower(text), '{TOKEN}')), '.-') AS token FROM documents JOIN labels USING (doc_id)) WHERE length(token) >= 3 AND token NOT IN ({STOP})),
    tot AS (SELECT count(DISTINCT doc_id) FILTER (quality = 1) AS nr, count(DISTINCT doc_id) FILTER (quality = 0) AS nn FROM tok),
    c AS (SELECT token, count(*) FILTER (quality = 1) AS r, count(*) FILTER (quality = 0) AS n FROM tok GROUP BY token HAVING count(*) >= 2),
    d AS (SELECT token, r, n, r::DOUBLE / nr - n::DOUBLE / nn AS delta FROM c, tot WHERE nr > 0 AND nn > 0),
    k0 AS (SELECT *, CASE WHEN delta >= 0.2 AND r >= 2 THEN 'include' WHEN delta <= -0.2 AND n >= 2 THEN 'exclude' END AS kind FROM d), k AS (SELECT *, CASE kind WHEN 'include' THEN r ELSE n END AS df FROM k0)
    SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY abs(delta) DESC, df DESC, token DESC)::INT AS rank, token, round(delta, 6) AS delta, df FROM k WHERE kind IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY kind ORDER BY abs(delta) DESC, df DESC, token DESC) <= 20""",
)
def learn_keywords(spark, sf):
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("id"), "text", F.col("quality").alias("relevant"))
    return T.learn_keywords(labelled, PROFILE.stop_words).withColumn("delta", _SIX(F.col("delta")))


_SKILLS = "list_transform(list_sort(list_filter([{spot: strpos(lower(text), 'data'), i: 0, name: 'data'}, {spot: strpos(lower(text), 'rest'), i: 1, name: 'rest'}, {spot: strpos(lower(text), 'license'), i: 2, name: 'license'}], lambda x: x.spot > 0)), lambda x: x.name)"


@query("skill_hits", f"SELECT doc_id, array_to_string({_SKILLS}, ',') AS skills FROM documents")
def skill_hits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.required_skills(F.col("text"), PROFILE.patterns(), 10), ",").alias("skills"))


@query("skill_match_missing", f"SELECT doc_id, array_to_string(list_filter({_SKILLS}, lambda x: x IN ('data', 'license')), ',') AS matched, array_to_string(list_filter({_SKILLS}, lambda x: x NOT IN ('data', 'license')), ',') AS missing FROM documents")
def skill_match_missing(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", T.required_skills(F.col("text"), PROFILE.patterns()).alias("s"))
    known = F.array(*map(F.lit, PROFILE.user_skills))
    return rows.select("doc_id", F.array_join(F.array_intersect("s", known), ",").alias("matched"), F.array_join(F.array_except("s", known), ",").alias("missing"))


_EXPLODED = f"WITH {_JOBS}, e AS (SELECT applied, quality, unnest({_SKILLS}) AS skill FROM jobs WHERE applied = 1 OR quality = 1)"


@query("weighted_skill_counts", _EXPLODED + " SELECT skill, count(*) AS occurrences, sum(CASE WHEN applied = 1 THEN 3 ELSE 1 END)::BIGINT AS weight FROM e GROUP BY skill")
def weighted_skill_counts(spark, sf):
    return T.skill_counts(jobs(spark, sf).where("applied = 1 OR quality = 1"), PROFILE, F.when(F.col("applied") == 1, 3).otherwise(1))


@query("missing_skills", _EXPLODED + " SELECT skill, count(*) AS occurrences FROM e WHERE applied = 1 AND skill NOT IN ('data', 'license') GROUP BY skill")
def missing_skills(spark, sf):
    return T.skill_counts(jobs(spark, sf).where("applied = 1"), PROFILE, F.lit(1), 25, PROFILE.user_skills).select("skill", "occurrences")


@query(
    "upsert_pattern_merge",
    """WITH o AS (SELECT lang AS k, count(*) AS occ, sum(n_chars)::DOUBLE AS w FROM documents WHERE doc_id % 2 = 0 AND lang <> 'es' GROUP BY lang), c AS (SELECT lang AS k, count(*) AS occ, -1.0::DOUBLE AS w FROM documents WHERE doc_id % 2 = 1 AND lang <> 'de' GROUP BY lang)
    SELECT coalesce(o.k, c.k) AS name_key, coalesce(o.occ, 0) + coalesce(c.occ, 0) AS occurrences, coalesce(o.w, 0) AS weight FROM o FULL JOIN c ON o.k = c.k""",
)
def upsert_pattern_merge(spark, sf):
    docs = table(spark, sf, "documents")
    side = lambda cond, w: docs.where(cond).groupBy(F.col("lang").alias("name_key")).agg(F.count("*").alias("occurrences"), w.alias("weight")).withColumns({"name": F.col("name_key"), "pattern": F.lit(""), "source": F.lit("seed")})
    merged = T.merge_patterns(side("doc_id % 2 = 0 AND lang <> 'es'", F.sum("n_chars").cast("double")), side("doc_id % 2 = 1 AND lang <> 'de'", F.min(F.lit(-1.0))))
    return merged.select("name_key", "occurrences", F.col("weight").cast("double").alias("weight"))


@query("exact_upsert", "SELECT doc_id AS id, md5(text) AS position_link FROM documents d WHERE doc_id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 4 = 0 AND e.text = d.text) QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def exact_upsert(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("position_link"))
    return T.new_rows(rows.where("id % 4 = 0"), rows.where("id % 4 <> 0"))


@query("link_dedup_min_id", "SELECT md5(text) AS link, min(doc_id) AS id, count(*) AS n FROM documents GROUP BY 1")
def link_dedup_min_id(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("link")).agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))


@query(
    "merge_cross_source",
    f"""WITH {_JOBS}, k AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS mkey, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS rk FROM jobs),
    m AS (SELECT mkey, arg_min(id, (-rk, -applied, id)) AS id, count(*) AS "rows", max(viewed) AS viewed, max(applied) AS applied, max(length(text)) AS n_raw, arg_min(place, (-rk, -applied, id)) AS place FROM k WHERE mkey <> '' GROUP BY mkey)
    SELECT mkey, id, "rows", viewed, applied, n_raw, place FROM m WHERE "rows" > 1""",
)
def merge_cross_source(spark, sf):
    rows = jobs(spark, sf).withColumn("mkey", X.title_key(F.col("title")))
    merged = T.merge_duplicates(rows, "mkey", F.when(F.col("id") % 2 == 0, 2).otherwise(1)).where("rows > 1")
    return merged.select("mkey", "id", "rows", "viewed", "applied", F.length("raw_text").alias("n_raw"), "place")


_HREF = r"""regexp_extract_all(html, '(?i)<a\s[^>]*?href=["'']([^"'']*)["'']', 1)"""


@query("report_links", f"SELECT link, count(*) AS n FROM (SELECT unnest({_HREF}) AS link FROM pages) GROUP BY link ORDER BY n DESC, link LIMIT 200")
def report_links(spark, sf):
    found = table(spark, sf, "pages").select(F.explode(U.hrefs_in(F.col("html"))).alias("link"))
    return found.groupBy("link").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "link").limit(200)


@query("page_titles", "SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages")
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"))


@query("parse_pages_udf")
def parse_pages_udf(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", parse_file(F.lit("page.html"), F.encode("html", "UTF-8")).alias("p"))
    return rows.select("page_id", "p.title", F.length("p.text").alias("n_text"), F.size("p.links").alias("n_links"))


#: What stands before and after a link's number, by extractor.
_SITES = (("https://careers.google.com/about/jobs/results/", "-x"), ("https://jobs.danfoss.com/job/", ""), ("https://careers.demant.com/job/", ""), ("https://www.jobindex.dk/jobannonce/h", ""), ("https://www.linkedin.com/jobs/view/", ""))


@query("page_entries")
def page_entries(spark, sf):
    """Every distinct link of a page stands for a listing of its own, the sites by turns."""
    quoted = r"""(?i)href\s*=\s*["']([^"']*)["']"""
    pages = table(spark, sf, "pages").select("page_id", F.split("html", quoted, -1).alias("between"), F.regexp_extract_all("html", F.lit(quoted), F.lit(1)).alias("hrefs"))
    number = F.transform("hrefs", lambda h: F.array_position(F.array_distinct("hrefs"), h).cast("int"))
    before, after = (F.array(*[F.lit(x[i]) for x in _SITES]) for i in (0, 1))
    site = lambda n: n % len(_SITES) + 1
    listed = F.transform(number, lambda n: F.concat(F.lit('href="'), F.element_at(before, site(n)), n.cast("string"), F.element_at(after, site(n)), F.lit('"')))
    html = F.array_join(F.zip_with("between", listed, lambda text, link: F.concat(text, F.coalesce(link, F.lit("")))), "")
    return extract.entries(pages.select("page_id", html.alias("html")), "page_id")


_USE = "CASE WHEN trim(line) <> '' AND NOT contains(lower(line), 'http') THEN trim(line) END"


@query(
    "line_candidates",
    f"WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) SELECT id, pos::INT AS pos, coalesce(string_agg({_USE}, '|') OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '') AS candidates FROM l",
)
def line_candidates(spark, sf):
    return T.line_candidates(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", "pos", "candidates")


@query("work_type_by_text", "SELECT doc_id, CASE WHEN contains(lower(text), 'hybrid') THEN 'Hybrid' WHEN contains(lower(text), 'remote') THEN 'Remote' WHEN regexp_matches(lower(text), 'on-?site') THEN 'On-site' ELSE '' END AS work_type FROM documents")
def work_type_by_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.work_type(F.col("text")).alias("work_type"))


@query(
    "nearest_token",
    r"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), p AS (SELECT doc_id, string_split(t, 'license') AS a, string_split_regex(t, '\bthe\b') AS b, string_split_regex(t, '\band\b') AS c FROM d),
    s AS (SELECT doc_id, list_transform(range(1, len(a)), lambda i: length(array_to_string(a[1:i], 'license'))) AS a, list_transform(range(1, len(b)), lambda i: length(array_to_string(b[1:i], 'the'))) AS b, list_transform(range(1, len(c)), lambda i: length(array_to_string(c[1:i], 'and'))) AS c FROM p),
    m AS (SELECT doc_id, list_min(flatten(list_transform(a, lambda x: list_transform(b, lambda y: abs(x - y))))) AS d0, list_min(flatten(list_transform(a, lambda x: list_transform(c, lambda y: abs(x - y))))) AS d1 FROM s)
    SELECT doc_id, CASE WHEN d0 <= 40 AND d0 <= coalesce(d1, d0) THEN 'the' WHEN d1 <= 40 THEN 'and' END AS token FROM m""",
)
def nearest_token(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = offsets.nearest_token(docs, "doc_id", F.col("text"), F.lit("license"), {"the": ("the",), "and": ("and",)}, 40)
    return docs.select("doc_id").join(found, "doc_id", "left")


@query("unique_word_ratio", "SELECT doc_id, round(len(list_distinct(w))::DOUBLE / len(w), 6) AS ratio FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+') AS w FROM documents) WHERE len(w) >= 45")
def unique_word_ratio(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ0-9]+"), F.lit(0)).alias("w")).where(F.size("w") >= 45)
    return rows.select("doc_id", F.round(F.size(F.array_distinct("w")) / F.size("w"), 6).alias("ratio"))


@query("summary_display", r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 260) AS summary FROM documents")
def summary_display(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.summary_text(F.lit(""), F.col("text")).alias("summary"))


@query("retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def retention(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    return events.join(F.broadcast(events.agg(F.max("ts").alias("now")))).where("ts >= now - INTERVAL 10 DAYS").select("event_id")


_EVENT = {"view": "viewed_on", "click": "viewed_off", "purchase": "applied_on", "signup": "relevant", "error": "not_relevant"}


@query(
    "feedback_fold",
    """WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 END AS v, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 END AS a, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN 0 END AS r FROM events)
    SELECT user_id, coalesce(arg_max(v, (ts, event_id)) FILTER (v IS NOT NULL), 0)::INT AS viewed, coalesce(arg_max(a, (ts, event_id)) FILTER (a IS NOT NULL), 0)::INT AS applied, coalesce(arg_max(r, (ts, event_id)) FILTER (r IS NOT NULL), 0)::INT AS relevant,
      CASE WHEN coalesce(arg_max(r, (ts, event_id)) FILTER (r IS NOT NULL), 0) = 1 THEN 'relevant' ELSE 'not relevant' END AS category,
      CASE arg_max(r, (ts, event_id)) FILTER (r IS NOT NULL) WHEN 1 THEN 'manual_feedback=relevant' WHEN 0 THEN 'manual_feedback=not relevant' ELSE '' END AS relevance_reason FROM e GROUP BY user_id""",
)
def feedback_fold(spark, sf):
    mapping = F.create_map(*[F.lit(x) for kv in _EVENT.items() for x in kv])
    log = table(spark, sf, "events").select("user_id", "ts", "event_id", F.element_at(mapping, F.col("event_type")).alias("event"))
    return T.fold_feedback(log, "user_id")


@query("json_skill_items", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_skill_items(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


from triagemill.plans import state_queries, table_queries  # noqa: E402,F401 - register their queries beside these
