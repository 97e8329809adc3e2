"""The state of jobs, skill patterns and their links, as transforms of tables: a snapshot and a change in, a snapshot out."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.functions import text as X
from triagemill.functions import urls as U
from triagemill.operators import triage as T
from triagemill.profile import Profile, skill_key, unique
from triagemill.scratch import cut, numbered

JOBS = """id long, source string, company string, title string, title_english string, place string, work_type string, position_link string, raw_text string, description string, viewed int, applied int,
    relevance_score double, relevant int, category string, relevance_reason string, summary string, created_at timestamp, updated_at timestamp"""
SKILL_PATTERNS = "id long, name string, name_key string, pattern string, source string, occurrences long, weight double, enabled int, created_at timestamp, updated_at timestamp, last_seen_at timestamp"
JOB_SKILLS = "job_id long, skill_id long"
#: What new rows hold where nothing is given.
DEFAULTS = {"title_english": "", "description": "", "viewed": 0, "applied": 0, "relevance_score": 0.0, "relevant": 0, "category": "not relevant", "relevance_reason": "", "summary": ""}
#: Links that a job may have, starts of titles and parts of texts that a LinkedIn job may not have, and days that it is kept.
KEPT_LINKS = r"linkedin\.com/.*jobs/view/|^(?=.*jobindex\.dk)(?=.*(?:jobid=|/jobannonce/[hr]))|^(?=.*jobs\.danfoss\.com)(?=.*/job/)"
ALERT_TITLES, ALERT_TEXTS = ("jobs similar to", "new jobs match your preferences", "job alert"), ("jobs similar to", "new jobs match your preferences")
RETENTION_DAYS = 90
#: Folders that a table of jobs is dealt into by its links.
BUCKETS = 4096
MANUAL_MARK = "[MANUAL_APPLIED_DESCRIPTION]"


def clean(jobs: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Jobs with a link that is kept, no alert mails, none older than `days`; missing values filled, titles cleaned (their translation
    goes with a change), links written anew and one row, that with the least id, each; the source is that of the link."""
    low = lambda c: F.lower(X.present(F.col(c)))
    alert = (low("source") == "linkedin") & (low("title").rlike("^(?:" + "|".join(ALERT_TITLES) + ")") | X.holds_any(low("raw_text"), ALERT_TEXTS))
    old = F.coalesce(F.col("created_at") < now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    rows = jobs.where(low("position_link").rlike(KEPT_LINKS) & ~alert & ~old)
    title, link = X.clean_title(F.col("title")), U.normalize(U.unwrap_tracker(F.col("position_link")))
    rows = rows.withColumns({
        "work_type": F.coalesce(F.nullif("work_type", F.lit("")), F.lit("Unknown")), "viewed": F.coalesce("viewed", F.lit(0)), "applied": F.coalesce("applied", F.lit(0)), "description": X.present(F.col("description")),
        "_title": title, "_link": F.coalesce(F.nullif(link, F.lit("")), F.col("position_link")),
    })
    changed = (F.col("_title") != "") & (F.col("_title") != X.present(F.col("title")))
    rows = rows.withColumns({"title_english": F.when(changed & (X.present(F.col("title_english")) != ""), "").otherwise(F.col("title_english")), "title": F.when(changed, F.col("_title")).otherwise(F.col("title")), "position_link": F.col("_link")})
    rows = rows.withColumn("source", U.provider(F.col("position_link"))).select(*jobs.columns)
    return T.first_by(rows, ["position_link"], "id")


def upsert_changes(jobs: DataFrame, incoming: DataFrame, now: Column, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What a batch changes: jobs that are new or differ, whole rows; and (ord, outcome) of the batch's rows, `inserted`, `merged` or `known`.

    `incoming`: ord (unique, the order of arrival), source, company, title, place, work_type, position_link, raw_text. A known link
    changes nothing. Else a row that is another source's posting of a job (the first such job, or else the first such row of the
    batch) is merged into it: its source counts, it fills a blank or unknown place and work type, the longer text stays, the translated title
    goes. Else it is inserted; ids go on after the largest in the order of arrival, without gaps. `near`: jobs among which all known links
    of the batch are, if not all need be asked. No task gets all rows of a link, of a key, or without a key."""
    rows = incoming.withColumns({
        "source": F.coalesce(F.nullif("source", F.lit("")), U.provider(F.col("position_link"))), "title": X.clean_title(F.col("title")), "work_type": F.coalesce("work_type", F.lit("Unknown")),
        **{c: X.present(F.col(c)) for c in ("company", "place", "raw_text")},
    }).withColumn("_key", X.cross_source_key(F.col("source"), F.col("company"), F.col("title")))
    rows = cut(rows)
    earliest = rows.groupBy("position_link").agg(F.min("ord").alias("ord")).join((jobs if near is None else near).select("position_link"), "position_link", "left_anti")
    once = cut(rows.join(earliest.select("ord"), "ord", "left_semi"))
    owner = F.coalesce(F.nullif("source", F.lit("")), U.provider(F.col("position_link")))
    keys = once.where("_key <> ''").select("_key").distinct()
    # Of the jobs that stand only those with a key of the batch go on.
    have = jobs.select("id", X.cross_source_key(owner, F.col("company"), F.col("title")).alias("_key")).where("_key <> ''").join(keys, "_key", "left_semi")
    targets = cut(have.groupBy("_key").agg(F.min("id").alias("_id")))
    # Of a key that no job has, the first row of the batch is inserted and the others are merged into it.
    heads = once.where("_key <> ''").groupBy("_key").agg(F.min("ord").alias("ord")).join(targets, "_key", "left_anti")
    fresh = once.where("_key = ''").select("ord").unionByName(heads.select("ord"))
    start = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ids = cut(numbered(fresh, [F.col("ord")], "_place").select("ord", (F.col("_place") + start).alias("id")))
    new, more = once.join(ids, "ord"), once.where("_key <> ''").join(ids, "ord", "left_anti")

    def first_of(column: str, usable: Column) -> Column:
        return F.min(F.when(usable, F.struct("ord", F.col(column).alias("v"))))["v"]

    fill = {c: (first_of(c, (F.col(c) != "") & (F.lower(F.col(c)) != "unknown")), F.max(F.when(F.col(c) != "", F.struct("ord", F.col(c).alias("v"))))["v"]) for c in ("place", "work_type")}
    change = more.groupBy("_key").agg(F.max(F.struct("ord", "source"))["source"].alias("_source"), *[x.alias(f"_{c}{i}") for c, xs in fill.items() for i, x in enumerate(xs)], F.max(F.struct(F.length("raw_text").alias("n"), (-F.col("ord")).alias("o"), F.col("raw_text").alias("v")))["v"].alias("_raw"))
    goals = targets.select("_key", F.col("_id").alias("_goal")).unionByName(new.where("_key <> ''").select("_key", F.col("id").alias("_goal")))
    change = change.join(goals, "_key").drop("_key")
    made = {**{c: F.lit(v) for c, v in DEFAULTS.items()}, "created_at": now, "updated_at": now}
    inserted = new.select(*[made.get(c, F.col(c) if c in new.columns else F.lit(None)).cast(jobs.schema[c].dataType).alias(c) for c in jobs.columns])
    joined = jobs.join(change, F.col("id") == F.col("_goal")).unionByName(inserted.join(change, F.col("id") == F.col("_goal"), "left"))
    known = lambda c: (X.present(F.col(c)) != "") & (F.lower(X.present(F.col(c))) != "unknown")
    hit = F.col("_goal").isNotNull()
    filled = lambda c: F.when(hit & ~known(c), F.coalesce(f"_{c}0", f"_{c}1", c)).otherwise(F.col(c))
    changed = joined.withColumns({
        "source": F.when(hit, F.coalesce(F.nullif("_source", F.lit("")), "source")).otherwise(F.col("source")), "title": F.when(hit, X.clean_title(F.col("title"))).otherwise(F.col("title")),
        "title_english": F.when(hit, "").otherwise(F.col("title_english")), "place": filled("place"), "work_type": F.when(hit, F.coalesce(F.nullif(filled("work_type"), F.lit("")), F.lit("Unknown"))).otherwise(F.col("work_type")),
        "raw_text": F.when(hit & (F.length("_raw") > F.length(X.present(F.col("raw_text")))), F.col("_raw")).otherwise(F.col("raw_text")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }).select(*jobs.columns)
    told = ids.select("ord", F.lit("inserted").alias("outcome")).unionByName(more.select("ord", F.lit("merged").alias("outcome")))
    outcomes = rows.select("ord").join(told, "ord", "left").withColumn("outcome", F.coalesce("outcome", F.lit("known")))
    return changed, outcomes


def upsert(jobs: DataFrame, incoming: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The jobs after a batch, and (ord, outcome) of its rows; see upsert_changes."""
    changed, outcomes = upsert_changes(jobs, incoming, now)
    changed = cut(changed)
    return jobs.join(changed.select("id"), "id", "left_anti").select(*jobs.columns).unionByName(changed), outcomes


def link_bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("position_link"), F.lit(buckets)).cast("int")


def write_buckets(jobs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Jobs as a table with a folder for each bucket of links; folders without rows here are left alone. Large buckets get several files."""
    rows = jobs.withColumn("bucket", link_bucket(buckets)).hint("rebalance", "bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOBS + ", bucket int").parquet(path)


def apply_changes(spark: SparkSession, path: str, changed: DataFrame, buckets: int = BUCKETS) -> int:
    """Writes changed jobs into a table of buckets: only the buckets that they are in are read and written again, which gives one result
    however often it is done. Returns their number."""
    touched = [r.bucket for r in changed.select(link_bucket(buckets).alias("bucket")).distinct().collect()]
    if touched:
        stay = read_buckets(spark, path).where(F.col("bucket").isin(touched)).join(changed.select("id"), "id", "left_anti")
        write_buckets(stay.select(*changed.columns).unionByName(changed), path, buckets)
    return len(touched)


def upsert_buckets(spark: SparkSession, path: str, incoming: DataFrame, now: Column, buckets: int = BUCKETS) -> tuple[int, DataFrame]:
    """A batch taken into a table of buckets; its links are looked up in their own buckets. Returns how many buckets were written anew, and
    the outcomes."""
    incoming = cut(incoming)
    asked = [r.bucket for r in incoming.select(link_bucket(buckets).alias("bucket")).distinct().collect()]
    table = read_buckets(spark, path)
    changed, outcomes = upsert_changes(table.drop("bucket"), incoming, now, table.where(F.col("bucket").isin(asked)))
    changed, outcomes = cut(changed), cut(outcomes)
    return apply_changes(spark, path, changed, buckets), outcomes


def ingest(jobs: DataFrame, entries: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The jobs after the entries of files (`file` and what upsert takes), and (file, found, inserted_new, skipped_existing). Entries
    without a link are neither found nor taken."""
    entries = entries.where(X.present(F.col("position_link")) != "")
    out, outcomes = upsert(jobs, entries, now)
    return out, counted(entries, outcomes)


def counted(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(file, found, inserted_new, skipped_existing) of a batch's entries (file, ord) and what became of them."""
    new = F.col("outcome") == "inserted"
    return entries.select("file", "ord").join(outcomes, "ord").groupBy("file").agg(F.count("*").alias("found"), F.count_if(new).alias("inserted_new"), F.count_if(~new).alias("skipped_existing"))


def set_fields(jobs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Values of `changes` (id and some columns of jobs; null leaves a value) put into the jobs of the ids."""
    columns = [c for c in changes.columns if c != "id"]
    c = changes.select("id", *[F.col(x).alias(f"_{x}") for x in columns], F.lit(True).alias("_hit"))
    rows = jobs.join(c, "id", "left").withColumns({x: F.coalesce(f"_{x}", x) for x in columns})
    return rows.withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))).select(*jobs.columns)


def append_text(jobs: DataFrame, changes: DataFrame, now: Column, mark: str = MANUAL_MARK, limit: int = 120_000) -> DataFrame:
    """Texts of `changes` (id, text), under a mark, put after the raw text of jobs applied for, once each; the last `limit` characters stay."""
    rows = jobs.join(changes.select("id", F.trim("text").alias("_text")), "id", "left")
    raw, block = F.trim(X.present(F.col("raw_text"))), F.concat(F.lit(mark + "\n"), F.col("_text"))
    wanted = F.coalesce((F.col("_text") != "") & (F.col("applied") == 1) & ~raw.contains(block), F.lit(False))
    merged = F.when(raw == "", block).otherwise(F.concat(raw, F.lit("\n\n"), block))
    return rows.withColumns({"raw_text": F.when(wanted, F.right(merged, F.lit(limit))).otherwise(F.col("raw_text")), "updated_at": F.when(wanted, now).otherwise(F.col("updated_at"))}).select(*jobs.columns)


def set_feedback(jobs: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """Jobs after feedback events (job_id, ts, event_id, event): each register is that of its latest event, else what it was."""
    out = []
    for i, register in enumerate(T.REGISTERS):
        effect = F.create_map(*[F.lit(x) for e, v in T.EFFECTS.items() if v[i] is not None for x in (e, v[i])])
        value = F.try_element_at(effect, F.col("event"))
        out.append(F.max(F.when(value.isNotNull(), F.struct("ts", "event_id", value.alias("v"))))["v"].alias(f"_{register}"))
    rows = jobs.join(log.groupBy(F.col("job_id").alias("id")).agg(*out, F.lit(True).alias("_hit")), "id", "left")
    rows = rows.withColumns({c: F.coalesce(f"_{c}", c) for c in ("viewed", "applied", "relevant")})
    category = F.when(F.col("relevant") == 1, "relevant").otherwise("not relevant")
    judged = F.col("_manual") == 1
    return rows.withColumns({
        "category": F.when(judged, category).otherwise(F.col("category")), "relevance_reason": F.when(judged, F.concat(F.lit("manual_feedback="), category)).otherwise(F.col("relevance_reason")),
        "updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at")),
    }).select(*jobs.columns)


def upsert_patterns(patterns: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Patterns after `changes` (name, pattern, source, occurrences, weight, enabled; one row a name key): see merge_patterns. New ones
    get ids after the largest, in the order of their keys."""
    changes = changes.withColumn("name_key", X.skill_key(F.col("name"))).where("name_key <> ''")
    merged = T.merge_patterns(patterns.select("name_key", "name", "pattern", "source", "occurrences", "weight"), changes)
    old = patterns.select("name_key", "id", "created_at", F.col("enabled").alias("_enabled"), F.col("updated_at").alias("_updated"), F.col("last_seen_at").alias("_seen"))
    rows = merged.join(old, "name_key", "left").join(changes.select("name_key", F.coalesce("enabled", F.lit(1)).alias("_now"), F.lit(True).alias("_hit")), "name_key", "left")
    rows = cut(rows)
    last = patterns.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(rows.where("id IS NULL"), [F.col("name_key")], "_place").withColumn("id", F.col("_place") + last).drop("_place")
    rows = rows.where("id IS NOT NULL").unionByName(new).withColumns({
        "enabled": F.coalesce("_now", "_enabled"), "created_at": F.coalesce("created_at", now), "updated_at": F.when(F.col("_hit"), now).otherwise(F.col("_updated")), "last_seen_at": F.when(F.col("_hit"), now).otherwise(F.col("_seen")),
    })
    return rows.select(*[F.col(c).cast(patterns.schema[c].dataType).alias(c) for c in patterns.columns])


def seed_patterns(patterns: DataFrame, profile: Profile, now: Column) -> DataFrame:
    """The patterns with those of the profile, which count as never seen."""
    rows = [(n, p) for n, p in profile.known_skill_patterns]
    if not rows:
        return patterns
    seeds = patterns.sparkSession.createDataFrame(rows, "name string, pattern string").withColumn("name_key", X.skill_key(F.col("name")))
    seeds = T.first_by(seeds, ["name_key"], "name").select("name", "pattern", F.lit("profile_seed").alias("source"), F.lit(0).alias("occurrences"), F.lit(0.0).alias("weight"), F.lit(1).alias("enabled"))
    return upsert_patterns(patterns, seeds, now)


def patterns_in_order(patterns: DataFrame, enabled_only: bool = True) -> DataFrame:
    """By weight, occurrences and name, the order that ties between matches follow."""
    rows = patterns.where("enabled = 1") if enabled_only else patterns
    return rows.orderBy(F.desc("weight"), F.desc("occurrences"), "name", "id")


def pattern_table(patterns: DataFrame, profile: Profile) -> DataFrame:
    """What texts are matched with, for operators/patterns.py: the enabled patterns, or where there are none those of the profile; blocked
    skills are left out. Matches at one place follow the order of patterns_in_order."""
    spark = patterns.sparkSession
    order = F.struct((-F.col("weight")).alias("w"), (-F.col("occurrences")).alias("o"), F.col("name").alias("n"))
    rows = patterns.where("enabled = 1 AND trim(name) <> '' AND trim(pattern) <> ''").select(F.col("id").alias("pid"), F.trim("name").alias("name"), F.trim("pattern").alias("pattern"), order.alias("ord"))
    if not patterns.where("enabled = 1").head(1):
        given = [(i, n, p, (0.0, 0, f"{i:09d}")) for i, (n, p) in enumerate(profile.known_skill_patterns)]
        rows = spark.createDataFrame(given, "pid long, name string, pattern string, ord struct<w:double,o:long,n:string>")
    blocked = [skill_key(x) for x in profile.blocked_skills]
    return rows.where(~X.skill_key(F.col("name")).isin(*blocked)) if blocked else rows


def word_pattern(name: Column) -> Column:
    """A pattern for a plain name: its words in order, any white space between, at word boundaries; read alike by Java, `re` and RE2."""
    words = F.transform(F.split(name, r"\s+"), lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_\s])", r"\\$1"))
    return F.concat(F.lit(r"\b"), F.array_join(words, r"\s+"), F.lit(r"\b"))


def set_job_skills(patterns: DataFrame, links: DataFrame, skills: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Patterns and links after skills (job_id, name) were found: a pattern is made for a new one, with counts of 0; links are added once."""
    named = skills.select("job_id", X.skill_name(F.col("name")).alias("name")).where("name <> ''").withColumn("name_key", X.skill_key(F.col("name")))
    new = named.select("name", "name_key").dropDuplicates(["name_key"]).join(patterns.select("name_key"), "name_key", "left_anti")
    new = new.select("name", word_pattern(F.col("name")).alias("pattern"), F.lit("detected").alias("source"), F.lit(0).alias("occurrences"), F.lit(0.0).alias("weight"), F.lit(1).alias("enabled"))
    after = upsert_patterns(patterns, new, now)
    found = named.join(after.select("name_key", F.col("id").alias("skill_id")), "name_key").select("job_id", "skill_id")
    return after, links.select("job_id", "skill_id").unionByName(found).distinct()


def job_skills(links: DataFrame, patterns: DataFrame) -> DataFrame:
    """(job_id, skills) in the order of names; links to what is no more are left out."""
    named = links.join(patterns.select(F.col("id").alias("skill_id"), "name"), "skill_id")
    return named.groupBy("job_id").agg(F.sort_array(F.collect_list("name")).alias("skills"))


def clear_unviewed(links: DataFrame, jobs: DataFrame) -> DataFrame:
    """Links but those of jobs nobody has viewed."""
    return links.join(jobs.where(F.coalesce("viewed", F.lit(0)) == 0).select(F.col("id").alias("job_id")), "job_id", "left_anti").select(*links.columns)


def clear_job(links: DataFrame, job_id: int) -> DataFrame:
    return links.where(F.col("job_id") != job_id)


def delete_skill(patterns: DataFrame, links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    return delete_skills(patterns, links, patterns.sparkSession.createDataFrame([(name,)], "name string"))


def delete_skills(patterns: DataFrame, links: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns and links without the skills of `names` (name), whatever their number, by one join each."""
    keys = names.select(X.skill_key(F.col("name")).alias("_key")).distinct()
    gone = patterns.withColumn("_key", X.skill_key(F.col("name"))).join(keys, "_key", "left_semi").select(F.col("id").alias("skill_id"))
    return patterns.withColumn("_key", X.skill_key(F.col("name"))).join(keys, "_key", "left_anti").select(*patterns.columns), links.join(gone, "skill_id", "left_anti").select(*links.columns)


def skills_tab(patterns: DataFrame, profile: Profile) -> DataFrame:
    """(name, key, source, occurrences, weight, has_skill, want_to_learn): the table's skills and the profile's, one row each, blocked
    ones left out, by name. The table counts before the profile, of it the most occurrences and weight."""
    spark = patterns.sparkSession
    lists = [(n, "profile", 0, 0) for n, _ in profile.known_skill_patterns] + [(n, "profile", 1, 0) for n in profile.user_skills] + [(n, "profile", 0, 1) for n in profile.missing_skills_suggestions]
    given = spark.createDataFrame(lists, "name string, source string, has int, want int") if lists else spark.createDataFrame([], "name string, source string, has int, want int")
    rows = patterns.select("name", F.lit("db").alias("source"), F.lit(0).alias("has"), F.lit(0).alias("want"), "occurrences", "weight").unionByName(given.withColumns({"occurrences": F.lit(0).cast("long"), "weight": F.lit(0.0)}))
    rows = rows.withColumn("name", X.skill_name(F.col("name"))).where("name <> ''").withColumn("key", F.lower("name"))
    if profile.blocked_skills:
        blocked = spark.createDataFrame([(b,) for b in profile.blocked_skills], "name string").select(F.lower(X.skill_name(F.col("name"))).alias("key"))
        rows = rows.join(F.broadcast(blocked), "key", "left_anti")
    out = rows.groupBy("key").agg(F.first("name").alias("name"), F.min("source").alias("source"), F.max("occurrences").alias("occurrences"), F.max("weight").alias("weight"), (F.max("has") == 1).alias("has_skill"), (F.max("want") == 1).alias("want_to_learn"))
    return out.select("name", "key", "source", "occurrences", "weight", "has_skill", "want_to_learn").orderBy("key", F.desc("occurrences"))


def learn_patterns(patterns: DataFrame, counts: DataFrame, now: Column, least: int = 3, limit: int = 20) -> DataFrame:
    """Patterns after weighted counts (skill, weight): known ones count them on, and of the others those of `least` at least, the
    first `limit` by count and name, are new ones of the same words."""
    counts = counts.withColumn("name_key", X.skill_key(F.col("skill")))
    known = counts.join(patterns.select("name_key", "pattern"), "name_key").select(F.col("skill").alias("name"), "pattern", "weight")
    fresh = counts.join(patterns.select("name_key"), "name_key", "left_anti").where(F.col("weight") >= least).orderBy(F.desc("weight"), "name_key").limit(limit)
    fresh = fresh.select(F.col("skill").alias("name"), word_pattern(F.col("name_key")).alias("pattern"), "weight")
    change = known.unionByName(fresh).select("name", "pattern", F.lit("learned").alias("source"), F.col("weight").cast("long").alias("occurrences"), F.col("weight").cast("double").alias("weight"), F.lit(1).alias("enabled"))
    return upsert_patterns(patterns, change, now)


def learned_profile(profile: Profile, jobs: DataFrame, keywords: int = 20, patterns: DataFrame | None = None) -> Profile:
    """The profile with the keywords that the jobs' categories tell and the skills that jobs applied for ask and the user lacks; both
    replace what was learned before. The driver gets at most 40 keywords and the skills' limit."""
    labelled = jobs.where("category IN ('relevant', 'not relevant')").select("id", F.concat_ws("\n", *[X.present(F.col(c)) for c in ("title", "company", "place", "work_type", "raw_text")]).alias("text"), (F.col("category") == "relevant").cast("int").alias("relevant"))
    found = T.learn_keywords(labelled, profile.stop_words, keywords).collect()
    include = [r.token for r in sorted(found, key=lambda r: r["rank"]) if r.kind == "include"]
    exclude = [r.token for r in sorted(found, key=lambda r: r["rank"]) if r.kind == "exclude" and r.token not in include]
    asked = jobs.where("applied = 1").select("id", F.concat_ws("\n", *[X.present(F.col(c)) for c in ("title", "summary", "raw_text")]).alias("text"))
    missing = T.skill_counts(asked, profile, F.lit(1), profile.missing_skills_max_items, (*profile.user_skills, *profile.blocked_skills), patterns).collect()
    return replace(profile, learned_include_keywords=unique(include), learned_exclude_keywords=unique(exclude), missing_skills_suggestions=unique(r.skill for r in missing))


def refresh_candidates(jobs: DataFrame, category: str = "", source: str = "", links: tuple[str, ...] = (), ids: tuple[int, ...] = (), limit: int = 0, missing_only: bool = False, unviewed_only: bool = False) -> DataFrame:
    """Jobs whose description may be made anew: not applied for, and what else is asked; by score, the latest change, and id."""
    rows = jobs.where(F.coalesce("applied", F.lit(0)) == 0)
    for asked, condition in (
        (category, F.col("category") == category), (source, F.lower(X.present(F.col("source"))) == source.strip().lower()), (links, F.col("position_link").isin(*links)), (ids, F.col("id").isin(*ids)),
        (missing_only, F.trim(X.present(F.col("description"))) == ""), (unviewed_only, F.coalesce("viewed", F.lit(0)) == 0),
    ):
        rows = rows.where(condition) if asked else rows
    rows = rows.orderBy(F.desc("relevance_score"), F.desc("updated_at"), "id")
    return rows.limit(limit) if limit > 0 else rows
