"""Skills out of texts and out of models' answers, and the rules that tell them from phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.functions import text as X
from triagemill.operators import patterns as P
from triagemill.operators import triage as T
from triagemill.operators.models import Factory, ask
from triagemill.profile import Profile

#: What a sentence that asks for something holds, and what stands before what it asks for.
CUES = r"(?i)\b(requirements?|required|must have|qualifications?|you (?:will|should)|experience with|we are looking for)\b"
CUE_START = r"(?i)^.*?\b(?:requirements?|qualifications?)\b\s*:?"
#: First words of what is no skill, and words that alone make none.
LED = r"^(?:our|we|you|they|it|this|that|these|those|and|or|but)\b"
EMPTY_WORDS = ("our", "we", "you", "their", "team", "colleague", "company", "role", "position", "work", "used", "across", "with", "for", "and", "or", "but", "the", "a", "an", "as", "at", "to")
#: Fixed values of the cleanup: words that no skill holds, that none is alone, that none begins with, and phrases that are none.
CLEANUP_STOPWORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "with", "within")
CLEANUP_SINGLE = (
    "analyze", "assessments", "carrying", "coordinating", "customers", "funding", "goals", "guidance", "industries", "international", "internally", "logistics", "maintain", "market", "mission", "monitored", "operate",
    "operating", "orders", "ownership", "partnerships", "positive", "pricing", "processes", "product", "projects", "race", "reporting", "review", "sales", "safely", "scans", "secure", "services", "setting", "software",
    "solutions", "structured", "succeeding", "systems", "talents", "technologies", "therefore", "together", "tools", "treat",
)
CLEANUP_PREFIXES = (
    "ability", "building", "calibration", "can", "challenge", "coaching", "deliver", "delivering", "degree", "depends", "determine", "discussing", "e.g", "enable", "establishing", "experience", "familiarity", "governing",
    "grow", "growing", "hands-on", "has", "have", "help", "implementing", "improving", "including", "influence", "integrate", "into", "invaluable", "issue", "knowledge", "will", "working",
)
CLEANUP_PHRASES = (
    "ability to work independently", "building standalone applications", "coaching developers onboarding", "data driven approach", "deliver high-quality solutions", "depends on manual effort", "determine root causes",
    "discussing product strategy", "global engineering", "grow professionally", "grow with us", "has been", "have access to support", "help to ensure quality", "implementing the finished solution",
    "improving their environmental impact", "in addition", "in device software", "in the future", "in this newly shaped role", "including blender", "including indirect reports", "into a seamless technical ecosystem",
    "into designs to supporting implementation", "into working", "interact efficiently with our services", "more specifically", "not theory", "set by radio communication solutions?", "slows down",
    "software architecture fundamentals", "will design", "will help shape",
)
#: Fixed values of the cleanup: characters and words that no skill holds, what its words are made of, and the most of them.
CLEANUP_MALFORMED, CLEANUP_PRONOUNS, CLEANUP_TOKEN, CLEANUP_MOST = r"[?\[\]{}]", r"\b(?:we|our|you|your|they|them|their)\b", "[a-z0-9+#./-]+", 4
ITEM = "name string, confidence double, evidence string"


def keys_of(names: tuple[str, ...]) -> Column:
    return F.filter(F.transform(F.array(*map(F.lit, names)).cast("array<string>"), X.skill_name), lambda x: x != "")


def cleanup_reason(name: Column, source: Column, protected: Column) -> Column:
    """Why a stored skill is none, or empty; `protected`: an array of keys that are left alone, as are the profile's own."""
    key = X.skill_name(name)
    tokens = F.regexp_extract_all(key, F.lit(CLEANUP_TOKEN), F.lit(0))
    first = F.get(tokens, F.lit(0))
    return (
        F.when(key == "", "empty").when(F.array_contains(protected, key) | F.startswith(F.lower(F.trim(X.present(source))), F.lit("profile")), "")
        .when(key.isin(*CLEANUP_PHRASES), "generic phrase").when(key.rlike(CLEANUP_MALFORMED), "malformed text").when(key.rlike(CLEANUP_PRONOUNS), "sentence fragment")
        .when(F.size(tokens) == 0, "empty").when(F.size(tokens) > CLEANUP_MOST, "too many words").when(F.exists(tokens, lambda t: t.isin(*CLEANUP_STOPWORDS)), "contains stopword")
        .when(first.isin(*CLEANUP_PREFIXES), "sentence fragment").when((F.size(tokens) == 1) & first.isin(*CLEANUP_SINGLE), "generic term").otherwise("")
    )


def cleanup_candidates(patterns: DataFrame, profile: Profile) -> DataFrame:
    """(name, reason, source, occurrences, weight) of stored skills that are none, the most frequent first; `patterns`: id, name, source,
    occurrences, weight."""
    named = (*[n for n, _ in profile.known_skill_patterns], *profile.user_skills, *profile.missing_skills_suggestions)
    rows = patterns.withColumn("key", X.skill_name(F.col("name"))).where(F.col("key") != "")
    rows = rows.where(~F.array_contains(keys_of(profile.blocked_skills), F.col("key")))
    rows = T.first_by(rows, ["key"], "id").withColumn("reason", cleanup_reason(F.col("name"), F.col("source"), keys_of(named))).where("reason <> ''")
    return rows.select(F.col("key").alias("name"), "reason", "source", "occurrences", "weight").orderBy(F.desc("occurrences"), F.desc("weight"), "name")


def good_phrase(name: Column) -> Column:
    """Neither led by a pronoun or connective nor made of empty words alone."""
    key = X.skill_name(name)
    tokens = F.regexp_extract_all(key, F.lit("[a-z0-9+#.]+"), F.lit(0))
    return (key != "") & ~key.rlike(LED) & (F.size(tokens) > 0) & F.exists(tokens, lambda t: ~t.isin(*EMPTY_WORDS))


def strong_candidate(name: Column, evidence: Column, confidence: Column, text: Column, threshold: float = 0.9, around: int = 200) -> Column:
    """A skill of four words at most that a model is sure of and the text holds, as its evidence; where the text holds it to the letter,
    near a cue."""
    def judged(v: Column) -> Column:
        key, corpus, proof = v["key"], v["corpus"], v["proof"]
        at = F.call_function("locate", key, corpus)
        words = F.transform(F.split(key, " "), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
        spelled = F.rlike(corpus, F.concat(F.lit(r"\b"), F.array_join(words, r"\s+"), F.lit(r"\b")))
        start = F.greatest(F.lit(1), at - around)
        near = F.substring(corpus, start, at + F.length(key) + around - start)
        return (key != "") & (F.size(words) <= 4) & (confidence >= threshold) & ((at > 0) | spelled) & ((proof == "") | corpus.contains(proof)) & ((at == 0) | near.rlike(CUES))

    return X.let(F.struct(X.skill_name(name).alias("key"), F.lower(X.compact(text)).alias("corpus"), F.lower(X.compact(evidence)).alias("proof")), judged)


def json_object(text: Column) -> Column:
    """What stands from the first brace to the last one of a model's answer; empty if there is no such thing."""
    t = X.present(text)
    first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    return F.when((first > 0) & F.reverse(t).contains("}") & (last > first), F.substring(t, first, last - first + 1)).otherwise("")


def json_items(text: Column, field: str) -> Column:
    """The items of a list in a model's answer, as (name, confidence, evidence): a bare text is the name of an item that is sure; what is
    neither a text nor an object is none. No item if the answer can't be read."""
    listed = F.try_variant_get(F.try_parse_json(json_object(text)), f"$.{field}", "array<variant>")
    is_text, is_object = (lambda x: F.schema_of_variant(x) == "STRING"), (lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    told = lambda x, name, kind: F.try_variant_get(x, f"$.{name}", kind)
    item = lambda x: F.struct(
        F.when(is_text(x), x.cast("string")).otherwise(told(x, "name", "string")).alias("name"), F.when(is_text(x), F.lit(1.0)).otherwise(F.coalesce(told(x, "confidence", "double"), F.lit(0.0))).alias("confidence"),
        F.when(is_text(x), "").otherwise(X.present(told(x, "evidence", "string"))).alias("evidence"),
    )
    kept = F.transform(F.filter(listed, lambda x: is_text(x) | is_object(x)), item)
    return F.coalesce(F.filter(kept, lambda x: X.present(x["name"]) != ""), F.array().cast("array<struct<name:string,confidence:double,evidence:string>>"))


def mined_skills(text: Column, patterns: list[tuple[str, str]], limit: int = 10) -> Column:
    """The patterns' names by place; if there are fewer than the limit, what sentences with a cue ask for, too."""
    return with_cued(text, T.required_skills(F.lower(X.compact(text)), patterns), limit)


def with_cued(text: Column, known: Column, limit: int = 10) -> Column:
    """The skills known to be in a text; if there are fewer than the limit, what its sentences with a cue ask for, too."""
    source = X.compact(text)
    cued = F.filter(F.split(source, r"(?<=[.!?])\s+"), lambda s: s.rlike(CUES))
    phrases = F.flatten(F.transform(cued, lambda s: F.transform(F.split(F.regexp_replace(s, CUE_START, ""), r"(?i),|\band\b|\bor\b"), X.skill_name)))
    keys = F.transform(known, lambda x: F.lower(x))
    more = F.filter(F.array_distinct(phrases), lambda p: (p != "") & ~F.array_contains(keys, p))
    return F.slice(F.when(F.size(known) >= limit, known).otherwise(F.concat(known, more)), 1, limit)


def unblocked(names: Column, blocked: tuple[str, ...], limit: int | None = None) -> Column:
    """Skills by their names, one of each, without blocked ones."""
    keys = keys_of(blocked)
    out = F.array_distinct(F.filter(F.transform(names, X.skill_name), lambda x: (x != "") & ~F.array_contains(keys, x)))
    return F.slice(out, 1, limit) if limit else out


def skills_of(rows: DataFrame, text: str, profile: Profile, model: Factory | None = None, cached: DataFrame | None = None, key: str = "id", limit: int = 10, table: DataFrame | None = None) -> DataFrame:
    """Adds skills: those `cached` (key, skills) has; else those of a model's JSON answer (known ones it matched, and new ones that are
    strong and well put, a few); else those its text or the row's holds. With a `table` of patterns texts are matched with that; the known
    skills of an answer are the profile's in either case."""
    patterns = profile.patterns()
    if table is None:
        found = mined_skills(F.col(text), patterns, limit)
    else:
        rows = P.with_skills(rows, key, F.lower(X.compact(F.col(text))), table, "_known")
        found = with_cued(F.col(text), F.col("_known"), limit)
    if model is not None:
        # The profile's own keys are made once, not for each item of an answer.
        names = rows.sparkSession.range(1).select(keys_of(tuple(n for n, _ in patterns)).alias("k")).first().k
        known = F.array(*map(F.lit, names)).cast("array<string>")
        rows = ask(rows, text, "_answer", model)
        matched = F.filter(F.transform(json_items(F.col("_answer"), "matched_known"), lambda x: X.skill_name(x["name"])), lambda n: F.array_contains(known, n))
        fresh = F.filter(json_items(F.col("_answer"), "new_candidates"), lambda x: strong_candidate(x["name"], x["evidence"], x["confidence"], F.col(text), profile.skill_new_confidence_threshold) & good_phrase(x["name"]))
        fresh = F.filter(F.transform(fresh, lambda x: X.skill_name(x["name"])), lambda n: ~F.array_contains(known, n))
        told = F.concat(matched, F.slice(fresh, 1, profile.skill_new_max_per_job))
        # An answer that is no JSON counts for the known skills it names.
        named = F.filter(X.split_skills(X.clean_answer_skills(F.col("_answer"))), lambda n: F.array_contains(known, n))
        told = F.when(json_object(F.col("_answer")) != "", told).otherwise(named)
        told, mined = F.coalesce(told, F.array().cast("array<string>")), found
        found = X.let(told, lambda t: F.when(F.size(t) > 0, t).otherwise(mined))
    rows = rows.withColumn("skills", unblocked(found, profile.blocked_skills, limit)).drop("_answer", "_known")
    if cached is None:
        return rows
    kept = cached.select(F.col(key).alias("_of"), F.col("skills").alias("_cached"))
    return rows.join(kept, F.col(key) == F.col("_of"), "left").withColumn("skills", F.coalesce(F.when(F.size("_cached") > 0, F.col("_cached")), "skills")).drop("_of", "_cached")


def skills_of_cv(text: str, spark, profile: Profile, limit: int = 40, table: DataFrame | None = None, model: Factory | None = None) -> tuple[str, ...]:
    """The skills of one CV (a driver's text), by a model where there is one."""
    rows = spark.createDataFrame([(0, text)], "id long, text string")
    return tuple(skills_of(rows, "text", profile, model, limit=max(20, limit), table=table).first().skills[:limit])
