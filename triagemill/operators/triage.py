"""Scoring, merging, learning, state and serving of job records: DataFrame in, DataFrame out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagemill.functions import text as X
from triagemill.operators import patterns as P
from triagemill.profile import Profile, skill_key, valid_pattern

#: A pattern that is a plain string.
PLAIN = re.compile(r"[a-z0-9 _#/,;:=@&!<>'\"-]+", re.I)
MANUAL = ("manual_feedback=relevant", "manual_feedback=not relevant")


def hits(low: Column, keywords: tuple[str, ...]) -> Column:
    """How many of the keywords a text, in small letters, holds."""
    return reduce(lambda a, b: a + b, [low.contains(k.lower()).cast("int") for k in keywords], F.lit(0))


def found_keywords(low: Column, keywords: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[F.lit(k.lower()) for k in keywords]).cast("array<string>"), lambda k: low.contains(k))


def required_skills(text: Column, patterns: list[tuple[str, str]], limit: int | None = None) -> Column:
    """The names of a profile's few patterns that match, whatever the case, by place of the first match, then by pattern order; one of
    each key. For a table of patterns see operators/patterns.py."""
    low = F.lower(X.present(text))

    def place(pattern: str) -> Column:
        if PLAIN.fullmatch(pattern):
            return F.instr(low, pattern.lower())
        # Letters of all scripts count for word bounds where the pattern asks for any.
        return F.regexp_instr(low, F.lit(("(?iU)" if "\\" in pattern or not pattern.isascii() else "(?i)") + pattern))

    found = [F.struct(place(p).alias("at"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, p) in enumerate(patterns) if valid_pattern(p)]
    if not found:
        return F.array().cast("array<string>")
    return P.names_found(P.firsts(F.sort_array(F.filter(F.array(*found), lambda x: x["at"] > 0))), limit)


def score(text: Column, profile: Profile, easy: Column | None = None) -> Column:
    """The score as one expression, for a text that is at hand; see scored."""
    user, low = [skill_key(s) for s in profile.user_skills], F.lower(X.present(text))
    out = profile.include_weight * hits(low, profile.include_keywords) - profile.exclude_weight * hits(low, profile.exclude_keywords)
    if user:
        need = F.transform(required_skills(low, profile.patterns()), X.skill_key)
        matched = F.size(F.filter(need, lambda s: s.isin(*user)))
        out = out + profile.skill_match_weight * matched - profile.skill_missing_penalty * (F.size(need) - matched)
    return out if easy is None else out + profile.easy_apply_bonus * easy.cast("int")


def scored(rows: DataFrame, profile: Profile, text: Column, source: Column | None = None, link: Column | None = None, probe: Column | None = None, patterns: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Adds relevance_score and relevance_reason. With source and link a LinkedIn posting that can be applied to with ease (by its
    text, or else by what a `probe` of its page found) gets the bonus. The text is put in small letters, and its skills are looked
    for, once a row: by the profile's patterns, or those of a table (see operators/patterns.py; `key` tells rows apart)."""
    user = F.array(*[F.lit(skill_key(s)) for s in profile.user_skills]).cast("array<string>")
    rows = rows.withColumn("_low", F.lower(X.present(text)))
    rows = rows.withColumn("_need", required_skills(F.col("_low"), profile.patterns())) if patterns is None else P.with_skills(rows, key, F.col("_low"), patterns, "_need")
    low, need = F.col("_low"), F.col("_need")
    matched = F.filter(need, lambda s: F.array_contains(user, X.skill_key(s)))
    missing = F.filter(need, lambda s: ~F.array_contains(user, X.skill_key(s)))
    points = profile.include_weight * hits(low, profile.include_keywords) - profile.exclude_weight * hits(low, profile.exclude_keywords)
    if profile.user_skills:
        points = points + profile.skill_match_weight * F.size(matched) - profile.skill_missing_penalty * F.size(missing)
    easy = F.lit(False)
    if source is not None and link is not None:
        said = X.easy_apply(low) if probe is None else X.easy_apply(low) | F.coalesce(probe, F.lit(False))
        easy = X.from_linkedin(source, link) & said
        points = points + profile.easy_apply_bonus * easy.cast("int")
    shown = lambda words, n: F.concat(F.lit("["), F.array_join(F.transform(F.slice(words, 1, n), X.quoted), ", "), F.lit("]"))
    rows = rows.withColumn("relevance_score", points)
    bonus = repr(profile.easy_apply_bonus)
    reason = F.concat_ws(
        "; ", F.concat(F.lit("score="), X.one_decimal(F.col("relevance_score"))), F.concat(F.lit("include="), shown(found_keywords(low, profile.include_keywords), 6)), F.concat(F.lit("exclude="), shown(found_keywords(low, profile.exclude_keywords), 6)),
        F.concat(F.lit("required_skills="), shown(F.array_sort(F.transform(need, X.skill_key)), 8)), F.concat(F.lit("matched_skills="), shown(F.array_sort(matched), 8)), F.concat(F.lit("missing_skills="), shown(F.array_sort(missing), 8)),
        F.concat(F.lit("easy_apply="), F.when(easy, "True").otherwise("False")), F.concat(F.lit("easy_apply_bonus="), F.when(easy, bonus).otherwise("0")),
    )
    return rows.withColumn("relevance_reason", reason).drop("_low", "_need")


def job_text() -> Column:
    return F.concat_ws("\n", X.present(F.col("title")), X.present(F.col("company")), X.present(F.col("raw_text")))


def apply_relevance(jobs: DataFrame, profile: Profile, prune: bool = False, probe: Column | None = None, patterns: DataFrame | None = None) -> DataFrame:
    """Jobs scored anew by title, company and raw text; rows judged by hand keep what they have. With `prune` those that aren't
    relevant go."""
    manual = X.present(F.col("relevance_reason")).isin(*MANUAL)
    old = {c: F.col(c) for c in ("relevance_score", "relevant", "relevance_reason")}
    kept = jobs.withColumn("_old", F.struct(*old.values())).withColumn("_manual", manual)
    kept = scored(kept, profile, job_text(), F.col("source"), F.col("position_link"), probe, patterns)
    kept = kept.withColumn("relevant", (F.col("relevance_score") >= profile.min_score).cast("int"))
    for c in old:
        kept = kept.withColumn(c, F.when(F.col("_manual"), F.col(f"_old.{c}")).otherwise(F.col(c)))
    out = kept.withColumn("category", F.when(F.col("relevant") == 1, "relevant").otherwise("not relevant")).select(*jobs.columns, *[c for c in ("category",) if c not in jobs.columns])
    return out.where("category <> 'not relevant'") if prune else out


def rescore(jobs: DataFrame, profile: Profile, ids: Column, patterns: DataFrame | None = None) -> DataFrame:
    """The jobs that `ids` holds for scored anew, whatever was judged by hand; one applied for is relevant."""
    fresh = scored(jobs.where(ids), profile, job_text(), F.col("source"), F.col("position_link"), patterns=patterns)
    relevant = ((F.col("relevance_score") >= profile.min_score) | (F.coalesce("applied", F.lit(0)) == 1)).cast("int")
    fresh = fresh.withColumn("relevant", relevant).withColumn("category", F.when(F.col("relevant") == 1, "relevant").otherwise("not relevant"))
    return jobs.where(~F.coalesce(ids, F.lit(False))).unionByName(fresh.select(*jobs.columns))


def merge_duplicates(jobs: DataFrame, key: str, rank: Column) -> DataFrame:
    """One row a key, with all columns of `jobs` and `rows`, how many it was made of. The keeper is the best by rank, applied and least
    id; a blank company and title, and a blank or unknown place and work type, are filled from the next best that has one, raw_text is
    the longest, viewed and applied the highest. Rows with an empty key or none pass."""
    order = F.struct((-rank).alias("r"), (-F.coalesce("applied", F.lit(0))).alias("a"), "id")

    def first(column: str, usable: Column) -> Column:
        return F.min(F.when(usable, F.struct(order.alias("o"), F.col(column).alias("v"))))["v"]

    def last(column: str, usable: Column) -> Column:
        return F.max(F.when(usable, F.struct(order.alias("o"), F.col(column).alias("v"))))["v"]

    def filled(c: str) -> Column:
        some = X.present(F.col(c)) != ""
        known = some & (F.lower(X.present(F.col(c))) != "unknown")
        return F.coalesce(first(c, known), last(c, some), F.lit(""))

    text = F.struct(F.length(X.present(F.col("raw_text"))).alias("n"), rank.alias("r"), F.coalesce("applied", F.lit(0)).alias("a"), (-F.col("id")).alias("i"), F.col("raw_text").alias("v"))
    made = {
        "company": first("company", X.present(F.col("company")) != ""), "title": X.clean_title(first("title", X.present(F.col("title")) != "")), "place": filled("place"), "work_type": F.coalesce(F.nullif(filled("work_type"), F.lit("")), F.lit("Unknown")),
        "raw_text": F.max(text)["v"], "viewed": F.max("viewed"), "applied": F.max("applied"),
    }
    made = {c: v for c, v in made.items() if c in jobs.columns}
    # What isn't merged is the keeper's.
    rest = [c for c in jobs.columns if c not in made and c != key]
    merged = jobs.where(X.present(F.col(key)) != "").groupBy(key).agg(F.count("*").alias("rows"), F.min(F.struct(order.alias("o"), F.struct(*rest).alias("v")))["v"].alias("_keeper"), *[v.alias(c) for c, v in made.items()], *[F.min_by(F.col(c), order).alias(f"_own_{c}") for c in made])
    # A row alone is left as it is.
    kept = merged.select("rows", key, *[F.when(F.col("rows") == 1, F.col(f"_own_{c}")).otherwise(F.col(c)).alias(c) for c in made], "_keeper.*")
    alone = jobs.where(X.present(F.col(key)) == "").withColumn("rows", F.lit(1).cast("long"))
    return kept.select("rows", *jobs.columns).unionByName(alone.select("rows", *jobs.columns))


def merge_cross_source(jobs: DataFrame) -> DataFrame:
    """Postings that stand in several sources made one each; `rows` says of how many."""
    keyed = jobs.withColumn("_key", X.cross_source_key(F.col("source"), F.col("company"), F.col("title")))
    return merge_duplicates(keyed, "_key", X.source_rank(F.col("source"))).drop("_key")


def merge_counters(merged: DataFrame) -> DataFrame:
    many = F.col("rows") > 1
    return merged.agg(F.count_if(many).alias("groups_merged"), F.coalesce(F.sum(F.when(many, F.col("rows") - 1)), F.lit(0)).alias("rows_deleted"), F.count_if(many).alias("rows_updated"))


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def new_rows(jobs: DataFrame, incoming: DataFrame, link: str = "position_link") -> DataFrame:
    """The rows of a batch that an upsert inserts: a link, not known yet, the first of the batch."""
    return first_by(incoming.where(X.present(F.col(link)) != ""), [link], "id").join(jobs.select(link), link, "left_anti")


def learn_keywords(labelled: DataFrame, stop: tuple[str, ...], limit: int = 20) -> DataFrame:
    """(token, kind, delta, df) of tokens whose share of documents differs between the classes by 0.2; `labelled`: id, text, relevant."""
    tokens = labelled.select("id", "relevant", F.explode(F.array_distinct(X.learning_tokens(F.col("text"), stop))).alias("token"))
    totals = tokens.groupBy().agg(F.countDistinct(F.when(F.col("relevant") == 1, F.col("id"))).alias("nr"), F.countDistinct(F.when(F.col("relevant") == 0, F.col("id"))).alias("nn"))
    counts = tokens.groupBy("token").agg(F.sum((F.col("relevant") == 1).cast("long")).alias("r"), F.sum((F.col("relevant") == 0).cast("long")).alias("n")).where("r + n >= 2")
    # The totals are one row.
    rated = counts.join(F.broadcast(totals)).where("nr > 0 AND nn > 0").withColumn("delta", F.col("r") / F.col("nr") - F.col("n") / F.col("nn"))
    kinds = rated.withColumn("kind", F.when((F.col("delta") >= 0.2) & (F.col("r") >= 2), "include").when((F.col("delta") <= -0.2) & (F.col("n") >= 2), "exclude")).where("kind IS NOT NULL")
    # A token is rated by the documents of its own class.
    kinds = kinds.withColumn("df", F.when(F.col("kind") == "include", F.col("r")).otherwise(F.col("n")))
    order = Window.partitionBy("kind").orderBy(F.desc(F.abs("delta")), F.desc("df"), F.desc("token"))
    return kinds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("kind", "rank", "token", "delta", "df")


def skill_counts(jobs: DataFrame, profile: Profile, weight: Column, limit: int = 20, without: tuple[str, ...] = (), patterns: DataFrame | None = None) -> DataFrame:
    """(skill, occurrences, weight), the most first; ties by name. Skills of the keys of `without` go before the limit."""
    keys = sorted({skill_key(x) for x in without})
    if patterns is None:
        found = jobs.select(weight.alias("w"), F.explode(required_skills(F.col("text"), profile.patterns())).alias("skill"))
    else:
        found = P.with_skills(jobs.select("id", "text", weight.alias("w")), "id", F.col("text"), patterns, "_skills").select("w", F.explode("_skills").alias("skill"))
    found = found.where(~X.skill_key(F.col("skill")).isin(*keys)) if keys else found
    return found.groupBy("skill").agg(F.count("*").alias("occurrences"), F.sum("w").alias("weight")).orderBy(F.desc("weight"), "skill").limit(limit)


def merge_patterns(old: DataFrame, change: DataFrame) -> DataFrame:
    """Patterns by name_key: occurrences and weight are added, negative increments count 0, a blank pattern or source keeps the old."""
    o, c = old.alias("o"), change.alias("c")
    pick = lambda new, was: F.coalesce(F.when(F.trim(X.present(new)) != "", new), was)
    add = lambda col: F.coalesce(F.col(f"o.{col}"), F.lit(0)) + F.greatest(F.coalesce(F.col(f"c.{col}"), F.lit(0)), F.lit(0))
    return o.join(c, "name_key", "full").select(
        "name_key", F.coalesce("c.name", "o.name").alias("name"), pick(F.col("c.pattern"), F.col("o.pattern")).alias("pattern"),
        pick(F.col("o.source"), F.col("c.source")).alias("source"), add("occurrences").alias("occurrences"), add("weight").alias("weight"),
    )


#: What each feedback event does to (viewed, applied, relevant, judged by hand); null leaves a register alone.
EFFECTS: dict[str, tuple[int | None, int | None, int | None, int | None]] = {
    "viewed_on": (1, None, None, None), "viewed_off": (0, 0, None, None), "applied_on": (1, 1, 1, 1), "applied_off": (None, 0, None, None), "relevant": (None, None, 1, 1), "not_relevant": (None, 0, 0, 1),
}
REGISTERS = ("viewed", "applied", "relevant", "manual")


def fold_feedback(log: DataFrame, key: str = "job_id") -> DataFrame:
    """The last value of every register for each key, and the category and reason that follow; `log`: key, ts, event_id, event."""
    out = []
    for i, register in enumerate(REGISTERS):
        value = reduce(lambda c, kv: c.when(F.col("event") == kv[0], kv[1]), [(e, v[i]) for e, v in EFFECTS.items() if v[i] is not None], F.when(F.lit(False), 0))
        out.append(F.coalesce(F.max(F.when(value.isNotNull(), F.struct("ts", "event_id", value.alias("v"))))["v"], F.lit(0)).alias(register))
    return judged(log.groupBy(key).agg(*out))


def judged(registers: DataFrame) -> DataFrame:
    category = F.when(F.col("relevant") == 1, "relevant").otherwise("not relevant")
    return registers.withColumn("category", category).withColumn("relevance_reason", F.when(F.col("manual") == 1, F.concat(F.lit("manual_feedback="), category)).otherwise("")).drop("manual")


def ranked(jobs: DataFrame, *, limit: int = 0, offset: int = 0, where: Column | None = None, order: tuple[Column, ...] = ()) -> DataFrame:
    """A served view: filtered, ordered (the last key should be unique), a page of it."""
    rows = jobs if where is None else jobs.where(where)
    rows = rows.orderBy(*order) if order else rows
    rows = rows.offset(max(0, offset)) if offset > 0 else rows
    return rows.limit(limit) if limit > 0 else rows


def union_first(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """The union of several views, each key from the earliest that has it."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    return first_by(reduce(DataFrame.unionByName, tagged), [key], "_part").drop("_part")


def line_candidates(docs: DataFrame, back: int = 10) -> DataFrame:
    """(id, pos, line, candidates): the usable lines among the `back` before each line."""
    lines = docs.select("id", F.posexplode(F.split(X.present(F.col("text")), "\n")).alias("pos", "line"))
    usable = F.when((F.trim("line") != "") & ~F.lower("line").contains("http"), F.trim("line"))
    frame = Window.partitionBy("id").orderBy("pos").rowsBetween(-back, -1)
    return lines.withColumn("candidates", F.array_join(F.collect_list(usable).over(frame), "|"))
