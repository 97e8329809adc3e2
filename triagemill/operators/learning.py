"""What a run learns from the jobs it keeps: their skills, English titles, and patterns for skills that positive signals ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.functions import text as X
from triagemill.operators import models, skills, state
from triagemill.profile import Profile
from triagemill.scratch import cut

#: What a skill counts in a job applied for, and in one judged relevant.
WEIGHTS = (3, 1)


def positions(jobs: DataFrame, most: int) -> DataFrame:
    """The first `most` of the jobs to learn from, with `weight`: those applied for, then the other relevant ones, each in the order they are served."""
    applied = F.coalesce(F.col("applied"), F.lit(0)) == 1
    manual = F.when(applied, F.lower(X.present(F.col("raw_text"))).contains(state.MANUAL_MARK.lower()).cast("int")).otherwise(0)
    rows = jobs.where(applied | (F.col("category") == "relevant")).withColumn("weight", F.when(applied, WEIGHTS[0]).otherwise(WEIGHTS[1]))
    return rows.orderBy(F.desc("weight"), manual, "viewed", F.desc("relevance_score"), F.desc("updated_at"), "id").limit(most)


def take_skills(jobs: DataFrame, patterns: DataFrame, links: DataFrame, profile: Profile, now: Column, model: models.Factory | None = None) -> tuple[DataFrame, DataFrame]:
    """Patterns and links after the skills of jobs that show were found: those not viewed yet and those applied for, unless they have some."""
    shown = jobs.where((F.coalesce("viewed", F.lit(0)) == 0) | (F.coalesce("applied", F.lit(0)) == 1))
    asked = shown.select("id", "raw_text").join(links.select(F.col("job_id").alias("id")).distinct(), "id", "left_anti")
    found = skills.skills_of(asked, "raw_text", profile, model, table=state.pattern_table(patterns, profile))
    return state.set_job_skills(patterns, links, cut(found.select(F.col("id").alias("job_id"), F.explode("skills").alias("name"))), now)


def english_titles(jobs: DataFrame, now: Column, translator: models.Factory | None) -> DataFrame:
    """Jobs with a title in English where they had none and the answer is plausible."""
    if translator is None:
        return jobs
    lacking = jobs.where((X.present(F.col("title_english")) == "") & (X.present(F.col("title")) != "")).select("id", "title")
    made = models.translate_titles(lacking, "title", translator).where("title_english <> ''").select("id", "title_english")
    return state.set_fields(jobs, made, now)


def learn(jobs: DataFrame, patterns: DataFrame, links: DataFrame, profile: Profile, now: Column, model: models.Factory | None = None) -> DataFrame:
    """Patterns after the skills of the positions were counted: known ones count on, frequent ones are new."""
    rows = positions(jobs, profile.skill_learning_max_positions).select("id", "raw_text", "weight")
    known = state.job_skills(links.join(rows.select(F.col("id").alias("job_id")), "job_id", "left_semi"), patterns).withColumnRenamed("job_id", "id")
    found = skills.skills_of(rows, "raw_text", profile, model, known, table=state.pattern_table(patterns, profile))
    counts = found.select("weight", F.explode("skills").alias("skill")).groupBy("skill").agg(F.sum("weight").alias("weight"))
    return state.learn_patterns(patterns, cut(counts), now, profile.skill_learning_min_occurrences, profile.skill_learning_max_new_patterns)
