"""The command line: mail folders and the state's store in, reports and a server out."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.functions import text as X
from triagemill.functions import urls as U
from triagemill.operators import extract, learning, models, skills, state
from triagemill.operators import triage as T
from triagemill.plans import report
from triagemill.profile import Profile, unique
from triagemill.scratch import cut, cut_counted, numbered
from triagemill.sources import mail, pages
from triagemill.store import Store

#: What a caller's models are, by task: summarise, skills, translate, detect. None comes with the library.
MODELS: dict[str, models.Factory] = {}
FETCHER: list[pages.Fetcher] = []
#: Commands that can't do without a model.
NEEDS = {"summarize-file": "summarise", "summarize-folder": "summarise"}
#: Least bytes of model files by task, and files of a translation model.
MODEL_BYTES = {"detect": ((".bin", ".ftz"), 100_000), "summarise": ((".gguf",), 200_000_000)}
TRANSLATION_FILES = ("config.json", "tokenizer_config.json")


def model_file_fits(task: str, path: str) -> bool:
    """Whether a model's file (or folder) looks like one."""
    p = Path(path)
    if task == "translate":
        return p.is_dir() and all((p / n).is_file() for n in TRANSLATION_FILES)
    endings, least = MODEL_BYTES[task]
    return p.is_file() and p.suffix.lower() in endings and p.stat().st_size >= least


def remaining(done: int, total: int, seconds: float) -> str:
    """The time that is left at the pace so far."""
    left = int(seconds / done * (total - done)) if done else 0
    hours, minutes, rest = left // 3600, left // 60 % 60, left % 60
    return f"{hours}h{minutes:02d}m" if hours else f"{minutes}m{rest:02d}s" if minutes else f"{rest}s"


def load_profile(path: str | None) -> Profile:
    return Profile.load(Path(path).read_text(encoding="utf-8") if path and Path(path).is_file() else None)


def save_profile(path: str, profile: Profile) -> None:
    part = Path(path + ".part")
    part.write_text(profile.dump() + "\n", encoding="utf-8")
    part.replace(path)


def process_inbox(spark: SparkSession, store: Store, folder: str, profile: Profile, now=None, prune: bool = False, limit: int = 0, entry_transform: Callable[[DataFrame], DataFrame] | None = None, progress: Callable[[str], None] = print) -> DataFrame:
    """Files of a folder taken into the store: parsed, read for postings, changed by `entry_transform`, merged, cleaned, scored and
    described; their skills, English titles and new patterns are learned. Returns (file, found, inserted_new, skipped_existing). One commit holds all of it."""
    now, base = F.current_timestamp() if now is None else now, store.version()
    docs = mail.load_files(spark, folder)
    docs, seen = cut_counted(docs.orderBy("path").limit(limit) if limit else docs, files=F.count("*"), links=F.sum(F.size("links")))
    progress(f"{seen['files']} files read, {seen['links'] or 0} links")
    entries = extract.job_entries(docs, "path").withColumnsRenamed({"link": "position_link", "path": "file"})
    entries = entry_transform(entries) if entry_transform else entries
    # The order of arrival is that of files and links.
    entries = numbered(entries, [F.col("file"), F.col("position_link")], "ord")
    jobs, counted = state.ingest(cut(state.clean(store.read("jobs"), now)), entries, now)
    # Made once, with one time, for the counts and for the commit.
    jobs, counted = cut(state.clean(jobs, now)), cut(counted)
    patterns = cut(state.seed_patterns(store.read("skill_patterns"), profile, now))
    jobs = cut(T.apply_relevance(jobs, profile, prune, patterns=state.pattern_table(patterns, profile)))
    patterns, linked = map(cut, learning.take_skills(jobs, patterns, store.read("job_skills"), profile, now, MODELS.get("skills")))
    jobs = cut(describe(learning.english_titles(jobs, now, MODELS.get("translate")), now, cache=f"{store.root}/pages"))
    patterns = learning.learn(jobs, patterns, linked, profile, now, MODELS.get("skills"))
    store.commit({"jobs": jobs, "skill_patterns": patterns, "job_skills": linked}, base)
    for r in counted.orderBy("file").limit(200).collect():
        progress(f"{r.file}: found {r.found}, new {r.inserted_new}, known {r.skipped_existing}")
    return counted


def describe(jobs: DataFrame, now, overwrite: bool = False, candidates: DataFrame | None = None, cache: str | None = None) -> DataFrame:
    """Jobs with descriptions made for the candidates (by default those without one that nobody has viewed): by a model where there is
    one, checked, or else out of the raw text, which gets its page's text first where pages may be fetched."""
    wanted = state.refresh_candidates(jobs, missing_only=not overwrite, unviewed_only=not overwrite) if candidates is None else candidates
    rows = pages.fetch_pages(wanted.select("id", "position_link", "title", "raw_text"), "position_link", FETCHER[0] if FETCHER else None, cache=cache)
    rows = rows.withColumn("raw_text", pages.append_page(F.col("raw_text"), F.col("page_text")))
    rows = models.ask(rows, "raw_text", "_answer", MODELS["summarise"]) if "summarise" in MODELS else rows.withColumn("_answer", F.lit(""))
    answer = X.without_repeats(X.clean_answer_description(F.col("_answer")))
    usable = (answer != "") & ~answer.contains(pages.PAGE_MARK) & ~X.low_quality(answer, F.col("raw_text"), F.col("title"))
    made = F.when(usable, answer).otherwise(X.description_text(F.lit(""), F.col("raw_text")))
    return state.set_fields(jobs, rows.select("id", F.nullif(made, F.lit("")).alias("description")), now)


def clean_inbox(folder: str, counted: DataFrame) -> dict[str, int]:
    """Deletes the files that postings were found in, if they are below the folder."""
    root, out = Path(folder).resolve(), {"deleted": 0, "missing": 0, "outside": 0, "failed": 0}
    for r in counted.where("found > 0").toLocalIterator():
        path = Path(r.file.removeprefix("file:")).resolve()
        if not path.is_relative_to(root):
            out["outside"] += 1
        elif not path.is_file():
            out["missing"] += 1
        else:
            try:
                path.unlink()
                out["deleted"] += 1
            except OSError:
                out["failed"] += 1
    return out


def panels(store: Store, profile: Profile) -> list[tuple[str, DataFrame, int]]:
    """The report's panels in their order: name, rows, and how many they are taken from."""
    jobs = store.read("jobs")
    score, late = F.desc("relevance_score"), F.desc("updated_at")
    manual = F.lower(X.present(F.col("raw_text"))).contains(state.MANUAL_MARK.lower()).cast("int")
    out = []
    for name, where, order, limit in (
        ("Relevant", F.col("category") == "relevant", ("viewed", score, late, "id"), profile.report_max_relevant_positions), ("Not relevant", F.col("category") == "not relevant", ("viewed", score, late, "id"), profile.report_max_not_relevant_positions),
        ("Applied", F.col("applied") == 1, (manual, "viewed", score, late, "id"), 0),
    ):
        rows = T.ranked(jobs, where=where, order=order, limit=limit)
        shown = rows.withColumn("summary", X.summary_text(F.col("summary"), F.col("raw_text"))).withColumn("easy_apply", X.easy_apply_posting(F.col("source"), F.col("position_link"), F.col("relevance_reason"), F.col("title"), F.col("raw_text")))
        out.append((name, shown, jobs.where(where).count()))
    return out


def write_report(store: Store, profile: Profile, folder: str) -> str:
    Path(folder).mkdir(parents=True, exist_ok=True)
    target = str(Path(folder) / "report.html")
    tab = state.skills_tab(store.read("skill_patterns"), profile).collect()
    report.write(target, "Positions", panels(store, profile), tab)
    return target


def company_page(store: Store, company: str) -> str:
    jobs = store.read("jobs").where(F.lower(F.trim(X.present(F.col("company")))) == company.strip().lower())
    order = (F.desc("applied"), F.desc("relevance_score"), F.desc("updated_at"), "id")
    parts = [("Applied", F.col("applied") == 1), ("Relevant", (F.col("applied") != 1) & (F.col("category") == "relevant")), ("Not relevant", (F.col("applied") != 1) & (F.col("category") != "relevant"))]
    made = [(name, T.ranked(jobs, where=where, order=order), jobs.where(where).count()) for name, where in parts]
    return "".join(report.html(company, made))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="triagemill")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple) -> None:
        one = sub.add_parser(name)
        one.add_argument("--profile", default="profile.json")
        for names, keywords in options:
            one.add_argument(*names, **keywords)

    db, limit, flag = (("--db",), {"default": "./jobs"}), (("--limit",), {"type": int, "default": 0}), lambda n: ((n,), {"action": "store_true"})
    out = (("--report-dir",), {"default": ""})
    add("report-links", (("folder",), {}))
    add("summarize-file", (("--path",), {"required": True}))
    add("summarize-folder", (("--folder",), {"required": True}), limit, (("--out",), {"default": "./summaries"}))
    add("process-inbox", (("--inbox",), {"default": "./inbox"}), db, out, limit, flag("--prune-irrelevant"), flag("--delete-processed"))
    add("init-profile", (("--path",), {"default": "profile.json"}), flag("--force"))
    add("render-html", (("--input",), {"required": True}), (("--out",), {"required": True}), (("--title",), {"default": "Relevant Positions"}))
    add("serve-gui", db, (("--report-dir",), {"default": "./outbox"}), (("--host",), {"default": "127.0.0.1"}), (("--port",), {"type": int, "default": 8765}))
    add("refresh-descriptions", db, (("--source",), {"default": ""}), (("--category",), {"default": "", "choices": ["", "relevant", "not relevant"]}), (("--link",), {"action": "append", "default": []}), (("--job-id",), {"action": "append", "type": int, "default": []}), limit, flag("--overwrite"))
    add("sync-user-skills", db, (("--cv",), {"default": "./CV"}), (("--limit",), {"type": int, "default": 80}), (("--max-chars",), {"type": int, "default": 40_000}), flag("--replace"))
    add("cleanup-skills", db, limit, flag("--dry-run"))
    add("dedupe-jobs", db)
    return p


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    if a.command in NEEDS and NEEDS[a.command] not in MODELS:
        print(f"{a.command} needs a model for: {NEEDS[a.command]}", file=sys.stderr)
        return 1
    profile, now = load_profile(a.profile), F.current_timestamp()
    store = Store(spark, a.db) if hasattr(a, "db") else None
    if a.command == "report-links":
        found = mail.load_files(spark, a.folder).select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))
        for r in found.orderBy(F.desc("n"), "link").limit(200).collect():
            print(r.n, r.link)
    elif a.command in ("summarize-file", "summarize-folder"):
        docs = mail.load_files(spark, a.path if a.command == "summarize-file" else a.folder)
        docs = docs.orderBy("path").limit(a.limit) if getattr(a, "limit", 0) else docs
        done = models.ask(docs.withColumn("_text", F.left("text", F.lit(profile.max_input_chars))), "_text", "summary", MODELS["summarise"]).select("path", "summary", "links")
        if a.command == "summarize-file":
            print(done.first().summary)
        else:
            done.write.mode("overwrite").json(a.out)
    elif a.command == "process-inbox":
        counted = process_inbox(spark, store, a.inbox, profile, prune=a.prune_irrelevant, limit=a.limit)
        save_profile(a.profile, state.learned_profile(profile, store.read("jobs"), patterns=state.pattern_table(store.read("skill_patterns"), profile)))
        if a.report_dir:
            print(write_report(store, load_profile(a.profile), a.report_dir))
        if a.delete_processed:
            print(clean_inbox(a.inbox, counted))
    elif a.command == "init-profile":
        if Path(a.path).exists() and not a.force:
            print(f"{a.path} exists", file=sys.stderr)
            return 1
        save_profile(a.path, Profile())
    elif a.command == "render-html":
        rows = mail.read_jsonl(spark, a.input, "title string, company string, place string, position_link string, summary string, description string, relevance_score double")
        report.write(a.out, a.title, [(a.title, rows, rows.count())])
    elif a.command == "serve-gui":
        from triagemill.serve import serve

        serve(store, a.profile, a.report_dir, a.host, a.port)
    elif a.command == "refresh-descriptions":
        base, jobs = store.version(), store.read("jobs")
        wanted = state.refresh_candidates(jobs, a.category, a.source, links(spark, a.link), tuple(a.job_id), a.limit, not a.overwrite)
        store.commit({"jobs": describe(jobs, now, candidates=wanted, cache=f"{store.root}/pages")}, base)
    elif a.command == "sync-user-skills":
        table = state.pattern_table(store.read("skill_patterns"), profile)
        found = skills.skills_of_cv(pages.cv_text(spark, a.cv, a.max_chars), spark, profile, a.limit, table, MODELS.get("skills"))
        own = unique(found) if a.replace else unique([*profile.user_skills, *found])
        save_profile(a.profile, replace(profile, user_skills=own))
        print(", ".join(own))
    elif a.command == "cleanup-skills":
        base, patterns, linked = store.version(), store.read("skill_patterns"), store.read("job_skills")
        gone = skills.cleanup_candidates(patterns, profile)
        gone = cut(gone.limit(a.limit) if a.limit else gone)
        for r in gone.orderBy(F.desc("occurrences"), F.desc("weight"), "name").toLocalIterator():
            print(f"{r.name}: {r.reason} ({r.occurrences})")
        if not a.dry_run:
            store.commit(dict(zip(("skill_patterns", "job_skills"), state.delete_skills(patterns, linked, gone.select("name")))), base)
    elif a.command == "dedupe-jobs":
        base = store.version()
        merged = T.merge_cross_source(store.read("jobs"))
        print(T.merge_counters(merged).first().asDict())
        store.commit({"jobs": merged.drop("rows")}, base)
    return 0


def links(spark: SparkSession, given: list[str]) -> tuple[str, ...]:
    """Links of the command line, written anew."""
    if not given:
        return ()
    rows = spark.createDataFrame([(x,) for x in given], "x string").select(U.normalize(U.unwrap_tracker(F.col("x"))).alias("x")).collect()
    return tuple(r.x for r in rows)


def main() -> None:
    spark = SparkSession.builder.appName("triagemill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
