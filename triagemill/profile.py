"""The profile: keywords, skills, weights and rules that every triage operator takes as a parameter."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields, replace


#: Words that no keyword is learned from.
STOP_WORDS = (
    "about", "above", "after", "again", "against", "all", "also", "and", "any", "are", "because", "been", "before", "being", "below", "between", "both", "but", "can", "company", "could", "danish", "denmark", "developer",
    "email", "for", "from", "have", "into", "job", "jobs", "just", "more", "not", "our", "out", "position", "role", "than", "that", "the", "their", "them", "there", "these", "this", "those", "through", "under", "using",
    "very", "want", "when", "where", "which", "with", "you", "your",
)


#: The skills that are known from the start, and what tells each of them in a text.
KNOWN_SKILL_PATTERNS = (
    ("Python", r"\bpython\b"),
    ("SQL", r"\bsql\b|\bpostgres(?:ql)?\b|\bmysql\b|\bsqlite\b"),
    ("Java", r"\bjava\b"),
    ("JavaScript", r"\bjavascript\b|\bjs\b"),
    ("TypeScript", r"\btypescript\b|\bts\b"),
    ("C#", r"\bc#\b|\bdotnet\b|\.net\b"),
    ("C++", r"\bc\+\+\b"),
    ("Go", r"\bgolang\b|\bgo\b"),
    ("Rust", r"\brust\b"),
    ("Docker", r"\bdocker\b"),
    ("Kubernetes", r"\bkubernetes\b|\bk8s\b"),
    ("AWS", r"\baws\b|\bamazon web services\b"),
    ("Azure", r"\bazure\b"),
    ("Git", r"\bgit\b"),
    ("Linux", r"\blinux\b|\bunix\b"),
    ("REST APIs", r"\brest\b|\bapi(?:s)?\b"),
    ("CI/CD", r"\bci/cd\b|\bcicd\b|\bcontinuous integration\b|\bcontinuous delivery\b"),
    ("Data Engineering", r"\bdata engineering\b|\betl\b|\belt\b"),
    ("Machine Learning", r"\bmachine learning\b|\bml\b|\bai\b"),
    ("Communication", r"\bcommunication\b|\bcommunicate\b"),
    ("Team Collaboration", r"\bcollaboration\b|\bteam player\b|\bteamwork\b"),
)


@dataclass(frozen=True)
class Profile:
    """The fixed default values, overlaid by `load` with a caller's. A pattern of the profile is (name, regular expression)."""

    include_keywords: tuple[str, ...] = ("python", "backend", "data", "machine learning", "ai", "developer", "engineer", "remote")
    exclude_keywords: tuple[str, ...] = ("sales", "marketing", "nurse", "driver", "on-site", "onsite", "unpaid")
    learned_include_keywords: tuple[str, ...] = ()
    learned_exclude_keywords: tuple[str, ...] = ()
    user_skills: tuple[str, ...] = ()
    blocked_skills: tuple[str, ...] = ()
    missing_skills_suggestions: tuple[str, ...] = ()
    known_skill_patterns: tuple[tuple[str, str], ...] = KNOWN_SKILL_PATTERNS
    min_score: float = 2.0
    skill_match_weight: float = 1.2
    skill_missing_penalty: float = 0.15
    easy_apply_bonus: float = 0.75
    include_weight: float = 1.5
    exclude_weight: float = 2.0
    report_max_relevant_positions: int = 7
    report_max_not_relevant_positions: int = 42
    missing_skills_max_items: int = 25
    skill_learning_max_positions: int = 180
    skill_learning_min_occurrences: int = 3
    skill_learning_max_new_patterns: int = 20
    skill_new_confidence_threshold: float = 0.9
    skill_new_max_per_job: int = 2
    language_checker_threshold: float = 0.8
    language_checker_min_letters: int = 4
    max_input_chars: int = 24000
    stop_words: tuple[str, ...] = STOP_WORDS

    @classmethod
    def load(cls, text: str | None) -> Profile:
        """Defaults overlaid with a JSON object: unknown keys, unreadable text and values that don't convert keep the default. A single
        older limit of reports stands for both; keywords are the given and the learned ones; thresholds are held to their ranges."""
        try:
            given = json.loads(text or "{}")
        except ValueError:
            given = {}
        given = dict(given) if isinstance(given, dict) else {}
        if "report_max_positions" in given:
            for name in ("report_max_relevant_positions", "report_max_not_relevant_positions"):
                given.setdefault(name, given["report_max_positions"])
        out = {}
        for f in fields(cls):
            if f.name not in given:
                continue
            value, default = given[f.name], getattr(cls(), f.name)
            try:
                if f.name == "known_skill_patterns":
                    pairs = [(str(p["name"]).strip(), str(p["pattern"]).strip()) for p in value if isinstance(p, dict) and p.get("name") and p.get("pattern")]
                    out[f.name] = tuple(p for p in pairs if all(p))
                elif isinstance(default, tuple):
                    out[f.name] = unique(value) if isinstance(value, list) else default
                else:
                    out[f.name] = type(default)(value)
            except (TypeError, ValueError, KeyError):
                continue
        made = cls(**out)
        limits = {n: getattr(made, n) if getattr(made, n) > 0 else getattr(cls(), n) for n in ("report_max_relevant_positions", "report_max_not_relevant_positions")}
        return replace(
            made, **limits, include_keywords=unique([*made.include_keywords, *made.learned_include_keywords]), exclude_keywords=unique([*made.exclude_keywords, *made.learned_exclude_keywords]),
            language_checker_threshold=min(1.0, max(0.0, made.language_checker_threshold)), language_checker_min_letters=max(1, made.language_checker_min_letters),
        )

    def dump(self) -> str:
        out = {f.name: getattr(self, f.name) for f in fields(self)}
        out["known_skill_patterns"] = [{"name": n, "pattern": p} for n, p in self.known_skill_patterns]
        return json.dumps(out, indent=2, ensure_ascii=False)

    def patterns(self) -> list[tuple[str, str]]:
        blocked = {skill_key(x) for x in self.blocked_skills}
        return [(n, p) for n, p in self.known_skill_patterns if skill_key(n) not in blocked]


def skill_key(name: str) -> str:
    return re.sub(r"\s+", " ", name.strip().lower())


def add_skill(profile: Profile, name: str, field: str = "user_skills") -> Profile:
    return replace(profile, **{field: unique([*getattr(profile, field), name])})


def remove_skill(profile: Profile, name: str) -> Profile:
    """Without the skill in any list and in the patterns."""
    lists = ("include_keywords", "learned_include_keywords", "learned_exclude_keywords", "exclude_keywords", "user_skills", "missing_skills_suggestions")
    left = {f: tuple(x for x in getattr(profile, f) if skill_key(x) != skill_key(name)) for f in lists}
    return replace(profile, **left, known_skill_patterns=tuple(p for p in profile.known_skill_patterns if skill_key(p[0]) != skill_key(name)))


def block_skill(profile: Profile, name: str) -> Profile:
    return add_skill(remove_skill(profile, name), name, "blocked_skills")


def unique(values) -> tuple[str, ...]:
    """Blank-free values in small letters, the first of each."""
    return tuple(dict.fromkeys(v for v in (str(x).strip().lower() for x in values) if v))


def valid_pattern(pattern: str) -> bool:
    """Whether the engine that will run the pattern, Java's, can read it."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    try:
        re.compile(pattern) if spark is None else spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001 - whatever it can't read is left out
        return False
    return True


def skill_regex(name: str) -> str:
    """A pattern for a plain name: its words in order, any white space between, at word boundaries."""
    words = [re.escape(w) for w in name.strip().lower().split()]
    return rf"\b{r'\s+'.join(words)}\b" if words else ""
