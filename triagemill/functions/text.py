"""Text normalisers and predicates as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms and places that don't tell companies apart.
COMPANY_NOISE = ("danmark", "denmark", "aps", "a", "s", "as", "ab", "oy", "ltd", "llc", "inc", "group", "holding")
#: Marks that end a title.
TITLE_ENDS = (
    "translated title", "translated title text", "original title", "original text", "english title", "english translation", "translation result", "translation:", "return value", "return only", "unchanged title",
    "step 1", "you are an ai assistant", "translate this job title to english", "the english title", "this translated title", "note:",
)
#: Marks that end a model's translation of a title, as whole words.
ANSWER_ENDS = (
    "translated title", "translated title text", "original title", "original text", "english title", "english translation", "translation result", "return value", "return only", "unchanged title", "step 1", "note:",
    "you are an ai assistant", "translate this job title to english", "this translation", "translation conveys", "the translated title", "is already in english",
)
#: What no translated title holds, and its limits (characters, share of the original's, words, points).
TITLE_FAULTS = ("translation", "translated title", "original title", "you are an ai assistant", "return only", "step 1", "this title", "in english")
TITLE_LIMITS = (80, 2.2, 14, 2)
#: What no summary and no description holds.
SUMMARY_FAULTS = ("llm summary failed", "model path does not exist", "traceback", "exception:")
DESCRIPTION_FAULTS = ("you are an ai assistant", "translated title", "original title", "english title", "return only", "step 1", "llm summary failed", "model path does not exist")
#: Least words and share of different ones; longest source and least description that don't fit; least words and hits of title words.
DESCRIPTION_LIMITS = (45, 0.42, 240, 360, 30, 6)
#: What a description made of raw text leaves out.
RAW_NOISE = (
    r"\bSummary\s*:\s*LLM\s+summary\s+failed\s*:[^.\n]*(?:\.|$)", r"\bLLM\s+summary\s+failed\s*:[^.\n]*(?:\.|$)", r"\bModel\s+path\s+does\s+not\s+exist\s*:[^.\n]*(?:\.|$)", r"\[POSITION_PAGE_CONTEXT[^\]]*\]",
    r"\(\s*settings\s*\)", r"\bPUBLISHED\s*:\s*\d{1,2}-\d{1,2}-\d{4}\b", r"\bRetrieved\s+from\s+Jobcenter\b", r"\bCheck\s+the\s+job\s+satisfaction\s*:\s*[^.\n]*", r"\b\d{1,3}(?:,\d{3})*\s+ratings\b", r"\bSave\s+job\b", r"\bView\s+job\b",
)
#: Beginnings that a skill's name goes without, each once, in this order, and words that it goes without anywhere.
SKILL_STARTS = (
    r"^[-*\d.)\s]+", r"^(?:a|an|as|at|you|but)\s+", r"^you\s+(?:will|can|have|are|should|must)\s+", r"^(?:good|great|strong|solid|excellent|proven|quality|high\s+quality)\s+",
    r"^(?:degree|bachelor(?:'s)?|master(?:'s)?|phd|doctorate)\s+in\s+", r"^(?:experience\s+with|experienced\s+with|hands-?on\s+with|knowledge\s+of|familiarity\s+with)\s+",
)
SKILL_FILLERS = r"\b(?:required|required:|requirements?|qualifications?|must have|nice to have)\b"
#: Sources whose postings meet in each other, the best first.
CROSS_SOURCES = ("jobindex", "linkedin")
#: What a cut title doesn't end in, and quotes around it.
_TAIL, _QUOTES = " -|:;,/", "\"'“”"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is made once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def present(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def compact(c: Column) -> Column:
    return F.trim(F.regexp_replace(present(c), r"\s+", " "))


def first_line(c: Column) -> Column:
    return present(F.get(F.filter(F.transform(F.split(present(c), "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)))


def holds_any(low: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(p) for p in parts])


def title_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(present(c)), "[^a-z0-9]+", "")


def company_key(c: Column, noise: tuple[str, ...] = COMPANY_NOISE) -> Column:
    """Alphanumeric tokens without noise, put together; all of them if nothing else is left."""
    tokens = F.regexp_extract_all(F.lower(present(c)), F.lit("[a-z0-9]+"), F.lit(0))
    pick = lambda ts: let(F.filter(ts, lambda t: ~t.isin(*noise)), lambda kept: F.array_join(F.when(F.size(kept) > 0, kept).otherwise(ts), ""))
    return let(tokens, pick)


def cross_source_key(source: Column, company: Column, title: Column, sources: tuple[str, ...] = CROSS_SOURCES) -> Column:
    """What postings of the sources have in common: company and cleaned title. Empty for other sources, or where either is."""
    both = lambda k: F.when((k["c"] != "") & (k["t"] != ""), F.concat_ws("|", k["c"], k["t"])).otherwise("")
    key = let(F.struct(company_key(company).alias("c"), title_key(clean_title(title)).alias("t")), both)
    return F.when(F.lower(F.trim(present(source))).isin(*sources), key).otherwise("")


def source_rank(source: Column, sources: tuple[str, ...] = CROSS_SOURCES) -> Column:
    """How good a source is: the last named 1, those before more, others 0."""
    out = F.lit(0)
    for rank, name in enumerate(reversed(sources), 1):
        out = F.when(F.lower(F.trim(present(source))) == name, rank).otherwise(out)
    return out


def _closed(t: Column, opening: str, closing: str) -> Column:
    """The text up to the last opening bracket, as long as there are more of these than closing ones."""
    many = lambda x, sign: F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))
    head = lambda x: F.rtrim(F.left(x, F.length(x) - F.length(F.substring_index(x, opening, -1)) - 1), F.lit(_TAIL))
    step = lambda x, _: F.when(many(x, opening) > many(x, closing), head(x)).otherwise(x)
    return let(t, lambda v: F.aggregate(F.sequence(F.lit(0), many(v, opening)), v, step))


def clean_title(c: Column, ends: tuple[str, ...] = TITLE_ENDS) -> Column:
    """One line, without quotes around it, cut at the first end mark and at unclosed brackets, `X (X)` made `X`, 180 characters."""
    marks = "|".join(map(_quoted, sorted(ends, key=len, reverse=True)))
    cut = lambda t: let(F.instr(F.regexp_replace(F.lower(t), marks, "\x01"), "\x01"), lambda at: F.when(at > 0, F.rtrim(F.left(t, at - 1), F.lit(_TAIL))).otherwise(t))
    t = _closed(_closed(let(F.btrim(compact(c), F.lit(_QUOTES)), cut), "(", ")"), "[", "]")
    t = F.rtrim(F.btrim(F.trim(t), F.lit(_QUOTES)), F.lit(_TAIL))
    twice = r"^(.+?)\s*\((.+?)\)$"
    parts = lambda t: F.struct(t.alias("t"), F.trim(F.regexp_extract(t, twice, 1)).alias("head"), F.trim(F.regexp_extract(t, twice, 2)).alias("inner"))
    same = lambda p: (p["head"] != "") & (p["inner"] != "") & (title_key(p["head"]) == title_key(p["inner"]))
    return F.left(let(let(t, parts), lambda p: F.when(same(p), p["head"]).otherwise(p["t"])), F.lit(180))


def _quoted(mark: str) -> str:
    return "".join(f"\\{x}" if x in ".:" else x for x in mark)


def quoted(c: Column) -> Column:
    """A text between quotes, as a list shows it: single ones, or double ones where it holds single ones alone."""
    escaped = F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def one_decimal(x: Column) -> Column:
    """A number to one decimal, by its exact value; ties go to the even digit."""
    a, b = x * 8, x * 2
    ten = a + b
    # What the sum lost to rounding tells on which side of a tie the number is.
    lost = (a - (ten - (ten - a))) + (b - (ten - a))
    low = F.floor(ten).cast("double")
    tenths = F.when(ten - low == 0.5, F.when(lost > 0, low + 1).when(lost < 0, low).otherwise(F.rint(ten))).otherwise(F.rint(ten))
    whole = F.abs(tenths).cast("long")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(whole / 10).cast("string"), F.lit("."), (whole % 10).cast("string"))


def skill_key(c: Column) -> Column:
    return F.lower(compact(c))


def skill_name(c: Column) -> Column:
    """A phrase reduced to the skill it names, or empty if it names none (over five words, or under two characters)."""
    t = F.lower(F.trim(present(c)))
    for start in SKILL_STARTS:
        t = F.regexp_replace(t, start, "")
    t = F.regexp_replace(F.regexp_replace(t, r"\(.*?\)", ""), SKILL_FILLERS, "")
    t = F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(" ,.;:-"))
    return let(t, lambda v: F.when((F.size(F.split(v, " ")) > 5) | (F.length(v) < 2), "").otherwise(v))


def split_skills(c: Column) -> Column:
    parts = F.split(F.regexp_replace(present(c), r"[\n;|/]", ","), ",")
    return F.array_distinct(F.filter(F.transform(parts, skill_name), lambda x: x != ""))


def learning_tokens(c: Column, stop: tuple[str, ...]) -> Column:
    found = F.regexp_extract_all(F.lower(present(c)), F.lit(r"[a-zA-Z][a-zA-Z0-9+#.\-]{2,}"), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.btrim(t, F.lit(".-"))), lambda t: (F.length(t) >= 3) & ~t.isin(*stop))


def work_type(c: Column) -> Column:
    """Hybrid, Remote or On-site by the words of a text, else empty; hybrid is asked first."""
    t = F.lower(present(c))
    return F.when(t.contains("hybrid"), "Hybrid").when(t.contains("remote"), "Remote").when(t.rlike("on-?site"), "On-site").otherwise("")


def easy_apply(c: Column) -> Column:
    return F.lower(compact(c)).rlike(r"\beasy\s*apply\b")


def from_linkedin(source: Column, link: Column) -> Column:
    return (F.lower(F.trim(present(source))) == "linkedin") | F.lower(present(link)).contains("linkedin.com/")


def easy_apply_posting(source: Column, link: Column, reason: Column, *parts: Column) -> Column:
    """Whether a LinkedIn posting says so in one of its texts, or its stored reason does."""
    said = easy_apply(F.concat_ws(" ", *[compact(p) for p in parts])) | F.lower(present(reason)).contains("easy_apply=true")
    return from_linkedin(source, link) & said


def low_quality(c: Column, raw: Column | None = None, title: Column | None = None) -> Column:
    """A description that a model got wrong: it holds a faulty mark, one word five times running, few different words, far more
    than its source, or its title's words over and over. An empty one isn't."""
    few, share, short, long, some, hits = DESCRIPTION_LIMITS

    def faulty(v: Column) -> Column:
        low, words = v["low"], v["words"]
        out = holds_any(low, DESCRIPTION_FAULTS) | low.rlike(r"(?U)\b(\w+)(?:\s+\1){4,}\b")
        out = out | F.coalesce((F.size(words) >= few) & (F.size(F.array_distinct(words)) / F.size(words) < share), F.lit(False))
        if raw is not None:
            n = F.length(compact(raw))
            out = out | ((n > 0) & (n < short) & (F.length(low) > long))
        if title is not None:
            tokens = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(present(title)), F.lit(r"[a-zA-Z0-9+#.\-]+"), F.lit(0)), lambda t: F.length(t) > 2))
            times = lambda t: ((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).cast("int")
            repeats = F.aggregate(F.transform(tokens, lambda t: times(t)), F.lit(0), lambda a, x: a + x)
            out = out | ((F.size(words) >= some) & (repeats > F.greatest(F.lit(hits), F.floor(F.size(words) / 4))))
        return (low != "") & out

    split = lambda low: F.struct(low.alias("low"), F.regexp_extract_all(low, F.lit(r"[a-zA-Z0-9+#.\-]+"), F.lit(0)).alias("words"))
    return let(let(F.lower(compact(c)), split), faulty)


def plausible_title(candidate: Column, original: Column) -> Column:
    """Neither much longer than the original, nor over 14 words, nor mostly one word, nor sentences, nor about translating."""
    chars, share, most_words, points = TITLE_LIMITS
    text = compact(candidate)
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z0-9+#.&/-]+"), F.lit(0))
    kinds = F.array_distinct(words)
    most = F.array_max(F.transform(kinds, lambda k: F.size(F.filter(words, lambda w: w == k))))
    dull = (F.size(words) >= 6) & ((most >= F.greatest(F.lit(4), F.floor(F.size(words) / 2))) | (F.size(kinds) <= 2))
    size = F.length(text) <= F.greatest(F.lit(chars), F.floor(F.length(compact(original)) * share))
    return (text != "") & size & ~holds_any(F.lower(text), TITLE_FAULTS) & (F.size(words) <= most_words) & ~F.coalesce(dull, F.lit(False)) & (F.regexp_count(text, F.lit(r"\.")) < points)


#: Labels that a model's answer carries: of a title, of skills, and of a description, which the last follows.
TITLE_LABELS = (r"(?i)^english\s+title\s*:\s*", r"(?i)^translated\s+title(?:\s+text)?\s*:\s*")
SKILL_LABELS = (r"\bskills?\s*:\s*", r"\boutput\s*:\s*", r"\bplaintext\b")
SKILL_BULLETS = (r"\s*[-*]\s*", r"\s*\d+[.)]\s*")
DESCRIPTION_LABELS = (r"(?is)^.*?\bto be concise\s*:\s*", r"(?i)\bplaintext\b", r"(?i)\bsummary\s*:\s*")


def clean_answer_title(c: Column) -> Column:
    """A model's translation of a title, without its label, what it says after it, unclosed brackets and quotes."""
    edge = " \"'`[]()"
    t = F.trim(F.regexp_replace(F.replace(present(c), F.lit("```"), F.lit(" ")), r"\s+", " "))
    for label in TITLE_LABELS:
        t = F.regexp_replace(t, label, "")
    t = F.btrim(t, F.lit(edge))
    marks = "|".join(m.replace(" ", r"\s+") for m in ANSWER_ENDS)
    t = F.rtrim(F.regexp_replace(t, rf"(?is)\b(?:{marks})\b.*$", "\x01"), F.lit(_TAIL + "\x01"))
    return F.left(F.rtrim(F.btrim(_closed(t, "(", ")"), F.lit(edge)), F.lit(_TAIL)), F.lit(180))


def final_title(candidate: Column, original: Column) -> Column:
    """The translation, or the original where the two are one or the translation isn't plausible."""

    def choose(p: Column) -> Column:
        c, o = p["c"], p["o"]
        return F.when(o == "", c).when((c == "") | (title_key(c) == title_key(o)) | ~plausible_title(c, o), o).otherwise(c)

    return let(F.struct(compact(candidate).alias("c"), compact(original).alias("o")), choose)


def valid_summary(c: Column) -> Column:
    low = F.lower(compact(c))
    return (low != "") & ~holds_any(low, SUMMARY_FAULTS)


def summary_text(summary: Column, raw: Column, limit: int = 260) -> Column:
    return F.left(F.when(valid_summary(summary), compact(summary)).otherwise(compact(raw)), F.lit(limit))


def description_text(description: Column, raw: Column, limit: int = 280) -> Column:
    """A usable description, or the start of the raw text without what isn't one."""
    t = compact(raw)
    for noise in RAW_NOISE:
        t = F.regexp_replace(t, f"(?i){noise}", " ")
    made = let(compact(t), lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(limit))), F.lit("..."))))
    return F.when((F.trim(present(description)) != "") & valid_summary(description), description).otherwise(made)


def clean_answer_skills(c: Column) -> Column:
    """A model's list of skills as one line, parted by commas."""
    t = F.replace(present(c), F.lit("```"), F.lit(" "))
    for label in SKILL_LABELS:
        t = F.regexp_replace(t, f"(?i){label}", " ")
    for bullet in SKILL_BULLETS:
        t = F.regexp_replace(t, bullet, ", ")
    return compact(t)


def clean_answer_description(c: Column) -> Column:
    """A model's description as one line, from its last `to be concise` on."""
    before, *within = DESCRIPTION_LABELS
    t = F.regexp_replace(F.replace(present(c), F.lit("```"), F.lit(" ")), before, "")
    for label in within:
        t = F.regexp_replace(t, label, " ")
    return compact(t)


def without_repeats(c: Column, most: int = 30, least: int = 5) -> Column:
    """A text without the second of two equal runs of words at its start and the last of two at its end, the longest runs first."""

    def longest(words: Column, equal) -> Column:
        sizes = F.sequence(F.least(F.floor(F.size(words) / 2).cast("int"), F.lit(most)), F.lit(least), F.lit(-1))
        return F.when(F.size(words) >= 2 * least, F.get(F.filter(sizes, lambda n: equal(words, n)), F.lit(0)))

    def at_start(words: Column) -> Column:
        cut = lambda n: F.when(n.isNotNull(), F.concat(F.slice(words, F.lit(1), n), F.slice(words, 2 * n + 1, F.size(words)))).otherwise(words)
        return let(longest(words, lambda w, n: F.slice(w, F.lit(1), n) == F.slice(w, n + 1, n)), cut)

    def at_end(words: Column) -> Column:
        cut = lambda n: F.when(n.isNotNull(), F.slice(words, F.lit(1), F.size(words) - n)).otherwise(words)
        return let(longest(words, lambda w, n: F.slice(w, -n, n) == F.slice(w, -2 * n, n)), cut)

    return let(F.split(present(c), r"\s+"), lambda words: F.when(F.size(words) < 8, c).otherwise(F.array_join(let(at_start(words), at_end), " ")))


def prepend_once(text: Column, marker: str, head: Column, limit: int = 9000) -> Column:
    start = F.concat(F.lit(marker), F.trim(present(head)))
    return F.left(F.when(F.startswith(present(text), start) | (F.trim(present(head)) == ""), present(text)).otherwise(F.concat_ws("\n", start, present(text))), F.lit(limit))


#: How a mail's subject or text names a company; the pattern's groups are the company.
_COMPANY_ALERT = r"(?i)^(.+?)\s*-\s*job alert notification$"
_COMPANY_IN = r"(?i)\b(?:opportunities?|jobs?|openings?)\s+(?:in|at|to)\s+([A-Z][^\n.!?]{2,60}?)(?:\s*$|\s+today|\s+now|\s+posted)"
_COMPANY_DOMAIN = r"(?i)\bfrom\s+(?:jobs\.|careers\.|career\.)([a-z0-9][a-z0-9\-]*)\b"
_COMPANY_HIRES = r"\b([A-Z][A-Za-z0-9&.,\- ]{2,50})(?:\s+is\s+hiring|\s+careers|\s+jobs?)\b"


def company_title(text: Column, hint: Column) -> Column:
    """(company, title) that a mail's subject and text name: `x: Company - Role`, `Role at Company`, or else, for the company, the
    first of the known forms, a line `company: X` among the first 20, and `X is hiring` in the text."""
    edge = F.lit(" \"'“”|:-")
    lines = F.filter(F.transform(F.split(present(text), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    both = lambda company, title: F.struct(company.alias("company"), title.alias("title"))

    def parted(title: Column) -> Column:
        right = F.trim(F.regexp_extract(title, r"(?s)^[^:]*:(.*)$", 1))
        role = F.btrim(F.regexp_extract(right, r"(?s)^.*? - (.*)$", 1), edge)
        fits = title.contains(":") & title.contains(" - ") & right.contains(" - ")
        return both(F.when(fits, F.btrim(F.substring_index(right, " - ", 1), edge)).otherwise(""), F.when(fits & (role != ""), role).otherwise(title))

    def placed(v: Column) -> Column:
        at, side = r"(?i)(.+?)\s+at\s+(.+)", lambda i: F.btrim(F.regexp_extract(v["title"], at, i), F.lit(" -|:"))
        fits = v["title"].rlike(at)
        return both(F.when(fits, side(2)).otherwise(v["company"]), F.when(fits, side(1)).otherwise(v["title"]))

    def named(v: Column) -> Column:
        title = v["title"]
        lined = F.filter(F.slice(lines, 1, 20), lambda x: x.rlike(r"(?i)\b(company|employer|organization)\b") & (F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)) != ""))
        brand = let(F.initcap(F.replace(F.regexp_extract(title, _COMPANY_DOMAIN, 1), F.lit("-"), F.lit(" "))), lambda b: F.when(F.length(b) >= 2, b))
        forms = [
            v["company"], F.left(F.btrim(F.regexp_extract(title, _COMPANY_ALERT, 1), edge), F.lit(180)), F.left(F.btrim(F.regexp_extract(title, _COMPANY_IN, 1), F.lit(" \"'|:-")), F.lit(180)), brand,
            F.left(F.trim(F.regexp_extract(F.get(lined, F.lit(0)), r"^[^:]*:(.*)$", 1)), F.lit(180)), F.trim(F.regexp_extract(present(text), _COMPANY_HIRES, 1)),
        ]
        return both(F.left(present(F.coalesce(*[F.nullif(f, F.lit("")) for f in forms])), F.lit(180)), F.left(title, F.lit(180)))

    title = F.when(F.trim(present(hint)) != "", F.trim(hint)).otherwise(F.left(present(F.get(lines, F.lit(0))), F.lit(180)))
    return let(let(let(title, parted), placed), named)
