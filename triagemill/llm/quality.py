"""Operator 10, quality rules by distribution distance, with SQL functions only.

A document's character-class histogram and its histogram over its language's most common words are compared with the
language's references by Jensen-Shannon distance (the root of the divergence in base 2, from 0 to 1). References are sums over
the documents of the language that pass the base rules (too few words, too much repetition inside the document), so that junk
doesn't shape what it is measured by. A document is rejected if it fails a base rule or if either distance passes its threshold;
documents or references too short to give a histogram meaning are not judged by it.

Texts are taken apart once; all later steps read the measures and words written then.

Defined cases: a null text has no words and fails the base rules, as an empty one does; a null language is a language of
its own; repeated rows are each judged alike; words that tie for the last common place count in the order of their code points;
an empty table gives an empty result; a text of any length is judged whole. Other columns, whatever their names, are returned
as they are, but that one named like an added column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagemill.llm.common import HELD, WORD, documents, materialize, release, small, unheld

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Words of a window (a power of two).
WINDOW = 8
#: The most common words of a language that make its word histogram, each with a cell of its own, all others in one.
COMMON_WORDS = 24
#: Words that a document, and a language's reference, must have for a distance to count.
GUARD_WORDS = 50
GUARD_REFERENCE_WORDS = 1000
MAX_CHAR_DISTANCE = 0.26
MAX_WORD_DISTANCE = 0.36
#: Character classes, counted among the characters of words; what is in none of them (mostly small letters) is a last class.
#: n_symbols is the last one's count.
CLASSES = (r"\p{Lu}", r"\p{Nd}", r"[.,]", r"[;:!?]", r"['\"()\-]", r"[#*$%&|<>]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept")


def measure(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, _words and _classes to the rows of `docs` (_text)."""
    text = F.col("_text")
    step = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).withColumn("n_words", F.size("_words").cast("long"))
    step = step.withColumn("word_chars", F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumn("_lines", lines).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    counts = [F.regexp_count(text, F.lit(c)).cast("long") for c in CLASSES]
    step = step.withColumn("_counts", F.array(*counts)).withColumn("n_symbols", F.col("_counts")[len(CLASSES) - 1])
    rest = F.col("word_chars") - F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    step = step.withColumn("_classes", F.concat("_counts", F.array(rest))).drop("_counts")
    # Windows by the hash of their words; only documents in which one occurs twice are sorted for places.
    # Hashes of 1 word are paired into hashes of 2, 4 and 8 words; an array that a lambda reads is never computed inside it.
    step = step.withColumn("_windows", F.transform("_words", lambda w: F.xxhash64(w)))
    width = 1
    while width < WINDOW:
        step = step.withColumn("_windows", F.zip_with("_windows", F.slice("_windows", F.lit(width + 1), F.greatest(F.size("_windows"), F.lit(1))), lambda x, y: F.xxhash64(x, y)))
        width *= 2
    step = step.withColumn("_windows", F.slice("_windows", F.lit(1), F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    step = step.withColumn("_placed", placed).drop("_windows")
    same = lambda x, i: (F.get("_placed", i - 1)["h"] == x["h"]) | (F.get("_placed", i + 1)["h"] == x["h"])
    step = step.withColumn("_twice", F.sort_array(F.transform(F.filter("_placed", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))).drop("_placed")
    covered = F.transform("_twice", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_twice", i + 1) - p, F.lit(WINDOW))).cast("long"))
    step = step.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_twice")
    return step.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def references(measured: DataFrame) -> DataFrame:
    """A row for each language: its name (`_lang`), class counts, common words with counts, and word count, of the measured rows that pass the base rules."""
    rows = measured.where("NOT base_failed")
    per_word = rows.select("_lang", F.explode("_words").alias("_word")).groupBy("_lang", "_word").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("_lang").orderBy(F.desc("_n"), "_word")
    top = per_word.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= COMMON_WORDS).groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("_rank", "_word", "_n"))).alias("_top"))
    n = len(CLASSES) + 1
    totals = rows.groupBy("_lang").agg(F.sum("n_words").alias("_ref_total"), F.array(*[F.sum(F.col("_classes")[i]) for i in range(n)]).alias("_ref_classes"))
    rest = F.col("_ref_total") - F.aggregate("_top._n", F.lit(0).cast("long"), lambda a, x: a + x)
    return totals.join(top, "_lang").select("_lang", "_ref_classes", F.col("_top._word").alias("_ref_words"), F.concat("_top._n", F.array(rest)).alias("_ref_counts"), "_ref_total")


def distance(p: Column, q: Column, p_total: Column, q_total: Column) -> Column:
    """Jensen-Shannon distance of two count arrays: the root of the divergence in bits."""

    def term(a: Column, b: Column) -> Column:
        x, y = a / p_total, b / q_total
        half = lambda u: F.when(u > 0, u * F.log2(2 * u / (x + y))).otherwise(F.lit(0.0))
        return (half(x) + half(y)) / 2

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, v: s + v)))


def judge(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows of `docs` (of its `columns`, or all) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance (null
    where a guard holds), base_failed and kept added."""
    text, lang = F.coalesce("text", F.lit("")), F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    columns = docs.columns if columns is None else columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(HELD), lang.alias("_lang"), text.alias("_text"))
    measured = materialize(measure(rows).drop("_text"), "quality-measures")
    found = materialize(references(measured), "quality-references")
    # A row for each language; 10,000 of them are a few MB.
    # Written, since a caller's filter pushed into the distances would make whole arrays again for each of their elements.
    judged = materialize(judge_against(measured, small(found, found.count(), 10_000)), "quality-judged")
    release(measured, found)
    return unheld(judged, columns, {m: F.col(m) for m in MEASURES})


def judge_against(measured: DataFrame, found: DataFrame) -> DataFrame:
    step = measured.join(found, "_lang", "left")
    long_enough = (F.col("n_words") >= GUARD_WORDS) & (F.col("_ref_total") >= GUARD_REFERENCE_WORDS)
    # The place of each common word in its language's list; others are in none.
    step = step.withColumn("_hits", F.filter(F.transform("_words", lambda w: F.array_position("_ref_words", w).cast("int")), lambda p: p > 0)).drop("_words")
    hits = F.transform("_ref_words", lambda w, i: F.size(F.filter("_hits", lambda p: p == i + 1)).cast("long"))
    step = step.withColumn("_cells", F.concat(hits, F.array(F.col("n_words") - F.size("_hits")))).drop("_hits")
    ref_chars = F.aggregate("_ref_classes", F.lit(0).cast("long"), lambda a, x: a + x)
    step = step.withColumn("char_distance", F.when(long_enough, distance(F.col("_classes"), F.col("_ref_classes"), F.col("word_chars"), ref_chars)))
    step = step.withColumn("word_distance", F.when(long_enough, distance(F.col("_cells"), F.col("_ref_counts"), F.col("n_words"), F.col("_ref_total"))))
    apart = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return step.withColumn("kept", ~F.col("base_failed") & ~apart).select(HELD, *MEASURES)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return judge(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_QUOTED = [c.replace("'", "''") for c in CLASSES]
_DUCK_CLASSES = ", ".join(f"(length(t) - length(regexp_replace(t, '{c}', '', 'g')))::BIGINT AS c{i}" for i, c in enumerate(_QUOTED))
_N = len(CLASSES)
_LISTED, _SUMS = ", ".join(f"c{i}" for i in range(_N)), ", ".join(f"sum(c{i}) AS r{i}" for i in range(_N))
_REST, _REF_REST = " - ".join(["word_chars", *(f"c{i}" for i in range(_N))]), " - ".join(["r", *(f"r{i}" for i in range(_N))])
_REF_LISTED = ", ".join(f"r{i}" for i in range(_N))
_FAILED = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
_TERM = "(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2"
OP10_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
g2 AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
rep AS (SELECT doc_id, sum(least(8, n))::BIGINT AS n_repeat_words FROM (SELECT doc_id, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8) AS n FROM g2) GROUP BY doc_id),
m0 AS (
  SELECT doc_id, lang, ws, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, {_DUCK_CLASSES} FROM d),
m AS MATERIALIZED (SELECT m0.*, coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words FROM m0 LEFT JOIN rep USING (doc_id)),
good AS (SELECT * FROM m WHERE NOT {_FAILED}),
rw AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(ws) AS w FROM good) GROUP BY lang, w),
top AS (SELECT lang, w, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS k FROM rw QUALIFY k <= {COMMON_WORDS}),
tot AS (SELECT lang, sum(n) AS total FROM rw GROUP BY lang),
refw AS (SELECT lang, k, n FROM top UNION ALL SELECT tot.lang, 0, total - (SELECT sum(n) FROM top WHERE top.lang IS NOT DISTINCT FROM tot.lang) FROM tot),
dw AS (SELECT doc_id, lang, w, count(*) AS n FROM (SELECT doc_id, lang, unnest(ws) AS w FROM m) GROUP BY ALL),
hit AS (SELECT dw.doc_id, top.k, dw.n FROM dw JOIN top ON dw.w = top.w AND dw.lang IS NOT DISTINCT FROM top.lang),
cell AS (SELECT doc_id, k, n FROM hit UNION ALL SELECT m.doc_id, 0, m.n_words - coalesce((SELECT sum(n) FROM hit WHERE hit.doc_id = m.doc_id), 0) FROM m),
wj AS (
  SELECT doc_id, sqrt(greatest(0, sum({_TERM}))) AS wd FROM (
    SELECT m.doc_id, coalesce(cell.n, 0)::DOUBLE / m.n_words AS x, refw.n::DOUBLE / tot.total AS y
    FROM m JOIN tot ON m.lang IS NOT DISTINCT FROM tot.lang JOIN refw ON refw.lang IS NOT DISTINCT FROM m.lang LEFT JOIN cell ON cell.doc_id = m.doc_id AND cell.k = refw.k
    WHERE m.n_words >= {GUARD_WORDS} AND tot.total >= {GUARD_REFERENCE_WORDS}) GROUP BY doc_id),
rc AS (SELECT lang, sum(word_chars) AS r, {_SUMS} FROM good GROUP BY lang),
cj AS (
  SELECT doc_id, sqrt(greatest(0, sum({_TERM}))) AS cd FROM (
    SELECT m.doc_id, unnest([{_LISTED}, {_REST}])::DOUBLE / word_chars AS x, unnest([{_REF_LISTED}, {_REF_REST}])::DOUBLE / r AS y
    FROM m JOIN rc ON m.lang IS NOT DISTINCT FROM rc.lang JOIN tot ON m.lang IS NOT DISTINCT FROM tot.lang WHERE m.n_words >= {GUARD_WORDS} AND tot.total >= {GUARD_REFERENCE_WORDS}) GROUP BY doc_id),
j AS (SELECT m.*, coalesce(wd, 0) AS wd, coalesce(cd, 0) AS cd FROM m LEFT JOIN wj USING (doc_id) LEFT JOIN cj USING (doc_id))
SELECT doc_id, n_words, word_chars, c{_N - 1} AS n_symbols, n_dup_lines, n_repeat_words, {_FAILED} AS base_failed,
       (NOT {_FAILED} AND wd <= {MAX_WORD_DISTANCE} AND cd <= {MAX_CHAR_DISTANCE}) AS kept
FROM j"""
