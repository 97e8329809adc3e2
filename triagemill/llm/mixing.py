"""Operator 5, mixing sources to target weights by a time-varying curriculum, with SQL functions only.

Every source has a token target and a weight schedule w(t) over training time 0..1. Integrating the schedule gives the
source's cumulative demand; inverting it at a document's place in the source's token line gives the training position
of each pass over that document, and documents are range-sorted by position. Targets share the total size by weight, are
held to `max_repeat` times the source's size, and what that leaves is shared again by weight among the other sources.

A source's documents stand in the order of a keyed digest of id and text (so that rows without an id, or with one id, spread). Their running sums are made in two levels (digest buckets,
then within a bucket), so that a source holding a third of all rows is dealt over thousands of groups. A source's last,
partial pass ends exactly at its target: at most one document of a source is taken in part.

Defined cases: a null text has size 0; rows of size 0 are returned with nothing taken and no position; the null source is
a source of its own, last in order; repeated rows are each a row of the mix; a null id sorts as the empty text; an empty
table gives an empty result; a text of any length is measured whole. Rows alike in id and text stand beside each other in the
source's line in an order that no result can tell, since what one of them is taken less the other is taken more; training_order
keeps them apart by a number. Columns beyond those named here, whatever their names, are ignored by the mix and returned by
training_order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagemill.llm.common import HELD, WORD, doc_key, documents, held, materialize

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
#: Hex digits of the digest that make the buckets of a source: 16 ** 3.
BUCKET_DIGITS = 3
SEED = "mix-1"
#: Knots (time, weight) of the schedule for each weight of the cycle: the lightest sources fade, the heaviest grow.
SCHEDULES: dict[int, list[tuple[float, float]]] = {1: [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)], 2: [(0.0, 1.0), (1.0, 1.0)], 3: [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]}


def segments(knots: list[tuple[float, float]]) -> list[tuple[float, ...]]:
    """(t0, t1, w0, w1, share0, share1, whole) of each stretch; shares are integrals from 0 as parts of the whole integral."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or min(w for _, w in knots) < 0:
        raise ValueError("knots must run from time 0 to 1 with weights of 0 or more")
    areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:])]
    whole, done, out = sum(areas), 0.0, []
    if whole <= 0:
        raise ValueError("a schedule needs some weight")
    for ((t0, a), (t1, b)), area in zip(zip(knots, knots[1:]), areas):
        out.append((t0, t1, a, b, done / whole, (done + area) / whole, whole))
        done += area
    return out


def invert(share: Column, knots: list[tuple[float, float]]) -> Column:
    """The time at which the schedule's integral reaches `share` (0 to 1) of the whole: a quadratic in each stretch."""
    out: Column | None = None
    for t0, t1, a, b, s0, s1, whole in reversed(segments(knots)):
        slope, area = (b - a) / (t1 - t0), (share - F.lit(s0)) * F.lit(whole)
        if slope:
            step = (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * area, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
        else:
            step = area / F.lit(a) if a else F.lit(0.0)
        at = F.least(F.lit(t1), F.lit(t0) + step)
        out = at if out is None else F.when(share < F.lit(s1), at).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """`_source`, `_source_size` (a row a source) with `_weight` and `_target` added. Its windows see a row a source, no documents."""
    lcm = 1
    for w in weights:
        lcm *= w
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("_rank", F.lit(len(weights))) + 1).cast("long")
    level = Window.orderBy("_level", "_rank")
    filled = (
        ranked.withColumn("_weight", weight)
        .withColumn("_cap", F.col("_source_size") * max_repeat)
        .withColumn("_level", (F.col("_source_size").cast("decimal(25,0)") * F.lit(lcm) / F.col("_weight")).cast("decimal(30,0)"))
        .withColumn("_total", F.sum("_source_size").over(Window.partitionBy()))
        # What is left to share, and the weights it is left to, when the sources that fill up sooner have their caps.
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_among", F.sum("_weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_full", F.col("_cap").cast("decimal(38,0)") * F.col("_among") <= F.col("_left").cast("decimal(38,0)") * F.col("_weight"))
    )
    share = F.min(F.when(~F.col("_full"), F.struct("_level", "_rank", "_left", "_among"))).over(Window.partitionBy())
    return filled.withColumn("_share", share).select(
        "_source", "_source_size", "_weight",
        F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise((F.col("_weight") * F.col("_share._left")).cast("double") / F.col("_share._among").cast("double")).alias("_target"),
    )


def mix_sources(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, schedules: dict[int, list[tuple[float, float]]] | None = None) -> DataFrame:
    """A row for each document: doc_id, doc_key, source, size, source_size, target, taken, position (of the first pass) and
    copies (an array of position, words), range-sorted by position."""
    schedules = schedules or SCHEDULES
    rows = docs.select("doc_id", "text", "source", doc_key().alias("_key"))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.hex("_key")))
    rows = rows.select(
        "doc_id", "_key", F.col("source").alias("_source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"), digest.alias("_digest")
    ).withColumn("_bucket", F.substring("_digest", 1, BUCKET_DIGITS)).withColumn("_name", F.coalesce(F.concat(F.lit("="), "_source"), F.lit("")))
    buckets = rows.groupBy("_name", "_bucket").agg(F.sum("_size").alias("_bucket_size"), F.first("_source").alias("_source"))
    # A row for each source and bucket: it bounds nothing but itself, so it is kept as a table rather than in memory.
    buckets = materialize(buckets, "mix-buckets")
    targets = source_targets(buckets.groupBy("_name").agg(F.first("_source").alias("_source"), F.sum("_bucket_size").alias("_source_size")).drop("_name"), weights, max_repeat)
    targets = targets.withColumn("_name", F.coalesce(F.concat(F.lit("="), "_source"), F.lit(""))).drop("_source")
    before = Window.partitionBy("_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.drop("_source").withColumn("_start", F.coalesce(F.sum("_bucket_size").over(before), F.lit(0))).join(targets, "_name").drop("_bucket_size")
    inner = Window.partitionBy("_name", "_bucket").orderBy("_digest").rowsBetween(Window.unboundedPreceding, -1)
    line = rows.join(starts, ["_name", "_bucket"]).withColumn("_at", F.col("_start") + F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    quota = F.floor("_target")
    line = (
        line.withColumn("_quota", quota)
        .withColumn("_passes", F.when(F.col("_source_size") > 0, F.floor(F.col("_quota") / F.greatest(F.col("_source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long"))
        .withColumn("_rest", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_quota") - F.col("_passes") * F.col("_source_size") - F.col("_at"))))
    )

    def place(share: Column) -> Column:
        out = F.lit(None).cast("double")
        for weight, knots in schedules.items():
            out = F.when(F.col("_weight") == weight, invert(share, knots)).otherwise(out)
        return out

    def copy(turn: Column) -> Column:
        share = (turn * F.col("_source_size") + F.col("_at")) / F.col("_quota")
        return F.struct(place(share).alias("position"), F.when(turn < F.col("_passes"), F.col("_size")).otherwise(F.col("_rest")).alias("words"))

    turns = F.when((F.col("_size") > 0) & (F.col("_quota") > 0), F.sequence(F.lit(0).cast("long"), F.col("_passes"))).otherwise(F.array().cast("array<bigint>"))
    line = line.withColumn("copies", F.filter(F.transform(turns, copy), lambda c: c["words"] > 0))
    out = line.select(
        "doc_id", F.col("_key").alias("doc_key"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_passes") + F.col("_rest")).alias("taken"), F.get("copies", F.lit(0))["position"].alias("position"), "copies",
    )
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of `docs`, a row for each pass over a document, range-sorted by training position.

    The one document of a source that is taken in part holds its first words, as many as the mix takes, joined by spaces.
    """
    # Rows alike in id, text and source share a key; the copies of all of them are dealt to them by turns.
    alike = lambda rows: rows.withColumn("same", F.row_number().over(Window.partitionBy("key", "name").orderBy("key")))
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    plan = mix_sources(docs, **options).select(F.col("doc_key").alias("key"), name.alias("name"), "size", "copies", "taken")
    once = materialize(plan.groupBy("key", "name").agg(F.count("*").alias("rows"), F.first("size").alias("size"), F.first("copies").alias("copies"), F.sum("taken").alias("taken")), "mix-plan")
    rows = held(docs, doc_key().alias("key"), name.alias("name"), F.col("doc_id").alias("id"))
    placed = rows.join(once.where("rows = 1 AND taken > 0"), ["key", "name"]).select(HELD, "id", "size", "copies")
    repeated = once.where("rows > 1 AND taken > 0").select("key", "name")
    many = materialize(plan.join(repeated, ["key", "name"], "left_semi"), "mix-alike")
    if not many.isEmpty():
        several = alike(rows.join(repeated, ["key", "name"], "left_semi")).join(alike(many).drop("taken"), ["key", "name", "same"])
        placed = placed.unionByName(several.select(HELD, "id", "size", "copies"))
    each = placed.select(HELD, "id", "size", F.explode("copies").alias("copy"))
    partial, given = F.col("copy.words") < F.col("size"), lambda c: F.col(f"{HELD}.`{c}`")
    cut = F.array_join(F.slice(F.regexp_extract_all(given("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("copy.words").cast("int")), " ")
    # Cut after the sort, so that no text travels twice.
    each = each.orderBy("copy.position", "id").withColumn("cut", F.when(partial, cut))
    whole = {"text": F.coalesce("cut", given("text")), "n_chars": F.coalesce(F.length("cut"), given("n_chars")) if "n_chars" in docs.columns else None}
    return each.select(*[(whole[c].cast(docs.schema[c].dataType) if c in whole else given(c)).alias(c) for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def _placed_sql(schedules: dict[int, list[tuple[float, float]]] = SCHEDULES) -> str:
    share, cases = "(place::DOUBLE / quota::DOUBLE)", []
    for weight, knots in schedules.items():
        for t0, t1, a, b, s0, s1, whole in segments(knots):
            slope, area = (b - a) / (t1 - t0), f"({share} - {s0!r}) * {whole!r}"
            step = f"(sqrt(greatest({a * a!r} + {2 * slope!r} * {area}, 0.0)) - {a!r}) / {slope!r}" if slope else f"{area} / {a!r}"
            below = f" AND {share} < {s1!r}" if t1 < 1 else ""
            cases.append(f"WHEN weight = {weight}{below} THEN least({t1!r}, {t0!r} + {step})")
    return f"CASE {' '.join(cases)} END"


_PLACED = _placed_sql()
OP5_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('{SEED}:' || upper(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || CASE WHEN text IS NULL THEN ':0' ELSE ':1' END || coalesce(text, '')))) AS digest FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM sized GROUP BY source),
weighted AS (SELECT *, rk % 3 + 1 AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total, source_size * 6 / (rk % 3 + 1) AS lvl FROM sources),
filling AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY lvl, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS remaining,
         (sum(weight) OVER (ORDER BY lvl, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS among FROM weighted),
judged AS (SELECT *, cap::HUGEINT * among <= remaining::HUGEINT * weight AS is_full FROM filling),
shared AS (SELECT arg_min(remaining, (lvl, rk)) AS remaining, arg_min(among, (lvl, rk)) AS among FROM judged WHERE NOT is_full),
targets AS (
  SELECT j.source, j.source_size, j.weight, CASE WHEN j.is_full THEN j.cap::DOUBLE ELSE (j.weight * s.remaining)::DOUBLE / s.among::DOUBLE END AS target FROM judged j LEFT JOIN shared s ON true),
lined AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.weight, floor(t.target)::BIGINT AS quota,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE size * (quota // source_size) + greatest(0, least(size, quota % source_size - place)) END::BIGINT AS taken,
       -- The first pass over the document, at the inverse of the schedule's integral.
       CASE WHEN size > 0 AND quota > 0 AND place < quota THEN round({_PLACED}, 6) END AS position
FROM lined"""
