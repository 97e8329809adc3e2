"""The corpus pipeline: raw documents to packed training sequences, in five stages.

Every stage takes all its predecessor kept, written as Parquet and read again. The last returns the pieces of sequences, the
others the columns of `documents`. Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are
linked as near duplicates. Rows without an id pass the near-duplicate stage unless they are linked, through others or not, to a
row with one; rows that repeat an id are judged by their texts.

Defined cases: null, empty and very short texts fail the quality rules, so no later stage sees them; of linked rows that tie for the
least id, that with the least key (a digest of id and text) stays, and one of identical rows; a null source is a source of its own;
texts of any length are taken whole; an empty table gives an empty result; columns beyond those of `documents`, whatever their
names, reach the last stage unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.llm import jaccard_join, line_dedup, mixing, packing
from triagemill.llm import quality as rules
from triagemill.llm.common import HELD, doc_key, documents, held, materialize, release, release_paths, small, written

#: Scratch tables that the result of the last stage called reads.
_left: set[str] = set()


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage; when the next one is called the result of this one has been written, so that what it reads is freed."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_paths(_left)
        _left.clear()
        before = written()
        out = work(spark, docs, sf_dir)
        _left.update(written() - before)
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    judged = rules.judge(docs.select(F.struct("*").alias("given"), "text", "lang"), ["given"])
    return judged.where("kept").select("given.*")


@stage
def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay in one of them."""
    done = line_dedup.dedup_lines(docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("given"), "doc_id", "text"))
    chars = F.when(F.col("_n_dropped") > 0, F.length("text")).otherwise(F.col("given.n_chars")).cast(docs.schema["n_chars"].dataType)
    changed = {"text": F.col("text"), "n_chars": chars}
    return done.select(*[changed.get(c, F.col(f"given.`{c}`")).alias(c) for c in docs.columns])


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents stays, that with the least id; all rows of a group without ids stay."""
    joined = materialize(jaccard_join.keyed(docs).select("row", "keeper"), "pipeline-groups")
    surplus = materialize(joined.where("row <> keeper").select("row").distinct(), "pipeline-surplus")
    kept = held(docs, doc_key().alias("row")).join(small(surplus, surplus.count()), "row", "left_anti")
    # Rows alike in id and text have one key, so those that stay are reduced to one.
    twice = materialize(joined.where("row = keeper").groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"), "pipeline-twice")
    n = twice.count()
    if n:
        twice = small(twice, n)
        kept = kept.join(twice, "row", "left_anti").unionByName(kept.join(twice, "row", "left_semi").dropDuplicates(["row"]))
    return kept.select(f"{HELD}.*")


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets, documents repeated as the mix says, in training order."""
    return mixing.training_order(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are tokenized and packed beside their lexical neighbours."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_deduplication), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: The pieces hold checksums of token ids, which SQL can't make; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
