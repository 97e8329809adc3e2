"""Merkle manifest of a dataset: a root for all rows, a subroot for each source, and a proof for each row.

Levels are built from the bottom up and written. Proofs are pushed from the top down: a level's rows join their parents, and each child
puts its own siblings before the proof suffix that it inherits. A run is `FANOUT` consecutive nodes; no task holds more of a source.

Defined cases: a null field is `-` in its leaf, an empty one `0:`; a null source is a source of its own, before all others; rows without
an id come first in their source and are never tampered with; rows that tie for an id are ordered by their leaves; rows alike in all
fields have leaves alike, and each its own place; a source with one row has its leaf as subroot; one source alone gives its subroot as root; an
empty table gives an empty result; texts are hashed whole, whatever their length; further columns are no part of a leaf and are carried along
under any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.llm.common import HELD, documents, materialize, release, unheld
from triagemill.llm.ranks import ranked

#: Nodes that become one on the next level.
FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level of a proof: the digests left of the node and those right of it.
_STEP = "array<struct<left:binary,right:binary>>"
#: The digests of the run that a node stands for.
RUN = [f"d{k}" for k in range(FANOUT)]


def framed(value: Column) -> Column:
    """A field with its length in bytes before it, so that no two rows give one string."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def text_of(digests: Column) -> Column:
    """Digests are joined as hex text."""
    return F.lower(F.hex(digests))


def leaf(fields: dict[str, Column]) -> Column:
    return digest(F.concat(*[framed(fields[f]) for f in FIELDS]))


def build(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The levels of each tree over `leaves` (tree, idx, n, digest), lowest first and written: tree, idx, n, digest. `n`: nodes of the
    tree on that level. A tree ends with a level of one node."""
    levels = [leaves]
    highest = leaves.agg(F.max("n")).first()[0] or 0
    while highest > 1:
        nodes = levels[-1].where("n > 1").withColumn("at", F.col("idx") % FANOUT)
        run = nodes.groupBy("tree", (F.floor(F.col("idx") / FANOUT)).alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n")).agg(
            *[F.max(F.when(F.col("at") == k, F.col("digest"))).alias(d) for k, d in enumerate(RUN)])
        joined = F.concat(*[F.coalesce(d, F.lit(b"")) for d in RUN])
        # The digests of the run stay: the way down takes siblings from them.
        levels.append(materialize(run.select("tree", "idx", "n", *RUN, digest(text_of(joined)).alias("digest")), f"{name}-{len(levels)}"))
        highest = -(-highest // FANOUT)
    return levels


def siblings(at: Column) -> Column:
    """The other nodes of a parent's run, left and right of place `at`."""
    def side(wanted) -> Column:
        return F.concat(*[F.when(wanted(k) & F.col(d).isNotNull(), F.col(d)).otherwise(F.lit(b"")) for k, d in enumerate(RUN)])

    return F.struct(side(lambda k: at > k).alias("left"), side(lambda k: at < k).alias("right"))


def proofs(levels: list[DataFrame], above: DataFrame, name: str) -> DataFrame:
    """(tree, idx, proof, subroot) of the lowest level. `above`: (top, proof, subroot) of each tree, what its top inherits."""
    inherited = None
    for k in range(len(levels) - 1, -1, -1):
        down = levels[k].where("n = 1").select("tree", "idx").join(above, F.col("tree").eqNullSafe(F.col("top"))).select("tree", "idx", "proof", "subroot")
        if inherited is not None:
            parents = inherited.withColumnsRenamed({"tree": "of", "idx": "parent"})
            children = levels[k].where("n > 1").select("tree", "idx")
            met = children.join(parents, F.col("tree").eqNullSafe(F.col("of")) & (F.floor(F.col("idx") / FANOUT) == F.col("parent")))
            down = down.unionByName(met.select("tree", "idx", F.concat(F.array(siblings(F.col("idx") % FANOUT)), "proof").alias("proof"), "subroot"))
        if k:
            # The run below each node, of which its children take their siblings.
            runs = levels[k].select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), *RUN)
            before = inherited
            inherited = materialize(down.join(runs, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("idx") == F.col("_i"))).drop("_t", "_i"), f"{name}-down-{k}")
            release(before)
    return down


def fold(start: Column, proof: Column) -> Column:
    return F.aggregate(proof, start, lambda h, step: digest(text_of(F.concat(step["left"], h, step["right"]))))


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """The rows of `docs` without their texts, and `_leaf`, `_subroot`, `_root`, `_proof` (an array, from the leaf's level up), and `_seen`: the
    leaf of the row as found later, with the columns of `tampered` instead of its own. `fold(_seen, _proof)` is the root if nothing changed."""
    fields = {f: F.col(f) for f in FIELDS}
    kept = [c for c in docs.columns if c.lower() != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias(HELD), F.col("source").alias("tree"), F.col("doc_id").alias("_id"), leaf(fields).alias("digest"), leaf(fields | (tampered or {})).alias("seen"))
    leaves = ranked(rows, "tree", [F.col("_id").asc_nulls_first(), F.col("digest"), F.col("seen")], "merkle-leaves")
    levels = build(leaves, "merkle-level")
    tops = [level.where("n = 1").select(F.col("tree").alias("top"), "digest") for level in levels]
    # The subroots are one more tree; Spark orders strings by their UTF-8 bytes.
    named = ranked(reduce(DataFrame.unionByName, tops).withColumn("tree", F.lit(0)), "tree", [F.col("top").asc_nulls_first()], "merkle-subroots")
    upper = build(named, "merkle-upper")
    end = upper[-1].first()
    root = F.lit(None if end is None else bytes(end["digest"])).cast("binary")
    nothing = rows.sparkSession.range(1).select(F.lit(0).alias("top"), F.array().cast(_STEP).alias("proof"), F.lit(None).cast("binary").alias("subroot"))
    down = proofs(upper, nothing, "merkle-upper").select("idx", "proof")
    above = materialize(named.join(down, "idx").select("top", "proof", F.col("digest").alias("subroot")), "merkle-above")
    pushed = proofs(levels, above, "merkle-level").withColumnsRenamed({"tree": "_t", "idx": "_i"})
    met = leaves.join(pushed, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("idx") == F.col("_i")))
    added = {"_leaf": F.col("digest"), "_seen": F.col("seen"), "_subroot": F.col("subroot"), "_root": root, "_proof": F.col("proof")}
    return unheld(met, kept, added)


def without_breaks() -> Column:
    """The text as the tampering of the registered query leaves it: in every second document, by its id's checksum, without line breaks."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = manifest(documents(spark, sf_dir).select(*FIELDS), {"text": without_breaks()})
    folded = done.withColumn("_folded", fold(F.col("_seen"), F.col("_proof")))
    proof = F.aggregate("_proof", F.lit(""), lambda text, step: F.concat(text, text_of(step["left"]), text_of(step["right"])))
    return folded.select("doc_id", text_of(F.col("_leaf")).alias("leaf"), text_of(F.col("_subroot")).alias("subroot"), text_of(F.col("_root")).alias("root"), F.sha2(proof, 256).alias("proof_sha256"),
        text_of(F.col("_folded")).alias("folded_root"), (F.col("_folded") == F.col("_root")).alias("verified"))


def crc32_sql(text: str) -> str:
    """DuckDB's unsigned CRC-32 of an ASCII string, bit by bit."""
    bits = "list_reduce(list_prepend(xor(acc, b), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda acc, b: {bits}), 4294967295)"


def _framed_sql(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_framed_sql(text if f == 'text' else f) for f in FIELDS)})"


OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf, {_leaf_sql(f"CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS seen,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM documents),
low(lvl, source, idx, n, d) AS (
  SELECT 0, source, idx, n, leaf FROM leaves
  UNION ALL SELECT lvl + 1, source, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY lvl, source, idx // 3, (n + 2) // 3),
tops AS (SELECT source, d, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high(lvl, idx, n, d) AS (
  SELECT 0, idx, n, d FROM tops
  UNION ALL SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY lvl, idx // 3, (n + 2) // 3),
low_runs AS (SELECT lvl, source, idx // 3 AS up, list(d ORDER BY idx) AS ds FROM low WHERE n > 1 GROUP BY lvl, source, idx // 3),
high_runs AS (SELECT lvl, idx // 3 AS up, list(d ORDER BY idx) AS ds FROM high WHERE n > 1 GROUP BY lvl, idx // 3),
climb(doc_id, source, lvl, idx, h, proof) AS (
  SELECT doc_id, source, 0, idx, seen, '' FROM leaves
  UNION ALL SELECT c.doc_id, c.source, c.lvl + 1, c.idx // 3,
    sha256(coalesce(array_to_string(ds[:c.idx % 3], ''), '') || h || coalesce(array_to_string(ds[c.idx % 3 + 2:], ''), '')),
    proof || coalesce(array_to_string(ds[:c.idx % 3], ''), '') || coalesce(array_to_string(ds[c.idx % 3 + 2:], ''), '')
    FROM climb c JOIN low_runs r ON r.lvl = c.lvl AND r.source IS NOT DISTINCT FROM c.source AND r.up = c.idx // 3),
reached AS (SELECT doc_id, source, h, proof FROM climb QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1),
climb2(doc_id, lvl, idx, h, proof) AS (
  SELECT r.doc_id, 0, t.idx, r.h, r.proof FROM reached r JOIN tops t ON t.source IS NOT DISTINCT FROM r.source
  UNION ALL SELECT c.doc_id, c.lvl + 1, c.idx // 3,
    sha256(coalesce(array_to_string(ds[:c.idx % 3], ''), '') || h || coalesce(array_to_string(ds[c.idx % 3 + 2:], ''), '')),
    proof || coalesce(array_to_string(ds[:c.idx % 3], ''), '') || coalesce(array_to_string(ds[c.idx % 3 + 2:], ''), '')
    FROM climb2 c JOIN high_runs r ON r.lvl = c.lvl AND r.up = c.idx // 3),
done AS (SELECT doc_id, h, proof FROM climb2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1)
SELECT l.doc_id, l.leaf, t.d AS subroot, (SELECT d FROM high WHERE n = 1) AS root, sha256(d.proof) AS proof_sha256, d.h AS folded_root, d.h = (SELECT d FROM high WHERE n = 1) AS verified
FROM leaves l JOIN done d USING (doc_id) JOIN tops t ON t.source IS NOT DISTINCT FROM l.source"""
