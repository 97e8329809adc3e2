"""Prefix trie of conversations: which prefixes are shared, by how many, and what a cache of them saves.

Conversations are dealt by the digest of their first turn; each task builds pointer tries, a dictionary of children a node, and adds
up subtrees in an iterative postorder. Turns travel as digests of 128 bits and text sizes. Equal conversations are one sequence
with a weight before anything is dealt. A first turn with more rows than a task should hold is dealt again by the next turn at which its
sequences part or end, and so on; the nodes above the cuts, a path for each such group, are added up from the tops below.

Defined cases: rows without a conversation's id belong to none and are left out; turns that tie are ordered by a digest of role and
text, and repeated rows are turns of their own; null roles and texts are empty; texts of any length count whole; a conversation
without turns of its own isn't known, one whose rebuilt form has none is a member of the root alone; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagemill.llm.common import materialize, release, salted_join, small
from triagemill.llm.merkle import crc32_sql
from triagemill.llm.ranks import ranked

#: Rows of a first turn (or of a longer prefix) beyond which it is dealt again.
GROUP_ROWS = 50_000
#: Rows that a task's tries have on average.
TASK_ROWS = 100_000
#: Turns of a conversation that one window sums over; longer ones take several and their offsets.
BLOCK = 1024
#: Conversation ids that go as one string into a node's hash of ids.
ID_CHUNK = 8192

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ended_by long, up string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, idx, n, key, bytes): the turns of each conversation in order, from 0, as digests."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    return ranked(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("key")], "trie-turns").drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another one: (conv, depth, key, bytes) from depth 1, and (conv, length) of all."""
    own = turns.where("idx = 0").select("conv", "n").withColumn("h", F.crc32(F.col("conv").cast("string")) % 9).withColumn("base", F.col("conv") - F.col("conv") % 5)
    of_base = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = own.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = materialize(plan.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-plan")
    # At most eight turns of a base, for its few conversations.
    first = turns.where("idx < 8").select(F.col("conv").alias("base"), "idx", "key", "bytes")
    lent = plan.join(first, "base").where("idx < h").select("conv", (F.col("idx") + 1).alias("depth"), "key", "bytes")
    rest = salted_join(turns.drop("n"), plan.select("conv", "h", "taken"), "conv", turns.count()).where("idx >= h")
    return lent.unionByName(rest.select("conv", (F.col("taken") + F.col("idx") - F.col("h") + 1).alias("depth"), "key", "bytes")), plan.select("conv", "length")


def with_prefixes(rows: DataFrame) -> DataFrame:
    """Adds `p` and `q`: 128 bits that stand for the first `depth` turns of the conversation (order and all)."""
    spotted = materialize(rows.withColumn("p", F.xxhash64("depth", "key")).withColumn("q", F.xxhash64("key", F.lit("q"), "depth")).withColumn("block", F.floor(F.col("depth") / BLOCK)), "trie-spots")
    inside = Window.partitionBy("conv", "block").orderBy("depth")
    summed = spotted.withColumns({c: F.bit_xor(c).over(inside) for c in ("p", "q")})
    if (spotted.agg(F.max("block")).first()[0] or 0) > 0:
        blocks = spotted.groupBy("conv", "block").agg(F.bit_xor("p").alias("bp"), F.bit_xor("q").alias("bq"))
        before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select("conv", "block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("bp", "bq")])
        summed = summed.join(blocks, ["conv", "block"]).withColumn("p", F.col("p").bitwiseXOR(F.col("bp"))).withColumn("q", F.col("q").bitwiseXOR(F.col("bq")))
    return summed.select("conv", "depth", "key", "bytes", "p", "q")


def node_name() -> Column:
    return F.concat_ws(":", "depth", "p", "q")


def tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries over `rows` (group, conv, weight, depth, length, key, bytes, up, up_conv), which are whole below each group's cut."""
    rows = rows.sort_values(["group", "conv", "depth"], kind="stable")
    depth, least, parent, convs, size, ended, kids = [], [], [], [], [], [], []
    tops: dict[str, int] = {}
    of_top, last, at = {}, None, -1
    for group, conv, weight, d, length, key, n_bytes, up, up_conv in rows[["group", "conv", "weight", "depth", "length", "key", "bytes", "up", "up_conv"]].itertuples(index=False, name=None):
        fresh = conv != last
        last = conv
        found = tops.get(group) if fresh else kids[at].get(key)
        if found is None:
            found = len(depth)
            depth.append(d), least.append(conv), parent.append(-1 if fresh else at), convs.append(0), size.append(n_bytes), ended.append(None), kids.append({})
            if fresh:
                tops[group], of_top[found] = found, (up, up_conv)
            else:
                kids[at][key] = found
        at = found
        convs[at] += weight
        least[at] = min(least[at], conv)
        if d == length:
            ended[at] = conv
    leaves, saved = [0] * len(depth), [(n - 1) * b for n, b in zip(convs, size)]
    # A node is made after its parent, so the way back is a postorder.
    for i in range(len(depth) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    above = [least[p] if p >= 0 else of_top[i][1] for i, p in enumerate(parent)]
    up = [of_top[i][0] if i in of_top else None for i in range(len(depth))]
    out = pd.DataFrame({"conv_id": least, "depth": depth, "parent_conv_id": above, "n_convs": convs, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved})
    out["ended_by"] = pd.array(ended, dtype="Int64")
    out["up"] = pd.array(up, dtype="string")
    return out


def deal_again(rows: DataFrame, big: DataFrame, n_big: int, total: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The paths at the top of oversized groups, down to where sequences part or end, and the rows below, grouped by their next turn."""
    hot = rows.join(small(big, n_big), "group", "left_semi")
    by_depth = hot.groupBy("group", "depth").agg(F.count("*").alias("seqs"), F.sum("weight").alias("n_convs"), F.min("conv").alias("least"), F.min("bytes").alias("bytes"), F.min("up").alias("up"), F.min("up_conv").alias("up_conv"),
        F.max(F.when(F.col("depth") == F.col("length"), F.col("conv"))).alias("ended_by"), ((F.min("p") != F.max("p")) | (F.min("q") != F.max("q"))).alias("parted"))
    by_depth = materialize(by_depth, f"{name}-depths")
    # Sequences that ended above leave fewer of them: the path's last turn is the one above the first such depth.
    whole = by_depth.groupBy("group").agg(F.max("seqs").alias("all"), F.max("depth").alias("deepest"))
    cut = by_depth.join(whole, "group").where("parted OR seqs < all").groupBy("group").agg(F.min("depth").alias("cut"))
    cut = materialize(whole.join(cut, "group", "left").select("group", F.coalesce("cut", F.col("deepest") + 1).alias("cut")), f"{name}-cuts")
    paths = materialize(by_depth.join(cut, "group").where("depth < cut").drop("seqs", "parted").withColumn("bottom", F.col("depth") == F.col("cut") - 1), f"{name}-paths")
    below = hot.join(small(cut, n_big), "group").where("depth >= cut")
    heads = below.where("depth = cut").select("conv", node_name().alias("next"))
    bottoms = paths.where("bottom").select("group", F.col("least").alias("bottom_conv"))
    below = below.drop("up", "up_conv").join(small(bottoms, n_big), "group")
    dealt = salted_join(below, heads, "conv", total).withColumn("up", F.col("group")).withColumn("up_conv", F.col("bottom_conv")).withColumn("group", F.col("next"))
    dealt = materialize(dealt.select(*rows.columns), f"{name}-rows")
    release(by_depth)
    return paths, dealt


def path_nodes(paths: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes of the paths, added up from the tops below their last turns."""
    kids = tops.groupBy("up").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("up", "group")
    upward = Window.partitionBy("group").orderBy(F.col("depth").desc())
    own = F.sum((F.col("n_convs") - 1) * F.col("bytes")).over(upward.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    top = F.row_number().over(Window.partitionBy("group").orderBy("depth")) == 1
    met = paths.withColumn("own", own).withColumn("top", top).join(kids, "group", "left")
    return met.select(F.col("least").alias("conv_id"), "depth", F.when(F.col("top"), F.col("up_conv")).otherwise(F.col("least")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("bottom"), F.coalesce("kids", F.lit(0))).otherwise(1).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (F.col("own") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        F.when(F.col("bottom"), F.col("ended_by")).alias("ended_by"), F.when(F.col("top"), F.col("up")).alias("up"))


def ends(members: DataFrame) -> DataFrame:
    """(ended_by, ends_sha256) of each sequence that conversations end with: the least of them, and the hash of all their ids.

    Ids are range-sorted and joined to strings of bounded length in all tasks; a hash takes its strings one after another, as a hash must, and
    holds one at a time."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["length", "p", "q"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, list[int]] = {}
            for *k, conv in zip(*[batch.column(c).to_pylist() for c in (*key, "conv")]):
                held.setdefault(tuple(k), []).append(conv)
            runs = [(*k, ids[i], ",".join(map(str, ids[i : i + ID_CHUNK]))) for k, ids in held.items() for i in range(0, len(ids), ID_CHUNK)]
            yield pa.RecordBatch.from_pylist([dict(zip((*key, "first", "ids"), r)) for r in runs], pa.schema([*[(c, pa.int64()) for c in key], ("first", pa.int64()), ("ids", pa.string())]))

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, sha = None, None, None
        schema = pa.schema([("ended_by", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            done = []
            for *k, start, ids in zip(*[batch.column(c).to_pylist() for c in (*key, "first", "ids")]):
                if k != now:
                    if now is not None:
                        done.append((first, sha.hexdigest()))
                    now, first, sha = k, start, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (first, sha.hexdigest())))], schema)

    ordered = members.repartitionByRange(parts, *key, "conv").sortWithinPartitions(*key, "conv")
    runs = ordered.mapInArrow(join, "length long, p long, q long, first long, ids string")
    return runs.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(hash_all, "ended_by long, ends_sha256 string")


def trie(sequences: DataFrame, lengths: DataFrame, group_rows: int = GROUP_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """A row for each node of the trie over `sequences` (conv, depth, key, bytes) of the conversations in `lengths` (conv, length)."""
    spark = sequences.sparkSession
    rows = materialize(with_prefixes(sequences), "trie-prefixes")
    last = salted_join(rows.select("conv", "depth", "p", "q"), lengths, "conv", rows.count()).where("depth = length").select("conv", "length", "p", "q")
    members = last.unionByName(lengths.where("length = 0").select("conv", "length", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q")))
    members = materialize(members, "trie-members")
    # Equal sequences are one, known by its least conversation.
    alone = members.groupBy("length", "p", "q").agg(F.min("conv").alias("conv"), F.count("*").alias("weight")).select("conv", "length", "weight")
    alone = alone.join(rows.where("depth = 1").select("conv", node_name().alias("group")), "conv")
    all_convs, least = members.agg(F.count("*"), F.min("conv")).first()
    rows = salted_join(rows, alone, "conv", rows.count())
    rows = materialize(rows.withColumn("up", F.lit("")).withColumn("up_conv", F.lit(least).cast("long")), "trie-rows")
    every, rounds = [], []
    while True:
        sizes = materialize(rows.groupBy("group").agg(F.count("*").alias("rows")), "trie-sizes")
        total, n_big = sizes.agg(F.sum("rows"), F.count_if(F.col("rows") > group_rows)).first()
        total, big = total or 0, sizes.where(F.col("rows") > group_rows).select("group")
        fits = rows if not n_big else rows.join(small(big, n_big), "group", "left_anti")
        buckets = max(1, -(-total // task_rows))
        dealt = fits.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)))
        columns = ["bucket", "group", "conv", "weight", "depth", "length", "key", "bytes", "up", "up_conv"]
        every.append(materialize(dealt.select(*columns).groupBy("bucket").applyInPandas(tries, _NODE), f"trie-nodes-{len(every)}"))
        if not n_big:
            break
        paths, below = deal_again(rows, big, n_big, total, f"trie-{len(rounds)}")
        rounds.append(paths)
        release(rows, sizes)
        rows = below
    # The tops of the tries made in round k + 1 hang on the paths of round k, and these on those of round k - 1.
    on_paths: list[DataFrame] = []
    hanging = None
    for k in range(len(rounds) - 1, -1, -1):
        tops = every[k + 1].where("up IS NOT NULL")
        tops = tops if hanging is None else tops.unionByName(hanging.where("up IS NOT NULL"))
        hanging = materialize(path_nodes(rounds[k], tops), f"trie-paths-{k}")
        on_paths.append(hanging)
    nodes = every[0]
    for more in [*every[1:], *on_paths]:
        nodes = nodes.unionByName(more)
    below_root = every[0] if hanging is None else every[0].unionByName(hanging)
    turnless = members.where("length = 0").agg(F.min("conv").alias("ended_by"))
    root = below_root.where("up = ''").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    sums = root.first()
    ended = turnless.first()[0]
    if all_convs:
        whole = [(least, 0, None, all_convs, sums[0], sums[1] or 1, sums[2] or 0, ended, None)]
        nodes = nodes.unionByName(spark.createDataFrame(whole, _NODE))
    hashes = materialize(ends(members), "trie-ends")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    with_ends = nodes.where("ended_by IS NOT NULL").join(hashes, "ended_by").select(*columns, "ends_sha256")
    return with_ends.unionByName(nodes.where("ended_by IS NULL").select(*columns, F.lit(hashlib.sha256().hexdigest()).alias("ends_sha256")))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences, lengths = rebuilt(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return trie(sequences, lengths)


OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, octet_length(encode(coalesce(text, ''))) AS bytes, turn FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT c, k, bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS i FROM turns),
convs AS (SELECT c, count(*) AS n, {crc32_sql('c::VARCHAR')} % 9 AS h, c - c % 5 AS base FROM placed GROUP BY c),
plan AS (SELECT a.c, a.h, a.base, least(a.h, coalesce(b.n, 0)) AS taken FROM convs a LEFT JOIN convs b ON b.c = a.base),
rebuilt AS (
  SELECT p.c, t.i AS d, t.k, t.bytes FROM plan p JOIN placed t ON t.c = p.base AND t.i <= p.h
  UNION ALL SELECT p.c, p.taken + t.i - p.h, t.k, t.bytes FROM plan p JOIN placed t ON t.c = p.c AND t.i > p.h),
paths AS (
  SELECT c, d, bytes, string_agg(k, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path, max(d) OVER (PARTITION BY c) AS length FROM rebuilt
  UNION ALL SELECT p.c, 0, 0, '', coalesce((SELECT max(d) FROM rebuilt r WHERE r.c = p.c), 0) FROM plan p),
nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = length), '')) AS ends_sha256 FROM paths GROUP BY path, d),
kids AS (SELECT path[:32 * (d - 1)] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
kinds AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)),
sums AS (
  SELECT path[:32 * a] AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM kinds) GROUP BY 1)
SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM kinds k JOIN sums s USING (path) LEFT JOIN nodes p ON k.d > 0 AND p.path = k.path[:32 * (k.d - 1)]"""
