"""Operator 2, line deduplication by a sharded minimal perfect hash.

Lines are known by the 128-bit hash of their key (stripped of ASCII white space, A-Z lower-cased). Every distinct hash of a long
key is indexed: for each shard of hashes a minimal perfect hash (levels of bit arrays, after BBHash, SEA 2017) leads it to its own
cell of three plain arrays: a 32-bit fingerprint, the number of documents, and the largest document. Documents probe the
arrays, which say how common a line is and who keeps it; no line is joined to another. A row's line hashes travel to the shard
that has their arrays, and only what is to be dropped comes back. A shard that many rows ask (a very common line) is copied to
several tasks, its rows dealt among them by row.

Defined cases: a null or empty text is one empty line; a row with a null id keeps all its lines and counts for none;
rows that repeat an id count as one document of that id and are each rewritten alike; a key shorter than the least length
is never counted; an empty table gives an empty result; a text, and a line, of any length is taken whole. Other columns, whatever
their names, are returned as they are, but that one named like an added column is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagemill.llm.common import HELD, U64, arrow_map, doc_key, documents, held, materialize, mix, release, small, unheld, with_text

MIN_CHARS = 40
MIN_DOCS = 5
#: Indexed hashes aimed at for each shard (about 3 MB of arrays), and rows that one task probes them for.
SHARD_KEYS = 200_000
PROBE_ROWS = 500_000
_LOW = (1 << 64) - 1


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def long_keys(lines: list[bytes], min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose key is long enough. bytes.strip and bytes.lower touch ASCII only, as the contract does."""
    out = []
    for i, line in enumerate(lines):
        if len(line) >= min_chars and len(key := line.strip().lower()) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            out.append((i, key))
    return out


def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = [xxhash.xxh3_128_intdigest(k) for k in keys]
    return np.fromiter((h >> 64 for h in both), U64, len(both)), np.fromiter((h & _LOW for h in both), U64, len(both))


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, n_docs, keeper) of every distinct long key."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            found = {k for _, k in long_keys(split(text), min_chars)}
            keys += found
            ids += [doc] * len(found)
        h1, h2 = hashes(keys)
        return pa.record_batch([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

    rows = arrow_map(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text"), work, "h1 long, h2 long, doc_id long")
    each = rows.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    return each.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


class PerfectHash:
    """Levels of bit arrays: a key's cell is the rank of the first level's bit that no other key shares. Keys are pairs of words."""

    LOAD = 2.0

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels, self.ranks, below = levels, [], 0
        for _, bits in levels:
            ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64))) + below
            self.ranks.append(ranks)
            below = int(ranks[-1])

    @staticmethod
    def spot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        # Pairs that agree in one word alone part at some level, too.
        return (mix(mix(h1 + U64(level * 0x632BE59BD9B4E019 & _LOW)) + h2) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        """`h1` and `h2` hold distinct pairs."""
        levels: list[tuple[int, np.ndarray]] = []
        while len(h1):
            if len(levels) > 200:
                raise ValueError("keys repeat")
            size = -(-int(len(h1) * cls.LOAD + 1) // 64) * 64
            at = cls.spot(h1, h2, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append((size, np.packbits(alone, bitorder="little").view(U64)))
            h1, h2 = h1[~alone[at]], h2[~alone[at]]
        return cls(levels)

    def cells(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The cell of every key; of a key that was not built in, any cell or -1."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, (size, bits) in enumerate(self.levels):
            if not len(left):
                break
            at = self.spot(h1[left], h2[left], level, size)
            word, bit = at >> 6, (at & 63).astype(U64)
            hit = (bits[word] >> bit) & U64(1) == 1
            under = np.bitwise_count(bits[word[hit]] & ((U64(1) << bit[hit]) - U64(1)))
            out[left[hit]] = self.ranks[level][word[hit]] + under
            left = left[~hit]
        return out


_ARRAYS = "sizes binary, bits binary, fingerprints binary, n_docs binary, keepers binary"


def fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mix(h1 ^ mix(h2)) >> U64(32)).astype(np.uint32)


def pack_shard(h1: np.ndarray, h2: np.ndarray, n_docs: np.ndarray, keeper: np.ndarray) -> dict[str, bytes]:
    table = PerfectHash.build(h1, h2)
    cell = table.cells(h1, h2)
    finger, count, keep = np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
    finger[cell], count[cell], keep[cell] = fingerprint(h1, h2), n_docs, keeper
    bits = np.concatenate([b for _, b in table.levels]) if table.levels else np.empty(0, U64)
    return {"sizes": np.array([s for s, _ in table.levels], np.int64).tobytes(), "bits": bits.tobytes(), "fingerprints": finger.tobytes(), "n_docs": count.tobytes(), "keepers": keep.tobytes()}


class Shard:
    def __init__(self, arrays: dict[str, bytes]):
        sizes, bits, at, levels = np.frombuffer(arrays["sizes"], np.int64), np.frombuffer(arrays["bits"], U64), 0, []
        for size in sizes.tolist():
            levels.append((size, bits[at : at + size // 64]))
            at += size // 64
        self.table = PerfectHash(levels)
        self.fingerprints = np.frombuffer(arrays["fingerprints"], np.uint32)
        self.n_docs = np.frombuffer(arrays["n_docs"], np.int64)
        self.keepers = np.frombuffer(arrays["keepers"], np.int64)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of documents that hold each line (0 where it isn't indexed), and the largest of them."""
        cell = self.table.cells(h1, h2)
        safe = np.maximum(cell, 0)
        if not len(self.n_docs):
            return np.zeros(len(h1), np.int64), np.full(len(h1), -1, np.int64)
        found = (cell >= 0) & (self.fingerprints[safe] == fingerprint(h1, h2))
        return np.where(found, self.n_docs[safe], 0), np.where(found, self.keepers[safe], -1)


def build_index(counts: DataFrame, shard_keys: int = SHARD_KEYS, probe_rows: int = PROBE_ROWS) -> tuple[DataFrame, DataFrame, int, int]:
    """A row of arrays for each shard, (shard, parts) of those that are asked by many rows, their number, and the number of shards."""
    counts = materialize(counts, "line-counts")
    shards = max(1, -(-counts.count() // shard_keys))
    of_shard = counts.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        arrays = pack_shard(rows["h1"].to_numpy(np.int64).view(U64), rows["h2"].to_numpy(np.int64).view(U64), rows["n_docs"].to_numpy(np.int64), rows["keeper"].to_numpy(np.int64))
        return pd.DataFrame([{"shard": key[0], **arrays}])

    index = materialize(of_shard.groupBy("shard").applyInPandas(build, f"shard int, {_ARRAYS}"), "line-index")
    asked = of_shard.groupBy("shard").agg(F.sum("n_docs").alias("asked")).where(F.col("asked") > probe_rows)
    parts = materialize(asked.select("shard", F.ceil(F.col("asked") / probe_rows).cast("int").alias("parts")), "line-parts")
    release(counts)
    return index, parts, parts.count(), shards


def rewrite(lines: list[bytes], drop: set[int]) -> str:
    return b"\n".join([x for i, x in enumerate(lines) if i not in drop] if drop else lines).decode()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, probe_rows: int = PROBE_ROWS) -> DataFrame:
    """The rows of `docs` with `text` rewritten and `_n_lines` (before), `_n_dropped` added."""
    index, parts, n_parts, shards = build_index(line_counts(docs, min_chars), shard_keys, probe_rows)

    def send(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, owner, row = [], [], []
        for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())):
            found = {k for _, k in long_keys(split(text), min_chars)}
            keys += found
            owner += [doc] * len(found)
            row += [i] * len(found)
        h1, h2 = hashes(keys)
        shard = (h1.view(np.int64) % shards).astype(np.int32)
        return pa.record_batch([pa.array(shard), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(owner, pa.int64()), batch.column("row").take(pa.array(row, pa.int64()))], ["shard", "h1", "h2", "owner", "row"])

    rows = docs.where("doc_id IS NOT NULL").select(doc_key().alias("row"), F.col("doc_id").cast("long"), "text")
    sent = arrow_map(rows, send, "shard int, h1 long, h2 long, owner long, row binary")
    # There is a row at most for each shard, so for 200,000 lines.
    spread = lambda df: df.join(small(parts, n_parts), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    sent = spread(sent).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    copies = spread(index).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    out = pa.schema([("row", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64())])

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out.empty_table()
        h1, h2 = (left[c].to_numpy().view(U64) for c in ("h1", "h2"))
        n_docs, keeper = Shard(right.drop_columns(["shard", "part"]).to_pylist()[0]).probe(h1, h2)
        gone = pa.array((n_docs >= min_docs) & (keeper != left["owner"].to_numpy()))
        return left.select(["row", "h1", "h2"]).filter(gone).cast(out)

    gone = sent.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(probe, "row binary, h1 long, h2 long")
    gone = materialize(gone.distinct().groupBy("row").agg(F.collect_list(F.struct("h1", "h2")).alias("gone")), "line-gone")
    release(index, parts)
    # Written, so that Spark knows its size: it is broadcast if that is small, else the rows are joined by their keys.
    joined = held(docs, doc_key().alias("row")).join(gone, "row", "left").select(HELD, "gone")
    schema = T.StructType([joined.schema[HELD], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, texts, n_lines, n_dropped = batch.column(HELD), [], [], []
        for text, gone in zip(rows.field("text").to_pylist(), batch.column("gone")):
            lines, drop = None, set()
            if gone.is_valid:
                lines, wanted = split(text), {(g["h1"], g["h2"]) for g in gone.as_py()}
                found = long_keys(lines, min_chars)
                h1, h2 = hashes([k for _, k in found])
                drop = {i for (i, _), a, b in zip(found, h1.view(np.int64).tolist(), h2.view(np.int64).tolist()) if (a, b) in wanted}
            texts.append(rewrite(lines, drop) if drop else text)
            n_lines.append((text or "").count("\n") + 1)
            n_dropped.append(len(drop))
        return pa.record_batch([with_text(rows, texts), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [HELD, "n_lines", "n_dropped"])

    return unheld(arrow_map(joined, finish, schema), docs.columns, {"_n_lines": F.col("n_lines"), "_n_dropped": F.col("n_dropped")})


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
counted AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
judged AS (SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN counted USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id"""
