"""Operator 6, exact top-k search over a bit-sliced index.

The components of a block of vectors are kept as bit slices: for each attribute and bit, a bitmap over the block's rows.
A query's inner product with all rows of the block is a sum of slices, shifted by the set bits of the query's components,
added by bitmap arithmetic (carry-save adders over 64 rows a word). The sums are slices again; the best rows are picked from
the most significant slice downward, and the rows that tie at the boundary are resolved exactly, by id. Blocks of queries
meet blocks of rows once each, and the best of the blocks are merged.

Components and queries are integers. A negative component of a query adds the attribute's complement.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part, nor do null ids; vectors of
another length than the query's are no candidates of it; all rows with the query's id are its own; repeated rows of a
candidate each count, a repeated query is answered once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagemill.llm.common import U64, materialize

TOP = 20
SCALE = 64
QUERY_EVERY = 20
BLOCK_ROWS = 16_384
#: Queries of a block: at least the first, so that small inputs are dealt to many tasks, and at most the second.
QUERY_BLOCK = (128, 32_768)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, values, width) with integer components, of the vectors that take part."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    clean = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(clean)
    return rows.select(F.col("vec_id").cast("long"), F.transform(doubles, lambda x: F.floor(x * scale).cast("long")).alias("values")).withColumn("width", F.size("values"))


class Slices:
    """Bit slices of a block: attribute d's values less its least, as `bits[d]` bitmaps of 64-row words."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.lexsort((ids,))
        self.ids, values = ids[order], values[order]
        self.rows = len(ids)
        self.words = -(-self.rows // 64)
        self.least = values.min(axis=0)
        spread = (values - self.least).astype(U64)
        self.bits = [int(x).bit_length() for x in spread.max(axis=0)]
        self.slices = [np.stack([self.pack(spread[:, d] >> U64(b) & U64(1)) for b in range(n)]) if n else np.empty((0, self.words), U64) for d, n in enumerate(self.bits)]
        self.all = self.pack(np.ones(self.rows, np.uint8))
        self.values = values

    def pack(self, flags: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, np.uint8)
        padded[: self.rows] = flags
        return np.packbits(padded, bitorder="little").view(U64)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the query's products less a constant of this block."""
        waiting: dict[int, list[np.ndarray]] = {}
        for d, q in enumerate(query.tolist()):
            if not q or not self.bits[d]:
                continue
            part = self.slices[d] if q > 0 else ~self.slices[d] & self.all
            for shift in range(abs(q).bit_length()):
                if abs(q) >> shift & 1:
                    for b in range(self.bits[d]):
                        waiting.setdefault(b + shift, []).append(part[b])
        out, weight = [], 0
        while any(w >= weight for w in waiting):
            held = waiting.pop(weight, [])
            maps = np.stack(held) if held else np.empty((0, self.words), U64)
            carried: list[np.ndarray] = []
            while len(maps) > 1:
                triples = len(maps) // 3
                if triples:
                    a, b, c = maps[:triples], maps[triples : 2 * triples], maps[2 * triples : 3 * triples]
                    half = a ^ b
                    carried.extend((a & b) | (half & c))
                    maps = np.concatenate([half ^ c, maps[3 * triples :]])
                else:
                    carried.append(maps[0] & maps[1])
                    maps = (maps[0] ^ maps[1])[None]
            out.append(maps[0] if len(maps) else np.zeros(self.words, U64))
            if carried:
                waiting.setdefault(weight + 1, []).extend(carried)
            weight += 1
        return out

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own, best first."""
        open_rows = self.all.copy()
        first, last = np.searchsorted(self.ids, [own, own + 1] if own < np.iinfo(np.int64).max else [own, own])
        for i in range(first, last):
            open_rows[i >> 6] &= ~(U64(1) << U64(i & 63))
        sure = np.zeros(self.words, U64)
        for bitmap in reversed(self.sums(query)):
            some = sure | (open_rows & bitmap)
            n = int(np.bitwise_count(some).sum())
            if n > k:
                open_rows = open_rows & bitmap
            else:
                sure, open_rows = some, open_rows & ~bitmap
                if n == k:
                    open_rows = np.zeros(self.words, U64)
                    break
        chosen = self.places(sure)
        # Rows still open tie on every slice; they stand in the order of their ids.
        chosen = np.concatenate([chosen, self.places(open_rows)[: k - len(chosen)]])
        score = self.values[chosen] @ query
        order = np.lexsort((self.ids[chosen], -score))
        return self.ids[chosen][order], score[order]

    def places(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.rows])


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query's candidates the k best, ties to the smaller id. Both inputs: vec_id, values, width."""

    def packed(df: DataFrame, rows_a_block: int, parts: int | None = None) -> tuple[DataFrame, int]:
        blocks = parts or max(1, -(-df.count() // rows_a_block))
        block = F.pmod(F.xxhash64("vec_id", F.hash("values")), F.lit(blocks)).cast("int").alias("block")

        def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            values = np.stack(rows["values"].to_numpy()).astype(np.int64)
            return pd.DataFrame([{"width": key[0], "block": key[1], "ids": rows["vec_id"].to_numpy(np.int64).tobytes(), "values": values.tobytes()}])

        return df.select("vec_id", "values", "width", block).groupBy("width", "block").applyInPandas(gather, "width int, block int, ids binary, values binary"), blocks

    queries = queries.dropDuplicates(["vec_id", "values"])
    n = queries.count()
    least, most = QUERY_BLOCK
    asked = max(-(-n // most), min(-(-n // least), 24), 1)
    left, n_blocks = packed(vectors, BLOCK_ROWS)
    right, n_asked = packed(queries, most, asked)
    # Every block of queries meets every block of rows of its width: a join on the pair of block numbers.
    left = materialize(left, "topk-rows").withColumnRenamed("ids", "row_ids").withColumnRenamed("values", "row_values").withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    right = materialize(right, "topk-queries").withColumnRenamed("block", "asked").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = left.join(right.hint("shuffle_hash"), ["width", "block", "asked"])

    def answer(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                rows = Slices(np.frombuffer(r.row_ids, np.int64), np.frombuffer(r.row_values, np.int64).reshape(-1, r.width))
                out = []
                for own, query in zip(np.frombuffer(r.ids, np.int64).tolist(), np.frombuffer(r.values, np.int64).reshape(-1, r.width)):
                    ids, score = rows.top(query, own, k)
                    out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": score, "query": xxhash.xxh3_64_intdigest(query.tobytes()) >> 1}))
                yield pd.concat(out)

    best = pairs.mapInPandas(answer, "query_id long, vec_id long, score long, query long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialize(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "topk-vectors")
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


OP6_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {QUERY_EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {TOP}"""
