"""Shared pieces of the corpus operators: scratch tables, size-checked broadcasts, vectorised words and hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters of the word and line contracts, as a Java/RE2/Python pattern class.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table may be broadcast (id-sized rows: about 16 MB).
BROADCAST_ROWS = 500_000
#: Text bytes handled at once by a Python worker; bounds its temporaries.
CHUNK_BYTES = 4 << 20
U64 = np.uint64
#: Odd multiplier of the polynomial window hash and its inverse modulo 2**64.
POLY = 0x9E3779B97F4A7C15
POLY_INV = pow(POLY, -1, 1 << 64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage. Where the cluster names none, a local one is set in local mode (tests) alone: on a cluster
    each executor would write to a disk of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="triagemill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Tables written and not yet released: path to session.
_written: dict[str, SparkSession] = {}
#: Set while a table is written: its shuffle files go when it is done, since later reads take the table.
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean_up() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at interpreter exit; the folder is then the cluster's to clear
            pass


atexit.register(_clean_up)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared scratch folder and read it again: lineage is cut, and a lost executor costs no recomputation.
    The shuffle files of the write are removed with it; the table stays until it is released or the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/triagemill/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_SHUFFLES, "false")
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete materialized tables that no later step reads."""
    for table in tables:
        path = getattr(table, "scratch_path", None)
        if path in _written:
            _delete(_written.pop(path), path)


def written() -> set[str]:
    """The paths of the tables that stand now."""
    return set(_written)


def release_paths(paths: set[str]) -> None:
    for path in paths & set(_written):
        _delete(_written.pop(path), path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of `df`, known to hold `rows` narrow rows, only below the limit; else the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


#: A key is hot from so many rows on, and from this share of all rows, so that there are at most 1 / share hot ones.
HOT_ROWS, HOT_SHARE = 1000, 1 / 50_000


def salted_join(left: DataFrame, right: DataFrame, key: str, total: int, of: DataFrame | None = None) -> DataFrame:
    """The inner join on one column with `right`, which has each key once. Rows of `left` (`total` of them) with a hot key are dealt
    over copies of its row in `right`, as many as it takes to leave each copy no more rows than the limit. `of`: what the hot keys are
    found in, where that is cheaper than `left`; any keys give the same rows."""
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    if total <= limit:
        return left.join(right, key)
    hot = (left if of is None else of).groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit).select(key, F.ceil(F.col("_rows") / limit).cast("int").alias("_ways"))
    others = [c for c in left.columns if c != key]
    # At most 1 / HOT_SHARE keys can be hot.
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*others), F.col("_ways")), F.lit(0)).cast("int")).drop("_ways")
    copies = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1))).drop("_ways")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def text_key(text: str = "text") -> Column:
    """128 bits that tell texts apart; a null text is no empty one."""
    return F.unhex(F.md5(F.concat(F.when(F.col(text).isNull(), "0").otherwise("1"), F.coalesce(text, F.lit("")))))


def doc_key() -> Column:
    """Row identity of 128 bits that needs no unique or non-null id: identical rows share it, and so share their result."""
    head = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.when(F.col("text").isNull(), ":0").otherwise(":1"))
    return F.unhex(F.md5(F.concat(head, F.coalesce("text", F.lit("")))))


#: The one column that holds the caller's row, so that no name of the caller's meets one of the operator's.
HELD = "_held"


def held(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(HELD), *more)


def unheld(rows: DataFrame, columns: list[str], added: dict[str, Column]) -> DataFrame:
    """The caller's columns again, and the added ones; a column of the caller's named like an added one is replaced by it."""
    taken = {c.lower() for c in added}
    return rows.select(*[F.col(f"{HELD}.`{c}`").alias(c) for c in columns if c.lower() not in taken], *[v.alias(c) for c, v in added.items()])


def field_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(HELD).field(name) if HELD in batch.schema.names else batch.column(name)


def with_text(rows: pa.StructArray, texts: list[str | None]) -> pa.StructArray:
    """The held rows with other texts."""
    names = [f.name for f in rows.type]
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()) if n == "text" else rows.field(n) for n in names], names)


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about `limit` bytes of text each (a longer text stands alone, whole)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(field_of(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one array, and each text's bounds in it (nulls: no words)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = parts.flatten()
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    keep = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(keep.to_numpy(zero_copy_only=False))))
    return flat.filter(keep), before[offsets]


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; every distinct word of the batch is hashed once."""
    if not len(words):
        return np.empty(0, U64)
    coded = words.dictionary_encode()
    distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), U64, len(coded.dictionary))
    return distinct[coded.indices.to_numpy()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit depends on all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((POLY, POLY_INV)):
            steps = np.full(max(n, 1 << 20), base, U64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Hashes of any word range [a, b) of an array, from one cumulative sum."""

    def __init__(self, hashes: np.ndarray):
        up, down = _powers(len(hashes) + 1)
        self.up = up
        self.sums = np.zeros(len(hashes) + 1, U64)
        np.cumsum(hashes * down[:-1], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # The power of `a` counts down from a fixed base, so that equal words give equal sums wherever they stand.
        _, down = _powers(len(self.sums))
        up = self.up
        return mix((self.sums[b] - self.sums[a]) * up[a] + (b - a).astype(U64) * down[1])


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over text-bounded slices of the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                out = work(part)
                yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)
