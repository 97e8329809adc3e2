"""Operator 9, lexical retrieval packing: sequences of related documents by a sharded BM25 inverted index.

Texts are tokenized once. Whole windows of a long document are sequences of their own; what is left over (under one
window) travels as 16-bit ids to a shard. Shards hold a bounded number of documents, those of a lexical neighbourhood:
documents are bucketed by a min-hash over their rarer tokens, and buckets that hold too many are split by a digest. A
shard builds an inverted index of its left-overs over tokens; each seed (the smallest unused id) asks it, with all its tokens, for
its unused neighbours by BM25, which fill the seed's window greedily, the last one cut. The cut-off part is the next seed. So only
the last sequence of a shard is padded. BM25's statistics (number of left-overs, their mean length, and how many hold a token)
are those of the whole corpus; neighbours are looked for in the seed's shard.

Defined cases: a null text is empty and packs as its closing id alone; rows repeating an id are each packed; a null id packs
last in its shard; equal left-overs fill windows by their id; an empty table gives an empty result; columns other than doc_id and text,
whatever their names, are ignored. Texts of any length are tokenized whole.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagemill.llm.common import U64, arrow_map, documents, materialize, mix, small

WINDOW = 2048
CLOSING_ID = 1
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Left-over documents aimed at for a shard, and at most (about) held by one: 4 KB of ids each.
SHARD_DOCS = 2048
#: Tokens below this id were merged early, so are frequent; they say little of a document's neighbourhood.
COMMON_IDS = 1000
#: A token that so small a part of a shard holds at least has a row of weights; fewer and it is kept as postings.
COMMON_SHARE = 8
#: BM25's constants.
K1, B = 1.2, 0.75
#: Bits of a sequence's number within its part; the rest of 63 bits number the parts.
SEQUENCE_BITS = 24


class Tokenizer:
    """The byte-level BPE tokenizer. The same vocabulary as ranks, run by the faster of the two libraries, gives the same
    ids; a text that spells a special token, which only the first treats as one, goes to the first."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer as Encoder

        self.encoder = Encoder.from_file(vocabulary)
        self.special = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as file:
            pairs = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        if len(pairs) + len(self.special) != self.encoder.get_vocab_size():
            raise ValueError("the two files hold different vocabularies")
        if self.encoder.get_vocab_size() > 1 << 16:
            raise ValueError("left-overs travel as 16-bit ids; the vocabulary is larger")
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, np.uint16)

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return self.whole(text)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)


_OPEN: dict[tuple, Tokenizer] = {}


def tokenizer(files: tuple[str, str, str] | None = None) -> Tokenizer:
    """One for each worker. `files`: vocabulary, ranks and splitting pattern; without them, the installed public ones."""
    if files is None:
        import public_tokenizers

        files = (public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    if files not in _OPEN:
        _OPEN[files] = Tokenizer(*files)
    return _OPEN[files]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def neighbourhoods(rests: list[np.ndarray]) -> np.ndarray:
    """The min-hash of each one's rarer tokens (of all if it has none, 0 if it is empty): two documents agree on it as often as they share
    such tokens."""
    out, size = np.zeros(len(rests), np.int64), np.array([len(r) for r in rests], np.int64)
    held = np.flatnonzero(size)
    if len(held):
        flat = np.concatenate(rests)
        hashes, starts = mix(flat.astype(U64)), (np.cumsum(size) - size)[held]
        none = ~U64(0)
        least = np.minimum.reduceat(np.where(flat >= COMMON_IDS, hashes, none), starts)
        least = np.where(least == none, np.minimum.reduceat(hashes, starts), least)
        out[held] = (least >> U64(1)).astype(np.int64)
    return out


def tokenized(docs: DataFrame, files: tuple[str, str, str] | None = None, window: int = WINDOW) -> DataFrame:
    """(doc_id, doc_tokens, whole: checksums of whole windows, rest: 16-bit ids, near: the neighbourhood)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tok, total, whole, rest = tokenizer(files), [], [], []
        closing = np.array([CLOSING_ID], np.uint16)
        for text in batch.column("text").to_pylist():
            ids = np.concatenate([tok.ids(text or ""), closing])
            cut = len(ids) // window * window
            total.append(len(ids))
            whole.append([checksum(ids[a : a + window]) for a in range(0, cut, window)])
            rest.append(ids[cut:])
        columns = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(whole, pa.list_(pa.int64())), pa.array([r.tobytes() for r in rest], pa.binary()), pa.array(neighbourhoods(rest))]
        return pa.record_batch(columns, ["doc_id", "doc_tokens", "whole", "rest", "near"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, doc_tokens long, whole array<long>, rest binary, near long")


def postings(rests: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, place of the left-over, times it holds the token), ordered by token and place: one sort of all of them."""
    size = np.array([len(r) for r in rests], np.int64)
    if not size.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    key = np.concatenate(rests).astype(np.int64) << 32 | np.repeat(np.arange(len(rests)), size)
    key.sort()
    first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.diff(first, append=len(key))


class Statistics:
    """BM25's view of the corpus: the number of left-overs, their mean length, and of each token how many hold it."""

    def __init__(self, count: int, mean: float, held_by: np.ndarray):
        self.count, self.mean = count, max(mean, 1.0)
        self.idf = np.log1p((count - held_by + 0.5) / (held_by + 0.5))

    @classmethod
    def of(cls, rests: list[np.ndarray]) -> Statistics:
        held_by = np.bincount(postings(rests)[0], minlength=1 << 16)
        return cls(len(rests), float(np.mean([len(x) for x in rests])) if rests else 0.0, held_by)


def statistics(coded: DataFrame) -> Statistics:
    """Of all left-overs of `coded` (rest). A row for each token of the vocabulary, 65,536 at most, reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, length = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            rests = [np.frombuffer(rest, np.uint16) for rest in batch.column("rest").to_pylist() if rest]
            rows, length = rows + len(rests), length + sum(map(len, rests))
            for a in range(0, len(rests), SHARD_DOCS):
                total += np.bincount(postings(rests[a : a + SHARD_DOCS])[0], minlength=1 << 16)
        tokens = np.flatnonzero(total)
        yield pa.record_batch([pa.array([*tokens.tolist(), -1, -2], pa.int32()), pa.array([*total[tokens].tolist(), rows, length], pa.int64())], ["token", "n"])

    found = {r.token: r.n for r in coded.select("rest").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    rows, length = found.pop(-1, 0), found.pop(-2, 0)
    held_by = np.zeros(1 << 16, np.int64)
    held_by[list(found)] = list(found.values())
    return Statistics(rows, length / rows if rows else 0.0, held_by)


class Index:
    """The tokens of a shard's left-overs, inverted, with their BM25 weights. Tokens that many of them hold have a row of weights each, which
    a product adds up; of the others the postings are kept."""

    def __init__(self, rests: list[np.ndarray], corpus: Statistics):
        term, doc, n = postings(rests)
        length = np.array([len(x) for x in rests], np.float64)
        self.count = len(rests)
        norm = K1 * (1 - B + B * length / corpus.mean)
        weight = corpus.idf[term] * n * (K1 + 1) / (n + norm[doc])
        held_by = np.bincount(term, minlength=1 << 16)
        common = np.flatnonzero(held_by >= max(1, self.count // COMMON_SHARE))
        #: The row of each token that has one.
        self.row = np.full(1 << 16, -1, np.int64)
        self.row[common] = np.arange(len(common))
        row = self.row[term]
        self.rows, self.alive = np.zeros((len(common), self.count)), np.arange(self.count)
        self.rows[row[row >= 0], doc[row >= 0]] = weight[row >= 0]
        self.doc, self.weight = doc[row < 0], weight[row < 0]
        self.bounds = np.searchsorted(term[row < 0], np.arange(1 << 16 | 1))

    def keep(self, unused: np.ndarray) -> None:
        """Drops the postings and columns of what is used; no later seed may take it."""
        kept = unused[self.doc]
        self.bounds = np.concatenate(([0], np.cumsum(kept)))[self.bounds]
        self.doc, self.weight = self.doc[kept], self.weight[kept]
        self.rows = np.ascontiguousarray(self.rows[:, unused[self.alive]])
        self.alive = self.alive[unused[self.alive]]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        terms = np.unique(ids)
        rows = self.row[terms]
        spans = [slice(self.bounds[t], self.bounds[t + 1]) for t in terms[rows < 0].tolist()]
        out = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.count).astype(np.float64, copy=False) if spans else np.zeros(self.count)
        asked = np.zeros(len(self.rows))
        asked[rows[rows >= 0]] = 1.0
        out[self.alive] += asked @ self.rows
        return out


def fill(rests: list[np.ndarray], window: int = WINDOW, corpus: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start in its rest, length) that hold every id once; each but the last is full."""
    index, unused, out = Index(rests, corpus or Statistics.of(rests)), np.array([len(r) > 0 for r in rests], bool), []
    at, seed, start, held = 0, -1, 0, len(rests)
    while True:
        left = int(unused.sum())
        if left < 0.75 * held:
            index.keep(unused)
            held = left
        if seed < 0:
            while at < len(rests) and not unused[at]:
                at += 1
            if at == len(rests):
                return out
            seed, start = at, 0
            unused[at] = False
        pieces, room = [(seed, start, len(rests[seed]) - start)], window - (len(rests[seed]) - start)
        query, seed = rests[seed], -1
        if room and unused.any():
            scores = np.where(unused, index.scores(query), -1.0)
            # Enough of the best to fill the window, since a left-over holds one id at least.
            k = min(room, len(scores))
            best = np.argpartition(-scores, k - 1)[:k] if k < len(scores) else np.arange(len(scores))
            for i in best[np.lexsort((best, -scores[best]))].tolist():
                if not room:
                    break
                if unused[i]:
                    unused[i] = False
                    took = min(room, len(rests[i]))
                    pieces.append((i, 0, took))
                    room -= took
                    if took < len(rests[i]):
                        seed, start = i, took
        out.append(pieces)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, files: tuple[str, str, str] | None = None, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    coded = materialize(tokenized(docs, files, window), "packing-ids")
    corpus = statistics(coded)
    shared = docs.sparkSession.sparkContext.broadcast(corpus)
    buckets = max(1, -(-coded.count() // shard_docs))
    bucketed = coded.withColumn("bucket", F.pmod(F.xxhash64("near"), F.lit(buckets)).cast("int")).withColumn("at", F.monotonically_increasing_id())
    # Buckets with too many documents (a large group of copies) are split; there are no more of these than buckets.
    split = bucketed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard_docs).select("bucket", F.ceil(F.col("n") / shard_docs).cast("int").alias("ways"))
    split = materialize(split, "packing-split")
    # Parts are numbered on: bucket b's first part, then the parts that split buckets have beyond one.
    ways = split.agg(F.coalesce(F.sum("ways"), F.lit(0))).first()[0]
    if buckets + ways > 1 << (63 - SEQUENCE_BITS):
        raise ValueError("more parts than can be numbered")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn("first", F.lit(buckets) + F.coalesce(F.sum("ways").over(before), F.lit(0)))
    dealt = bucketed.join(small(split, buckets), "bucket", "left")
    # Rows alike in id and text are told apart by their places in the written table.
    place = F.xxhash64(F.col("doc_id"), F.xxhash64("rest"), F.col("at"))
    dealt = dealt.withColumn("part", F.when(F.col("ways").isNotNull(), F.col("first") + F.pmod(place, F.col("ways"))).otherwise(F.col("bucket")).cast("long"))

    def shard(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending")])
        ids, totals, whole = rows["doc_id"].to_pylist(), rows["doc_tokens"].to_pylist(), rows["whole"].to_pylist()
        rests = [np.frombuffer(x, np.uint16) for x in rows["rest"].to_pylist()]
        made, sequence = [], key[0].as_py() << SEQUENCE_BITS
        last = sequence + (1 << SEQUENCE_BITS)
        for doc, total, sums in zip(ids, totals, whole):
            for i, crc in enumerate(sums):
                made.append((doc, i * window, window, crc, total, sequence, 0))
                sequence += 1
        for pieces in fill(rests, window, shared.value):
            offset = 0
            for i, start, length in pieces:
                made.append((ids[i], len(whole[i]) * window + start, length, checksum(rests[i][start : start + length]), totals[i], sequence, offset))
                offset += length
            sequence += 1
        if sequence > last:
            raise ValueError("more sequences in a part than can be numbered")
        columns = list(zip(*made)) if made else [[]] * 7
        return pa.table({c.split()[0]: pa.array(v, pa.int64()) for c, v in zip(_PIECES.split(", "), columns)})

    return dealt.select("part", "doc_id", "doc_tokens", "whole", "rest").groupBy("part").applyInArrow(shard, _PIECES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
