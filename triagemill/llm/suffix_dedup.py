"""Removes byte strings that stand earlier in the corpus, found by sharded suffix arrays.

Every window of `WINDOW` bytes has an anchor: of its substrings of some bytes, the one with the least hash. Windows with equal bytes have
equal anchors, so a document is cut into segments, the runs of windows that share an anchor, and segments are dealt by the anchor's hash.
Anchors seen once go. Equal segments are one, known by its first place; each further place goes whole. The segments of anchors that
stand in unequal surroundings are the shards: strings joined by separators, whose suffix array comes from induced sorting, and whose
permuted common prefixes of at least a window's length join the places of one string. No task holds more than a shard; an anchor with more than that is
cut again by longer anchors, in the end by the windows themselves, of which there is one to an anchor.

Defined cases: null texts count as empty and keep nothing; texts shorter than a window stay; documents without an id come last, in the order of
digests of their texts; of documents with one id and unequal texts that with the least digest is first; rows alike in id and text are one
document and share its result; texts of any length are judged whole, in blocks; an empty table gives an empty result; a cut may fall inside a
character, so what is kept is bytes; further columns are carried along under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagemill.llm.common import HELD, POLY, POLY_INV, U64, chunks, documents, field_of, held, materialize, mix, release, salted_join, small, unheld
from triagemill.llm.suffix_array import permuted_common_prefixes, suffix_array

#: Bytes of a string whose second place goes.
WINDOW = 100
#: Bytes of the anchors, level by level; the last is the window itself.
ANCHORS = (40, 64, 88, 100)
#: Bytes of segments in a shard, and those from which an anchor alone is cut again.
SHARD_BYTES, ANCHOR_BYTES = 3 << 20, 1 << 20
#: Window starts handled at once; less than 2**20, as places take 20 bits beside a hash.
BLOCK = 1 << 19

_DOC = ["none", "id", "tie"]
_PLACE = "none boolean, id long, tie long, start long, size int"
_PLACE_FIELDS = [("none", pa.bool_()), ("id", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("size", pa.int32())]
#: A fixed odd number for each byte.
_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(POLY)) | U64(1)
_powers: list[np.ndarray] = []


def _power(base: int) -> np.ndarray:
    steps = np.full(BLOCK + WINDOW + 1, base, U64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def segments(data: np.ndarray, valid: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts in `data` that share an anchor: (anchor hash, hash of the run's bytes, first start, bytes). `valid`: the starts to
    judge; each has a whole window behind it."""
    if not _powers:
        _powers.extend((_power(POLY), _power(POLY_INV)))
    up, down = _powers
    n = len(data)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTES[data] * down[:n], out=sums[1:])
    hashes = mix((sums[anchor:] - sums[:-anchor]) * up[: n - anchor + 1])
    # The leftmost of the least: hash and place in one number, least over each window by doubling.
    low = U64((1 << 20) - 1)
    least, reach, width = (hashes & ~low) | np.arange(len(hashes), dtype=U64), 1, WINDOW - anchor + 1
    while 2 * reach <= width:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    if reach < width:
        least = np.minimum(least[: n - WINDOW + 1], least[width - reach :])
    at = (least & low).astype(np.int64)
    turn = at[1:] != at[:-1]
    first = np.flatnonzero(valid & np.concatenate(([True], turn | ~valid[:-1])))
    last = np.flatnonzero(valid & np.concatenate((turn | ~valid[1:], [True])))
    size = last - first + WINDOW
    whole = mix((sums[first + size] - sums[first]) * up[first] + size.astype(U64) * down[1])
    return hashes[at[first]], whole, first, size


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and the bounds of each in them."""
    flat = pc.fill_null(texts.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = flat.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def segments_of(texts: pa.Array, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, anchor hash, segment hash, start in its text, bytes, start in all bytes) of the segments of some texts, block by block."""
    data, bounds = _bytes(texts)
    starts = np.maximum(np.diff(bounds) - WINDOW + 1, 0)
    # 1 where a text's window starts begin, -1 where they end.
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, bounds[:-1][starts > 0], 1)
    np.add.at(edge, (bounds[:-1] + starts)[starts > 0], -1)
    valid = np.cumsum(edge[:-1]).astype(bool)
    for a in range(0, max(len(data) - WINDOW + 1, 0), BLOCK):
        part = data[a : a + BLOCK + WINDOW - 1]
        h, g, first, size = segments(part, valid[a : a + len(part) - WINDOW + 1], anchor)
        row = np.searchsorted(bounds, first + a, side="right") - 1
        yield row, h.view(np.int64), g.view(np.int64), first + a - bounds[row], size.astype(np.int32), first + a


def told_by_id(docs: DataFrame) -> bool:
    """Whether each row has an id of its own, so that texts need not be hashed to tell rows apart."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()


def keyed(docs: DataFrame, by_id: bool = False) -> DataFrame:
    """The caller's rows, and the order of documents: rows with an id first, then by id, then by text (of which nothing is made if ids tell
    rows apart)."""
    ident = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("none"), "text"))
    return held(docs, F.col("doc_id").isNull().alias("none"), ident.alias("id"), (F.lit(0).cast("long") if by_id else F.xxhash64("text")).alias("tie"))


def _once(docs: DataFrame, by_id: bool) -> DataFrame:
    """(none, id, tie, text) of each document, rows alike in id and text once."""
    rows = keyed(docs, by_id).select(*_DOC, F.col(f"{HELD}.text").alias("text"))
    if by_id:
        return rows
    twice = materialize(rows.groupBy(*_DOC).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "suffix-twice")
    n = twice.count()
    if not n:
        release(twice)
        return rows
    return rows.join(small(twice, n), _DOC, "left_anti").unionByName(rows.join(small(twice, n), _DOC, "left_semi").dropDuplicates(_DOC))


def _cut(docs: DataFrame, anchor: int) -> DataFrame:
    """(h, g, none, id, tie, start, size): the segments of all documents."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), *_PLACE_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", BLOCK):
                for row, h, g, start, size, _ in segments_of(part.column("text"), anchor):
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), *[part.column(c).take(row) for c in _DOC], pa.array(start), pa.array(size)], schema=schema)

    return docs.mapInArrow(run, f"h long, g long, {_PLACE}")


def _pieces(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(h, none, id, tie, start, size, piece): the bytes of places (h, none, id, tie, start, size)."""
    wanted = places.groupBy(*_DOC).agg(F.collect_list(F.struct("h", "start", "size")).alias("wanted"))
    schema = pa.schema([("h", pa.int64()), *_PLACE_FIELDS, ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                lists = part.column("wanted")
                flat, owner = lists.flatten(), np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                data, bounds = _bytes(part.column("text"))
                start, size = flat.field("start").to_numpy(), flat.field("size").to_numpy()
                out, view = [], memoryview(np.ascontiguousarray(data))
                for a, n in zip((bounds[owner] + start).tolist(), size.tolist()):
                    out.append(bytes(view[a : a + n]))
                row = pa.array(owner)
                yield pa.RecordBatch.from_arrays([flat.field("h"), *[part.column(c).take(row) for c in _DOC], flat.field("start"), flat.field("size"), pa.array(out, pa.binary())], schema=schema)

    return docs.join(wanted, _DOC).mapInArrow(run, f"h long, {_PLACE}, piece binary")


def shard_repeats(table: pa.Table) -> pa.Table:
    """Of a shard's segments (none, id, tie, start, piece) the bytes covered by windows that start earlier elsewhere in it: (none, id, tie, start, size)."""
    out = pa.schema(_PLACE_FIELDS)
    table = table.combine_chunks()
    if not table.num_rows:
        return out.empty_table()
    data, bounds = _bytes(table["piece"].combine_chunks() if isinstance(table["piece"], pa.ChunkedArray) else table["piece"])
    size, n = np.diff(bounds), table.num_rows
    # Bytes become 2 to 257; each segment ends with the separator 1, all of them with the sentinel 0.
    owner = np.repeat(np.arange(n), size + 1)
    symbols = np.ones(len(data) + n + 1, np.uint16)
    symbols[np.arange(len(data)) + np.repeat(np.arange(n), size)] = data + np.uint16(2)
    symbols[-1] = 0
    order = suffix_array(symbols, 258)
    _, shared = permuted_common_prefixes(symbols, order, 1)
    joined = shared[order] >= WINDOW
    member = joined.copy()
    member[:-1] |= joined[1:]
    at = order[member]
    if not len(at):
        return out.empty_table()
    group = np.flatnonzero(~joined[member])
    columns = [table[c].to_numpy() for c in ("none", "id", "tie", "start")]
    by_doc = np.lexsort(columns[2::-1])
    new = np.any([c[by_doc][1:] != c[by_doc][:-1] for c in columns[:3]], axis=0)
    rank = np.empty(n, np.int64)
    rank[by_doc] = np.concatenate(([0], np.cumsum(new)))
    head = bounds[:-1] + np.arange(n)
    where = columns[3][owner[at]] + at - head[owner[at]]
    # Places in order: a document's rank in the shard above the place in its text.
    key = rank[owner[at]] * (1 << 40) + where
    first = np.minimum.reduceat(key, group)
    late = np.zeros(len(symbols) + 1, bool)
    late[at[key != np.repeat(first, np.diff(group, append=len(at)))]] = True
    turns = np.flatnonzero(late[1:] != late[:-1]) + 1
    turns = np.concatenate(([0], turns)) if late[0] else turns
    a, b = turns[::2], turns[1::2]
    of = owner[a]
    docs = table.select(_DOC).take(pa.array(of))
    spans = [pa.array(columns[3][of] + a - head[of]), pa.array((b - a + WINDOW - 1).astype(np.int32))]
    return pa.table([*docs.columns, *spans], schema=out)


def _recut(pieces: DataFrame, anchor: int) -> DataFrame:
    """(h, g, none, id, tie, start, size, piece): segments cut again, by longer anchors."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), *_PLACE_FIELDS, ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "piece", BLOCK):
                data, _ = _bytes(part.column("piece"))
                view = memoryview(np.ascontiguousarray(data))
                for row, h, g, start, size, at in segments_of(part.column("piece"), anchor):
                    start = start + part.column("start").to_numpy()[row]
                    cut = [bytes(view[a : a + k]) for a, k in zip(at.tolist(), size.tolist())]
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), *[part.column(c).take(row) for c in _DOC], pa.array(start), pa.array(size), pa.array(cut, pa.binary())], schema=schema)

    return pieces.mapInArrow(run, f"h long, g long, {_PLACE}, piece binary")


_SPAN = [*_DOC, "start", "size", "kind"]


def _as_spans(places: DataFrame, kind: int) -> DataFrame:
    return places.select(*_DOC, "start", "size", F.lit(kind).cast("byte").alias("kind"))


def repeats(docs: DataFrame, by_id: bool, anchors: tuple[int, ...] = ANCHORS, shard_bytes: int = SHARD_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(none, id, tie, spans): of documents with repeats, what `covered` makes their removed bytes from.

    Kind 0 is a span to remove. Of the other kinds, odd ones are places of segments that came up more than once and even ones the first places
    among them, level by level: odd ones without the next even one go whole."""
    once = _once(docs, by_id)
    places = materialize(_cut(once, anchors[0]), "suffix-places")
    seen = places.groupBy("h").agg(F.count("*").alias("n"), ((F.min("g") != F.max("g")) | (F.min("size") != F.max("size"))).alias("parted")).where("n > 1")
    seen = materialize(seen.select("h", "parted"), "suffix-anchors")
    # Hot anchors are looked for among those seen more than once; their number is bounded by the share that makes them hot.
    cand = materialize(salted_join(places, seen, "h", places.count()), "suffix-candidates")
    release(places, seen)
    place = F.struct(*_DOC, "start")
    firsts = materialize(cand.groupBy("h", "g", "size").agg(F.min(place).alias("first"), F.max("parted").alias("parted")).select("h", "first.*", "size", "parted"), "suffix-firsts")
    spans = [_as_spans(cand, 1), _as_spans(firsts, 2)]
    pieces = materialize(_pieces(once, firsts.where("parted")), "suffix-pieces")
    done = [cand, firsts]
    for level in range(1, len(anchors)):
        sizes = pieces.groupBy("h").agg(F.sum(F.octet_length("piece") + 1).alias("bytes"))
        big = materialize(sizes.where(F.col("bytes") > anchor_bytes), "suffix-big")
        n_big = big.count()
        fits = pieces.join(small(big, n_big), "h", "left_anti") if n_big else pieces
        total = pieces.agg(F.sum(F.octet_length("piece") + 1)).first()[0] or 0
        shards = max(1, -(-total // shard_bytes))
        dealt = fits.select(F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"), *_DOC, "start", "piece")
        found = materialize(dealt.groupBy("shard").applyInArrow(shard_repeats, _PLACE), f"suffix-found-{level}")
        spans.append(_as_spans(found, 0))
        done.append(found)
        if not n_big:
            release(pieces, big)
            break
        again = materialize(_recut(pieces.join(small(big, n_big), "h", "left_semi"), anchors[level]), f"suffix-recut-{level}")
        release(pieces, big)
        # The least place of each segment keeps its bytes; an anchor in unequal surroundings goes on.
        best = again.groupBy("h", "g", "size").agg(F.min(F.struct(*_DOC, "start", "piece")).alias("first")).select("h", "g", "first.*", "size")
        best = materialize(best, f"suffix-best-{level}")
        parted = best.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
        spans += [_as_spans(again, 2 * level + 1), _as_spans(best, 2 * level + 2)]
        done += [again, best]
        pieces = materialize(best.drop("g").join(parted, "h", "left_semi").select("h", *_DOC, "start", "size", "piece"), f"suffix-pieces-{level}")
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    out = materialize(every.groupBy(*_DOC).agg(F.collect_list(F.struct("start", "size", "kind")).alias("spans")), "suffix-spans")
    release(*done)
    return out


def covered(start: np.ndarray, size: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal removed runs of a document, as starts and ends."""
    gone = kind == 0
    for k in range(1, int(kind.max(initial=0)) + 1, 2):
        gone |= (kind == k) & ~np.isin(start, start[kind == k + 1])
    a, b = start[gone], start[gone] + size[gone]
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    head = np.concatenate(([True], a[1:] > reach[:-1]))
    return a[head], reach[np.append(np.flatnonzero(head)[1:] - 1, len(a) - 1)]


def drop_repeats(docs: DataFrame, **sizes) -> DataFrame:
    """The rows of `docs`, and `_n_bytes`, `_n_removed`, `_n_spans`, `_spans` (start and size of the removed runs) and `_kept`, the remaining bytes."""
    by_id = told_by_id(docs)
    spans = repeats(docs, by_id, **sizes)
    joined = keyed(docs, by_id).join(spans, _DOC, "left").select(HELD, "spans")
    runs = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("size", T.LongType())]))
    schema = T.StructType([joined.schema[HELD], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("runs", runs), T.StructField("kept", T.BinaryType())])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                data, bounds = _bytes(field_of(part, "text"))
                view = memoryview(np.ascontiguousarray(data))
                lists = part.column("spans")
                flat, ends = lists.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                columns = [flat.field(c).to_numpy() for c in ("start", "size", "kind")]
                removed, n_spans, found, kept = [], [], [], []
                for i in range(part.num_rows):
                    lo, hi = (ends[i - 1] if i else 0), ends[i]
                    x, y = int(bounds[i]), int(bounds[i + 1])
                    a, b = covered(*[c[lo:hi] for c in columns]) if hi > lo else ((), ())
                    if not len(a):
                        removed.append(0), n_spans.append(0), found.append([]), kept.append(bytes(view[x:y]))
                        continue
                    edges = [0, *np.column_stack((a, b)).ravel().tolist(), y - x]
                    kept.append(b"".join(view[x + p : x + q] for p, q in zip(edges[::2], edges[1::2])))
                    removed.append(int((b - a).sum())), n_spans.append(len(a))
                    found.append([{"start": p, "size": q - p} for p, q in zip(a.tolist(), b.tolist())])
                yield pa.RecordBatch.from_arrays([part.column(HELD), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(found, run_type), pa.array(kept, pa.binary())],
                    [HELD, "n_bytes", "n_removed", "n_spans", "runs", "kept"])

    added = {"_n_bytes": F.col("n_bytes"), "_n_removed": F.col("n_removed"), "_n_spans": F.col("n_spans"), "_spans": F.col("runs"), "_kept": F.col("kept")}
    return unheld(joined.mapInArrow(finish, schema), docs.columns, added)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, n, i, x[2 * i + 1 : 2 * i + 2 * {WINDOW}] AS w FROM (SELECT *, unnest(range(n - {WINDOW - 1})) AS i FROM texts WHERE n >= {WINDOW})),
late AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
runs AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM late),
numbered AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + {WINDOW} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM runs),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {WINDOW} AS b FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT doc_id, max(b), (SELECT n FROM texts t WHERE t.doc_id = s.doc_id) FROM spans s GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(t.x[2 * a + 1 : 2 * b], '' ORDER BY a) AS x FROM gaps g JOIN texts t USING (doc_id) WHERE b > a GROUP BY g.doc_id),
counts AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN c.doc_id IS NULL THEN t.x ELSE coalesce(k.x, '') END)) AS kept_sha256
FROM texts t LEFT JOIN counts c USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
