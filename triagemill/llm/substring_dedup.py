"""Operator 7, substring deduplication by level-wise doubling.

A window is `length` consecutive words. Every word that a window covers is removed if the window's words also start anywhere
else. Short windows are looked at first, and only those that repeat are extended to twice their length, level by level, until the
full length is reached or no candidate survives:

1. At each level a full window is stood for by the least (by hash, the first of equals) of the level's windows inside it, which
   depends on its words alone: equal windows have equal ones. So a level counts few places, one in fourteen at the first.
   A full window is a candidate of the next level if the one that stands for it repeats; all others are unique and end here.
2. At the last level below the full one (half its length at least) the window that stands for others is their owner. A repeated
   owner is extended by all windows that it owns in a place, which form one stretch of up to twice its length. Stretches are
   counted as wholes, so a passage in a thousand copies is a handful of rows. A stretch that occurs twice has all its windows
   repeated. Where an owner's stretches differ (at a passage's edges), one of each kind is cut into windows of the full length,
   and these are counted, each with its stretch's number.
3. What a removal covers depends on windows of the full length alone, so that longer repeats need no level of their own.

Repeated windows return to the documents as (word, mask) pairs and are marked on the text. Keys that very many rows share are few,
by construction, and joined by a broadcast; no task gets all rows of a common passage.

Hashes: levels below the last tell windows apart by 64 bits (two taken for equal survive in vain), an owner and its stretch are
told apart by 64 bits each, 128 together.

Defined cases: null and empty texts, and those shorter than a window, lose nothing; identical rows, null ids included, are
distinct places and lose what they share; an empty table gives an empty result; a text, and a word, of any length is taken
whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.llm.common import HOT_ROWS, HOT_SHARE, U64, Rolling, arrow_map, doc_key, documents, hash_words, materialize, release, small, words_of

LENGTH = 35
#: Words of the windows counted first: a quarter of the full length, since nearly all much shorter ones repeat in any prose.
START = 9


def levels(length: int, start: int) -> list[int]:
    """The lengths looked at before the full one, each twice the one before."""
    out = [start]
    while 2 * out[-1] < length:
        out.append(2 * out[-1])
    return out


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The inner join with `right`, which has each key once and `rows`, the number of rows that `left` has of it (`total` of all)."""
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    heavy, light = (F.broadcast(right.where(F.col("rows") >= limit).drop("rows")), right.where(F.col("rows") < limit).drop("rows"))
    return left.join(heavy, keys).unionByName(left.join(heavy, keys, "left_anti").join(light, keys))


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least of each `width` consecutive values, by doubling."""
    at, span, n = np.arange(len(values)), 1, len(values)
    least = values
    while span < width:
        step = min(span, width - span)
        n -= step
        left, right = least[:n], least[step : step + n]
        later = right < left
        at = np.where(later, at[step : step + n], at[:n])
        least = np.where(later, right, left)
        span += step
    return at


def stretches(hashes: np.ndarray, bounds: np.ndarray, length: int, half: int) -> tuple[np.ndarray, ...]:
    """For word hashes of texts with these bounds, each owner's stretch of windows: the text's number, the owner's place in the
    words, the first and last window start it owns, the owner's hash and the stretch's; and the rolling hash of the words."""
    rolling = Rolling(hashes)
    empty = np.empty(0, np.int64)
    if len(hashes) < length:
        return empty, empty, empty, empty, empty.astype(U64), empty.astype(U64), rolling
    start = np.arange(len(hashes) - half + 1)
    halves = rolling.of(start, start + half)
    owner = first_least(halves, length - half + 1)
    windows = np.arange(len(hashes) - length + 1)
    text = np.searchsorted(bounds, windows, side="right") - 1
    valid = windows + length <= bounds[text + 1]
    windows, owner, text = windows[valid], owner[valid], text[valid]
    if not len(windows):
        return empty, empty, empty, empty, empty.astype(U64), empty.astype(U64), rolling
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(windows)])) - 1
    text, owner, begin, end = text[first], owner[first], windows[first], windows[last]
    whole = rolling.of(begin, end + length) ^ ((owner - begin).astype(U64) * U64(0xD6E8FEB86659FD93))
    return text, owner, begin, end, halves[owner], whole, rolling


def stand_ins(hashes: np.ndarray, bounds: np.ndarray, length: int, level: int, rolling: Rolling) -> tuple[np.ndarray, ...]:
    """Of all full windows inside a text: their starts, text numbers, and the place and hash of the level's window that stands for each."""
    if len(hashes) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    start = np.arange(len(hashes) - level + 1)
    small_ones = rolling.of(start, start + level)
    place = first_least(small_ones, length - level + 1)
    windows = np.arange(len(hashes) - length + 1)
    text = np.searchsorted(bounds, windows, side="right") - 1
    valid = windows + length <= bounds[text + 1]
    windows, place, text = windows[valid], place[valid], text[valid]
    return windows, text, place, small_ones[place]


def alive_windows(batch: pa.RecordBatch, hashes: np.ndarray, bounds: np.ndarray, length: int, before: int, rolling: Rolling) -> np.ndarray:
    """Whether each place of the words starts a full window whose stand-in of the level before (listed in `alive`) repeats."""
    out = np.zeros(len(hashes) + 1, bool)
    windows, _, place, _ = stand_ins(hashes, bounds, length, before, rolling)
    alive = batch.column("alive")
    counts = pc.fill_null(pc.list_value_length(alive), 0).to_numpy(zero_copy_only=False)
    repeated = np.zeros(len(hashes) + 1, bool)
    repeated[np.repeat(bounds[:-1], counts) + alive.flatten().to_numpy()] = True
    out[windows[repeated[place]]] = True
    return out


def candidates(docs: DataFrame, length: int, level: int, before: int) -> DataFrame:
    """(h, row, place): the level's windows that stand for candidates, of `docs` (row, text, and alive after the first level)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, bounds = words_of(batch.column("text"))
        hashes = hash_words(words)
        rolling = Rolling(hashes)
        windows, text, place, h = stand_ins(hashes, bounds, length, level, rolling)
        if before:
            keep = alive_windows(batch, hashes, bounds, length, before, rolling)[windows]
            text, place, h = text[keep], place[keep], h[keep]
        # Windows in a row have mostly the same stand-in; places never fall.
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        text, place, h = text[new], place[new], h[new]
        return pa.record_batch([pa.array(h.view(np.int64)), batch.column("row").take(pa.array(text)), pa.array((place - bounds[text]).astype(np.int32))], ["h", "row", "place"])

    return arrow_map(docs, work, "h long, row binary, place int")


def survivors(docs: DataFrame, length: int, start: int) -> tuple[DataFrame | None, int]:
    """(row, alive: places of repeated stand-ins) of the last level but the owners', and that level; None if nothing survives."""
    alive, before = None, 0
    for level in levels(length, start)[:-1]:
        at = docs if alive is None else docs.join(alive, "row")
        found = materialize(candidates(at, length, level, before), "windows-candidates")
        rows = found.count()
        # A place of identical rows stands once for each of them.
        repeated = materialize(found.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1"), "windows-repeated")
        after = materialize(spread_join(found, repeated, ["h"], rows).groupBy("row").agg(F.collect_set("place").alias("alive")), "windows-alive")
        release(alive, found, repeated)
        alive, before = after, level
        if alive.isEmpty():
            break
    return alive, before


def owners(docs: DataFrame, length: int, half: int, before: int) -> DataFrame:
    """(row, place, owner, whole): a row for each owner in each place of `docs` (row, text, and alive after a level) that owns a candidate."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, bounds = words_of(batch.column("text"))
        hashes = hash_words(words)
        text, owner, begin, end, own, whole, rolling = stretches(hashes, bounds, length, half)
        if before and len(text):
            count = np.concatenate(([0], np.cumsum(alive_windows(batch, hashes, bounds, length, before, rolling))))
            keep = count[end + 1] > count[begin]
            text, owner, own, whole = text[keep], owner[keep], own[keep], whole[keep]
        columns = [batch.column("row").take(pa.array(text)), pa.array((owner - bounds[text]).astype(np.int32)), pa.array(own.view(np.int64)), pa.array(whole.view(np.int64))]
        return pa.record_batch(columns, ["row", "place", "owner", "whole"])

    return arrow_map(docs, work, "row binary, place int, owner long, whole long")


def cut_up(docs: DataFrame, length: int, level: int) -> DataFrame:
    """(owner, whole, offset, window): the windows of the wanted stretches of `docs` (text, wanted: places of owners)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, bounds = words_of(batch.column("text"))
        text, owner, begin, end, half, whole, rolling = stretches(hash_words(words), bounds, length, level)
        wanted = batch.column("wanted")
        at = np.repeat(bounds[:-1], wanted.value_lengths().to_numpy()) + wanted.flatten().to_numpy()
        keep = np.isin(owner, at)
        owner, begin, end, half, whole = (x[keep] for x in (owner, begin, end, half, whole))
        n = end - begin + 1
        which = np.repeat(np.arange(len(n)), n)
        start = begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) if len(n) else np.empty(0, np.int64)
        window = rolling.of(start, start + length) if len(start) else np.empty(0, U64)
        columns = [half[which].view(np.int64), whole[which].view(np.int64), (owner[which] - start).astype(np.int32), window.view(np.int64)]
        return pa.record_batch([pa.array(c) for c in columns], ["owner", "whole", "offset", "window"])

    return arrow_map(docs, work, "owner long, whole long, offset int, window long")


def repeated_windows(docs: DataFrame, length: int = LENGTH, start: int = START) -> DataFrame:
    """(row, marks: array of place, mask) of the rows of `docs` (row, text) with repeated windows: bit o of a mask says that the
    window starting o words before the place is repeated."""
    level = levels(length, start)[-1]
    alive, before = survivors(docs, length, start)
    places = materialize(owners(docs if alive is None else docs.join(alive, "row"), length, level, before), "windows-owners")
    total = places.count()
    release(alive)
    # The owners' level: those that repeat, and the stretches that they are extended to.
    counted = places.groupBy("owner", "whole").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one"))
    counted = materialize(counted, "windows-stretches")
    kinds = materialize(counted.join(counted.groupBy("owner").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where("all > 1"), "owner"), "windows-kinds")
    release(counted)
    # The full length: stretches of owners with several kinds are cut into full windows.
    several = kinds.where("kinds > 1")
    wanted = materialize(several.groupBy(F.col("one.row").alias("row")).agg(F.collect_list(F.col("one.place")).alias("wanted")), "windows-wanted")
    texts = docs.join(small(wanted, wanted.count(), 50_000), "row").select("text", "wanted")
    pieces = cut_up(texts, length, level).distinct().join(several.select("owner", "whole", "n"), ["owner", "whole"])
    pieces = materialize(pieces, "windows-pieces")
    release(wanted)
    twice = materialize(pieces.groupBy("owner", "window").agg(F.sum("n").alias("all"), F.count("*").alias("rows")).where("all > 1").drop("all"), "windows-twice")
    masks = spread_join(pieces, twice, ["owner", "window"], pieces.count()).groupBy("owner", "whole").agg(F.expr("bit_or(shiftleft(1L, offset))").alias("mask"))
    whole = kinds.where("n > 1").select("owner", "whole", F.lit(-1).cast("long").alias("mask"))
    found = whole.unionByName(masks).groupBy("owner", "whole").agg(F.bit_or("mask").alias("mask"))
    found = materialize(found.join(kinds.select("owner", "whole", F.col("n").alias("rows")), ["owner", "whole"]), "windows-found")
    release(pieces, twice, kinds)
    marks = spread_join(places, found, ["owner", "whole"], total).groupBy("row").agg(F.collect_set(F.struct("place", "mask")).alias("marks"))
    marks = materialize(marks, "windows-marks")
    release(places, found)
    return marks


def drop_repeats(docs: DataFrame, length: int = LENGTH, start: int | None = None) -> DataFrame:
    """(doc_id, text: the words kept, joined by spaces, _n_words, _n_removed) of every row of `docs`. The first level has windows of
    `start` words, or of about a quarter of the full length."""
    start = start or max(1, min(START, (length + 1) // 4))
    if length < 2 or not 0 < start < length:
        raise ValueError("a full window has two words at least, and the first level fewer than it")
    if length - levels(length, start)[-1] > 62:
        raise ValueError("a mask holds the windows of an owner in 64 bits")
    level = levels(length, start)[-1]
    keyed = docs.select(F.col("doc_id").cast("long"), "text", doc_key().alias("row"))
    marks = repeated_windows(keyed.where("text IS NOT NULL").select("row", "text"), length, start)
    # Rows alike share a key, and their places.
    joined = keyed.join(marks, "row", "left").select("doc_id", "text", F.col("marks.place").alias("places"), F.col("marks.mask").alias("masks"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, bounds = words_of(batch.column("text"))
        sizes = np.diff(bounds)
        places, masks = batch.column("places"), batch.column("masks")
        counts = pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False)
        gone = np.zeros(len(words) + 1, np.int64)
        if counts.any():
            _, owner, begin, end, _, _, _ = stretches(hash_words(words), bounds, length, level)
            at, mask = np.repeat(bounds[:-1], counts) + places.flatten().to_numpy(), masks.flatten().to_numpy()
            order = np.argsort(at, kind="stable")
            at, mask = at[order], mask[order]
            found = np.minimum(np.searchsorted(at, owner), len(at) - 1)
            mine = np.flatnonzero(at[found] == owner)
            # The windows an owner has in its text, less those its mask leaves out.
            begin, size, own, bits = begin[mine], (end - begin)[mine] + 1, owner[mine], mask[found[mine]]
            which = np.repeat(np.arange(len(mine)), size)
            window = begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            window = window[(bits[which] == -1) | ((bits[which] >> np.minimum(own[which] - window, 63)) & 1 == 1)]
            gone = np.bincount(window, minlength=len(gone)) - np.bincount(window + length, minlength=len(gone))
        keep = np.cumsum(gone[:-1]) == 0
        ends = np.concatenate(([0], np.cumsum(keep)))[bounds]
        kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(keep)).cast(pa.string()))
        columns = [batch.column("doc_id"), pc.binary_join(kept, " "), pa.array(sizes, pa.int64()), pa.array(sizes - np.diff(ends), pa.int64())]
        return pa.record_batch(columns, ["doc_id", "text", "_n_words", "_n_removed"])

    return arrow_map(joined, work, "doc_id long, text string, _n_words long, _n_removed long")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeats(documents(spark, sf_dir))
    return done.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + {LENGTH - 1}], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {LENGTH - 2})) AS i FROM d)),
hit AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY md5(g), length(g)) > 1),
near AS (SELECT w.r, w.i, w.w, w.i - h.i < {LENGTH} AS gone FROM w ASOF LEFT JOIN hit h ON w.r = h.r AND w.i >= h.i),
kept AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT coalesce(gone, false)) AS t FROM near GROUP BY r)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON d.r = k.r"""
