"""Operator 8, n-gram Jaccard join with rare-first prefix filtering.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with equal sets (by 128 bits) are one node. Shingles are
ordered rare-first (by how often their hash bucket occurs in the corpus, a table of a fixed number of buckets, then by hash);
two sets as similar as asked share a shingle among the first few of each, so only these prefixes are joined. Pairs must pass
the length filter, the positional filter and the suffix filter in two forms (parity sketches, which bound the symmetric
difference from below, inside the join; then the overlap of the hash range's parts) before their whole sets are compared, once a pair.

What is asked for are the components of the links, so a pair inside a component needs no comparison. While the lists of a
shingle hold many more pairs than rows, the rows of a list are compared with one of its members only (of each size class, by the
hash of its shingle, so that a group of near copies has several), which joins such groups in time linear in their size. As soon as the pairs across components are few, or
the rounds are used up, all of them are compared; none is left out, so the components are exact.

Defined cases: a null, empty or wordless text has no set, links with nothing and is its own component; null ids take no part
in naming a component (one of null ids alone is named null); rows that repeat an id are rows of their own; a text with fewer
words than a shingle is one shingle; an empty table gives an empty result; texts of any length are taken whole; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.llm.common import U64, Rolling, arrow_map, chunks, doc_key, documents, hash_words, materialize, mix, release, salted_join, small, words_of

#: Words of a shingle, and the percent of the union that two sets must share to be near duplicates.
SHINGLE, PERCENT = 5, 80
#: What op8's contract asks for instead.
OP8_SHINGLE, OP8_PERCENT = 3, 90
#: Buckets of the shingle frequencies: a table of this many counts is all that is broadcast of them.
BUCKET_BITS = 21
#: Parts of the hash range in the suffix filter.
PARTS = 128
#: All pairs across components are compared once their lists hold at most so many a row of all prefixes; else after so many rounds.
PAIRS_A_ROW = 0.5
ROUNDS = 1
#: Members of a list, by the hash of its shingle, that a round compares the others with: so many for a group of near copies.
LEADERS = 8
#: Preceding grams of the prefix that a posting carries, so that a pair sharing a run of grams meets at the run's first.
BEFORE = 2


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, bounds = words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = hash_words(words)
    rolling, out = Rolling(hashes), []
    start = np.arange(max(0, len(hashes) - shingle + 1))
    all_of = rolling.of(start, start + shingle)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(all_of[a : b - shingle + 1]))
        elif b > a:
            out.append(rolling.of(np.array([a]), np.array([b])))
        else:
            out.append(np.empty(0, U64))
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def overlap_needed(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(percent * (a + b) / (100 + percent))


def bucket_frequencies(docs: DataFrame, shingle: int, bits: int = BUCKET_BITS) -> np.ndarray:
    """Of each hash bucket, the shingles that the documents' sets have in it: 2 ** bits counts, whatever the corpus.

    A task sends its counts as compressed stretches, which are summed as they stream in, so no group is ever held."""
    shift, stretch = U64(64 - bits), 1 << min(16, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part.column("text"), shingle)
                np.add.at(total, (np.concatenate(sets) >> shift).astype(np.int64), 1)
        yield from packed({i: total[i * stretch : (i + 1) * stretch] for i in range(len(total) // stretch)})

    def packed(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, counts in totals.items():
            if counts.any():
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], ["stretch", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column("stretch").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.frombuffer(zlib.decompress(counts), np.int64)
                totals[i] = totals[i] + counts if i in totals else counts
        yield from packed(totals)

    schema = "stretch int, counts binary"
    sent = docs.select("text").mapInArrow(count, schema).repartition(max(1, (1 << bits) // stretch), "stretch").mapInArrow(add, schema)
    out = np.zeros(1 << bits, np.int64)
    for row in sent.collect():
        out[row.stretch * stretch : (row.stretch + 1) * stretch] += np.frombuffer(zlib.decompress(bytes(row.counts)), np.int64)
    return np.minimum(out, np.iinfo(np.uint32).max).astype(np.uint32)


def described(docs: DataFrame, frequencies: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """(doc_id, row, n, set0 and set1: 128 bits of the set, prefix: rare-first, parts: set sizes by part of the hash range, sketch0 and sketch1: parities of 128 hash cells) of every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)
    shift = U64(64 - (len(frequencies).bit_length() - 1))
    part_shift = U64(64 - (PARTS.bit_length() - 1))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, whole, prefix, parts, sketch = [], [], [], [], []
        for s in shingle_sets(batch.column("text"), shingle):
            n.append(len(s))
            # The set's own hash: two sums of remixed members, remixed with its size.
            sums = np.array([mix(s ^ U64(seed)).sum(dtype=U64) + U64(len(s)) for seed in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)], U64)
            whole.append(mix(sums).view(np.int64).tolist() if len(s) else (None, None))
            order = np.argsort(shared.value[(s >> shift).astype(np.int64)], kind="stable")[: prefix_length(len(s), percent)]
            prefix.append(s[order].view(np.int64))
            parts.append(np.bincount((s >> part_shift).astype(np.int64), minlength=PARTS).astype(np.int32))
            odd = np.bincount((s & U64(127)).astype(np.int64), minlength=128) & 1
            sketch.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
        columns = [batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), *[pa.array([x[i] for x in whole], pa.int64()) for i in (0, 1)], pa.array(prefix, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32())), *[pa.array([x[i] for x in sketch], pa.int64()) for i in (0, 1)]]
        return pa.record_batch(columns, ["doc_id", "row", "n", "set0", "set1", "prefix", "parts", "sketch0", "sketch1"])

    return arrow_map(docs.select("doc_id", "row", "text"), work, "doc_id long, row binary, n long, set0 long, set1 long, prefix array<long>, parts array<int>, sketch0 long, sketch1 long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the linked nodes: the least node reachable, by label propagation with pointer jumping."""
    edges = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "join-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "join-labels")
    n_edges, n_nodes = edges.count(), labels.count()
    while True:
        # A node of many links hears them all: its labels are put together before the shuffle.
        heard = salted_join(edges.select(F.col("b").alias("node"), "a"), labels, "node", n_edges).select(F.col("a").alias("node"), "component")
        near = labels.union(heard).groupBy("node").agg(F.min("component").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = salted_join(near, jump, "component", n_nodes, labels).select("node", F.least("component", "further").alias("component"))
        after = materialize(after, "join-labels")
        settled = after.join(labels.withColumnRenamed("component", "before"), "node").where("component <> before").isEmpty()
        release(labels)
        labels = after
        if settled:
            release(edges)
            return labels


def compare(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are as similar as asked; the sets are made again from their texts. A node of many
    pairs (the leader of a large group) is dealt over copies of its set."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    rows = materialize(nodes.select("node", F.col("row").alias("of")).join(wanted, "node", "left_semi"), "join-wanted")
    texts = docs.join(small(rows, rows.count(), 100_000), docs["row"] == rows["of"]).select("node", "text")

    def members(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("node"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), shingle)], pa.binary())], ["node", "members"])

    sets = materialize(arrow_map(texts, members, "node long, members binary").dropDuplicates(["node"]), "join-sets")
    total = pairs.count()
    both = salted_join(pairs, sets.select(F.col("node").alias("a"), F.col("members").alias("left")), "a", total)
    both = salted_join(both, sets.select(F.col("node").alias("b"), F.col("members").alias("right")), "b", total, pairs)

    def similar(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for left, right in zip(batch.column("left"), batch.column("right")):
            x, y = np.frombuffer(left.as_buffer(), U64), np.frombuffer(right.as_buffer(), U64)
            together = np.concatenate((x, y))
            together.sort(kind="stable")
            shared = int((together[1:] == together[:-1]).sum())
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        mask = pa.array(keep, pa.bool_())
        return pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(similar, batches)

    links = materialize(both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long"), "join-links")
    release(rows, sets)
    return links


def join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, pairs_a_row: float = PAIRS_A_ROW, rounds: int = ROUNDS, leaders: int = LEADERS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`."""
    return keyed(docs, shingle, percent, pairs_a_row, rounds, leaders).select("doc_id", "n_shingles", "component_id")


def keyed(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, pairs_a_row: float = PAIRS_A_ROW, rounds: int = ROUNDS, leaders: int = LEADERS) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, keeper) of every row of `docs`: row is its doc_key, keeper that of the row of its
    component with the least id (of those the least key), null where the component has no id or the text no word."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", doc_key().alias("row"))
    seen = materialize(described(docs, bucket_frequencies(docs, shingle), shingle, percent), "join-described")
    rows_of = materialize(seen.select("doc_id", "row", "n", "set0", "set1"), "join-rows")
    nodes = seen.where("set0 IS NOT NULL").groupBy("set0", "set1").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("doc"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parts").alias("parts"), F.first("sketch0").alias("sketch0"), F.first("sketch1").alias("sketch1"))
    # Numbers of their own, which hold once they are written; no two sets share one.
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "join-nodes")
    release(seen)
    # Similar sets are of one size class or of neighbouring ones.
    grade = F.floor(F.ln(F.col("n").cast("double")) / F.lit(math.log(100 / percent))).cast("int")
    postings = nodes.select("node", "n", "sketch0", "sketch1", grade.alias("grade"), "prefix", F.posexplode("prefix").alias("pos", "gram"))
    before = [F.get("prefix", F.col("pos") - i).alias(f"before{i}") for i in range(1, BEFORE + 1)]
    postings = postings.select("node", "n", "sketch0", "sketch1", "grade", "pos", "gram", *before)
    total = nodes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    lists = postings.groupBy("gram").agg(F.count("*").alias("size")).where("size > 1").select("gram")
    # Kept by node, so that labels meet a row a node and not one a posting.
    own = F.collect_list(F.struct("gram", "pos", *[f"before{i}" for i in range(1, BEFORE + 1)])).alias("own")
    postings = materialize(postings.join(lists, "gram").groupBy("node", "n", "sketch0", "sketch1", "grade").agg(own), "join-postings")
    past: list[DataFrame] = [postings]

    def passes(x: str, y: str) -> Column:
        n, m, pos, at = (F.col(f"{c}.{v}" if c else v) for v in ("n", "pos") for c in (x, y))
        length = (100 * n >= percent * m) & (100 * m >= percent * n)
        needed = overlap_needed(n, m, percent)
        # Cells of different parity hold a shingle that only one of the sets has.
        apart = [F.bit_count(F.col(f"{x}.{s}" if x else s).bitwiseXOR(F.col(f"{y}.{s}"))) for s in ("sketch0", "sketch1")]
        return length & (1 + F.least(n - pos - 1, m - at - 1) >= needed) & (apart[0] + apart[1] <= n + m - 2 * needed)

    labels, links, tested = None, None, None
    for turn in range(rounds + 1):
        if labels is None:
            at = postings.withColumn("component", F.col("node"))
        else:
            at = postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        at = at.select("node", "n", "sketch0", "sketch1", "grade", "component", F.inline("own"))
        # Lists inside one component are done.
        apart = at.groupBy("gram").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high").select("gram")
        at = materialize(at.join(apart, "gram", "left_semi"), "join-open")
        # Pairs of a list across components, by size class: of one class, and at most twice as many of two neighbouring ones.
        counted = at.groupBy("gram", "grade", "component").agg(F.count("*").alias("k")).groupBy("gram", "grade").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
        rows, across = counted.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum((F.col("k") * F.col("k") - F.col("kk")) * 1.5), F.lit(0.0))).first()
        if not rows:
            release(at)
            break
        every = across <= pairs_a_row * total or turn == rounds
        if every:
            # A pair meets in the larger one's class, so each row stands in its own class and the next.
            x = at.withColumn("grade", F.explode(F.array("grade", F.col("grade") + 1))).alias("x")
            y = at.alias("y")
            larger = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
            on = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.grade") == F.col("y.grade")) & larger & (F.col("x.component") != F.col("y.component"))
            # A pair that shares a gram just before this one meets there, under the same conditions, so not again here.
            sooner = F.lit(False)
            for i in range(1, BEFORE + 1):
                for j in range(1, BEFORE + 1):
                    sooner = sooner | F.coalesce(F.col(f"x.before{i}") == F.col(f"y.before{j}"), F.lit(False))
            met = x.join(y, on & ~sooner & passes("x", "y")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        else:
            member = F.min(F.struct(F.xxhash64("node", F.pmod("gram", F.lit(leaders)), F.lit(turn)).alias("by"), "node", "n", "pos", "component", "sketch0", "sketch1"))
            met = at.join(at.groupBy("gram", "grade").agg(member.alias("m")), ["gram", "grade"]).where((F.col("component") != F.col("m.component")) & passes("", "m"))
            met = met.select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b"))
        met = met.distinct()
        if tested is not None:
            met = met.join(tested, ["a", "b"], "left_anti")
        # The suffix filter: in no part of the hash range can two sets share more than the smaller has there.
        size = nodes.select("node", "n", "parts")
        met = met.join(size.toDF("a", "na", "pa"), "a").join(size.toDF("b", "nb", "pb"), "b")
        bound = F.aggregate(F.zip_with("pa", "pb", lambda u, v: F.least(u, v)), F.lit(0), lambda s, v: s + v)
        pairs = materialize(met.where(bound >= overlap_needed(F.col("na"), F.col("nb"), percent)).select("a", "b"), "join-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        release(at)
        new = compare(pairs, nodes, docs, shingle, percent)
        past += [pairs, new]
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            release(labels)
            labels = components(links)
        if every:
            break
    named = nodes.select("node", "set0", "set1", "doc")
    named = named.withColumn("component", F.col("node")) if labels is None else named.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named, "join-named")
    least = named.groupBy("component").agg(F.min("doc").alias("least"))
    n_named = named.count()
    names = salted_join(named.drop("doc"), least, "component", n_named).select("set0", "set1", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("keeper"))
    # Many rows may hold one set: those are known by a broadcast list, as they are few.
    names = materialize(names, "join-names")
    release(*past, labels, nodes, named)
    total = rows_of.count()
    out = salted_join(rows_of.where("set0 IS NOT NULL").withColumn("whole", F.struct("set0", "set1")).drop("set0", "set1"), names.withColumn("whole", F.struct("set0", "set1")).drop("set0", "set1"), "whole", total)
    bare = rows_of.where("set0 IS NULL").select("doc_id", "row", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("keeper"))
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), "component_id", "keeper").unionByName(bare)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir), OP8_SHINGLE, OP8_PERCENT)
