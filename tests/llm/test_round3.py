"""Merkle manifest, conversation tries and suffix-array deduplication: awkward rows against brute force, and the queries against DuckDB."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagemill.llm import conversation_trie, merkle, suffix_array, suffix_dedup

DOCS = "doc_id long, source string, lang string, n_chars long, text string, idx int, digest string, _leaf string"


def bag(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest_rows():
    rng = random.Random(3)
    out = [(i, ["s1", "s2", None, "é", "s1"][i % 5], [None, "en"][i % 2], rng.choice([None, 3, -4]), rng.choice([None, "", "a\nb", "é\n\n", "x" * 50_000, f"t{i}"]), i, "clash", "clash") for i in range(120)]
    out += [(900, "alone", "en", 1, "one"), (None, "s1", None, None, None), (None, "s1", "en", 2, "a\nb"), (5, "s1", "en", 5, "same id"), (5, "s1", "en", 5, "same id")]
    return [(*r, 0, "clash", "clash")[:8] if len(r) == 5 else r for r in out]


def brute_manifest(rows):
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(frame, (r[0], r[1], r[2], r[3], text))))
    cut = lambda r: r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]

    def tree(leaves):
        """The root; and of each leaf the left and right siblings of every level."""
        level, steps, where = leaves, [[] for _ in leaves], list(range(len(leaves)))
        while len(level) > 1:
            for i, at in enumerate(where):
                start = at // 3 * 3
                steps[i].append(("".join(level[start:at]), "".join(level[at + 1 : start + 3])))
            where = [at // 3 for at in where]
            level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        return level[0], steps

    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, cut(r)), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:4])]) for s in order}
    root, upper = tree([trees[s][0] for s in order])
    out = collections.Counter()
    for s, up in zip(order, upper):
        for x, steps in zip(sorted(by_source[s], key=lambda x: x[:4]), trees[s][1]):
            h = x[3]
            for left, right in steps + up:
                h = sha(left + h + right)
            out[(x[4][0], x[2], trees[s][0], root, sha("".join(a + b for a, b in steps + up)), h, h == root)] += 1
    return out


def result_of(docs):
    docs.sparkSession.conf.set("spark.sql.shuffle.partitions", "4")
    done = merkle.manifest(docs, {"text": merkle.without_breaks()})
    proof = F.aggregate("_proof", F.lit(""), lambda t, s: F.concat(t, merkle.text_of(s["left"]), merkle.text_of(s["right"])))
    folded = merkle.text_of(merkle.fold(F.col("_seen"), F.col("_proof")))
    root = merkle.text_of(F.col("_root"))
    return done.select("doc_id", merkle.text_of(F.col("_leaf")), merkle.text_of(F.col("_subroot")), root, F.sha2(proof, 256), folded, folded == root)


def test_merkle(spark):
    rows = manifest_rows()
    docs = spark.createDataFrame(rows, DOCS)
    assert bag(result_of(docs)) == brute_manifest(rows)
    # What the caller holds beside the fields comes back, under its own names.
    assert bag(merkle.manifest(docs).select("doc_id", "idx", "digest")) == collections.Counter((r[0], r[5], "clash") for r in rows)


def test_merkle_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(7, "s", "en", 1, "a\nb")], "doc_id long, source string, lang string, n_chars long, text string")
    assert bag(result_of(one)) == brute_manifest([(7, "s", "en", 1, "a\nb")])
    assert result_of(one.limit(0)).count() == 0


def conversation_rows():
    rng = random.Random(5)
    out = []
    for c in range(90):
        n = rng.choice([1, 2, 3, 5, 9, 14])
        for t in range(n):
            out.append((c + (c > 60) * 7, rng.choice([t, t, None]) if c % 11 == 0 else t, rng.choice(["user", None, ""]) if c % 7 == 0 else "user", rng.choice(["a", "b", "é" * 3]) if t else rng.choice(["hello", "hi"]), "more"))
    out += [(c, 0, "user", "hot", "more") for c in range(200, 260)]
    out += [(c, t, "user", f"hot {t % 3}", "more") for c in range(300, 330) for t in range(12)]
    out += [(400, t, "user", f"long {t % 5}", "more") for t in range(60)] + [(-3, 0, "a", "b", "more"), (-7, 0, None, None, "more"), (None, 0, "user", "no id", "more"), (7, None, None, None, "x"), (7, None, None, None, "x")]
    return out


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    full = {}
    for c, own in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        full[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = collections.Counter()
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(y[: len(x)] == x and len(y) > len(x) for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ended = ",".join(str(c) for c in sorted(cs) if full[c] == node)
        out[(min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), leaves, saved, sha(ended))] += 1
    return out


@pytest.mark.parametrize("group_rows, task_rows, block", [(50_000, 100_000, 1024), (3, 7, 4), (20, 1, 1024)])
def test_conversation_trie(spark, group_rows, task_rows, block, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", block)
    monkeypatch.setattr(conversation_trie, "ID_CHUNK", 4)
    rows = conversation_rows()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string").repartition(3)
    sequences, lengths = conversation_trie.rebuilt(conversation_trie.turns_of(frame))
    assert bag(conversation_trie.trie(sequences, lengths, group_rows, task_rows)) == brute_trie(rows)


def test_conversation_trie_of_no_rows(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    sequences, lengths = conversation_trie.rebuilt(conversation_trie.turns_of(frame))
    assert conversation_trie.trie(sequences, lengths).count() == 0


def suffix_rows():
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghij é") for _ in range(900))
    texts = [None, "", "x" * 99, "x" * 100, "x" * 101, "x" * 700, "ab" * 400, "é" * 300, base, base, base[:300] + "Z" + base[300:], "q" + base[100:420] + "rs", "z" * 60 + base[50:149] + "y"]
    line = "one line that very many of all the documents share among words of their own, and more"
    texts += ["".join(rng.choice("klmnop ") for _ in range(70)) + line + "".join(rng.choice("klmnop ") for _ in range(70)) for _ in range(40)]
    texts += ["".join(rng.choice("klmnop ") for _ in range(70)) + line * 2 + "tail" for _ in range(10)]
    for _ in range(40):
        at = rng.randrange(700)
        texts.append("".join(rng.choice("stuvw ") for _ in range(rng.randrange(200))) + base[at : at + rng.randrange(80, 200)] + rng.choice(texts[1:8])[:300] if rng.random() < 0.7 else base[at:] + base[:at])
    rng.shuffle(texts)
    rows = [(i, t, "clash", 1, "clash") for i, t in enumerate(texts)]
    return rows + [(3, base[5:500], "clash", 1, "same id"), (3, base[5:500], "clash", 2, "same row")] + [(None, t, "clash", 1, "no id") for t in (base, base, line * 4, None)]


def brute_suffix(rows, xxhash):
    order = {}
    for i, r in enumerate(rows):
        order.setdefault(xxhash[i], (r[1] or "").encode())
    first, gone = {}, {}
    for k in sorted(order):
        t = order[k]
        cut = bytearray(len(t))
        for i in range(len(t) - 99):
            if first.setdefault(t[i : i + 100], (k, i)) != (k, i):
                cut[i : i + 100] = b"\1" * 100
        gone[k] = cut
    out = collections.Counter()
    for i, r in enumerate(rows):
        t, cut = (r[1] or "").encode(), gone[xxhash[i]]
        runs = sum(1 for j, c in enumerate(cut) if c and (j == 0 or not cut[j - 1]))
        out[(r[0], len(t), sum(cut), runs, bytes(b for b, c in zip(t, cut) if not c).hex().upper())] += 1
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 4000, "anchor_bytes": 400}, {"shard_bytes": 1, "anchor_bytes": 0, "anchors": (20, 99, 100)}])
@pytest.mark.parametrize("block", [1 << 19, 150])
def test_suffix_dedup(spark, sizes, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rows = suffix_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, start int, _held string").repartition(3)
    keys = suffix_dedup.keyed(docs).select(f"{suffix_dedup.HELD}.doc_id", f"{suffix_dedup.HELD}.text", "none", "id", "tie").collect()
    of = {(r[0], r[1]): tuple(r[2:]) for r in keys}
    expected = brute_suffix(rows, [of[(r[0], r[1])] for r in rows])
    done = suffix_dedup.drop_repeats(docs, **sizes)
    assert bag(done.select("doc_id", "_n_bytes", "_n_removed", "_n_spans", F.hex("_kept"))) == expected
    assert done.where("h = 'clash' AND size(_spans) = _n_spans").count() == len(rows)
    assert suffix_dedup.drop_repeats(docs.limit(0), **sizes).count() == 0
    # Rows with ids of their own alone, whose texts are not hashed.
    apart = [r for r in rows if r[4] == "clash"]
    few = spark.createDataFrame(apart, docs.schema).repartition(2)
    assert suffix_dedup.told_by_id(few) and not suffix_dedup.told_by_id(docs)
    assert bag(suffix_dedup.drop_repeats(few, **sizes).select("doc_id", "_n_bytes", "_n_removed", "_n_spans", F.hex("_kept"))) == brute_suffix(apart, [r[0] for r in apart])


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(300):
        symbols = [rng.randrange(1, rng.choice([3, 4, 60])) for _ in range(rng.randrange(0, 150))] * rng.choice([1, 1, 3])
        t = np.array([*symbols, 0], rng.choice([np.uint16, np.int32]))
        order = suffix_array.suffix_array(t, 61)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        before, shared = suffix_array.permuted_common_prefixes(t, order, 1)
        for r in range(1, len(t)):
            a, b, k = int(order[r]), int(order[r - 1]), 0
            while t[a + k] == t[b + k] and t[a + k] > 1:
                k += 1
            assert before[a] == b and shared[a] == k
