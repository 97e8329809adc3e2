"""Skill patterns as a table: which of very many regular expressions match a text, where, and under which names.

Of each pattern plain strings are known one of which every match holds. An automaton over all of these finds, in one reading of a text, the
patterns that may match; those alone are tried, at the places found where the string opens the pattern. Up to `BROADCAST_PATTERNS` (and
`BROADCAST_CHARS`) go to every task. Of more, each part of the texts gets those that words or runs of characters of its texts call for.

A table of patterns is (pid, name, pattern, ord): `pid` is unique and `ord` orders matches at one place. Matching is that of Python's `re`
on the text in small letters, without regard to case; a pattern that it can't read matches nothing."""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagemill.functions import text as X
from triagemill.scratch import cut

#: Patterns, plain keywords, and characters of them, that go to every task as one automaton; beyond that, patterns that are tried at once.
BROADCAST_PATTERNS, BROADCAST_KEYWORDS, BROADCAST_CHARS = 200_000, 500_000, 8 << 20
#: Texts and characters of a part that is matched in one task, and bytes of text that are matched before their matches are handed on.
PART_TEXTS, PART_CHARS, SLICE_CHARS = 20_000, 8 << 20, 2 << 20
#: Characters of a run that tells which parts may hold a string, and binary digits of a place in the table of all runs.
GRAM, BITS = 6, 26
#: Letters that `re` takes for ASCII ones without regard to case, besides their own small and capital forms.
_SAME = (("ſ", "s"), ("ı", "i"))
_QUANTIFIED = re.compile(r"[*?]|\{0*,|\{0")


def _alternatives(pattern: str) -> list[list[str]] | None:
    """The top-level alternatives of a pattern as steps: `=x` a character that a match holds, `^` one that takes none, `.` anything else.
    None if the pattern is not understood."""
    out, steps, i = [], [], 0
    while i < len(pattern):
        c, step, end = pattern[i], ".", i + 1
        if c == "|":
            out.append(steps)
            steps, i = [], i + 1
            continue
        if c == "\\":
            if end >= len(pattern):
                return None
            step, end = ("^" if pattern[end] in "bBAZ" else "." if pattern[end].isalnum() else "=" + pattern[end]), i + 2
        elif c in "^$":
            step = "^"
        elif c == "[":
            found = re.compile(r"\[\^?\]?(?:[^\]\\]|\\.)*\]", re.S).match(pattern, i)
            if not found:
                return None
            end = found.end()
        elif c == "(":
            depth, end = 1, i + 1
            if pattern.startswith("(?", i) and not pattern.startswith(("(?:", "(?=", "(?!", "(?<", "(?P<"), i):
                return None
            while end < len(pattern) and depth:
                if pattern[end] == "\\":
                    end += 1
                elif pattern[end] == "[":
                    found = re.compile(r"\[\^?\]?(?:[^\]\\]|\\.)*\]", re.S).match(pattern, end)
                    if not found:
                        return None
                    end = found.end() - 1
                depth += {"(": 1, ")": -1}.get(pattern[end : end + 1], 0)
                end += 1
            if depth:
                return None
        elif c not in ".*+?{}":
            step = "=" + c
        if c in "*+?":
            return None
        many = re.compile(r"(?:[*+?]|\{\d*,?\d*\})[?+]?").match(pattern, end)
        if many and many.group() != "{}":
            # A part that may be left out tells nothing; one that comes once or more is held once.
            optional = _QUANTIFIED.match(many.group())
            steps += ["."] if optional or step[0] != "=" else [step, "."]
            i = many.end()
            continue
        steps.append(step)
        i = end
    return [*out, steps]


#: A word or words between word boundaries, which is seen without the pattern.
_BARE = re.compile(r"(?:\\b|\(\?<!\\w\))([A-Za-z0-9_](?:[A-Za-z0-9_ ]*[A-Za-z0-9_])?)(?:\\b|\(\?!\\w\))")


def required(pattern: str) -> tuple[list[str], bool] | None:
    """Small-letter ASCII strings one of which every match holds, and whether each match begins with the one it holds; None if there are
    none."""
    if bare := _BARE.fullmatch(pattern):
        return [bare[1].lower()], True
    parts = _alternatives(pattern)
    if parts is None:
        return None
    found, opening = [], True
    for steps in parts:
        runs, run, first = [], "", None
        for n, step in enumerate([*steps, "."]):
            if step[0] == "=" and step[1:].isascii():
                first = n if not run else first
                run += step[1:].lower()
            elif step != "^":
                if run:
                    runs.append((len(run), -first, run))
                run = ""
        if not runs:
            return None
        _, at, longest = max(runs)
        found.append(longest)
        opening &= all(s == "^" for s in steps[:-at])
    return found, opening


_TOKEN = re.compile(r"\w+")


def _same(low: str) -> str:
    for a, b in _SAME:
        low = low.replace(a, b)
    return low


def _in_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def _compiled(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern, re.I)
    except (re.error, RecursionError, OverflowError):
        return None


class Matcher:
    """A list of patterns: single words by the tokens of a text, others by an automaton; it is built where it is used."""

    def __init__(self, patterns: list[str]):
        self.patterns, self.free, self.words, of = patterns, [], {}, {}
        self.opening, self.bare = [False] * len(patterns), [0] * len(patterns)
        self.compiled = lru_cache(maxsize=20_000)(lambda i: _compiled(patterns[i]))
        for i, p in enumerate(patterns):
            known = required(p)
            if known is None:
                if _compiled(p):
                    self.free.append(i)
                continue
            bare = _BARE.fullmatch(p)
            if bare and _TOKEN.fullmatch(known[0][0]):
                self.words.setdefault(known[0][0], []).append(i)
                continue
            self.opening[i] = known[1]
            self.bare[i] = len(known[0][0]) if bare else 0
            for s in set(known[0]):
                of.setdefault(s, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for s, owners in of.items():
            self.automaton.add_word(s, (len(s), owners))
        if of:
            self.automaton.make_automaton()
        self.has_strings = bool(of)

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(place, number) of the first match of each pattern that matches, by place, then by number."""
        low = (text or "").lower()
        if not low:
            return []
        plain, out = _same(low), []
        if self.words:
            # From the last to the first, so that the first place of a word stays.
            first = {m[0]: m for m in reversed([*_TOKEN.finditer(plain)])}
            out = [(first[w].start(), i) for w in first.keys() & self.words.keys() for i in self.words[w]]
        places: dict[int, list[int]] = {}
        if self.has_strings:
            for end, (n, owners) in self.automaton.iter(plain):
                for i in owners:
                    places.setdefault(i, []).append(end - n + 1)
        for i, starts in [*places.items(), *((i, []) for i in self.free)]:
            if n := self.bare[i]:
                at = next((at for at in starts if not _in_word(low, at - 1) and not _in_word(low, at + n)), None)
                if at is not None:
                    out.append((at, i))
                continue
            pattern = self.compiled(i)
            if pattern is None:
                continue
            if self.opening[i]:
                hit = next((m for m in (pattern.match(low, at) for at in sorted(starts)) if m), None)
            else:
                hit = pattern.search(low)
            if hit:
                out.append((hit.start(), i))
        return sorted(out)


class Keywords:
    """A list of plain strings, found by one automaton without any pattern."""

    def __init__(self, keywords: list[str]):
        of: dict[str, list[int]] = {}
        for i, k in enumerate(keywords):
            of.setdefault(k.lower(), []).append(i)
        self.strings, self.owners = list(of), list(of.values())
        self.automaton = ahocorasick.Automaton()
        for n, s in enumerate(self.strings):
            self.automaton.add_word(s, n)
        if of:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(place, number) of each keyword that the text holds, by place, then by number."""
        low = (text or "").lower()
        if not low or not self.strings:
            return []
        last: dict[int, int] = {}
        for end, n in self.automaton.iter(low):
            if n not in last:
                last[n] = end
        return sorted((end + 1 - len(self.strings[n]), i) for n, end in last.items() for i in self.owners[n])


_matchers: dict[str, Matcher | Keywords] = {}


def _shared(number: str, kind: type, patterns: list[str]) -> Matcher | Keywords:
    """One automaton a worker and broadcast."""
    if number not in _matchers:
        _matchers.clear()
        _matchers[number] = kind(patterns)
    return _matchers[number]


_FOUND = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("first", T.BooleanType())]))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of pieces of a batch, of some `SLICE_CHARS` bytes of text each: a batch has a number of rows, whatever they hold."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_CHARS)) + 1
    starts = [0, *cuts.tolist()]
    for a, b in zip(starts, [*starts[1:], len(sizes)]):
        yield a, b - a


class _Names:
    """What patterns are called, and lists of matches as Arrow arrays."""

    def __init__(self, names: list[str]):
        number: dict[str, int] = {"": 0}
        self.names = pa.array(names, pa.string())
        self.keys = [number.setdefault(" ".join(n.lower().split()), len(number)) for n in names]
        self.distinct = len(number) == len(names) + 1

    def told(self, counts: np.ndarray, at: np.ndarray, which: np.ndarray) -> pa.Array:
        """Matches of texts, of which there are so many each, in the order in which they are told."""
        first = np.ones(len(which), bool)
        if not self.distinct:
            end = 0
            for n in counts.tolist():
                seen, start, end = {0}, end, end + n
                for j in range(start, end):
                    k = self.keys[which[j]]
                    first[j] = k not in seen
                    seen.add(k)
        told = pa.StructArray.from_arrays([pa.array(at, pa.int32()), self.names.take(pa.array(which, pa.int64())), pa.array(first)], ["at", "name", "first"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), told)


def _hits(matcher: Matcher | Keywords, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches a text, and the place and number of each."""
    counts, at, which = [], array("i"), array("q")
    for t in texts:
        hits = matcher.find(t.as_py())
        counts.append(len(hits))
        at.extend([h[0] for h in hits])
        which.extend([h[1] for h in hits])
    return np.array(counts, np.int64), np.frombuffer(at, np.int32) if at else np.empty(0, np.int32), np.frombuffer(which, np.int64) if which else np.empty(0, np.int64)


def _by_broadcast(rows: DataFrame, text: Column, patterns: DataFrame, kind: type) -> DataFrame:
    spark = rows.sparkSession
    # As many as the caller has checked.
    listed = [(r.name, r.pattern) for r in patterns.orderBy("ord", "pid").select("name", "pattern").collect()]
    shared = spark.sparkContext.broadcast(listed)
    number = uuid.uuid4().hex
    inside = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, names = None, None
        for batch in batches:
            matcher, names = matcher or _shared(number, kind, [p for _, p in shared.value]), names or _Names([n for n, _ in shared.value])
            for start, n in _slices(batch.column("text")):
                part = batch.slice(start, n)
                yield pa.RecordBatch.from_arrays([part.column("row"), names.told(*_hits(matcher, part.column("text")))], ["row", "found"])

    done = inside.mapInArrow(run, T.StructType([inside.schema["row"], T.StructField("found", _FOUND)]))
    return done.select("row.*", F.col("found").alias("_found"))


def _gram(s: str) -> int:
    return int(_grams(s, len(s))[0])


def _grams(text: str, n: int) -> np.ndarray:
    """A number of 63 bits for each run of n characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.full(max(0, len(codes) - n + 1), n, np.uint64)
    for i in range(n):
        out = (out ^ codes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(1)).astype(np.int64)


def _word(w: str) -> int:
    return zlib.crc32(w.encode("utf-8", "surrogatepass")) | 1 << 62


def _marks(pattern: str, kind: type) -> list[tuple[int, int]] | None:
    """(length, number) of words (of length 0) or runs of characters one of which a text that matches holds; None if nothing is known."""
    strings = [pattern.lower()] if kind is Keywords else (required(pattern) or [None])[0]
    if strings is None:
        return None
    if kind is Matcher and _BARE.fullmatch(pattern):
        return [(0, _word(max(_TOKEN.findall(strings[0]), key=len)))]
    return [(len(s[:GRAM]), _gram(s[:GRAM])) for s in strings]


def _by_parts(rows: DataFrame, key: str, text: Column, patterns: DataFrame, kind: type, most: int, part_texts: int, part_chars: int) -> DataFrame:
    """Texts are dealt into parts, and each part gets the patterns that its texts' words and runs of characters call for, all parts those
    of which nothing is known: no text is copied, and a pattern goes to the parts that may hold it."""
    spark = rows.sparkSession
    patterns = cut(patterns.select("pid", "name", "pattern", "ord"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    parts = max(1, -(-n // part_texts), -(-chars // part_chars))
    inside = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), text.alias("text"), F.pmod(F.xxhash64(F.col(key), text), F.lit(parts)).cast("int").alias("part"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, p in enumerate(batch.column("pattern").to_pylist()):
                marks = _marks(p, kind)
                # A pattern that can't be read matches nothing.
                found += [(i, -1, None)] * bool(_compiled(p)) if marks is None else [(i, *m) for m in dict.fromkeys(marks)]
            whole = batch.take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64())], [*batch.schema.names, "length", "mark"])

    kinds = T.StructType([*patterns.schema.fields, T.StructField("length", T.IntegerType()), T.StructField("mark", T.LongType())])
    marks = cut(patterns.mapInArrow(marked, kinds))
    lengths = sorted(r.length for r in marks.select("length").distinct().collect())
    # One bit a mark, of a fixed number of bits: runs of characters that no pattern begins with go no further.
    bit = F.col("mark").bitwiseAND((1 << BITS) - 1) + 1
    bits = np.zeros(1 << BITS - 3, np.uint8)
    for r in marks.where("mark IS NOT NULL").select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("v")).collect():
        bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.v, np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def wanted(found: np.ndarray) -> np.ndarray:
        at = found & (1 << BITS) - 1
        return found[(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]

    def held(texts: pa.Table) -> pa.Table:
        words, grams = set(), [np.empty(0, np.int64)]
        for batch in texts.select(["text"]).to_batches():
            for start, n in _slices(batch.column("text")):
                low = [(t or "").lower() for t in batch.column("text").slice(start, n).to_pylist()]
                low = low if kind is Keywords else [*map(_same, low)]
                if 0 in lengths:
                    words.update(w for t in low for w in _TOKEN.findall(t))
                for size in lengths:
                    # Runs across two texts do no harm.
                    if size > 0:
                        grams.append(np.unique(wanted(_grams("\0".join(low), size))))
        marks = np.unique(np.concatenate([*grams, wanted(np.fromiter(map(_word, words), np.int64, len(words)))]))
        return pa.table([pa.array(np.full(len(marks), texts["part"][0].as_py(), np.int32)), pa.array(marks)], ["part", "mark"])

    of = inside.groupBy("part").applyInArrow(held, "part int, mark long")
    called = marks.where("mark IS NOT NULL").join(of, "mark").select("part", *patterns.columns)
    free = marks.where("mark IS NULL").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), *patterns.columns) if -1 in lengths else None
    dealt = called if free is None else called.unionByName(free)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = right.drop_columns(["part", "name", "pattern"]).select(["ord", "pid"])
        while any(pa.types.is_struct(f.type) for f in order.schema):
            order = order.flatten()
        order = order.rename_columns([str(i) for i in range(order.num_columns)])
        right = right.take(pc.sort_indices(order, sort_keys=[(c, "ascending") for c in order.column_names], null_placement="at_start"))
        # One of each, where several marks of a pattern are held.
        pids = right["pid"].to_numpy()
        right = right.take(pa.array(np.flatnonzero(np.concatenate(([True], pids[1:] != pids[:-1])) if len(pids) else []), pa.int64()))
        patterns, names = right["pattern"], _Names(right["name"].to_pylist())
        texts, found = left["text"].combine_chunks(), []
        for start in range(0, len(patterns), most):
            counts, at, which = _hits(kind(patterns.slice(start, most).to_pylist()), texts)
            found.append((np.repeat(np.arange(len(texts)), counts), at, which + start))
        if len(found) == 1:
            at, which = found[0][1:]
        else:
            of, at, which = (np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in range(3))
            best = np.lexsort((which, at, of))
            at, which, counts = at[best], which[best], np.bincount(of, minlength=len(texts))
        return pa.table([left["row"].combine_chunks(), names.told(counts, at, which)], ["row", "found"])

    done = inside.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(run, T.StructType([inside.schema["row"], T.StructField("found", _FOUND)]))
    return done.select("row.*", F.col("found").alias("_found"))


def find_patterns(rows: DataFrame, key: str, text: Column, patterns: DataFrame, most: int | None = None, part_texts: int = PART_TEXTS, kind: type = Matcher) -> DataFrame:
    """`rows` and `_found`: (at, name, first) of each pattern that matches the text, by the place of its first match (from 0), then by `ord`;
    `first` marks the first of a skill key. `key` tells rows apart. `kind`: Matcher, or Keywords where patterns are plain strings."""
    n, chars = patterns.agg(F.count("*"), F.coalesce(F.sum(F.length("pattern") + F.length("name")), F.lit(0))).first()
    limit = (BROADCAST_KEYWORDS if kind is Keywords else BROADCAST_PATTERNS) if most is None else most
    if n <= limit and chars <= BROADCAST_CHARS:
        return _by_broadcast(rows, text, patterns, kind)
    return _by_parts(rows, key, text, patterns, kind, limit, part_texts, PART_CHARS)


def names_found(found: Column, limit: int | None = None) -> Column:
    """The names of `_found` that are the first of their skill keys."""
    once = F.transform(F.filter(found, lambda x: x["first"]), lambda x: F.trim(x["name"]))
    return F.slice(once, 1, limit) if limit else once


def firsts(found: Column) -> Column:
    """(at, name, first) of sorted matches; `first`: no match before has its skill key."""
    def marked(keys: Column) -> Column:
        return F.transform(found, lambda x, i: F.struct(x["at"].alias("at"), x["name"].alias("name"), ((F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1)).alias("first")))

    return X.let(F.transform(found, lambda x: X.skill_key(x["name"])), marked)


def with_skills(rows: DataFrame, key: str, text: Column, patterns: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """`rows` and, as `name`, the skills whose patterns match the text."""
    found = find_patterns(rows, key, text, patterns)
    return found.withColumn(name, names_found(F.col("_found"), limit)).drop("_found")


def find_keywords(rows: DataFrame, key: str, text: Column, keywords: DataFrame, most: int | None = None) -> DataFrame:
    """`rows` and `_found`: (at, name, first) of each keyword (keyword, ord) that the text holds, in small letters, by the place where it stands
    first. Any number of keywords: beyond one automaton each part of the texts gets those that it may hold."""
    plain = keywords.where("keyword <> ''").select(F.xxhash64("keyword").alias("pid"), F.col("keyword").alias("name"), F.col("keyword").alias("pattern"), "ord")
    return find_patterns(rows, key, text, plain, most, kind=Keywords)
