"""Places in texts as rows, and which token stands nearest to a place: an as-of join in both directions, by one ordered pass each way.

Work grows with the places, not with their pairs; a text with very many places is sorted and streamed, never held as an array of pairs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagemill.functions import text as X


def places(rows: DataFrame, key: str, low: Column, pattern: Column | str, width: Column | int, *carried: Column) -> DataFrame:
    """(key, at, carried...) of each place, from 0, where a pattern of fixed width stands in a text."""
    pieces = F.split(low, pattern, -1)
    # Lengths alone are exploded, not the pieces.
    lengths = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.length)
    names = [f"_c{i}" for i in range(len(carried))]
    cut = rows.select(key, F.lit(0).alias("_w") if isinstance(width, int) else width.alias("_w"), *[c.alias(n) for c, n in zip(carried, names)], F.posexplode(lengths).alias("_i", "_n"))
    step = F.lit(width) if isinstance(width, int) else F.col("_w")
    running = Window.partitionBy(key, *names).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.select(key, *names, (F.sum(F.col("_n") + step).over(running) - step).cast("long").alias("at"))


def token_places(rows: DataFrame, key: str, low: Column, tokens: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, token, at) of the words of tokens, by the token's number."""
    found = None
    for number, words in enumerate(tokens.values()):
        for word in words:
            more = places(rows, key, low, rf"\b{re.escape(word)}\b", len(word)).withColumn("token", F.lit(number))
            found = more if found is None else found.unionByName(more)
    return found.select(key, "token", "at")


def nearest(hits: DataFrame, tokens: DataFrame, key: str, target: str, n_tokens: int, reach: int) -> DataFrame:
    """(key, target, token, away): for each target the token with a place nearest to one of the target's, all within one key; of equally near
    ones that of the lesser number. Targets with none within reach are left out. `hits`: key, target, at; `tokens`: key, token, at."""
    rows = hits.select(key, target, "at", F.lit(-1).alias("token")).unionByName(tokens.select(key, F.lit(None).cast(hits.schema[target].dataType).alias(target), "at", "token"))
    # Tokens come before hits at one place on the way forth, so that they are seen there.
    forth = Window.partitionBy(key).orderBy("at", F.desc("token")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy(key).orderBy(F.desc("at"), F.desc("token")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumns({f"_l{i}": F.max(F.when(F.col("token") == i, F.col("at"))).over(forth) for i in range(n_tokens)})
    seen = seen.withColumns({f"_r{i}": F.min(F.when(F.col("token") == i, F.col("at"))).over(back) for i in range(n_tokens)}).where("token = -1")
    away = F.array_min(F.array(*[F.struct(F.coalesce(F.least(F.col("at") - F.col(f"_l{i}"), F.col(f"_r{i}") - F.col("at")), F.lit(1 << 40)).alias("away"), F.lit(i).alias("token")) for i in range(n_tokens)]))
    best = seen.groupBy(key, target).agg(F.min(away).alias("_best")).where(F.col("_best.away") <= reach)
    return best.select(key, target, F.col("_best.token").alias("token"), F.col("_best.away").alias("away"))


def named(number: Column, tokens: dict[str, tuple[str, ...]]) -> Column:
    return F.get(F.array(*map(F.lit, tokens)), number)


def nearest_token(rows: DataFrame, key: str, text: Column, needle: Column, tokens: dict[str, tuple[str, ...]], reach: int = 6000) -> DataFrame:
    """(key, token): which token has a word nearest to a place of the row's needle; keys without one within reach are left out. `key` tells rows
    apart."""
    low, what = F.lower(X.present(text)), X.present(needle)
    quoted = F.concat(F.lit(r"\Q"), F.replace(what, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    hits = places(rows.where(what != ""), key, low, quoted, F.length(what)).withColumn("_needle", F.lit(0))
    found = nearest(hits, token_places(rows, key, low, tokens), key, "_needle", len(tokens), reach)
    return found.select(key, named(F.col("token"), tokens).alias("token"))


def link_places(pages: DataFrame, key: str, html: Column, mark: str = "/jobs/view/", before: str = "/comm", digits: int = 20) -> DataFrame:
    """(key, number, at): the places of links by number. A place counts for each number that its digits begin with, and again for the longer
    form of the link, where what stands `before` opens it."""
    low = F.lower(X.present(html))
    pieces = F.split(low, rf"\Q{mark}\E", -1)
    parts = F.transform(pieces, lambda x: F.struct(F.length(x).alias("n"), F.regexp_extract(x, rf"^\d{{1,{digits}}}", 0).alias("digits"), x.endswith(before).alias("longer")))
    cut = pages.select(key, F.posexplode(parts).alias("i", "p"))
    order = Window.partitionBy(key).orderBy("i")
    running = F.sum(F.col("p.n") + len(mark)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    at = cut.select(key, "i", F.col("p.digits").alias("digits"), (running - len(mark)).cast("long").alias("at"), F.lag("p.longer").over(order).alias("longer")).where("i > 0 AND digits <> ''")
    at = at.select(key, "digits", F.explode(F.when(F.col("longer"), F.array(F.col("at"), F.col("at") - len(before))).otherwise(F.array("at"))).alias("at"))
    return at.select(key, "at", F.explode(F.sequence(F.lit(1), F.length("digits"))).alias("n"), "digits").select(key, F.substring("digits", F.lit(1), F.col("n")).alias("number"), "at")


def work_types(pages: DataFrame, key: str, html: Column, wanted: DataFrame, tokens: dict[str, tuple[str, ...]], reach: int) -> DataFrame:
    """(key, number, work_type) of the links `wanted` (key, number) whose page has a work type's word near one of their places."""
    hits = link_places(pages, key, html).join(wanted.select(key, "number").distinct(), [key, "number"], "left_semi")
    found = nearest(hits, token_places(pages, key, F.lower(X.present(html)), tokens), key, "number", len(tokens), reach)
    return found.select(key, "number", named(F.col("token"), tokens).alias("work_type"))
