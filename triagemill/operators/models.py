"""Models behind one interface: a factory, called once a Python worker, gives a function from texts to texts.

Each distinct text is asked once and its answer joined back, so a text that many rows share costs one call. No model comes with
the library; a caller passes one (a summariser, a translator, a language detector)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagemill.functions import text as X

Factory = Callable[[], Callable[[list[str]], list[str]]]
CHUNK = 500


def ask(rows: DataFrame, column: str, answer: str, factory: Factory, where: Column | None = None) -> DataFrame:
    """Adds `answer` for the rows that `where` holds for; null for the others and for null texts."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield pd.Series(model(texts.tolist()), dtype=object)

    wanted = F.coalesce(F.lit(True) if where is None else where, F.lit(False)) & F.col(column).isNotNull()
    asked = rows.where(wanted).select(F.col(column).alias("_asked")).distinct().withColumn(answer, run("_asked"))
    return rows.withColumn("_key", F.when(wanted, F.col(column))).join(asked, F.col("_key") == F.col("_asked"), "left").drop("_key", "_asked")


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(X.present(c), r"[^\p{L}]", ""))


def _packed(parts: list[str], limit: int) -> list[str]:
    """Parts put together up to the limit; a longer one stands alone."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + 1 + len(part) <= limit:
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def pieces(text: str, limit: int = CHUNK) -> list[str]:
    """What a translator gets of a text: its paragraphs; of longer ones their sentences, put together up to the limit; of longer sentences
    their words. Words that fill a piece come before the sentences that were being put together, which come before the last words."""
    text, out = text.replace("\r\n", "\n").replace("\r", "\n").strip(), []
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n+", text))):
        if len(paragraph) <= limit:
            out.append(paragraph)
            continue
        waiting: list[str] = []
        for sentence in filter(None, (s.strip() for s in re.split(r"(?<=[.!?])\s+", paragraph))):
            if len(sentence) <= limit:
                waiting.append(sentence)
                *full, last = _packed(waiting, limit)
                out += full
                waiting = [last]
                continue
            *full, last = _packed(sentence.split(), limit)
            out += [*full, *waiting, last]
            waiting = []
        out += waiting
    return out


def translated(factory: Factory, limit: int = CHUNK) -> Factory:
    """A translator of whole texts out of one of short pieces."""

    def make() -> Callable[[list[str]], list[str]]:
        model = factory()

        def run(texts: list[str]) -> list[str]:
            parts = [pieces(t, limit) for t in texts]
            answers = iter(model([p for ps in parts for p in ps]))
            return ["\n\n".join(next(answers) for _ in ps).strip() for ps in parts]

        return run

    return make


def translate(rows: DataFrame, column: str, detector: Factory, translator: Factory, language: str = "da", least_letters: int = 4) -> DataFrame:
    """The rows with `column` translated where the detector names `language`; a blank answer keeps the text."""
    asked = ask(rows, column, "_language", detector, letters(F.col(column)) >= least_letters)
    asked = ask(asked, column, "_translated", translated(translator), F.col("_language") == language)
    text = F.coalesce(F.when(X.compact(F.col("_translated")) != "", F.col("_translated")), F.col(column))
    return asked.withColumn(column, text).select(*rows.columns)


def translate_titles(rows: DataFrame, title: str, translator: Factory) -> DataFrame:
    """Adds title_english: the answer if it is plausible and not the title again, else empty."""
    asked = ask(rows, title, "_answer", translator)
    answer = X.clean_title(F.col("_answer"))
    usable = X.plausible_title(answer, F.col(title)) & (X.title_key(answer) != X.title_key(F.col(title)))
    return asked.withColumn("title_english", F.when(usable, answer).otherwise("")).drop("_answer")


def describe(rows: DataFrame, raw: str, model: Factory, fallback: int = 280) -> DataFrame:
    """Adds description: the model's, or the start of the raw text where that is blank or of low quality."""
    asked = ask(rows, raw, "_answer", model)
    usable = (X.compact(F.col("_answer")) != "") & ~X.low_quality(F.col("_answer"))
    return asked.withColumn("description", F.when(usable, X.compact(F.col("_answer"))).otherwise(F.left(X.compact(F.col(raw)), F.lit(fallback)))).drop("_answer")
