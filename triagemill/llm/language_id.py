"""Operator 3, language identification by nearest centroid.

A text's features are byte n-grams of its letters (A-Z lower-cased, everything that is no letter made one gap), hashed into
a fixed number of cells, weighted by sublinear TF and IDF and normalised. A language has several centroids, the means of
clusters found by spherical k-means in its sample, so that registers of one language need not share a mean. The nearest
centroid by cosine names the language. A text is flagged as rejected if it is further from that centroid's language than all but
a hundredth of the language's own sample is.

The classifier is fitted on a bounded sample: of each language the `SAMPLE` distinct labelled rows with the smallest digests; there
is no bound on the number of languages. Samples are featurised and clustered on the executors, a language a task; the driver
receives centroids and document frequencies alone. All rows are predicted, from their whole text; language, source and id are no
inputs.

Defined cases: a null text, or one without a letter, is `und` with score 0 (and not rejected); rows with a null language aren't
learned from; with no labelled row at all every text is `und`; of languages that tie the first by code point is named; repeated
rows are learned from once and predicted alike; a null id counts as held in (crc32 of nothing); an empty table gives an empty
result; a text of any length is read whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagemill.llm.common import arrow_map, doc_key, documents, materialize, release, small

#: Labelled rows of a language that the fit may use; so it is bounded.
SAMPLE = 400
CENTROIDS = 3
CELLS = 1 << 14
#: The share of a language's own sample that lies beyond its rejection distance.
REJECT_SHARE = 0.01
UNDETERMINED = "und"
ROUNDS = 8


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of the byte 1-, 2- and 3-grams; empty if the text has no letter. Long texts go in overlapping pieces."""
    total = np.zeros(CELLS, np.int64)
    letters = False
    for start in range(0, len(text), 1 << 20):
        piece = text[max(0, start - 4) : start + (1 << 20)]
        raw = np.frombuffer(piece.encode("utf-8", "surrogatepass").lower(), np.uint8)
        letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
        if not letters:
            letters = bool(((raw >= 97) & (raw <= 122)).any()) or any(c.isalpha() for c in piece)
        x = np.where(letter, raw, np.uint8(32))
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
        x = x[keep].astype(np.uint32)
        one, two = x * np.uint32(2654435761), x[:-1] * np.uint32(2246822519) + x[1:] * np.uint32(3266489917)
        three = x[:-2] * np.uint32(668265263) + x[1:-1] * np.uint32(374761393) + x[2:] * np.uint32(2654435761) if len(x) > 2 else x[:0]
        for h in (one, two, three):
            total += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(18), minlength=CELLS)
    if not letters:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cells = np.flatnonzero(total)
    return cells, total[cells]


def weigh(cells: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(n)) * idf[cells]
    norm = np.sqrt((v * v).sum())
    return v / norm if norm else v


def cluster(sample: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, centroids: int) -> tuple[np.ndarray, float]:
    """The centroids of one language's sample (cells, counts), and the least cosine that is not rejected."""
    rows = np.zeros((len(sample), CELLS), np.float32)
    for row, (cells, n) in zip(rows, sample):
        row[cells] = weigh(cells, n, idf)
    # Start from spread-out rows, each the furthest from those chosen so far; then move to the means.
    chosen = [0]
    while len(chosen) < min(centroids, len(rows)):
        chosen.append(int((rows @ rows[chosen].T).max(axis=1).argmin()))
    centres = rows[chosen].copy()
    for _ in range(ROUNDS):
        nearest = (rows @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            if (nearest == k).any():
                mean = rows[nearest == k].mean(axis=0)
                centres[k] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres, float(np.quantile((rows @ centres.T).max(axis=1), REJECT_SHARE))


class Classifier:
    """IDF, centroids with their languages, and each language's least cosine; arrays of a fixed size for each language."""

    def __init__(self, idf: np.ndarray, found: list[tuple[str, np.ndarray, float]]):
        found = sorted(found, key=lambda x: x[0])
        self.idf = idf.astype(np.float32)
        self.centroids = np.vstack([c for _, c, _ in found]).astype(np.float32) if found else np.empty((0, CELLS), np.float32)
        self.languages = [lang for lang, c, _ in found for _ in range(len(c))]
        self.least = {lang: least for lang, _, least in found}

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, its cosine (0 to 1), and whether the text is rejected."""
        cells, n = counts(text or "")
        if not len(cells) or not self.languages:
            return UNDETERMINED, 0.0, False
        cosine = self.centroids[:, cells] @ weigh(cells, n, self.idf).astype(np.float32)
        best = int(cosine.argmax())
        lang, score = self.languages[best], float(min(1.0, max(0.0, cosine[best])))
        return lang, score, score < self.least[lang]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Classifier:
    """Learns from `text` and `lang` of a bounded sample of the labelled rows in `docs`."""
    spark = docs.sparkSession
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", doc_key().alias("key"))
    # The smallest digests of each language: ranked before the shuffle too, so a frequent language sends `sample` rows a task.
    ranked = labelled.select("lang", "key").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("rank") <= sample)
    chosen = materialize(ranked.select("lang", "key"), "language-sample")
    n = chosen.count()
    texts = labelled.join(small(chosen, n), ["lang", "key"]).dropDuplicates(["lang", "key"])

    def featurise(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [counts(t) for t in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("lang"), batch.column("key"), pa.array([c.astype(np.int32) for c, _ in made], pa.list_(pa.int32())), pa.array([n.astype(np.int32) for _, n in made], pa.list_(pa.int32()))], ["lang", "key", "cells", "n"])

    rows = materialize(arrow_map(texts.select("lang", "key", "text"), featurise, "lang string, key binary, cells array<int>, n array<int>").where("size(cells) > 0"), "language-features")
    # A row a cell: bounded by their number.
    held_by = {r.cell: r.n for r in rows.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    df = np.zeros(CELLS)
    df[list(held_by)] = list(held_by.values())
    idf = np.log((1 + rows.count()) / (1 + df)) + 1

    def learn(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("key")
        centres, least = cluster([(np.asarray(c), np.asarray(n)) for c, n in zip(own["cells"], own["n"])], idf, centroids)
        return pd.DataFrame([{"lang": key[0], "centres": centres.astype(np.float32).tobytes(), "least": least}])

    learned = rows.groupBy("lang").applyInPandas(learn, "lang string, centres binary, least double").collect()
    release(chosen, rows)
    return Classifier(idf, [(r.lang, np.frombuffer(bytes(r.centres), np.float32).reshape(-1, CELLS), r.least) for r in learned])


def identify(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, held, lang, score, rejected) of every row of `docs` (doc_id, text, held)."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
        made = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
        return pa.record_batch([batch.column("doc_id"), batch.column("held"), *made], ["doc_id", "held", "lang", "score", "rejected"])

    return arrow_map(docs, work, "doc_id long, held boolean, lang string, score double, rejected boolean")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text", "lang", held_out().alias("held"))
    found = identify(docs.select("doc_id", "text", "held"), fit(docs.where("NOT held")))
    return found.select("doc_id", F.col("held").alias("held_out"), F.col("lang").alias("lang_pred"), "score", "rejected")
