"""Language ID: nearest of several clustered centroids a language, by cosine of normalised TF-IDF n-gram vectors.

Vectors count byte n-grams (1 to 4) of the lower-cased text without digits and ASCII punctuation, hashed to ``DIMENSIONS``
counters, damped by a logarithm, weighted by inverse document frequency and normalised. Fitting uses a bounded sample: at most
``sample_per_language`` different labelled texts with a letter of each language (those with the smallest hashes); a language's vectors
are clustered in one task (bounded by sample x dimensions) by spherical k-means, and only document frequencies and centroids, some of fixed length for
each language, reach the driver. Predicting reads each whole text once, in Arrow batches.

Distance-based rejection: a cosine grows with the square root of the number of distinct n-grams while these are few, so the
nearness of a text is its best cosine over that root (relative to ``ENOUGH`` n-grams). A text whose nearness lies below the floor of
the language it is nearest to is rejected; a language's floor is ``MARGIN`` times the ``LOW`` quantile of the nearness of all documents
labelled so to their own language. A few mislabelled or junk rows do not move it, and the margin leaves room for texts of a few words.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is rejected; ties go to the language that sorts
first; without any labelled document all are ``und``; repeated rows get equal results; an empty table gives an empty table;
columns besides those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import table, written

DIMENSIONS = 1 << 13
CENTROIDS = 4
SAMPLE_PER_LANGUAGE = 400
ENOUGH = 1000
LOW = 0.05
MARGIN = 0.45

#: Bytes of ASCII that are no letters become spaces; all others stay.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
_SHIFT = 32 - DIMENSIONS.bit_length() + 1
_PIECE = 1 << 20
#: Texts whose counters are held at once.
_ROWS = 64


class Model(NamedTuple):
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # centroids x dimensions, of length one
    idf: np.ndarray
    floors: np.ndarray  # of each centroid: that of its language


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Hashed counts of the text's n-grams."""
    words = text.lower().encode("utf-8", "replace").translate(_LETTERS).split()
    data = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    total = np.zeros(DIMENSIONS, dtype=np.int64)
    for first in range(0, len(data), _PIECE):  # a long text is counted piece by piece, each with the start of the next
        piece, own = data[first : first + _PIECE + len(_MULTIPLIERS) - 1], min(_PIECE, len(data) - first)
        code = np.zeros(len(piece), dtype=np.uint32)
        for n, multiplier in enumerate(_MULTIPLIERS, 1):
            if len(piece) < n:
                break
            code = (code[: len(piece) - n + 1] << np.uint32(8)) | piece[n - 1 :]
            total += np.bincount((code[:own] * np.uint32(multiplier) + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(_SHIFT), minlength=DIMENSIONS)
    return total


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf, dtype=np.float32) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def nearness(tf: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    distinct = np.count_nonzero(tf, axis=1)
    return cosine / np.sqrt(np.clip(distinct / ENOUGH, 1e-9, 1.0))


def _clustered(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts are taken one after the other, each the vector least like those before."""
    starts = [int(np.argmax(v @ v.mean(axis=0)))]
    nearest = v @ v[starts[0]]
    while len(starts) < min(k, len(v)):
        starts.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, v @ v[starts[-1]])
    c = v[starts]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        sums = np.stack([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit(labelled: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Fits on rows ``text, lang``; the sample's size is the documented bound of what reaches the driver.

    Texts are ranked by their own hash and copies count once: neither missing nor repeated ids nor copies take places in the sample.
    """
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    named = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", h.alias("_h"))
    # only hashes so small that about four times the sample passes are ranked: the ranking's input does not grow with the table
    sizes = named.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_n"))  # a row for each language
    near = named.join(F.broadcast(sizes), "lang").where(F.col("_h") * F.col("_n").cast("double") < 4.0 * sample_per_language * (1 << 40))
    near = near.groupBy("lang", "_h").agg(F.min("text").alias("text"))
    by_hash = Window.partitionBy("lang").orderBy("_h")
    chosen = near.withColumn("_r", F.row_number().over(by_hash)).where(F.col("_r") <= sample_per_language)
    texts = written(chosen.select("lang", "text"), "langid-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, counts(text).astype("<u4").tobytes()) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "tf"])

    counted = written(texts.mapInArrow(run, "lang string, tf binary"), "langid-counts")
    n, frequency = 0, np.zeros(DIMENSIONS, dtype=np.int64)
    for row in counted.mapInArrow(_document_frequencies, "n long, df binary").toLocalIterator():  # one row a task
        n += row.n
        frequency += np.frombuffer(row.df, "<i8")
    if not n:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS, np.float32), np.zeros(0))
    idf = (np.log((1 + n) / (1 + frequency)) + 0.1).astype(np.float32)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        tf = np.stack([np.frombuffer(x, "<u4") for x in sorted(map(bytes, group["tf"]))])
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [c.astype("<f4").tobytes() for c in _clustered(vectors(tf, idf), centroids)]})

    found = counted.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary")  # a group: sample_per_language rows at most
    rows = sorted((str(r.lang), i, bytes(r.centroid)) for i, r in enumerate(found.collect()))
    names = [lang for lang, _, _ in rows]
    model = Model(names, np.stack([np.frombuffer(c, "<f4") for _, _, c in rows]), idf, np.zeros(len(names)))
    low = _low_nearness(labelled, model)
    return model._replace(floors=np.array([MARGIN * low.get(lang, 0.0) for lang in names]))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, frequency = 0, np.zeros(DIMENSIONS, dtype="<i8")
    for batch in batches:
        n += batch.num_rows
        for tf in batch.column(1):
            frequency += np.frombuffer(tf.as_buffer(), "<u4") > 0
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([frequency.tobytes()], pa.binary())], names=["n", "df"])


def _low_nearness(labelled: DataFrame, m: Model) -> dict[str, float]:
    """The ``LOW`` quantile of the nearness of each language's documents to it: one pass over all that are labelled, one row a language."""
    sent = labelled.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        own = {lang: [i for i, x in enumerate(m.languages) if x == lang] for lang in m.languages}
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                rows = [(lang, text) for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if lang in own and has_letter(text)]
                if rows:
                    tf = np.stack([counts(text) for _, text in rows])
                    cosines = vectors(tf, m.idf) @ m.centroids.T
                    best = np.array([cosines[i, own[lang]].max() for i, (lang, _) in enumerate(rows)])
                    yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in rows], pa.string()), pa.array(nearness(tf, best), pa.float64())], names=["lang", "near"])

    near = labelled.where("lang is not null and text is not null").select("lang", "text").mapInArrow(run, "lang string, near double")
    return {r.lang: r.low for r in near.groupBy("lang").agg(F.percentile_approx("near", LOW, 10_000).alias("low")).collect()}


def judged(texts: list[str | None], m: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and acceptance of a few texts."""
    names, scores, kept = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
    where = [i for i, t in enumerate(texts) if m.languages and has_letter(t)]
    if where:
        tf = np.stack([counts(texts[i]) for i in where])
        cosines = vectors(tf, m.idf) @ m.centroids.T
        best = cosines.max(axis=1)
        scores[where] = np.clip(best, 0.0, 1.0)
        which = np.argmax(cosines, axis=1)
        kept[where] = nearness(tf, best) >= m.floors[which]
        for i, c in zip(where, which, strict=True):
            names[i] = m.languages[c]
    return names, scores, kept


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score, rejected`` for each row; reads nothing but the text."""
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(model)  # centroids x dimensions: a fixed size for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                names, scores, kept = judged(part.column(1).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(~kept)], names=["id", "lang_pred", "score", "rejected"]
                )

    return df.select(key, text).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", key)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fitted_on(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out()).select("doc_id", "text", "lang"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fitted_on(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_recognised(docs: DataFrame, model: Model) -> DataFrame:
    """Only the rows of ``docs`` that the model does not reject, with all their columns, in one pass and without a join."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                yield part.filter(pa.array(judged(part.column(at).to_pylist(), sent.value)[2]))

    return docs.mapInArrow(run, docs.schema)
