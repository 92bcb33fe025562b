"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader (proximal) with elastic-net penalties, followed by one
temperature fitted on rows kept out of the fit. Document frequencies cover every labelled row; the
fit itself reads a seeded sample whose size is the parameter `max_rows`, shared out evenly over the
languages, so a hot source or language neither fills the sample nor a task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import text_batches

UNKNOWN = "und"
BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
BLANK = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Unicode letters by code point."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets and counts of the character n-grams of a whole text; empty without a letter.

    Letters are lower-cased, every run of other characters counts as one word gap."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return none
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return none
    padded = np.full(len(codes) + 2, BLANK, np.uint64)
    padded[1:-1] = np.where(letter, codes, BLANK)
    gap = padded == BLANK
    padded = padded[~(gap & np.roll(gap, 1)) | (np.arange(len(padded)) == 0)]
    found = []
    for n in ORDERS:
        if len(padded) < n:
            continue
        mixed = np.full(len(padded) - n + 1, n, np.uint64)
        for i in range(n):
            mixed = (mixed ^ padded[i : len(padded) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        found.append((mixed % np.uint64(BUCKETS)).astype(np.int64))
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    """Weights by language and bucket (last column: bias), inverse document frequencies, temperature."""

    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1.0 + np.log(counts)) * self.idf[at]
        norm = np.sqrt(x @ x)
        return x / norm if norm > 0 else x

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ x + self.weights[:, -1]

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = ngram_counts(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(at, self.vector(at, counts)) / self.temperature)
        best = int(np.argmax(p))  # ties: the language that sorts first
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(
    model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 5, alpha: float = 2.0,
    beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, seed: int = 42,
) -> None:
    """FTRL-proximal over (class, buckets, counts) rows. The weight of a coordinate is exactly 0 until its
    accumulated gradient exceeds l1; l2 shrinks the rest."""
    k, width = len(model.languages), BUCKETS + 1
    z, n = np.zeros((k, width)), np.zeros((k, width))
    data = [(y, np.append(at, BUCKETS), np.append(model.vector(at, c), 1.0)) for y, at, c in rows]

    def weights(zs, ns):
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1, 0.0)
        return -shrunk / ((beta + np.sqrt(ns)) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            y, at, x = data[i]
            zs, ns = z[:, at], n[:, at]
            w = weights(zs, ns)
            error = _softmax(w @ x)
            error[y] -= 1.0
            g = error[:, None] * x
            more = ns + g * g
            z[:, at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[:, at] = more
    model.weights = weights(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Golden-section search for the temperature with the least log loss on held-out rows. Targets are
    smoothed by the number of rows, (n + 1) / (n + k), so that perfectly separated rows do not drive
    the temperature to 0."""
    n, k = logits.shape if len(y) else (0, 1)
    if not n or k == 1:
        return 1.0
    target = np.full((n, k), 1.0 / (n + k))
    target[np.arange(n), y] = (n + 1.0) / (n + k)

    def loss(log_t: float) -> float:
        return float(-(target * np.log(np.maximum(_softmax(logits / np.exp(log_t)), 1e-300))).sum(axis=1).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket that occurs in the partition; bucket -1 counts its texts."""
    df, texts = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            at, _ = ngram_counts(text.as_py())
            df[at] += 1
            texts += bool(len(at))
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1)), pa.array(np.append(df[at], texts))], ["bucket", "df"]
    )


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [ngram_counts(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
        rest = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "text"]
        names = [f.name for f in batch.schema if f.name != "text"]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()),
             pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())],
            [*names, "buckets", "counts"],
        )


def train(labelled: DataFrame, max_rows: int = 3000, seed: int = 42) -> Model:
    """Fits a model to labelled(doc_id, text, lang).

    Rows without language are left out by this function; `max_rows` bounds what the fit and the
    calibration (every fifth sampled row) read. With no usable row the model knows no language."""
    spark = labelled.sparkSession
    text_batches(spark)
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = dict(
        rows.select("text").mapInArrow(_document_frequencies, "bucket long, df long")
        .groupBy("bucket").agg(F.sum("df").alias("df")).collect()  # BUCKETS + 1 rows at most
    )
    texts = counts.pop(-1, 0) or 0
    idf = np.full(BUCKETS, np.log(1.0 + texts) + 1.0)
    for bucket, df in counts.items():
        idf[bucket] = np.log((1.0 + texts) / (1.0 + df)) + 1.0
    # A row's place among those of its language is estimated from a uniform hash and the language's
    # count, so languages take turns without a group ever meeting in one task.
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "lang").limit(max_rows)
    uniform = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = (
        rows.select("doc_id", "lang").join(F.broadcast(sizes), "lang")  # max_rows languages at most
        .orderBy(uniform * F.col("_n"), "doc_id", "lang").limit(max_rows).select("doc_id").distinct()
    )
    ids = [r[0] for r in chosen.collect()]  # max_rows at most
    few = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    schema = "doc_id long, lang string, buckets binary, counts binary"
    sample = (
        rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
        .join(F.broadcast(few), "doc_id", "left_semi").mapInArrow(_sample_features, schema)
        .withColumn("_text", F.xxhash64("buckets", "counts")).dropDuplicates(["lang", "_text"])
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "lang", "_text").limit(max_rows).drop("_text").collect()
    )
    found = [(r.lang, np.frombuffer(r.buckets, np.int32).astype(np.int64), np.frombuffer(r.counts, np.int32)) for r in sample]
    found = [r for r in found if len(r[1])]
    languages = sorted({r[0] for r in found})
    model = Model(languages, np.zeros((len(languages), BUCKETS + 1)), idf)
    if not languages:
        return model
    data = [(languages.index(lang), at, c) for lang, at, c in found]
    held = [r for i, r in enumerate(data) if i % 5 == 4]
    fit_ftrl(model, [r for i, r in enumerate(data) if i % 5 != 4], seed=seed)
    logits = np.array([model.logits(at, model.vector(at, c)) for _, at, c in held])
    model.temperature = fit_temperature(logits, np.array([r[0] for r in held], np.int64))
    return model


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (calibrated probability of the prediction, 0 to 1) to every row.

    A null, empty or letterless text is `und` with score 0. Only the text goes to Python; columns named like
    a result are replaced, all others pass through, repeated rows are predicted each."""
    text_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        said = [shared.value.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], ["lang_pred", "score"])

    # not deterministic by declaration only: the optimizer must not evaluate it once a use
    told = df.drop("lang_pred", "score").withColumn("_said", predict.asNondeterministic()(F.col(f"`{text}`")))
    return told.withColumns({"lang_pred": F.col("_said.lang_pred"), "score": F.col("_said.score")}).drop("_said")
