"""Toxicity: logistic regression trained with FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, its pairs of neighbouring words and its
pairs of words with one word between. FTRL-proximal gives each coordinate a learning rate of its own
and L1 sparsity, so the weights that are broadcast are few. It sees the training rows in a fixed
(hashed) order, in one task: that is bounded by ``max_train`` rows, chosen by hash of the id, and by
``max_features`` features in all, rows in the same order as far as that reaches. Of rows that repeat a
labelled id one is learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import lowest, materialize, needed, text_or_empty
from ledgerlens.llm.words import mixed, word_hashes
from ledgerlens.sources.tables import table

BITS = 22
MAX_TRAIN = 20_000
MAX_FEATURES = 50_000_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 12.0, 1.0
THRESHOLD = 0.7


def features(text: str) -> np.ndarray:
    """Hashed features of a text, repeats included."""
    h = word_hashes(text)
    salted = lambda x, salt: mixed(x + np.uint64(salt))
    pair = h * np.uint64(0x9E3779B97F4A7C15)
    parts = [salted(h, 1), salted(pair[:-1] + h[1:], 2), salted(pair[:-2] + h[2:], 3)] if len(h) else [h]
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32)


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after the rows, in their order, epochs times."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for ids, label in rows:
            zi, ni = z[ids], n[ids]
            w = weights(zi, ni)
            b = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - label
            root = np.sqrt(ni + g * g)
            z[ids] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
            n[ids] = ni + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * b
            bias_n += g * g
    return weights(z, n), float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA))


def held_out(doc_id) -> F.Column:
    """Rows that are never learnt from: CRC-32 of the id's text leaves 1 by 3. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights other than 0, and the bias. Of a doc_id's labels the
    greatest counts; null labels and ids count for nothing. Without rows to learn from there are no
    weights and the bias is 0."""
    known = needed(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null")
    known = (
        known.where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("label"))
        .withColumn("place", F.xxhash64("doc_id"))
    )
    chosen = lowest(known, "place", max_train, "doc_id")
    texts = needed(docs, "doc_id", "text").select("doc_id", text_or_empty(F.col("text")).alias("text"))
    # chosen has max_train rows at most
    rows = texts.join(F.broadcast(chosen), "doc_id").select("place", "label", F.xxhash64("text").alias("h"), "text")

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"place": batch["place"], "h": batch["h"], "label": batch["label"], "ids": [np.unique(features(t)) for t in batch["text"]]})

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", kind="stable")
        w, b = ftrl([(np.asarray(ids), y) for ids, y in zip(group["ids"], group["label"], strict=True)])
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": [at.astype(np.int32)], "w": [w[at]], "b": [b]})

    made = rows.mapInPandas(featurize, "place long, h long, label int, ids array<int>")
    made = materialize(made.groupBy("place", "label").agg(F.min(F.struct("h", "ids")).alias("row")).select("place", "label", F.col("row.ids").alias("ids")), "toxicity-features")
    # max_train narrow rows at most
    so_far = F.sum(F.size("ids").cast("long")).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    within = made.select("place", so_far.alias("so_far")).where(F.col("so_far") <= max_features).select("place")
    found = made.join(F.broadcast(within), "place").withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "at array<int>, w array<double>, b double").collect()
    if not found:
        return np.empty(0, np.int32), np.empty(0), 0.0
    return np.array(found[0]["at"], np.int32), np.array(found[0]["w"], float), found[0]["b"]


def score_texts(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], name: str = "score") -> DataFrame:
    """docs, which have a column text, and the score in a column of this name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS weights

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, values, bias = shared.value
        w = np.zeros(1 << BITS)
        w[at] = values
        weighs = w != 0
        for batch in texts:
            out = np.empty(len(batch))
            for i, text in enumerate(batch):
                ids = features(text) if text else np.empty(0, np.int32)
                out[i] = w[np.unique(ids[weighs[ids]])].sum() + bias
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))

    return docs.withColumn(name, score(text_or_empty(F.col("text"))))


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null text is empty; an empty text has the bias for its score. Null and repeated ids come back
    as they are, a row for each input row. An empty table gives no rows; without labels every score
    is 0.5. Further columns are ignored; only the text is an input of a score."""
    texts = needed(docs, "doc_id", "text").select("doc_id", text_or_empty(F.col("text")).alias("text"))
    scored = score_texts(texts, train(docs, labels, max_train))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their columns."""
    name = "_toxicity"
    return score_texts(docs, train(docs, labels, max_train), name).where(F.col(name) < THRESHOLD).drop(name)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
