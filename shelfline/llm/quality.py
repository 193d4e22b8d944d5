"""Quality classifier: hashed word n-grams, logistic regression trained with FTRL-proximal, sparse dot products.

Tokens are runs of word characters and runs of punctuation, lower-cased A-Z; features are single tokens, pairs of
neighbours, and two n-grams without their words: a token that comes again at once, or after one other.  All are
hashed to 2**BITS weights, each occurrence weighing 1 / sqrt(occurrences in the text).
Training reads at most `MOST_TRAINING` labelled rows (those with the smallest hashes of their ids) in a fixed
order, one after another, in one task that holds only the model; scoring is a gather and a sum by text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.llm.common import renamed_apart, table, unused
from shelfline.llm.hashing import span_hashes, texts_of

BITS = 18
#: Labelled rows that training reads at most, and how often it reads them.
MOST_TRAINING = 12_000
EPOCHS = 3
#: FTRL-proximal: learning rate, its offset, and the L1 and L2 strengths.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.1
#: What stands for "the same token again" and "the same token after one other" among hashes.
AGAIN, LATER = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Bytes of text hashed at a time, about.
GROUP_BYTES = 1 << 20

#: 0 white space and control, 1 word, 2 punctuation; and A-Z as a-z.
KIND = np.array([0 if b <= 32 or b == 127 else 1 if chr(b).isalnum() or b >= 128 else 2 for b in range(256)], dtype=np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight numbers of all features, text by text; features in each text)."""
    kind = KIND[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    h = span_hashes(LOWER[data], starts, ends)
    of_text = np.searchsorted(starts, offsets)
    n = np.diff(of_text)
    text = np.repeat(np.arange(len(n)), n)
    pair = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.empty(0, dtype=np.int64)
    pairs = h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    again = pair[h[pair] == h[pair + 1]]
    later = pair[:-1][(pair[1:] == pair[:-1] + 1) & (h[pair[:-1]] == h[pair[1:] + 1])]
    every = np.concatenate([h, pairs, np.full(len(again), AGAIN, np.uint64), np.full(len(later), LATER, np.uint64)])
    every ^= every >> np.uint64(31)
    index = ((every * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int32)
    owner = np.concatenate([text, text[pair], text[again], text[later]])
    order = np.argsort(owner, kind="stable")
    return index[order], np.bincount(owner, minlength=len(n))


def grouped(data: np.ndarray, offsets: np.ndarray):
    """`features` of runs of whole texts of about GROUP_BYTES."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP_BYTES, side="right")) - 1)
        yield features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


class Ftrl:
    """FTRL-proximal logistic regression; the last weight is the intercept, which has no penalty."""

    def __init__(self, size: int):
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)

    def weights(self, index: np.ndarray) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        free = index == len(self.z) - 1
        shrunk = np.where(free, z, np.sign(z) * np.maximum(0, np.abs(z) - L1))
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + np.where(free, 0, L2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[index] = n + g * g


def train(docs: DataFrame, labels: DataFrame, usable: F.Column | None = None, most: int = MOST_TRAINING, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (2**BITS, then the intercept) learned from `labels` (doc_id, quality) over `docs` (doc_id, text).

    `usable` restricts the labels.  Rows with a null id or label are left out; other labels than 1 count as 0;
    without any labelled text all weights are 0, so every score is 0.5.
    """
    chosen = labels.filter("doc_id is not null and quality is not null")
    chosen = chosen.filter(usable) if usable is not None else chosen
    order = F.xxhash64("doc_id")
    chosen = chosen.select("doc_id", (F.col("quality") == 1).cast("int").alias("label")).orderBy(order, "doc_id", "label").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")

    def extract(batches):
        for batch in batches:
            if batch.num_rows:
                out = []
                for index, n in grouped(*texts_of(batch.column(2))):
                    for own in np.split(index, np.cumsum(n)[:-1]):
                        feature, count = np.unique(own, return_counts=True)
                        out.append((feature.astype("<i4").tobytes(), (count / np.sqrt(max(1, len(own)))).astype("<f4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())],
                    names=["doc_id", "label", "feature", "value"],
                )

    def learn(batches):
        model = Ftrl(1 << BITS)
        for batch in batches:
            for label, feature, value in zip(*(batch.column(k).to_pylist() for k in range(3))):
                index = np.append(np.frombuffer(feature, dtype="<i4"), 1 << BITS)
                model.learn(index, np.append(np.frombuffer(value, dtype="<f4"), 1.0).astype(np.float64), label)
        learned = model.weights(np.arange((1 << BITS) + 1)).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([learned.tobytes()], pa.binary())], names=["weights"])

    found = texts.select("doc_id", "label", "text").mapInArrow(extract, "doc_id long, label int, feature binary, value binary")
    passes = found.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).repartition(1)
    ordered = passes.sortWithinPartitions("epoch", order, "doc_id", "label", "feature").select("label", "feature", "value")
    rows = ordered.mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(rows[0][0], dtype="<f4") if rows else np.zeros((1 << BITS) + 1, dtype=np.float32)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """`docs` with `score` (double, 0 to 1: how likely the text is good) of every whole text.

    A null or empty text scores as the intercept alone; an input column named score is replaced; repeated rows
    score alike.
    """
    docs = renamed_apart(docs, ["score"])
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    texts = docs.withColumn(unused("__text", docs), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))

    def rate(batches):
        w = shared.value.astype(np.float64)
        for batch in batches:
            found = []
            for index, n in grouped(*texts_of(batch.column(batch.num_columns - 1))) if batch.num_rows else []:
                total = np.zeros(len(n))
                some = n > 0
                total[some] = np.add.reduceat(w[index], (np.cumsum(n) - n)[some]) if some.any() else 0
                found.append(total / np.sqrt(np.maximum(1, n)))
            z = np.concatenate([np.empty(0), *found]) + w[-1]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            rated = pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))
            yield pa.RecordBatch.from_arrays([*columns, rated], names=[*batch.schema.names[:-1], "score"])

    return texts.mapInArrow(rate, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def rated_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with `score`, learned from the labels of rows that are not held out."""
    return score(docs, train(docs, labels, ~held_out(F.col("doc_id"))))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, and whether its label was held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = rated_documents(docs, table(spark, sf_dir, "labels"))
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
