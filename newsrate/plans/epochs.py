"""Epochs of one fit: mini-batch gradient passes over a linear softmax head.

Texts become hashed token ids once, stored by mini-batch. A step reads its part of the table, every task
adds up the gradient of its rows, Spark sums the parts by block of features, and the driver makes one AdamW
step; there is one part a core, and a gradient has ``features`` times classes numbers at most, whatever the number of rows. Weights and moments
carry on from one epoch to the next, and each epoch leaves a copy of the weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsrate.functions.text import tokens
from newsrate.schemas import LABELS
from newsrate.session import scratch_dir

FEATURES = 1 << 18
EPOCHS, BATCHES = 2, 16
LEARNING_RATE, WEIGHT_DECAY = 0.05, 0.0
BETAS, EPSILON = (0.9, 0.999), 1e-8
#: Tokens handled at once in a task.
CHUNK_TOKENS = 1 << 20
#: Numbers of a sum that travel in one row.
BLOCK = 1 << 14


def token_ids(text: Column, features: int) -> Column:
    """The tokens of a text as places in the feature space; null gives none."""
    found = F.coalesce(tokens(text), F.array().cast("array<string>"))
    return F.transform(found, lambda t: F.pmod(F.hash(t), F.lit(features)))


def _chunks(ids: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, token ids, row of each token) of parts of a column of token lists."""
    sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        used = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, used + CHUNK_TOKENS, "right")))
        row = np.repeat(np.arange(stop - start), sizes[start:stop])
        yield start, stop - start, flat[used : ends[stop - 1]], row
        start = stop


@dataclass
class Head:
    """Inverse document frequencies, and weights by feature and class; the last row is the bias."""

    idf: np.ndarray
    weights: np.ndarray
    features: int = field(init=False)

    def __post_init__(self):
        self.features = len(self.idf)

    def _inputs(self, rows: int, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The input of each token: its idf over the number of tokens of its text."""
        return self.idf[ids] / np.maximum(1, np.bincount(row, minlength=rows))[row]

    def probabilities(self, rows: int, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
        x = self._inputs(rows, ids, row)
        logits = np.stack(
            [np.bincount(row, x * w[ids], rows) + w[-1] for w in self.weights.T], axis=1
        )
        out = np.exp(logits - logits.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    def gradient(self, rows, ids, row, labels) -> tuple[np.ndarray, float, int]:
        """(sum of the gradients, sum of the losses, hits) of some texts."""
        probs = self.probabilities(rows, ids, row)
        at = np.arange(rows), labels
        loss = float(-np.log(np.maximum(probs[at], 1e-300)).sum())
        hits = int((probs.argmax(1) == labels).sum())
        probs[at] -= 1.0
        x = self._inputs(rows, ids, row)
        out = [np.bincount(ids, x * d[row], self.features) for d in probs.T]
        return np.vstack([np.stack(out, axis=1), probs.sum(0)]), loss, hits

    def probs(self, spark: SparkSession, ids: Column) -> Column:
        """The class probabilities of a column of token ids."""
        shared = spark.sparkContext.broadcast((self.idf, self.weights))

        @F.arrow_udf("array<double>")
        def probs(ids: pa.Array) -> pa.Array:
            head = Head(*shared.value)
            parts = [head.probabilities(n, flat, row) for _, n, flat, row in _chunks(ids)]
            found = np.concatenate([*parts, np.zeros((0, head.weights.shape[1]))])
            offsets = np.arange(0, found.size + 1, found.shape[1], dtype="i4")
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))

        return probs(ids)

    def predict(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """Add ``probs``, the class probabilities."""
        ids = token_ids(F.col(text_col), self.features)
        return df.withColumn("probs", self.probs(df.sparkSession, ids))

    def save(self, spark: SparkSession, path: str) -> None:
        n, classes = self.weights.shape
        offsets = np.arange(0, n * classes + 1, classes, dtype="i4")
        weights = pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.weights.ravel()))
        columns = [pa.array(np.arange(n, dtype="i4")), pa.array(np.append(self.idf, 1.0)), weights]
        rows = pa.table(columns, ["feature", "idf", "weights"])
        spark.createDataFrame(rows).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Head:
        rows = spark.read.parquet(path).orderBy("feature").toPandas()
        return cls(rows["idf"].to_numpy()[:-1], np.stack(rows["weights"].to_list()))


def summed(rows: DataFrame, size: int, total: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of ``total``, ``size`` numbers, over the tasks that share ``rows``: one a core, as every
    task sends as many numbers. They travel in blocks, and one array reaches the driver."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = total(batches)
        starts = [at for at in range(0, size, BLOCK) if values[at : at + BLOCK].any()]
        blocks = [values[at : at + BLOCK].tobytes() for at in starts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(starts, pa.int64()), pa.array(blocks, pa.binary())], ["start", "part"]
        )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(part.as_buffer(), "f8")
                held[at] = held[at] + values if at in held else values
        blocks = pa.array([v.tobytes() for v in held.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), blocks], ["start", "part"])

    kind = "start long, part binary"
    cores = rows.sparkSession.sparkContext.defaultParallelism
    found = rows.coalesce(cores).mapInArrow(parts, kind).repartition("start").mapInArrow(added, kind)
    out = np.zeros(size)
    for r in found.collect():  # size / BLOCK rows at most
        out[r.start : r.start + BLOCK] = np.frombuffer(r.part, "f8")
    return out


def inverse_frequencies(ids: DataFrame, features: int) -> np.ndarray:
    """log((rows + 1) / (rows with the feature + 1)) by feature."""

    def counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(features + 1)
        for batch in batches:
            out[-1] += batch.num_rows
            for _, _, flat, _ in _chunks(batch.column(0)):
                out[:-1] += np.bincount(flat, minlength=features)
        return out

    found = summed(ids.select(F.array_distinct("ids")), features + 1, counts)
    return np.log((found[-1] + 1) / (found[:-1] + 1))


def batch_gradient(rows: DataFrame, head: Head) -> tuple[np.ndarray, float, int, int]:
    """(sum of the gradients, sum of the losses, hits, rows) of a mini-batch."""
    shared = rows.sparkSession.sparkContext.broadcast((head.idf, head.weights))
    shape = head.weights.shape

    def gradients(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        head = Head(*shared.value)
        total, loss, hits, n = np.zeros_like(head.weights), 0.0, 0, 0
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for start, count, flat, row in _chunks(batch.column(0)):
                part = head.gradient(count, flat, row, labels[start : start + count])
                total, loss, hits, n = total + part[0], loss + part[1], hits + part[2], n + count
        return np.concatenate([total.ravel(), [loss, hits, n]])

    out = summed(rows.select("ids", "label"), head.weights.size + 3, gradients)
    loss, hits, n = out[-3:]
    return out[:-3].reshape(shape), float(loss), int(hits), int(n)


def fit_epochs(
    train: DataFrame,
    epochs: int = EPOCHS,
    batches: int = BATCHES,
    learning_rate: float = LEARNING_RATE,
    weight_decay: float = WEIGHT_DECAY,
    features: int = FEATURES,
    classes: int = len(LABELS),
    text_col: str = "text",
    label_col: str = "label",
    key: str | None = None,
    seed: int = 0,
) -> tuple[list[Head], list[dict]]:
    """(the head after each epoch, {epoch, loss, acc} of each): mean of the mini-batches' means as seen
    while training. Rows without a label are left out. A row's mini-batch is a hash of its ``key`` and
    text, or without a key of its place when the table is stored; the order of the mini-batches is
    drawn anew in every epoch."""
    spark = train.sparkSession
    path = scratch_dir(spark, "epochs")
    text = F.col(text_col)
    place = F.xxhash64(text, F.col(key) if key else F.monotonically_increasing_id())
    rows = train.filter(F.col(label_col).isNotNull()).select(
        token_ids(text, features).alias("ids"),
        F.col(label_col).cast("int").alias("label"),
        F.pmod(place, F.lit(batches)).cast("int").alias("batch"),
    )
    rows.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema("ids array<int>, label int, batch int").parquet(path)
    idf = inverse_frequencies(stored, features)
    head = Head(idf, np.zeros((features + 1, classes)))
    first, second = np.zeros_like(head.weights), np.zeros_like(head.weights)
    rng = np.random.default_rng(seed)
    heads, history, step = [], [], 0
    for epoch in range(1, epochs + 1):
        losses, accs = [], []
        for b in rng.permutation(batches).tolist():
            gradient, loss, hits, n = batch_gradient(stored.filter(F.col("batch") == b), head)
            if not n:
                continue
            step += 1
            gradient /= n
            first = BETAS[0] * first + (1 - BETAS[0]) * gradient
            second = BETAS[1] * second + (1 - BETAS[1]) * gradient**2
            move = first / (1 - BETAS[0] ** step)
            move /= np.sqrt(second / (1 - BETAS[1] ** step)) + EPSILON
            head = Head(idf, head.weights - learning_rate * (move + weight_decay * head.weights))
            losses.append(loss / n)
            accs.append(hits / n)
        heads.append(head)
        mean = {"loss": float(np.mean(losses)), "acc": float(np.mean(accs))} if losses else {}
        history.append({"epoch": epoch, "loss": None, "acc": None, **mean})
    return heads, history
