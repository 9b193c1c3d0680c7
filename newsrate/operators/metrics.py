"""Accuracy and loss per batch and epoch, and the choice of the best epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsrate.functions.vectors import argmax, cross_entropy


def score_rows(preds: DataFrame, mode: str = "intended") -> DataFrame:
    """Add ``hit`` and ``loss`` to rows with ``probs`` and the class index ``label``."""
    return preds.withColumn(
        "hit", (argmax(F.col("probs")) == F.col("label")).cast("int")
    ).withColumn("loss", cross_entropy(F.col("probs"), F.col("label"), mode))


def batch_metrics(preds: DataFrame, by=("epoch", "split")) -> DataFrame:
    """Rows with ``batch``, ``hit``, ``loss`` -> accuracy and mean loss of each batch."""
    return preds.groupBy(*by, "batch").agg(
        F.avg("hit").alias("acc"), F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n")
    )


def epoch_metrics(batches: DataFrame, by=("epoch", "split")) -> DataFrame:
    """Mean of batch means (a short last batch weighs as much as a full one), and next to it
    the mean over rows."""
    rows = F.sum("n")
    return batches.groupBy(*by).agg(
        F.avg("acc").alias("acc"),
        F.avg("loss").alias("loss"),
        (F.sum(F.col("acc") * F.col("n")) / rows).alias("row_acc"),
        (F.sum(F.col("loss") * F.col("n")) / rows).alias("row_loss"),
    )


def best_epoch(epochs: DataFrame) -> DataFrame:
    """One row: the epoch with the highest accuracy, the earliest on ties; NULL if none is
    above 0."""
    rank = F.struct(F.col("acc"), -F.col("epoch"))
    return epochs.filter(F.col("acc") > 0).agg(
        F.max_by("epoch", rank).alias("epoch"), F.max("acc").alias("acc")
    )


def running_best(epochs: DataFrame) -> DataFrame:
    """Best accuracy before each epoch and whether the epoch improves on it. The input has
    one row per epoch, so the unpartitioned window is small."""
    before = W.orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    return epochs.withColumn(
        "best_before", F.coalesce(F.max("acc").over(before), F.lit(0.0))
    ).withColumn("improved", F.col("acc") > F.col("best_before"))


def insert_count(inserted: DataFrame) -> DataFrame:
    return inserted.agg(F.count(F.lit(1)).alias("inserted"))


def dataset_size(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(label).alias("n_classes"))
