"""Fit, evaluate and apply the five-class text classifier with Spark ML."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsrate.functions.binding import bind
from newsrate.functions.rating import index_to_rate
from newsrate.functions.text import TOKEN_PATTERN
from newsrate.functions.vectors import argmax, linear_head, softmax
from newsrate.operators.metrics import (
    batch_metrics,
    best_epoch,
    epoch_metrics,
    running_best,
    score_rows,
)
from newsrate.operators.ordering import batch_number
from newsrate.plans.epochs import EPOCHS, Head, fit_epochs, token_ids
from newsrate.session import write_table

# Fixed value: rows per metric batch.
BATCH_ROWS = 4
FEATURES = 1 << 18


def _classifier(features: str, label: str, max_iter: int, reg_param: float) -> LogisticRegression:
    """A linear head with softmax and cross-entropy. Gradients are tree-aggregated; their size
    is features times classes, whatever the number of rows."""
    return LogisticRegression(
        featuresCol=features,
        labelCol=label,
        predictionCol="_prediction",
        rawPredictionCol="_raw",
        probabilityCol="_probability",
        family="multinomial",
        maxIter=max_iter,
        regParam=reg_param,
        aggregationDepth=3,
    )


def fit_candidates(
    train: DataFrame,
    max_iters,
    text_col: str = "text",
    label_col: str = "label",
    reg_param: float = 0.01,
    features: int = FEATURES,
) -> list[PipelineModel]:
    """One classifier on hashed TF-IDF per entry of ``max_iters``. Texts are turned into
    features once; the candidates are fitted on the stored features."""
    text_stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=TOKEN_PATTERN, gaps=False),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
    ]
    prepared = Pipeline(stages=text_stages).fit(train)
    stored = write_table(prepared.transform(train).select("_features", label_col), "features")
    heads = [_classifier("_features", label_col, n, reg_param).fit(stored) for n in max_iters]
    return [PipelineModel(stages=[*prepared.stages, head]) for head in heads]


def fit(train: DataFrame, max_iter: int = 20, **options) -> PipelineModel:
    return fit_candidates(train, [max_iter], **options)[0]


def fit_head(
    train: DataFrame,
    vector_col: str,
    label_col: str = "label",
    max_iter: int = 20,
    reg_param: float = 0.01,
) -> LogisticRegressionModel:
    """Train the head alone, on vectors that an encoder has already produced."""
    rows = train.select(array_to_vector(vector_col).alias("_features"), label_col)
    return _classifier("_features", label_col, max_iter, reg_param).fit(rows)


def predict_head(df: DataFrame, model: LogisticRegressionModel, vector_col: str) -> DataFrame:
    """Add ``probs`` from a head fitted by ``fit_head``."""
    out = model.transform(df.withColumn("_features", array_to_vector(vector_col)))
    return out.select(*df.columns, vector_to_array("_probability").alias("probs"))


def score_vectors(df: DataFrame, vector_col: str, weights, bias=None) -> DataFrame:
    """Add ``logits``, ``probs`` and the rating ``label`` from given head weights."""
    logits = df.withColumn("logits", linear_head(F.col(vector_col), weights, bias))
    probs = logits.withColumn("probs", softmax(F.col("logits")))
    return probs.withColumn("label", index_to_rate(argmax(F.col("probs"))))


def predict(df: DataFrame, model: PipelineModel | Head) -> DataFrame:
    """Add ``probs``, the class probabilities."""
    if isinstance(model, Head):
        return model.predict(df)
    out = model.transform(df)
    return out.select(*df.columns, vector_to_array("_probability").alias("probs"))


def score(df: DataFrame, model: PipelineModel | Head) -> DataFrame:
    """Add ``probs`` and the rating ``label``; one text is a one-row table."""
    return predict(df, model).withColumn("label", index_to_rate(argmax(F.col("probs"))))


def save_best(model: PipelineModel | Head, path: str) -> None:
    if isinstance(model, Head):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | Head:
    """What ``save_best`` wrote: a pipeline keeps its stages and metadata in folders, a head is one
    table."""
    spark = SparkSession.active()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return PipelineModel.load(path)
    return Head.load(spark, path)


def _predictions(rows: DataFrame, candidates, key: str) -> list[DataFrame]:
    """Parts with (key, label, probs, epoch) of all candidates. Heads on the same features share the
    tokens of a text."""
    heads = [m for m in candidates if isinstance(m, Head)]
    if heads and len({m.features for m in heads}) == 1 and len(heads) == len(candidates):
        ids = token_ids(F.col("text"), heads[0].features)
        coded = bind(rows.select(key, "label", "text"), _ids=ids)
        found = [
            F.struct(m.probs(rows.sparkSession, F.col("_ids")).alias("probs"), F.lit(e).alias("epoch"))
            for e, m in enumerate(heads, 1)
        ]
        return [coded.select(key, "label", F.inline(F.array(*found)))]
    return [
        predict(rows, m).select(key, "label", "probs", F.lit(e).alias("epoch"))
        for e, m in enumerate(candidates, 1)
    ]


class Evaluation(NamedTuple):
    epochs: DataFrame
    best: int | None
    splits: DataFrame


def evaluate(
    candidates: list[PipelineModel] | list[Head],
    valid: DataFrame,
    key: str = "id",
    batch_rows: int = BATCH_ROWS,
    mode: str = "intended",
    train: DataFrame | None = None,
) -> Evaluation:
    """Metrics per candidate (= epoch, from 1) on ``valid``, the best epoch, if any, and the
    metrics per epoch and split, those of ``train`` included if it is given."""
    sides = {"valid": valid} if train is None else {"train": train, "valid": valid}
    parts = [
        part.withColumn("split", F.lit(split))
        for split, rows in sides.items()
        for part in _predictions(rows, candidates, key)
    ]
    scored = score_rows(reduce(DataFrame.unionByName, parts), mode)
    # A sort reads its rows twice; what they are scored by is computed once.
    stored = write_table(scored.select(key, "epoch", "split", "hit", "loss"), "scored")
    batches = batch_number(stored, batch_rows, [key], ["epoch", "split"])
    splits = write_table(epoch_metrics(batch_metrics(batches)), "epochs")
    epochs = splits.filter("split = 'valid'")
    return Evaluation(running_best(epochs), best_epoch(epochs).first()["epoch"], splits)


def fit_and_score(
    train: DataFrame,
    valid: DataFrame,
    path: str,
    key: str = "id",
    epochs: int = EPOCHS,
    **options,
) -> tuple[Evaluation, DataFrame]:
    """Train one head for some epochs, each going on from the last, keep the best on ``path`` and
    score ``valid`` with it. Where no epoch is better than 0 nothing is kept, and the last scores."""
    heads, _ = fit_epochs(train, epochs, key=key, **options)
    result = evaluate(heads, valid, key, train=train)
    chosen = heads[-1]
    if result.best:
        save_best(heads[result.best - 1], path)
        chosen = load_model(path)
    return result, score(valid.withColumnRenamed("label", "truth"), chosen)
