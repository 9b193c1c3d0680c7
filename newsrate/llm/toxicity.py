"""A toxicity classifier with a counterfactual penalty.

Logistic regression over the words of a text and the beginnings of its words, each counted once.
Labelled texts that name a group are copied with the name swapped for another one, and the squared
change of the score is penalised, so naming a group does not by itself make a text toxic.

The fit uses at most ``MAX_ROWS`` labelled rows, picked by a hash of their id, and happens on the
driver; features that do not tell the classes apart are dropped first. Scoring covers all rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsrate.llm.common import BoundedCache, crc_fold

MAX_ROWS = 8_000
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
SPACE = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
LEAST_DOCS, LEAST_Z = 4, 5.0
L2, COUNTERFACTUAL, STEPS = 2e-4, 1.0, 300
CACHED_WORDS = 200_000

TOKEN = re.compile(rb"[a-z\x80-\xff]+")
#: Names of groups that are swapped for each other.
IDENTITY = (
    "women men woman man girls boys muslims christians jews hindus buddhists atheists muslim "
    "christian jewish hindu gay lesbian straight trans bisexual black white asian latino african "
    "european american immigrants refugees foreigners natives disabled blind deaf old young"
).split()
_NEXT = {a.encode(): b.encode() for a, b in zip(IDENTITY, IDENTITY[1:] + IDENTITY[:1])}


def word_features(word: bytes) -> tuple[int, ...]:
    """The word and its beginnings as places in the feature space."""
    parts = [word] + [b"^" + word[:n] for n in PREFIXES if len(word) > n]
    return tuple(zlib.crc32(p) & SPACE - 1 for p in parts)


def _words(text: str | None) -> set[bytes]:
    return set(TOKEN.findall(text.encode().lower())) if text else set()


def features(words: set[bytes]) -> np.ndarray:
    return np.unique(np.fromiter((f for w in words for f in word_features(w)), "i4"))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> list:
    """At most about ``max_rows`` labelled rows as (toxic, features, features with names swapped)."""
    known = labels.filter(
        F.col("toxic").isNotNull()
        & F.col("doc_id").isNotNull()
        & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    ).select("doc_id", "toxic")
    share = min(1.0, max_rows / max(1, known.count()))
    u = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    picked = known.filter(u < int(share * (1 << 30)))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, swapped = [], []
            for text in batch["text"]:
                words = _words(text)
                own.append(features(words).tobytes())
                named = words & _NEXT.keys()
                other = (words - named) | {_NEXT[w] for w in named}
                swapped.append(features(other).tobytes() if named else None)
            yield pd.DataFrame({"toxic": batch["toxic"], "own": own, "swapped": swapped})

    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return (
        joined.select("toxic", "text")
        .mapInPandas(rows, "toxic int, own binary, swapped binary")
        .collect()
    )


def fit(rows: list) -> tuple[dict[int, float], float]:
    """(weights by feature, bias). Without rows of both classes every text gets the share of toxic
    rows, or 0 without any row."""
    y = np.array([r.toxic for r in rows], "f8") > 0
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    if not len(y) or y.all() or not y.any():
        return {}, math.log(rate / (1 - rate)) if len(y) else -20.0
    own = [np.frombuffer(r.own, "i4") for r in rows]
    hits = [np.zeros(SPACE, "i4"), np.zeros(SPACE, "i4")]
    for c, f in zip(y, own):
        hits[int(c)][f] += 1
    one, zero = y.sum(), (~y).sum()
    pooled = (hits[0] + hits[1]) / len(y)
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / one + 1 / zero))
    z = (hits[1] / one - hits[0] / zero) / spread
    chosen = np.flatnonzero((hits[0] + hits[1] >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z))
    place = np.full(SPACE, -1, "i4")
    place[chosen] = np.arange(len(chosen))

    def matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        kept = [p[p >= 0] for p in (place[s] for s in sets)]
        row = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
        return row, np.concatenate([*kept, np.empty(0, "i4")])

    row, col = matrix(own)
    named = [i for i, r in enumerate(rows) if r.swapped is not None]
    a_row, a_col = matrix([own[i] for i in named])
    b_row, b_col = matrix([np.frombuffer(rows[i].swapped, "i4") for i in named])
    w, bias = np.zeros(len(chosen)), math.log(rate / (1 - rate))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        score = np.bincount(row, w[col], len(y)) + bias
        error = (1 / (1 + np.exp(-score)) - y) / len(y)
        grad = np.bincount(col, error[row], len(w)) + L2 * w
        if named:
            change = np.bincount(a_row, w[a_col], len(named))
            change -= np.bincount(b_row, w[b_col], len(named))
            pull = 2 * COUNTERFACTUAL * change / len(named)
            grad += np.bincount(a_col, pull[a_row], len(w))
            grad -= np.bincount(b_col, pull[b_row], len(w))
        full = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full * full
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return {int(f): float(x) for f, x in zip(chosen, w) if abs(x) > 1e-3}, float(bias)


def score_text(text: str | None, cache: BoundedCache, weights: dict[int, float], bias: float):
    active = set()
    if text:
        for found in map(cache.__getitem__, set(TOKEN.findall(text.encode().lower()))):
            active.update(found)
    logit = bias + math.fsum(weights[f] for f in active)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS):
    return fit(training_rows(docs, labels, max_rows))


def scorer(spark: SparkSession, weights: dict[int, float], bias: float):
    """A function from a text column to its score."""
    model = spark.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = model.value

        def known(word: bytes) -> tuple[int, ...]:
            return tuple(f for f in word_features(word) if f in weights)

        cache = BoundedCache(known, CACHED_WORDS)
        for texts in batches:
            yield pd.Series([score_text(t, cache, weights, bias) for t in texts], dtype="f8")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; repeated rows and null ids included.
    Only the text enters a score; null and empty texts get that of a text without features.
    Held-out rows are those whose crc32 of the id is 1 modulo 3; they are never learned from."""
    score = scorer(docs.sparkSession, *train(docs, labels, max_rows))
    return docs.select(
        "doc_id",
        (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        score(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
