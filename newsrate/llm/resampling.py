"""Importance resampling towards a target distribution.

The library's pre-tokeniser, an untrained regular expression ``Split``, returns the words of an
ASCII-lowered text with their offsets. A window over neighbouring offset pairs is a feature: one word,
or several joined by one space. Features fall into buckets by CRC-32; the share of each bucket in the
target against that in the documents is its gain. A document's weight is the mean gain of its features,
and documents are drawn without replacement by weight plus Gumbel noise from a hash of their id.

Texts are pre-tokenised once: the buckets of each document are stored, two bytes a feature, and both
the histogram and the weights are read from there. Only histograms of ``BUCKETS`` numbers are
broadcast or reach the driver, and the ranks come from a range sort, so no task holds all rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from newsrate.llm.common import stored
from newsrate.operators.ordering import global_position

#: A word, for the pre-tokeniser's regular expressions.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST = 2
SEED = 7
LEAST_WORDS, DRAW_PERCENT = 20, 25
SCALE = 1000


def splitter():
    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def feature_buckets(split, text: str | None, buckets: int, longest: int) -> tuple[int, np.ndarray]:
    """(number of words, buckets of all runs of 1 to ``longest`` words). A run is a window over
    neighbouring offsets; its CRC continues that of the window without its last word, so no word
    is read twice."""
    if not text:
        return 0, np.empty(0, "u2")
    lowered = text.encode().lower().decode()
    offsets = [span for _, span in split.pre_tokenize_str(lowered)]
    pieces = [lowered[start:end].encode() for start, end in offsets]
    spaced = [b" " + w for w in pieces]
    crc = zlib.crc32
    runs = list(map(crc, pieces))
    found = [runs]
    for n in range(1, longest):
        runs = list(map(crc, spaced[n:], runs))
        found.append(runs)
    out = np.concatenate([np.array(r, "u4") for r in found]) % np.uint32(buckets)
    return len(pieces), out.astype("u2")


def bucketed(key: Column, text: Column, docs: DataFrame, buckets: int, longest: int) -> DataFrame:
    """(doc_id, n_words, buckets) with the buckets as unsigned 16-bit integers."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are stored in 16 bits")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in batches:
            found = [
                feature_buckets(split, t.as_py(), buckets, longest) for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([b.tobytes() for _, b in found], pa.binary()),
                ],
                ["doc_id", "n_words", "buckets"],
            )

    source = docs.select(key.cast("long").alias("doc_id"), text.alias("text"))
    return source.mapInArrow(rows, "doc_id long, n_words long, buckets binary")


def _bucket_arrays(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for b in batch.column(batch.schema.get_field_index("buckets")):
        yield np.frombuffer(b.as_buffer(), "u2")


def histogram(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket: every task counts its own rows, the counts are added up in Spark."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, "i8")
        for batch in batches:
            for found in _bucket_arrays(batch):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    parts = rows.select("buckets").mapInArrow(counts, "bucket long, n long")
    out = np.zeros(buckets, "i8")
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets``
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the source, smoothed by one
    feature a bucket."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = (
        (t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))
        for s, t in zip(source.tolist(), target.tolist())
    )
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio], "i8")


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from a hash of the key; a null key counts as the empty text."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    least_words: int = LEAST_WORDS,
    percent: int = DRAW_PERCENT,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs``; ``target`` has a
    column of that name for its texts.

    Null, empty and wordless texts have no feature, weight 0 and no rank. An empty target, or empty
    documents, leave the gains to the smoothing. Repeated rows are rows of their own: they get
    equal scores and following ranks. Rows with a null id get the noise of an empty id and come after
    all others of their score. Rank is null for rows that are too short or not drawn."""
    text = F.col(text_col)
    rows = stored(bucketed(F.col(id_col), text, docs, buckets, longest), "buckets")
    wanted = bucketed(F.lit(None), text, target, buckets, longest)
    gain = gains(histogram(wanted, buckets), histogram(rows, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @F.arrow_udf("long")
    def weight(found: pa.Array) -> pa.Array:
        table = shared.value
        arrays = (np.frombuffer(b.as_buffer(), "u2") for b in found)
        return pa.array([int(table[a].sum()) // len(a) if len(a) else 0 for a in arrays], pa.int64())

    weighted = rows.select(
        "doc_id",
        "n_words",
        (F.octet_length("buckets") / 2).cast("long").alias("n_features"),
        weight("buckets").alias("weight"),
    ).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = stored(weighted, "weights")
    long_enough = F.col("n_words") >= least_words
    drawn = scored.filter(long_enough).count() * percent // 100
    order = scored.filter(long_enough).select(
        "doc_id", "n_features", "weight", "score",
        (-F.col("score")).alias("_rarity"), F.col("doc_id").isNull().alias("_last"),
    )
    ranked = global_position(order, ["_rarity", "_last", "doc_id"])
    columns = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("position") < drawn, F.col("position") + 1)
    return ranked.select(*columns, rank.alias("rank")).union(
        scored.filter(~long_enough).select(*columns, F.lit(None).cast("long").alias("rank"))
    )
