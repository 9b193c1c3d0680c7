"""Insert-if-absent into a Parquet table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from newsrate.operators.lookup import not_in_target
from newsrate.operators.ordering import keep_first


def absent_rows(
    new: DataFrame, target: DataFrame, key: str = "id", order: str | list[str] = "inputtime"
) -> DataFrame:
    """The rows to insert: the first row per key, for keys not in ``target``. Stored keys leave
    before whole rows are compared. Both steps use the same partitioning by ``key``; of the
    target only the key column is read. A row without a key can not be told from another one
    and is never inserted."""
    keyed = new.filter(F.col(key).isNotNull())
    return keep_first(not_in_target(keyed, target, key), key, order)


def read_keys(df: DataFrame, path: str, key: str) -> DataFrame:
    """The keys of the table at ``path``; empty when nothing was written yet."""
    spark = df.sparkSession
    schema = df.select(key).schema
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def insert_if_absent(
    new: DataFrame,
    target: str,
    key: str = "id",
    order: str | list[str] = "inputtime",
    prune: bool = True,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Append the rows whose key is new and return their number; stored rows never change.

    Running the same batch again inserts nothing, so a failed job is simply repeated. One
    writer per table. With ``prune`` the key range of the batch reaches the scan of the target
    as a filter: batches of recent keys skip the older row groups. The range binds the batch
    too, which is read again: a row that its source has got since waits for the next run.
    ``prepare`` computes further columns of the rows that are inserted, and of no others.
    """
    stored = read_keys(new, target, key)
    if prune:
        low, high = new.agg(F.min(key), F.max(key)).first()
        if low is None:
            return 0
        inside = F.col(key).between(low, high)
        stored, new = stored.filter(inside), new.filter(inside)
    rows = absent_rows(new, stored, key, order)
    if prepare is not None:
        rows = prepare(rows)
    counted = Observation()
    rows.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(target)
    return counted.get["n"]
