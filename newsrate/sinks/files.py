"""Appending CSV and line files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsrate.functions.text import to_line
from newsrate.schemas import TIME_FORMAT

# Keeps files to a moderate size for readers that take one with line breaks as one split.
ROWS_PER_FILE = 1_000_000


def _as_text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    is_time = isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType))
    text = F.date_format(name, TIME_FORMAT) if is_time else F.col(name).cast("string")
    return F.coalesce(text, F.lit(""))


def csv_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exactly ``cols`` as text: extra fields ignored, missing ones empty."""
    return df.select(*[_as_text(df, c).alias(c) for c in cols])


def append_csv(df: DataFrame, path: str, cols: list[str]) -> None:
    (
        csv_columns(df, cols)
        .write.mode("append")
        .option("header", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .csv(path)
    )


def append_text(df: DataFrame, path: str, col: str = "value") -> None:
    df.select(F.col(col).alias("value")).write.mode("append").text(path)


def append_predictions(df: DataFrame, path: str) -> None:
    """One line per scored row: the original line, its pair and its rating."""
    line = to_line(F.col("value"), F.col("tp"), F.col("label"))
    append_text(df.select(line.alias("value")), path)
