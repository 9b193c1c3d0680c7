"""CSV and line files, and the train/validation split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsrate.functions.binding import bind
from newsrate.functions.text import split_fields, trunc_int
from newsrate.schemas import MARKED_COLUMNS, NEWS, TIME_FORMAT
from newsrate.sources.records import csv_records


_CSV = {"header": "false", "quote": '"', "escape": '"', "timestampFormat": TIME_FORMAT}


def read_news_csv(
    spark: SparkSession, path: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(news, bad records) of header-less eight-column CSV. A record with another number of
    fields, or with a field that its type can not hold, is bad: (value, status), never shifted.

    Quoted fields may span lines; a large file is read by many tasks all the same. Pass
    ``multi_line=False`` for files without line breaks in fields, which are then scanned once."""
    schema = T.StructType([*NEWS.fields, T.StructField("_record", T.StringType())])
    options = {**_CSV, "columnNameOfCorruptRecord": "_record"}
    if multi_line:
        row = F.from_csv("value", schema.toDDL(), options)
        read = bind(csv_records(spark, path), _row=row).select("_row.*")
    else:
        read = spark.read.schema(schema).options(**options).option("columnPruning", False).csv(path)
        # Always true. A field that a query does not need is not parsed, and its fault not found.
        read = read.filter(F.abs(F.hash(*NEWS.fieldNames()).cast("bigint")) >= 0)
    record = F.col("_record")
    good = read.filter(record.isNull()).drop("_record")
    bad = read.filter(record.isNotNull()).select(
        record.alias("value"), F.lit("record").alias("status")
    )
    return good, bad


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as ``value``; ``\\r``, ``\\n`` and ``\\r\\n`` end a line."""
    return spark.read.text(path)


def marked_fields(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(title, description, tp and rate of twelve-field lines, other lines with a status);
    ``rate`` is NULL if unparsable."""
    split = bind(lines, _fields=split_fields(F.col(col), strip=True))
    field = {c: F.get(F.col("_fields"), F.lit(i)) for i, c in enumerate(MARKED_COLUMNS)}
    whole = F.coalesce(F.size("_fields") == len(MARKED_COLUMNS), F.lit(False))
    good = split.filter(whole).select(
        field["title"].alias("title"),
        field["description"].alias("description"),
        field["tp"].alias("tp"),
        trunc_int(field["rate"]).alias("rate"),
    )
    return good, split.filter(~whole).select(F.col(col).alias("value"), F.lit("width").alias("status"))


def read_marked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return marked_fields(read_lines(spark, path))


def split_bucket(key: str, buckets: int = 10) -> Column:
    """0 .. buckets-1 by a hash of the key; the same row always falls in the same bucket."""
    digits = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10)
    return F.pmod(digits.cast("bigint"), F.lit(buckets)).cast("int")


def train_valid(
    df: DataFrame, by_hash: str = "id", valid_buckets: int = 1, buckets: int = 10
) -> tuple[DataFrame, DataFrame]:
    """(train, valid) by key hash."""
    bucket = split_bucket(by_hash, buckets)
    return df.filter(bucket >= valid_buckets), df.filter(bucket < valid_buckets)
