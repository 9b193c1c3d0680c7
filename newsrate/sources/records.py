"""Records of CSV files whose quoted fields may hold line breaks, read by many tasks a file.

A split of such a file may start inside a quoted field, and whether it does depends on all that comes
before. Every split is therefore first scanned for both cases: the state in which it ends if it starts
outside, and if it starts inside a field. These two-state functions, one row per split, are chained per
file. In the second scan every split starts in its right state. Records that lie in one split are whole;
the parts of the others, at most two a split, are put together by file and split.

The text itself is never shuffled but for those parts. Broadcast is one number for each split that
starts or ends inside a field: 8 bytes for 128 MB of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUOTE, COMMA = '"', ","


def _closing(line: str, at: int) -> int:
    """The place after the quote that closes a field; doubled quotes close nothing. -1 if none."""
    while True:
        at = line.find(QUOTE, at)
        if at < 0:
            return -1
        if line[at + 1 : at + 2] != QUOTE:
            return at + 1
        at += 2


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that starts inside a quoted field, or not, ends inside one. A quote opens a
    field only as its first character; what follows a closing quote counts up to the next comma."""
    if QUOTE not in line:
        return inside
    at = 0
    if inside:
        at = _closing(line, 0)
        if at < 0:
            return True
        at = line.find(COMMA, at) + 1
        if not at:
            return False
    while True:
        if line[at : at + 1] == QUOTE:
            at = _closing(line, at + 1)
            if at < 0:
                return True
        at = line.find(COMMA, at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with their split. A split's lines are consecutive rows, in file order."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("start"),
        "value",
    )


def _key(start: str = "start") -> Column:
    return F.xxhash64("file", start)


def split_states(lines: DataFrame) -> DataFrame:
    """(file, start, inside, ends_inside) of every split with lines."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, from_out, from_in = None, False, True
        for batch in batches:
            done = []
            columns = (batch.column(i).to_pylist() for i in range(3))
            for file, start, line in zip(*columns):
                if (file, start) != here:
                    if here:
                        done.append((*here, from_out, from_in))
                    here, from_out, from_in = (file, start), False, True
                if QUOTE in line:
                    from_out = ends_inside(line, from_out)
                    from_in = ends_inside(line, from_in)
            yield _batch(done, STATE)
        if here:
            yield _batch([(*here, from_out, from_in)], STATE)

    kinds = "file string, start long, from_out boolean, from_in boolean"
    found = lines.mapInArrow(scanned, kinds).groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("start", "from_out", "from_in"))).alias("splits")
    )  # one small struct for each split of a file
    nothing = F.array().cast("array<struct<start:bigint,inside:boolean,ends_inside:boolean>>")
    before = F.struct(F.lit(False).alias("state"), nothing.alias("out"))

    def step(held: Column, split: Column) -> Column:
        state = F.when(held["state"], split["from_in"]).otherwise(split["from_out"])
        row = F.struct(
            split["start"].alias("start"), held["state"].alias("inside"), state.alias("ends_inside")
        )
        return F.struct(state.alias("state"), F.concat(held["out"], F.array(row)).alias("out"))

    chained = F.aggregate("splits", before, step, lambda held: held["out"])
    return found.select("file", F.inline(chained))


STATE = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("from_out", pa.bool_()), ("from_in", pa.bool_())]
)
PART = pa.schema(
    [
        ("file", pa.string()),
        ("start", pa.int64()),
        ("opens", pa.bool_()),
        ("whole", pa.bool_()),
        ("value", pa.string()),
    ]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema
    )


def _parts(lines: DataFrame, whole: bool) -> DataFrame:
    """The whole records of each split, or the parts of records that reach beyond it. ``lines`` has
    ``inside``, the state in which its split starts."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, state, opened = None, [], False, True

        def part(is_whole: bool) -> list[tuple]:
            text = "\n".join(held)
            return [(*here, opened, is_whole, text)] if held and is_whole == whole else []

        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(i).to_pylist() for i in range(4))
            for file, start, line, inside in zip(*columns):
                if (file, start) != here:
                    out += part(False)
                    here, held, state, opened = (file, start), [], inside, not inside
                held.append(line)
                state = ends_inside(line, state)
                if not state:
                    out += part(opened)
                    held, opened = [], True
            yield _batch(out, PART)
        yield _batch(part(False), PART)

    kinds = "file string, start long, opens boolean, whole boolean, value string"
    return lines.mapInArrow(joined, kinds)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the text of each record, line breaks in quoted fields included. Empty lines between
    records are left out; a field that is never closed reaches to the end of its file."""
    lines = _lines(spark, path)
    states = split_states(lines).filter("inside OR ends_inside")
    marks = states.select(_key().alias("_key"), "inside").collect()  # one row per split
    marks = spark.createDataFrame(marks, "_key bigint, inside boolean")
    marked = lines.withColumn("_key", _key()).join(F.broadcast(marks), "_key", "left")
    state = F.coalesce("inside", F.lit(False)).alias("inside")
    whole = _parts(marked.select("file", "start", "value", state), True)
    # Splits that start and end outside of a field have no parts.
    touched = marked.filter(F.col("inside").isNotNull()).select("file", "start", "value", state)
    parts = _parts(touched, False)
    order = W.partitionBy("file").orderBy("start", "opens")
    opener = F.max(F.when(F.col("opens"), F.col("start"))).over(order)
    piece = F.struct("start", "opens", "value")
    together = parts.withColumn("_opener", opener).groupBy("file", "_opener").agg(
        F.array_sort(F.collect_list(piece)).alias("_pieces")
    )
    spanning = together.select(F.array_join(F.col("_pieces")["value"], "\n").alias("value"))
    found = whole.select("value").union(spanning)
    return found.select(F.regexp_replace("value", "\r$", "").alias("value")).filter("value <> ''")
