"""Ingest, dedup, insert, label and rate as streams. The row logic is that of the batch jobs;
a checkpoint takes the place of the time cutoff."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsrate.functions.rating import price_move, price_rating
from newsrate.lexicon import DEFAULT_LEXICON
from newsrate.operators.interval import WINDOW_SECONDS, no_nan
from newsrate.operators.ordering import since
from newsrate.plans.jobs import feed_rows, label_news
from newsrate.schemas import NEWS_COLUMNS
from newsrate.sinks.tables import insert_if_absent


# Take what is there and stop; pass e.g. {"processingTime": "1 minute"} to keep running.
ONCE = {"availableNow": True}


def start_append(
    df: DataFrame, path: str, checkpoint: str, trigger: dict = ONCE
) -> StreamingQuery:
    """Append to a Parquet table."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stream_ingest(
    pages: DataFrame,
    sink: str,
    checkpoint: str,
    cutoff: str | None = None,
    trigger: dict = ONCE,
) -> StreamingQuery:
    """New landed pages -> clean news rows, each id once however often its page is polled, newer
    than ``cutoff`` (time text) if given. A poll lands no page after its first empty one."""
    rows = feed_rows(pages)
    if cutoff is not None:
        rows = since(rows, "inputtime", cutoff)
    rows = rows.filter(F.col("inputtime").isNotNull())
    return stream_insert(rows.select(*NEWS_COLUMNS), sink, checkpoint, trigger=trigger)


def stream_dedup(df: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """One row per key within ``delay``. A first pass per (key, input task) thins out the
    copies of a hot key before they meet in one task."""
    marked = df.withWatermark(time, delay).withColumn(
        "_task", F.pmod(F.spark_partition_id(), F.lit(16))
    )
    thinned = marked.dropDuplicatesWithinWatermark([key, "_task"]).drop("_task")
    return thinned.dropDuplicatesWithinWatermark([key])


def stream_insert(
    df: DataFrame,
    target: str,
    checkpoint: str,
    key: str = "id",
    order: str = "inputtime",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    trigger: dict = ONCE,
) -> StreamingQuery:
    """Insert-if-absent per micro-batch; a batch that is replayed inserts nothing twice."""

    def insert(rows: DataFrame, _: int) -> None:
        insert_if_absent(rows, target, key, order, prepare=prepare)

    return (
        df.writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stream_label(
    df: DataFrame, lexicon: dict[str, str] = DEFAULT_LEXICON, mode: str = "intended"
) -> DataFrame:
    return label_news(df, lexicon, mode)


#: Bars are summed up by second and by this many seconds.
SPAN = 60


def _units(start: Column, seconds: int) -> Column:
    """The whole spans, and the single seconds before and after them, that make up the window from
    ``start`` on: an array of (span, unit)."""
    last = start + seconds
    first_span = F.ceil(start / SPAN)
    end_span = F.floor(last / SPAN)
    none = F.array().cast("array<bigint>")

    def numbers(wanted: Column, low: Column, high: Column) -> Column:
        return F.when(wanted, F.sequence(low, high)).otherwise(none)

    before = numbers(start < first_span * SPAN, start, F.least(first_span * SPAN - 1, last))
    spans = numbers(first_span < end_span, first_span, end_span - 1)
    after = numbers(first_span <= end_span, end_span * SPAN, last)

    def units(of: Column, span: int) -> Column:
        return F.transform(of, lambda u: F.struct(F.lit(span).alias("span"), u.alias("unit")))

    return F.concat(units(before, 1), units(spans, SPAN), units(after, 1))


def _bar_units(bars: DataFrame, delay: str) -> DataFrame:
    """Bars summed up by second (those on the full second apart from the others) and by span."""
    second = F.unix_seconds("open_time")
    full = F.pmod(F.unix_micros("open_time"), F.lit(1_000_000)) == 0

    def unit(span: int, number: Column, last: Column) -> Column:
        return F.struct(
            F.lit(span).alias("bar_span"), number.alias("bar_unit"), last.alias("last_second")
        )

    of_span = F.floor(second / SPAN)
    both = F.array(
        unit(1, second, second + F.when(full, 0).otherwise(1)),
        unit(SPAN, of_span, (of_span + 1) * SPAN),
    )
    summed = (
        bars.withWatermark("open_time", delay)
        .select("*", F.inline(both))
        .groupBy(
            F.window("open_time", f"{SPAN} seconds"),
            F.col("symbol").alias("bar_symbol"),
            "bar_span",
            "bar_unit",
            "last_second",
        )
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("open_time").alias("first_time"),
            F.min_by(no_nan(F.col("open")), "open_time").alias("first_open"),
            F.max(no_nan(F.col("high"))).alias("high"),
            F.min(no_nan(F.col("low"))).alias("low"),
        )
    )
    return summed.select(F.window_time("window").alias("bar_time"), *summed.columns[1:])


def stream_interval(
    news: DataFrame, bars: DataFrame, seconds: int = WINDOW_SECONDS, delay: str = "10 minutes"
) -> DataFrame:
    """Price rating of each news row once its window is complete.

    ``news``: id, symbol, inputtime (whole seconds count); ``bars``: symbol, open_time, open,
    high, low. Four stateful steps, the watermark drops the state of each:

    1. News become distinct (symbol, second), bars become sums by second and by ``SPAN``.
    2. Every second asks for the units of its window, some 140, each by its own key: the join is one
       on equal keys, without a range and without a hot group, and it meets no news row.
    3. What was found is summed up by (symbol, second).
    4. The summary is joined back to the news of its second.
    """
    dated = news.withWatermark("inputtime", delay)
    asked = dated.groupBy(F.window("inputtime", "1 second"), F.col("symbol").alias("of")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    asked = asked.select(
        "of",
        F.unix_seconds("window.start").alias("second"),
        F.window_time("window").alias("asked_time"),
    )
    asked = asked.select("*", F.inline(_units(F.col("second"), seconds)))
    reach = F.expr(f"INTERVAL {int(seconds) + SPAN + 2} SECONDS")
    moment = F.expr("INTERVAL 1 SECOND")
    in_unit = (
        (F.col("of") == F.col("bar_symbol"))
        & (F.col("span") == F.col("bar_span"))
        & (F.col("unit") == F.col("bar_unit"))
        & (F.col("last_second") <= F.col("second") + seconds)
        # On the event times, which bounds the join state.
        & (F.col("bar_time") >= F.col("asked_time") - moment)
        & (F.col("bar_time") <= F.col("asked_time") + reach)
    )
    summary = (
        asked.join(_bar_units(bars, delay), in_unit, "left_outer")
        .groupBy("of", "second", "asked_time")
        .agg(
            F.min_by("first_open", "first_time").alias("first_open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.sum("n").alias("n_bars"),
        )
    )
    own = (
        (F.col("symbol") == F.col("of"))
        & (F.unix_seconds("inputtime") == F.col("second"))
        & (F.col("asked_time") >= F.col("inputtime"))
        & (F.col("asked_time") <= F.col("inputtime") + moment)
    )
    rated = dated.select("id", "symbol", "inputtime").join(summary, own, "left_outer")
    move = price_move(F.col("first_open"), F.col("high"), F.col("low"))
    return rated.select(
        "id",
        "inputtime",
        "first_open",
        "high",
        "low",
        F.coalesce("n_bars", F.lit(0)).alias("n_bars"),
        price_rating(move["rise"], move["drop"]).alias("rate"),
    )
