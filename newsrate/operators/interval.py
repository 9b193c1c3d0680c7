"""News against price bars: which bars open in ``[t, t + seconds]``, both ends inclusive.

No (news, bar) pair is ever formed. Time is cut into buckets as long as the window, so a
window is the rest of its own bucket plus the start of the next one. Inside a bucket both
parts are running aggregates over sorted rows, read off at the news times. News are first
reduced to distinct (symbol, second), bars to (symbol, second), so a bucket holds at most
``seconds`` news times and ``2 * seconds`` bar slots however many rows share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsrate.operators.lookup import HOT_ROWS, spread_join

WINDOW_SECONDS = 1200
SUMMARY_COLUMNS = ["n_bars", "first_time", "last_time", "first_open", "high", "low"]


def no_nan(col: Column) -> Column:
    return F.nanvl(col, F.lit(None).cast("double"))


def unique_bars(bars: DataFrame) -> DataFrame:
    """One row per (symbol, open_time): landed bar pages overlap."""
    return bars.groupBy("symbol", "open_time").agg(
        F.min(no_nan(F.col("open"))).alias("open"),
        F.max(no_nan(F.col("high"))).alias("high"),
        F.min(no_nan(F.col("low"))).alias("low"),
    )


def _bucket(second: Column, seconds: int) -> Column:
    return second - F.pmod(second, F.lit(seconds))


def bar_slots(bars: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Bars reduced to (symbol, half-second position): even = opens on the full second."""
    micros = F.unix_micros("open_time")
    on_second = F.pmod(micros, F.lit(1_000_000)) == 0
    return (
        bars.withColumn("_second", F.unix_seconds("open_time"))
        .withColumn("_bucket", _bucket(F.col("_second"), seconds))
        .withColumn("_pos", F.col("_second") * 2 + F.when(on_second, 0).otherwise(1))
        .groupBy("symbol", "_bucket", "_pos")
        .agg(
            F.count(F.lit(1)).alias("n_bars"),
            F.min("open_time").alias("first_time"),
            F.max("open_time").alias("last_time"),
            F.min_by(no_nan(F.col("open")), "open_time").alias("first_open"),
            F.max(no_nan(F.col("high"))).alias("high"),
            F.min(no_nan(F.col("low"))).alias("low"),
        )
    )


def _merge() -> dict[str, Column]:
    """How the summaries of parts of a window combine."""
    return {
        "n_bars": F.sum("n_bars"),
        "first_time": F.min("first_time"),
        "last_time": F.max("last_time"),
        "first_open": F.min_by("first_open", "first_time"),
        "high": F.max("high"),
        "low": F.min("low"),
    }


def window_summaries(starts: DataFrame, bars: DataFrame, seconds: int) -> DataFrame:
    """``starts``: distinct (symbol, _start, _rows). Adds the bar summary of each window."""
    start = F.col("_start")
    rest = F.struct(
        _bucket(start, seconds).alias("_bucket"),
        F.lit("rest").alias("_part"),
        (-2 * start).alias("_key"),
    )
    head = F.struct(
        (_bucket(start, seconds) + seconds).alias("_bucket"),
        F.lit("head").alias("_part"),
        (2 * (start + seconds)).alias("_key"),
    )
    probes = starts.select("symbol", "_start", "_rows", F.inline(F.array(rest, head)))
    # Each bar slot serves both parts: read backwards for the rest, forwards for the head.
    slots = bar_slots(bars, seconds).select(
        "symbol",
        "_bucket",
        F.inline(
            F.array(
                F.struct(F.lit("rest").alias("_part"), (-F.col("_pos")).alias("_key")),
                F.struct(F.lit("head").alias("_part"), F.col("_pos").alias("_key")),
            )
        ),
        *SUMMARY_COLUMNS,
    )
    # At equal keys NULL sorts first, so the bars of a key precede the probe that includes them.
    running = (
        W.partitionBy("symbol", "_bucket", "_part")
        .orderBy("_key", F.col("_start").asc_nulls_first())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    halves = (
        slots.unionByName(probes, allowMissingColumns=True)
        .select("symbol", "_start", "_rows", *[c.over(running).alias(m) for m, c in _merge().items()])
        .filter(F.col("_start").isNotNull())
    )
    return halves.groupBy("symbol", "_start").agg(
        F.max("_rows").alias("_rows"), *[c.alias(m) for m, c in _merge().items()]
    )


def interval_join(
    news: DataFrame,
    bars: DataFrame,
    seconds: int = WINDOW_SECONDS,
    symbol: str = "symbol",
    time: str = "inputtime",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left interval join: every news row plus the summary of the bars in its window.

    ``bars``: symbol, open_time, open, high, low; unique by (symbol, open_time). News without
    bars keep ``n_bars = 0`` and NULL prices. News times count in whole seconds.
    """
    keyed = news.withColumn("_symbol", F.col(symbol)).withColumn(
        "_start", F.unix_seconds(F.col(time).cast("timestamp"))
    )
    starts = (
        keyed.filter(F.col("_symbol").isNotNull() & F.col("_start").isNotNull())
        .groupBy(F.col("_symbol").alias("symbol"), "_start")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    summary = window_summaries(starts, bars, seconds).withColumnRenamed("symbol", "_symbol")
    joined = spread_join(keyed, summary, ["_symbol", "_start"], "_rows", hot_rows)
    return joined.select(
        *news.columns,
        F.coalesce("n_bars", F.lit(0)).cast("bigint").alias("n_bars"),
        *SUMMARY_COLUMNS[1:],
    )


def first_bar_after(joined: DataFrame, key: str = "id") -> DataFrame:
    """Forward as-of: the first bar at or after the news, inside the window."""
    return joined.select(key, "first_time", "first_open")


def bar_summary(joined: DataFrame, key: str = "id") -> DataFrame:
    return joined.select(key, "first_open", "high", "low", "n_bars")
