"""First-per-key, take-while, global positions, shuffling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsrate.operators.lookup import BROADCAST_ROWS, HOT_ROWS, is_small, spread_join
from newsrate.session import write_table


def keep_first(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """The first row per key. A ``min`` over (order, row) instead of ``row_number``: it
    combines before the shuffle, so copies of a hot key never travel, and ties are decided
    by the row itself."""
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys and c not in orders]
    value = F.struct(*[c for c in orders if c not in keys], *rest)
    first = df.groupBy(*keys).agg(F.min(value).alias("_first"))
    fields = [F.col(c) if c in keys else F.col(f"_first.`{c}`").alias(c) for c in df.columns]
    return first.select(*fields)


dedup = keep_first


def before_first(df: DataFrame, order: list[str], stops: DataFrame) -> DataFrame:
    """Rows of ``df`` that come before the first row of ``stops``."""
    position = F.struct(*order)
    stop = stops.agg(F.min(position)).scalar()
    return df.filter(F.coalesce(position < stop, F.lit(True)))


def take_while(df: DataFrame, order_cols: list[str], stop: Column) -> DataFrame:
    """Rows before the first stop row in feed order: one aggregate, then a filter."""
    return before_first(df, order_cols, df.filter(stop))


def since(
    df: DataFrame,
    time_col: str,
    cutoff,
    mode: str = "intended",
    order_cols: list[str] | None = None,
) -> DataFrame:
    """Rows after ``cutoff``. ``compat`` reads in feed order and ends at the first older row."""
    if mode == "compat":
        return take_while(df, order_cols or ["page", "pos"], F.col(time_col) <= F.lit(cutoff))
    return df.filter(F.col(time_col) > F.lit(cutoff))


def _file_number(file: tuple[str, int]) -> tuple[int, str]:
    """Written files by their task number; as text, part-100000 would come before part-99999."""
    return int(file[0].split("part-")[1].split("-")[0]), file[0]


def global_position(
    df: DataFrame,
    order: list[str],
    by: list[str] | None = None,
    limit: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``position``, the 0-based rank by ``order`` (a unique key) inside ``by``.

    The rows are range-sorted into a written table; a row's rank is its index in its file
    plus the rows of the files before it. The first rank of each group is broadcast while the
    groups are few; beyond ``limit`` groups the rows of those with more than ``hot_rows`` are
    spread. No task ever holds a whole group.
    """
    by = by or []
    stored = write_table(df.orderBy(*by, *order), "sorted")
    placed = stored.select(
        *df.columns,
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    # One row per written file.
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows")).collect()
    offsets, total = [], 0
    for name, rows in sorted(((r["_file"], r["_rows"]) for r in sizes), key=_file_number):
        offsets.append((name, total))
        total += rows
    starts = df.sparkSession.createDataFrame(offsets, "_file string, _offset bigint")
    ranked = placed.join(F.broadcast(starts), "_file").withColumn(
        "_global", F.col("_offset") + F.col("_row")
    )
    if not by:
        return ranked.select(*df.columns, F.col("_global").alias("position"))
    # As JSON, a missing part of the key is a value of its own.
    keyed = ranked.withColumn("_group", F.to_json(F.struct(*by)))
    first = write_table(
        keyed.groupBy("_group").agg(
            F.min("_global").alias("_base"), F.count(F.lit(1)).alias("_weight")
        ),
        "groups",
    )
    if is_small(first, limit):
        placed = keyed.join(F.broadcast(first), "_group")
    else:
        placed = spread_join(keyed, first, ["_group"], "_weight", hot_rows)
    return placed.select(*df.columns, (F.col("_global") - F.col("_base")).alias("position"))


def batch_number(
    df: DataFrame, n: int, order: list[str], by: list[str] | None = None
) -> DataFrame:
    """Add ``batch``: consecutive groups of ``n`` rows by ``order`` inside ``by``."""
    placed = global_position(df, order, by)
    return placed.withColumn("batch", F.floor(F.col("position") / n)).drop("position")


def shuffle_key(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def seeded_shuffle(df: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """A repeatable random order: a range sort by a seeded hash of the key. Rows of one key are
    ordered by their other columns; exact copies, which are interchangeable, by task number, so
    that many of them do not end up in one range."""
    atomic = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    return df.orderBy(shuffle_key(seed, key), *atomic, F.spark_partition_id())


def union_pages(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out
