"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source is a stream of words: its documents end to end in a seeded order, twice at most. The
stream is cut into blocks of equal words. Seats (blocks of the mix) go to the sources by the
highest quotients target / (2 i + 1); with as many seats as quotients reach ``block_words / 2``
a source gets round(target / block_words) of them, and as the method is house-monotone every
prefix of shards is such an apportionment too, so each shard has integer quotas. The seats of a
source take its blocks in the seeded order.

Everything is DataFrame operations. Places in a stream are sums over small, ordered groups of a
source plus sums within a group, so no source is ever held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsrate.llm.common import WORD, stored
from newsrate.operators.lookup import unique_side_join

WEIGHTS = (3, 1, 2)
RATE = 1.5
CAP = 2
BLOCK_WORDS = 16
GROUP_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, rate: float = RATE, cap: int = CAP
) -> DataFrame:
    """(source, source_size, target): the sources by code point, null last, weigh ``weights`` in
    turn and share ``rate`` times all words; a target stops at ``cap`` times its source, the
    excess goes to the others by weight until none is above. All sizes 0: all targets 0.

    That is a water level L with target = min(cap * size, L * weight); with the sources ordered
    by cap / weight, L is the largest of the levels at which a prefix of them is full. The
    windows here have one row per source.
    """
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")
    )
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sources.select(
        "*",
        F.get(F.array(*[F.lit(float(w)) for w in weights]), turn % len(weights)).alias("_w"),
        (F.col("source_size") * cap).cast("double").alias("_cap"),
    )
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    onward = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = onward.rowsBetween(Window.unboundedPreceding, -1)
    after = onward.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * rate
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    return (
        ranked.withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(every))
        .select(
            "source",
            "source_size",
            "source_rows",
            F.least(F.col("_cap"), F.col("_level") * F.col("_w")).alias("target"),
        )
    )


def quota(target: Column, block_words: int = BLOCK_WORDS) -> Column:
    """Seats of a source: those i whose quotient target / (2 i + 1) is at least half a block."""
    return F.floor(target / block_words + 0.5)


def shard_quotas(
    targets: DataFrame, shards: int, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(source, shard, quota): seat i stands at (i + 1/2) block_words / target of the mix, the
    order of the highest quotients; shard h has the seats from h / shards on."""
    upto = F.floor(F.col("target") * (F.col("shard") + 1) / (block_words * shards) + 0.5)
    since = F.floor(F.col("target") * F.col("shard") / (block_words * shards) + 0.5)
    return targets.withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    ).select("source", "shard", (upto - since).cast("long").alias("quota"))


def mix(
    docs: DataFrame,
    seed: int = 7,
    block_words: int = BLOCK_WORDS,
    weights: tuple[int, ...] = WEIGHTS,
    rate: float = RATE,
    cap: int = CAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """(id, size, source_size, target, taken), one row per input row. ``taken`` counts the words
    of the document in the mix, repeats included, ``cap`` times its size at most. Null texts have
    no words; a null source is a source; null ids and repeated rows are documents of their own,
    ordered by their hash, size and a hash of the text. The same rows give the same result.
    ``row_col``, a unique key of the rows, is returned too."""
    row = [] if row_col is None else [row_col]
    text, key = F.col(text_col), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    sized = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(text).alias("size"),
            F.md5(F.concat_ws(":", F.lit(str(seed)), key)).alias("place"),
            F.xxhash64(text).alias("tie"),
            *row,
        ),
        "mix-sizes",
    )
    targets = stored(source_targets(sized, weights, rate, cap), "mix-targets").withColumn(
        "key", source_key(F.col("source"))
    )
    side = targets.select("key", "source_size", "source_rows", "target")
    rows = unique_side_join(
        sized.withColumn("key", source_key(F.col("source"))), side, ["key"], "left"
    )
    # Groups follow the order of the hash, so that whole groups come before others.
    groups = F.ceil(F.col("source_rows") / GROUP_ROWS)
    share = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("group", F.floor(share * groups))
    sums = rows.groupBy("key", "group").agg(F.sum("size").alias("_n"))
    earlier = (
        Window.partitionBy("key").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sums.select(
        "key", "group", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    inside = (
        Window.partitionBy("key", "group")
        .orderBy("place", "doc_id", "size", "tie", *row)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = rows.withColumn("_end", F.sum("size").over(inside)).join(starts, ["key", "group"])
    start = F.col("_start") + F.col("_end") - F.col("size")
    wanted = F.least(
        quota(F.col("target"), block_words) * block_words, F.col("source_size") * cap
    )
    copies = [
        F.greatest(F.lit(0), F.least(F.col("size"), wanted - start - F.col("source_size") * c))
        for c in range(cap)
    ]
    taken = copies[0]
    for c in copies[1:]:
        taken = taken + c
    return placed.select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target",
        taken.cast("long").alias("taken"), *row,
    )
