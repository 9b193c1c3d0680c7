"""Look-up joins: lexicon, keys already loaded, and a left join that survives hot keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsrate.functions.binding import bind
from newsrate.functions.keywords import folded, listed_pair
from newsrate.functions.text import words

# A broadcast lexicon or hot-key list stays below some tens of MB: by rows and by bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Keys with more left rows than this leave the shuffle of spread_join.
HOT_ROWS = 1_000_000


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    return df.limit(limit + 1).count() <= limit


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` (a stored table: it is read once for this) has at most ``rows`` rows and
    ``size`` bytes."""
    if not fits_broadcast(df, rows):
        return False
    used = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return (used or 0) <= size


def unique_side_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    limit: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join, ``inner`` or ``left``, where ``right`` holds each key once and is cheap to
    count (a stored table).

    A small right side is broadcast. For a larger one the left rows of each key are counted
    (combined before their shuffle), and ``spread_join`` spreads the keys with many.
    """
    if is_small(right, limit):
        return left.join(F.broadcast(right), keys, how)
    weights = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_weight"))
    weighted = right.join(weights, keys).withColumn("_found", F.lit(True))
    joined = spread_join(left, weighted, keys, "_weight", hot_rows)
    return (joined.filter("_found") if how == "inner" else joined).drop("_found")


def lexicon_join(
    df: DataFrame, lexicon: DataFrame, on: str, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Add ``pair`` for the keyword in column ``on`` (case folded); NULL when unknown."""
    side = lexicon.select(F.col("keyword").alias("_kw"), "pair")
    keyed = df.withColumn("_kw", F.lower(F.col(on)))
    return unique_side_join(keyed, side, ["_kw"], "left", limit).drop("_kw")


def lexicon_pairs(
    df: DataFrame, text_col: str, lexicon: DataFrame, key: str = "id", limit: int = BROADCAST_ROWS
) -> DataFrame:
    """(key, pair) of the leftmost hit of a lexicon table in each text: what ``text_pair`` finds, with
    a NULL pair for a hit that has none. Texts without a hit give no row, rows of one key each
    their own.

    Up to ``limit`` rows (and the size of a broadcast) the lexicon is matched by an automaton; of equal
    starts the smallest ``ord`` wins, if there is such a column. Beyond, words are joined, and the
    keywords must be single words."""
    if is_small(lexicon, limit):
        order = "ord" if "ord" in lexicon.columns else "keyword"
        rows = lexicon.select("keyword", "pair", order).orderBy(order).collect()
        pair = listed_pair(F.col(text_col), {r.keyword: r.pair for r in rows if r.keyword})
        return bind(df.select(key, text_col), pair=pair).select(key, "pair").filter(
            F.col("pair").isNull() & F.col(text_col).isNotNull() | (F.col("pair") != "")
        )
    numbered = df.select(key, text_col, F.monotonically_increasing_id().alias("_row"))
    words_ = F.transform(words(F.col(text_col)), lambda w: F.struct(w.alias("word"), folded(w).alias("_kw")))
    found = numbered.select(key, "_row", F.posexplode(F.array_distinct(words_)).alias("_pos", "_word"))
    found = found.select(key, "_row", "_pos", "_word.word", "_word._kw")
    own = F.struct(F.col("keyword").alias("_own"), "pair")
    side = lexicon.groupBy(folded(F.col("keyword")).alias("_kw")).agg(F.max(own).alias("_entry"))
    side = side.select("_kw", "_entry.*")
    hits = unique_side_join(found, side, ["_kw"], "inner", limit)
    own = F.struct(F.when(F.col("word") == F.col("_own"), F.col("pair")).alias("pair"))
    first = hits.groupBy("_row", key).agg(F.min_by(own, "_pos").alias("_hit"))
    return first.select(key, "_hit.pair")


def not_in_target(new: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` whose key is not in ``target``."""
    return new.join(target.select(key), key, "left_anti")


def spread_join(
    left: DataFrame, right: DataFrame, keys: list[str], weight: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join with a ``right`` that is unique by ``keys`` and counts the left rows of each
    key in ``weight`` (dropped).

    At most ``rows(left) / hot_rows`` keys can be hot: they are broadcast, and their left rows
    are spread by task number in the shuffle that joins all other keys, as are rows without a
    key.
    """
    names = [c for c in right.columns if c not in keys and c != weight]
    values = F.struct(*names)
    # The salt of a cold key is its hash on both sides; a constant would be optimised away.
    salt = F.xxhash64(*keys)
    hot = right.filter(F.col(weight) > hot_rows).select(*keys, values.alias("_hot"))
    cold = right.filter(F.col(weight) <= hot_rows).select(
        *keys, salt.alias("_salt"), values.alias("_cold")
    )
    seen = left.join(F.broadcast(hot), keys, "left")
    keyed = reduce(and_, [F.col(k).isNotNull() for k in keys])
    apart = F.when(F.col("_hot").isNull() & keyed, F.lit(0)).otherwise(F.spark_partition_id() + 1)
    salted = seen.withColumn("_salt", salt.bitwiseXOR(apart.cast("bigint")))
    found: Column = F.coalesce("_hot", "_cold")
    return salted.join(cold, keys + ["_salt"], "left").select(
        *left.columns, *[found[c].alias(c) for c in names]
    )
