"""Vocabulary and fixed-length encoding."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsrate.functions.binding import bind
from newsrate.functions.text import tokens
from newsrate.operators.lookup import (
    BROADCAST_BYTES,
    HOT_ROWS,
    is_small,
    spread_join,
    unique_side_join,
)
from newsrate.operators.ordering import global_position
from newsrate.session import write_table

# Ids of padding, unknown word, start and end marker; words follow.
PAD_ID, UNKNOWN_ID, START_ID, END_ID, FIRST_WORD_ID = 0, 100, 101, 102, 106
MAX_LEN = 256
# Words that travel with the tasks; what bounds them is the size of a broadcast, in bytes.
VOCABULARY_ROWS = 2_000_000
# Parts of a large vocabulary's ids that are counted to see how many words may travel.
ID_SPANS = 1024


def build_vocabulary(df: DataFrame, col: str, size: int | None = None) -> DataFrame:
    """All tokens, or the ``size`` most frequent ones, as (token, token_id); ties by token.

    A word count, combined before its shuffle, and a rank from a range sort of the words.
    """
    counts = (
        df.select(F.explode(tokens(F.col(col))).alias("token")).groupBy("token").count()
    )
    rarity = counts.select((-F.col("count")).alias("rarity"), "token")
    ranked = global_position(rarity, ["rarity", "token"])
    if size is not None:
        ranked = ranked.filter(F.col("position") < size)
    return ranked.select("token", (F.col("position") + FIRST_WORD_ID).cast("int").alias("token_id"))


def _travelling(words: DataFrame, limit: int) -> int | None:
    """The smallest id of the words that do not travel with the tasks: those before it are as many as
    a broadcast may hold, and in a vocabulary by frequency nearly all that texts contain. Ids are
    counted in ``ID_SPANS`` equal spans, and whole spans are taken. None if all words travel."""
    low, high = words.agg(F.min("token_id").cast("bigint"), F.max("token_id").cast("bigint")).first()
    if low is None:
        return None
    width = (high - low) // ID_SPANS + 1
    span = F.floor((F.col("token_id") - F.lit(low)) / F.lit(width))
    used = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    known = words.filter(F.col("token_id").isNotNull())
    spans = known.groupBy(span.alias("span")).agg(F.count(F.lit(1)).alias("n"), used.alias("used"))
    n = size = 0
    for row in spans.orderBy("span").collect():  # at most ID_SPANS rows
        n, size = n + row.n, size + row.used
        if n > limit or size > BROADCAST_BYTES:
            return low + row.span * width
    return None


def _look_up(words: pa.Table, col: Column) -> Column:
    """Token ids of an array of tokens, by one hash look-up per Arrow batch; null for other words."""
    known = words["token"].combine_chunks()
    ids = words["token_id"].cast("int32").combine_chunks()

    @F.arrow_udf("array<int>")
    def look_up(batch: pa.Array) -> pa.Array:
        found = ids.take(pc.index_in(batch.flatten(), value_set=known.cast(batch.type.value_type)))
        ends = pc.cumulative_sum(pc.list_value_length(batch))
        offsets = pa.concat_arrays([pa.array([0], ends.type), ends])
        return pa.ListArray.from_arrays(offsets, found)

    return look_up(col)


def _pad(ids: Column, max_len: int) -> dict[str, Column]:
    size = F.size(ids)
    missing = F.lit(max_len) - size
    return {
        "input_ids": F.concat(ids, F.array_repeat(F.lit(PAD_ID), missing)),
        "token_type_ids": F.array_repeat(F.lit(0), max_len),
        "attention_mask": F.concat(
            F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), missing)
        ),
    }


def encode_text(
    df: DataFrame,
    col: str,
    vocab: DataFrame,
    max_len: int = MAX_LEN,
    limit: int = VOCABULARY_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``n_tokens``, all tokens of the text, and ``input_ids``, ``token_type_ids`` and
    ``attention_mask`` of length ``max_len``.

    Tokens beyond ``max_len - 2`` are cut off, as the fixed length demands; ``n_tokens`` shows
    it. ``vocab`` should be a stored table. Up to ``limit`` words of 64 MB in all travel with
    the tasks and nothing is shuffled; of a larger vocabulary those with the smallest ids do, and
    the others are joined to the tokens that are then left of the distinct texts. Texts are told
    apart by 128 bits of their SHA-256, so none is a key of a shuffle.
    """
    split = bind(df, _all=F.coalesce(tokens(F.col(col)), F.array().cast("array<string>")))
    counted = split.withColumns(
        {"n_tokens": F.size("_all"), "_kept": F.slice("_all", 1, max_len - 2)}
    ).drop("_all")
    words = vocab.select("token", "token_id")
    rest = _travelling(words, limit)
    near = words if rest is None else words.filter(F.col("token_id") < rest)
    coded = bind(counted, _ids=_look_up(near.toArrow(), F.col("_kept")))
    unknown = F.lit(UNKNOWN_ID)
    if rest is None:
        coded = coded.withColumn("_ids", F.transform("_ids", lambda i: F.coalesce(i, unknown)))
    else:
        spot = F.transform("_kept", lambda t, i: F.struct(i.alias("pos"), t.alias("token")))
        coded = coded.withColumns(
            {
                "_key": F.substring(F.unhex(F.sha2(F.col(col), 256)), 1, 16),
                "_left": F.filter(spot, lambda x: F.get("_ids", x["pos"]).isNull()),
            }
        )
        # Each text once, with the number of rows that have it.
        texts = coded.filter(F.size("_left") > 0).groupBy("_key").agg(
            F.first("_left").alias("_left"), F.count(F.lit(1)).alias("_weight")
        )
        spots = write_table(texts.select("_key", "_weight", F.inline("_left")), "left")
        far = words.filter(F.col("token_id") >= rest)
        found = unique_side_join(spots, far, ["token"], "inner", limit, hot_rows)
        pair = F.struct("pos", F.col("token_id").cast("int"))
        more = write_table(
            found.groupBy("_key").agg(
                F.map_from_entries(F.collect_list(pair)).alias("_more"),
                F.first("_weight").alias("_weight"),
            ),
            "coded",
        )
        keyed = coded.drop("_kept", "_left")
        if is_small(more, min(limit, BROADCAST_BYTES // (8 * max_len))):
            joined = keyed.join(F.broadcast(more.drop("_weight")), "_key", "left")
        else:
            joined = spread_join(keyed, more, ["_key"], "_weight", hot_rows)
        ids = F.transform("_ids", lambda i, at: F.coalesce(i, F.element_at("_more", at), unknown))
        coded = joined.withColumn("_ids", ids).drop("_key", "_more")
    coded = coded.drop("_kept")
    marked = F.concat(F.array(F.lit(START_ID)), F.col("_ids"), F.array(F.lit(END_ID)))
    return coded.withColumn("_ids", marked).withColumns(_pad(F.col("_ids"), max_len)).drop("_ids")
