"""Ratings from votes and from price moves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsrate.schemas import LABELS

# Lower bounds (exclusive) of the vote share for the ratings 2, 1, 0 and -1.
VOTE_BOUNDS = ((0.9, 2), (0.6, 1), (0.45, 0), (0.15, -1))
# Relative price moves for the ratings +-2 and +-1.
STRONG_MOVE = 0.075
WEAK_MOVE = 0.01


def up_ratio(up: Column, down: Column) -> Column:
    """Share of up votes; NULL without votes."""
    votes = up.cast("bigint") + down
    return F.when(votes > 0, up.cast("double") / votes)


def vote_rating(up: Column, down: Column) -> Column:
    """Rating -2..2 from the share of up votes; 0 without votes."""
    share = up_ratio(up, down)
    steps = F.when(up.cast("bigint") + down <= 0, F.lit(0))
    for bound, rating in VOTE_BOUNDS:
        steps = steps.when(share > bound, F.lit(rating))
    return steps.when(share.isNotNull(), F.lit(min(LABELS)))


def price_move(open_: Column, high: Column, low: Column) -> Column:
    """struct(rise, drop) relative to the first price."""
    base = F.nullif(open_, F.lit(0.0))
    return F.struct(((high - base) / base).alias("rise"), ((base - low) / base).alias("drop"))


def price_rating(
    rise: Column, drop: Column, l2: float = STRONG_MOVE, l1: float = WEAK_MOVE
) -> Column:
    """Rating -2..2 from the larger move; a tie counts as a drop; NULL without prices or where a
    price is not a number."""
    unknown = rise.isNull() | drop.isNull() | F.isnan(rise) | F.isnan(drop)
    rated = F.when(unknown, F.lit(None).cast("int"))
    for level, size in ((l2, 2), (l1, 1)):
        rated = rated.when((rise > level) & (rise > drop), F.lit(size))
        rated = rated.when(drop > level, F.lit(-size))
    return rated.otherwise(F.lit(0))


def label_index(rate: Column, labels=LABELS) -> Column:
    """Rating -> class index; NULL for a value outside the list."""
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), rate)
    return F.when(position > 0, (position - 1).cast("int"))


def index_to_rate(index: Column, labels=LABELS) -> Column:
    """Class index -> rating; NULL outside the list."""
    return F.get(F.array(*[F.lit(x) for x in labels]), index.cast("int"))
