"""Table layouts and the label list."""

from __future__ import annotations

from pyspark.sql import types as T

NEWS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("inputtime", T.TimestampType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("up_count", T.IntegerType()),
        T.StructField("down_count", T.IntegerType()),
        T.StructField("hits", T.LongType()),
        T.StructField("url", T.StringType()),
    ]
)
NEWS_COLUMNS = NEWS.fieldNames()

NEWS_LABELLED = T.StructType(
    NEWS.fields
    + [
        T.StructField("tp", T.StringType()),
        T.StructField("rate", T.IntegerType()),
        T.StructField("cat", T.IntegerType()),
    ]
)

# Twelve comma fields of a marked row; everything is text until it is checked.
MARKED_COLUMNS = [
    "id",
    "time",
    "title",
    "description",
    "up_count",
    "down_count",
    "hits",
    "url",
    "risk",
    "tp",
    "rate",
    "cat",
]

# Feed items are read as text, so that 7 and "7" are both accepted, and cast afterwards.
FEED_BODY = T.StructType(
    [
        T.StructField(
            "data",
            T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in NEWS_COLUMNS])),
        )
    ]
)

BAR_BODY = T.ArrayType(T.ArrayType(T.StringType()))

POST_COLUMNS = ["tweet_id", "text", "time"]

# Class order of the five ratings; the class index is the list position.
LABELS = (-2, -1, 0, 1, 2)

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
