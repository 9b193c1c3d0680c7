"""Landed feed pages and price bars (JSON), saved post pages (markup)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsrate.functions.binding import bind
from newsrate.schemas import BAR_BODY, FEED_BODY

_ITEM_TYPES = {"id": "bigint", "up_count": "int", "down_count": "int", "hits": "bigint"}


#: Pages in one folder of the landed table.
PAGES_PER_RANGE = 1000
#: What counts as an empty item list besides an empty array and null.
NOTHING = ("", "0", "0.0", "false", "{}")


def page_items(json_col: Column) -> Column:
    """The item array of a page body; NULL when missing or unreadable."""
    return F.from_json(json_col, FEED_BODY)["data"]


def _size(json_col: Column, items: Column) -> Column:
    listed = F.array_contains(F.json_object_keys(json_col), "data")
    value = F.get_json_object(json_col, "$.data")
    nothing = listed & (value.isNull() | value.isin(*NOTHING))
    return F.when(items.isNotNull(), F.size(items)).when(nothing, F.lit(0))


def page_size(json_col: Column) -> Column:
    """Number of items of a page body, without converting their fields: 0 for a list that is there
    and empty or null, NULL where there is no list or the body is not a JSON object."""
    return _size(json_col, F.from_json(json_col, "data array<struct<id: string>>")["data"])


def parse_pages(pages: DataFrame, json_col: str = "body") -> DataFrame:
    """The body replaced by ``items``, ``n_items`` (as ``page_size``) and ``fault``: ``body`` if it
    is not a JSON object, ``data`` if it has no item list. Every body is parsed here, once."""
    body = F.col(json_col)
    parsed = bind(pages, items=page_items(body)).withColumn("n_items", _size(body, F.col("items")))
    fault = F.when(F.json_object_keys(body).isNull(), "body").when(F.col("n_items").isNull(), "data")
    return parsed.withColumn("fault", fault).drop(json_col)


def land_pages(
    pages: DataFrame, path: str, page_col: str = "page", per_range: int = PAGES_PER_RANGE
) -> None:
    """Append parsed pages to the table at ``path``, in folders of page ranges."""
    folder = F.floor(F.col(page_col) / per_range)
    parse_pages(pages).withColumn("page_range", folder).write.mode("append").partitionBy(
        "page_range"
    ).parquet(path)


def pages_before_stop(
    landed: DataFrame, page_col: str = "page", per_range: int = PAGES_PER_RANGE
) -> DataFrame:
    """The answered pages of a landed table before the first empty one. It is looked for in the item
    counts alone; then folders of later pages are not read."""
    answered = landed.filter(F.col("status") == 200)
    stop = answered.filter("n_items = 0").agg(F.min(page_col)).first()[0]
    if stop is None:
        return answered
    return answered.filter((F.col("page_range") <= stop // per_range) & (F.col(page_col) < stop))


def read_feed_pages(df: DataFrame, json_col: str = "body") -> DataFrame:
    """One row per feed item: the other page columns, ``pos`` and the eight item fields.
    ``inputtime`` stays epoch text; extra keys are dropped. Parsed pages are taken as they are."""
    parsed = "items" in df.columns and json_col not in df.columns
    items = F.col("items") if parsed else page_items(F.col(json_col))
    kept = [c for c in df.columns if c not in (("items", "n_items", "fault", "page_range") if parsed else (json_col,))]
    rows = df.select(*kept, F.posexplode(items).alias("pos", "_item"))
    fields = [
        F.col(f"_item.{c}").try_cast(_ITEM_TYPES.get(c, "string")).alias(c)
        for c in FEED_BODY["data"].dataType.elementType.fieldNames()
    ]
    return rows.select(*kept, "pos", *fields)


def read_bars(df: DataFrame, json_col: str = "body", symbol_col: str = "symbol") -> DataFrame:
    """Bars from arrays of arrays: open time in ms, open, high, low by position."""
    bar = F.explode(F.from_json(F.col(json_col), BAR_BODY)).alias("_bar")
    at = [F.get(F.col("_bar"), F.lit(i)) for i in range(4)]
    return df.select(F.col(symbol_col).alias("symbol"), bar).select(
        "symbol",
        F.timestamp_millis(at[0].try_cast("bigint")).alias("open_time"),
        at[1].try_cast("double").alias("open"),
        at[2].try_cast("double").alias("high"),
        at[3].try_cast("double").alias("low"),
    )


# Where a post and its parts are in saved markup; replace them for other page layouts.
POST_PATTERN = r"(?s)<article\b.*?</article>"
LINK_PATTERN = r'(?s)<a\b[^>]*\bhref="([^"]*)"[^>]*>\s*<time\b'
TIME_PATTERN = r'(?s)<time\b[^>]*\bdatetime="([^"]*)"'
BLOCK_PATTERN = r"(?s)<p\b[^>]*>(.*?)</p>"
TITLE_PATTERN = r"(?s)<title>(.*?)</title>"
# The named entities of plain markup.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain_text(markup: Column) -> Column:
    """Visible text: line breaks kept, other tags removed, entities decoded."""
    text = F.regexp_replace(markup, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def page_title(html: Column) -> Column:
    return plain_text(F.nullif(F.regexp_extract(html, TITLE_PATTERN, 1), F.lit("")))


def extract_posts(
    pages: DataFrame, html_col: str = "html", page_col: str = "page_id"
) -> DataFrame:
    """Posts of saved pages as (page, seq, href, first, second, datetime); a missing part is
    NULL, a missing link ``''``."""
    posts = pages.select(
        F.col(page_col).alias("page"),
        F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(POST_PATTERN), F.lit(0))).alias(
            "seq", "_post"
        ),
    )
    blocks = F.regexp_extract_all(F.col("_post"), F.lit(BLOCK_PATTERN), F.lit(1))
    return posts.withColumn("_blocks", blocks).select(
        "page",
        "seq",
        F.regexp_extract("_post", LINK_PATTERN, 1).alias("href"),
        plain_text(F.get("_blocks", F.lit(0))).alias("first"),
        plain_text(F.get("_blocks", F.lit(1))).alias("second"),
        F.nullif(F.regexp_extract("_post", TIME_PATTERN, 1), F.lit("")).alias("datetime"),
    )
