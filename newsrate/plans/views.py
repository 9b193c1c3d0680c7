"""News, bars, pages and posts derived from the general test tables.

The news tables the jobs expect do not exist there; every view below reads a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsrate.functions.text import epoch_to_text, sanitize, to_line
from newsrate.functions.vectors import linear_head, softmax
from newsrate.lexicon import pairs_for
from newsrate.operators.metrics import score_rows
from newsrate.operators.ordering import union_pages
from newsrate.schemas import NEWS_COLUMNS, TIME_FORMAT
from newsrate.session import use_utc
from newsrate.sources.feeds import extract_posts

# Common words of the test languages stand in for the default keywords, which never occur.
STAND_IN = pairs_for(
    ("from", "this", "que", "der", "für", "una", "which", "être", "sind", "año"), asset_codes={}
)
# More keywords than one pattern takes: common words, and any two of them next to each other.
COMMON = (
    "the of and to is was it for that le la les un et de des die der und zu mit el los en del".split()
)
LONG_LIST = {
    **{f"{a} {b}": f"{a}-{b}/USDT".upper() for a in COMMON for b in COMMON},
    **pairs_for(COMMON, asset_codes={}),
}
POST_TERMS = ("the", "que", "les", "und", "", "")
SYMBOLS = ("view", "click", "error", "signup", "purchase")
MARKET = dict(zip(SYMBOLS, ("DERUSDT", "QUEUSDT", "THISUSDT", "FROMUSDT", "FÜRUSDT")))
START_EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC
PAGE_ITEMS = 20
BARS_PER_PAGE = 100
CUTOFF = "2024-01-05 00:00:00"
EARLY = "2024-01-01 02:00:00"
HEAD_CLASSES, HEAD_DIMS, HEAD_EPOCHS = 5, 64, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. These are single files of one row group, which one task would read; a
    scan with fewer splits than cores is spread out. Larger tables are read as they are."""
    df = use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of a document = title, the rest = description."""
    doc = F.col("doc_id")
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select(
        doc.alias("id"),
        F.timestamp_seconds(F.lit(START_EPOCH) + (doc * 2591) % 2592000).alias("inputtime"),
        title.alias("title"),
        F.substr("text", F.length(title) + 2).alias("description"),
        ((doc * 7919) % 23).cast("int").alias("up_count"),
        ((doc * 104729) % 11).cast("int").alias("down_count"),
        F.col("n_chars").alias("hits"),
        F.concat_ws("/", "source", doc.cast("string")).alias("url"),
        F.get(F.array(*map(F.lit, SYMBOLS)), (doc % 5).cast("int")).alias("sym"),
        "lang",
        "source",
    )


def plain_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).select(*NEWS_COLUMNS)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All news, and each of them once more a day later under another title."""
    first = plain_news(spark, sf_dir)
    again = first.withColumn("inputtime", F.col("inputtime") + F.expr("interval 1 day"))
    return first.unionByName(again.withColumn("title", F.lit("again")))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News that were loaded earlier: those with a row in ``labels``."""
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return plain_news(spark, sf_dir).join(known, "id").select(
        *NEWS_COLUMNS,
        F.lit("OLD/USDT").alias("tp"),
        F.col("quality").cast("int").alias("rate"),
        F.lit(2).alias("cat"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.lit(1000.0) + F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("open_time"),
        price.alias("open"),
        price.alias("high"),
        price.alias("low"),
    )


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars under the symbols of five stand-in pairs."""
    names = F.create_map(*[F.lit(x) for kv in MARKET.items() for x in kv])
    return bars(spark, sf_dir).withColumn("symbol", F.element_at(names, F.col("symbol")))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.translate("text", "\n\r", "  ").alias("value"))


def news_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-field lines whose description still has its commas."""
    rows = news(spark, sf_dir)
    return rows.select(
        to_line(
            F.col("id"),
            F.date_format("inputtime", TIME_FORMAT),
            F.translate(sanitize(F.col("title")), "\r", " "),
            F.translate("description", "\n\r", "  "),
            F.col("up_count"),
            F.col("down_count"),
            F.col("hits"),
            F.col("url"),
        ).alias("value")
    )


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of marked rows; the rating is text like ``-1.0``, empty or broken, and titles
    with commas make ragged lines."""
    rows = news(spark, sf_dir)
    up, down = F.col("up_count"), F.col("down_count")
    rate = (
        F.when(up + down == 0, "")
        .when(up > 20, "x")
        .otherwise(F.concat((F.pmod(up, F.lit(7)) - 3).cast("string"), F.lit(".9")))
    )
    return rows.select(
        "id",
        to_line(
            F.col("id"),
            F.date_format("inputtime", TIME_FORMAT),
            F.translate("title", "\r", " "),
            F.translate(sanitize(F.col("description")), "\n\r", "  "),
            up,
            down,
            F.col("hits"),
            F.col("url"),
            F.lit("0"),
            F.col("sym"),
            rate,
            F.lit("1"),
        ).alias("value"),
    )


def feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed pages of twenty items (page, status, body). An empty page comes after nine
    tenths of them; a page whose first two items are both German failed; one page in the middle was
    also answered without items."""
    rows = news(spark, sf_dir).withColumn("_page", F.floor(F.col("id") / PAGE_ITEMS))
    cut = rows.agg(F.floor(F.max("_page") * 9 / 10)).scalar()
    item = F.struct(
        F.col("id"),
        F.unix_seconds("inputtime").cast("string").alias("inputtime"),
        *NEWS_COLUMNS[2:],
        "lang",
    )
    pages = rows.groupBy("_page").agg(F.sort_array(F.collect_list(item)).alias("data"))
    failed = (F.get("data", F.lit(0))["lang"] == "de") & (F.get("data", F.lit(1))["lang"] == "de")
    full = pages.select(
        (F.col("_page") + F.when(F.col("_page") >= cut, 1).otherwise(0)).alias("page"),
        F.when(F.coalesce(failed, F.lit(False)), 500).otherwise(200).alias("status"),
        F.to_json(F.struct("data")).alias("body"),
    )
    empty = rows.agg(F.floor(F.max("_page") * 9 / 10).alias("page")).select(
        "page", F.lit(200).alias("status"), F.lit('{"data":[]}').alias("body")
    )
    refused = rows.agg(F.floor(F.floor(F.max("_page") * 9 / 10) / 2).alias("page")).select(
        "page", F.lit(200).alias("status"), F.lit('{"error":"rate limit"}').alias("body")
    )
    return union_pages(full, empty, refused)


def bar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as landed JSON, a hundred event ids per page."""
    rows = table(spark, sf_dir, "events")
    price = (F.lit(1000.0) + F.col("value")).cast("string")
    bar = F.array(
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), price, price, price
    )
    return (
        rows.groupBy(
            F.col("event_type").alias("symbol"),
            F.floor(F.col("event_id") / BARS_PER_PAGE).alias("page"),
        )
        .agg(F.to_json(F.collect_list(bar)).alias("body"))
        .select("symbol", "body")
    )


def post_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per saved page: text blocks from its article; pages of a mobile host are
    replies."""
    pages = table(spark, sf_dir, "pages")
    blocks = extract_posts(pages).filter("seq = 0").select(
        F.col("page").alias("page_id"), "first", "second"
    )
    reply = F.col("url").rlike("^https?://m[.]")
    return pages.join(blocks, "page_id", "left").select(
        F.col("page_id").alias("seq"),
        F.col("url").alias("href"),
        F.when(reply, F.concat(F.lit("回复 \n@"), "first")).otherwise(F.col("first")).alias("first"),
        "second",
        F.date_format(
            F.timestamp_seconds(F.lit(START_EPOCH) + F.col("page_id") * 3600),
            "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
        ).alias("datetime"),
    )


def head_weights(epoch: int = 1) -> list[list[float]]:
    return [
        [((i * 7 + k * 13 * epoch) % 11 - 5) / 5.0 for i in range(1, HEAD_DIMS + 1)]
        for k in range(HEAD_CLASSES)
    ]


def epoch_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities of three fixed heads (= epochs) over all embeddings."""
    rows = table(spark, sf_dir, "embeddings")

    def one(epoch: int) -> DataFrame:
        head = linear_head(F.col("embedding"), head_weights(epoch))
        return rows.withColumn("logits", head).select(
            F.lit(epoch).alias("epoch"),
            F.when(F.col("label") < 5, "train").otherwise("valid").alias("split"),
            F.col("vec_id").alias("pos"),
            softmax(F.col("logits")).alias("probs"),
            (F.col("label") % HEAD_CLASSES).cast("int").alias("label"),
        )

    return union_pages(*[one(e) for e in range(1, HEAD_EPOCHS + 1)])


def scored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rows(epoch_predictions(spark, sf_dir)).drop("probs")


def number_text() -> Column:
    """Event values as good, negative, empty and broken number texts."""
    value = F.col("value").cast("string")
    return (
        F.when(F.col("event_type") == "view", value)
        .when(F.col("event_type") == "click", F.concat(F.lit("-"), value))
        .when(F.col("event_type") == "error", "")
        .when(F.col("event_type") == "signup", F.concat(F.lit("x"), value))
        .otherwise(F.col("event_id").cast("string"))
    )


def epoch_text(col: str) -> Column:
    return epoch_to_text(F.unix_seconds(col).cast("string"))
