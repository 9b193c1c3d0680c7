"""The jobs: label, repair, mark, ingest, collect, build a training set, score."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsrate.functions.binding import bind
from newsrate.functions.rating import label_index, price_move, price_rating, vote_rating
from newsrate.functions.text import (
    epoch_to_text,
    id_from_href,
    iso_plain,
    middle_text,
    pair_symbol,
    repair_row,
    reply_body,
    sanitize,
    split_fields,
    strip_line,
    text_pair,
    trade_pair,
    trunc_int,
)
from newsrate.lexicon import DEFAULT_LEXICON, FILTER_TERMS
from newsrate.operators.encode import MAX_LEN, encode_text
from newsrate.operators.filters import (
    fields_status,
    keyword_filter,
    ok_pages,
    require_id,
    tradable,
    with_pair,
)
from newsrate.operators.interval import WINDOW_SECONDS, interval_join
from newsrate.operators.lookup import HOT_ROWS
from newsrate.operators.ordering import dedup, since
from newsrate.plans.epochs import Head
from newsrate.plans.model import score
from newsrate.schemas import MARKED_COLUMNS, NEWS_COLUMNS, POST_COLUMNS, TIME_FORMAT
from newsrate.session import scratch_dir, write_table
from newsrate.sinks.tables import absent_rows, insert_if_absent
from newsrate.sources.feeds import land_pages, pages_before_stop, read_feed_pages

# Defaults of a row that is not rated yet; category 1 is "policy".
DEFAULTS = {"risk": 0, "tp": "", "rate": -101, "cat": 1}


def with_defaults(df: DataFrame) -> DataFrame:
    """Add the columns risk, tp, rate and cat of a row that is not rated yet."""
    return df.withColumns({c: F.lit(v) for c, v in DEFAULTS.items()})


def label_news(
    news: DataFrame, lexicon: dict[str, str] = DEFAULT_LEXICON, mode: str = "intended"
) -> DataFrame:
    """Add pair, vote rating and category. No shuffle; the same on batch and stream."""
    pair = trade_pair(F.col("title"), F.col("description"), lexicon, mode)
    return bind(news.select(*NEWS_COLUMNS), tp=pair).select(
        *NEWS_COLUMNS,
        "tp",
        vote_rating(F.col("up_count"), F.col("down_count")).alias("rate"),
        F.lit(DEFAULTS["cat"]).alias("cat"),
    )


def label_by_votes(
    news: DataFrame,
    target: DataFrame,
    lexicon: dict[str, str] = DEFAULT_LEXICON,
    mode: str = "intended",
    order: str | list[str] = "inputtime",
) -> DataFrame:
    """Labelled rows that ``target`` does not have yet, one per id.

    Rows are made unique and compared with the target first, so only rows that are inserted
    are matched against the lexicon.
    """
    return label_news(absent_rows(news, target, "id", order), lexicon, mode)


def load_by_votes(
    news: DataFrame,
    target: str,
    lexicon: dict[str, str] = DEFAULT_LEXICON,
    mode: str = "intended",
    order: str | list[str] = "inputtime",
) -> int:
    """Label the news that are not in the table ``target`` yet and append them; returns how
    many."""
    return insert_if_absent(
        news.select(*NEWS_COLUMNS),
        target,
        order=order,
        prepare=lambda rows: label_news(rows, lexicon, mode),
    )


def repair_file(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(repaired lines, lines with too few fields)."""
    fixed = bind(lines, _fixed=repair_row(F.col(col)))
    good = fixed.filter(F.col("_fixed").isNotNull()).select(F.col("_fixed").alias(col))
    bad = fixed.filter(F.col("_fixed").isNull()).select(col, F.lit("width").alias("status"))
    return good, bad


def bars_between(news: DataFrame, bars: DataFrame, seconds: int) -> DataFrame:
    """The bars in the time span of stored news; the bounds reach the scan of the bars."""
    start = F.unix_micros("inputtime")
    low, high = news.agg(F.min(start), F.max(start)).first()
    if low is None:
        return bars.limit(0)
    last = F.timestamp_micros(F.lit(high + seconds * 1_000_000))
    return bars.filter(F.col("open_time").between(F.timestamp_micros(F.lit(low // 1_000_000 * 1_000_000)), last))


def mark_rows(
    news: DataFrame,
    bars: DataFrame,
    lexicon: dict[str, str] = DEFAULT_LEXICON,
    mode: str = "intended",
    seconds: int = WINDOW_SECONDS,
    text: str = "description",
    hot_rows: int = HOT_ROWS,
    store: bool = True,
) -> DataFrame:
    """The twelve marked columns and ``status``: rating from the price move after the news.

    The pair comes from one text column (``description`` by default). News without bars get a
    NULL rating and the status ``no_bars``. The interval join reads the news twice; with
    ``store`` the rows with a pair are written once, so that no text is matched twice.
    """
    paired = bind(with_defaults(news).drop("tp"), tp=text_pair(F.col(text), lexicon))
    symbols = with_pair(paired, mode).withColumn("symbol", pair_symbol(F.col("tp")))
    if store:
        symbols = write_table(symbols, "paired")
        bars = bars_between(symbols, bars, seconds)
    joined = interval_join(symbols, bars, seconds, hot_rows=hot_rows)
    move = price_move(F.col("first_open"), F.col("high"), F.col("low"))
    marked = joined.withColumn("rate", price_rating(move["rise"], move["drop"]))
    return marked.withColumn("time", F.date_format("inputtime", TIME_FORMAT)).select(
        *MARKED_COLUMNS,
        F.when(F.col("n_bars") == 0, "no_bars")
        .when(F.col("rate").isNull(), "no_price")
        .otherwise("rated")
        .alias("status"),
    )


def feed_rows(pages: DataFrame) -> DataFrame:
    """Clean news rows of feed pages, raw or parsed; the part of the ingest that has no end
    condition. An item whose time can not be read has a NULL time."""
    return read_feed_pages(ok_pages(pages)).withColumns(
        {
            "inputtime": epoch_to_text(F.col("inputtime")),
            "title": sanitize(F.col("title")),
            "description": sanitize(F.col("description")),
        }
    )


def landed(pages: DataFrame) -> DataFrame:
    """Pages as ``land_pages`` writes them; raw pages are landed in the shared folder first, so that
    no body is parsed twice."""
    if "body" not in pages.columns:
        return pages
    path = scratch_dir(pages.sparkSession, "pages")
    land_pages(pages, path)
    return pages.sparkSession.read.parquet(path)


def ingest_feed(pages: DataFrame, cutoff: str | None = None, mode: str = "intended") -> DataFrame:
    """News of the pages before the first empty one, newer than ``cutoff`` (time text). What can
    not be read is in ``feed_quarantine`` and nowhere else. ``pages``: raw, or a landed table."""
    rows = feed_rows(pages_before_stop(landed(pages)))
    if cutoff is not None:
        rows = since(rows, "inputtime", cutoff, mode)
    return rows.filter(F.col("inputtime").isNotNull()).select(*NEWS_COLUMNS)


def feed_quarantine(pages: DataFrame) -> DataFrame:
    """(page, pos, status) of what ``ingest_feed`` cannot read: whole pages (``pos`` NULL) whose body
    is not a JSON object (``body``) or has no item list (``data``), and items without a readable
    time."""
    read = pages_before_stop(landed(pages))
    faulty = read.filter(F.col("fault").isNotNull()).select(
        "page", F.lit(None).cast("int").alias("pos"), F.col("fault").alias("status")
    )
    late = feed_rows(read).filter(F.col("inputtime").isNull())
    return faulty.unionByName(late.select("page", "pos", F.lit("time").alias("status")))


def post_clean(posts: DataFrame, terms=FILTER_TERMS, mode: str = "intended") -> DataFrame:
    """Posts with an id, once per id, that mention a filter term."""
    ids = require_id(posts.withColumn("tweet_id", id_from_href(F.col("href"))))
    unique = dedup(ids, "tweet_id", "seq")
    texts = unique.withColumn("text", reply_body(F.col("first"), F.col("second"))).withColumn(
        "time", iso_plain(F.col("datetime"))
    )
    return keyword_filter(texts, "text", terms, mode).select(*POST_COLUMNS)


def training_rows(
    lines: DataFrame, by: str = "votes", col: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """(good, bad): (text, label) of well-formed lines, which is title and vote rating of
    eight-field lines, or description and stored rating of twelve-field lines; and (value,
    status) of all others."""
    split = bind(lines, _fields=split_fields(F.col(col), strip=True))
    fields = F.col("_fields")

    def at(i):
        return F.get(fields, F.lit(i))

    if by == "votes":
        status = fields_status(fields, 8, ints=(4, 5))
        text, rate = at(2), vote_rating(at(4).try_cast("int"), at(5).try_cast("int"))
    else:
        status = fields_status(fields, 12, rate_at=10)
        text, rate = at(3), trunc_int(at(10))
    checked = bind(split, status=status)
    good = checked.filter("status = 'ok'")
    return good.select(text.alias("text"), label_index(rate).alias("label")), checked.filter(
        "status <> 'ok'"
    ).select(F.col(col).alias("value"), "status")


def training_set(
    lines: DataFrame, vocab: DataFrame, by: str = "votes", max_len: int = MAX_LEN
) -> tuple[DataFrame, DataFrame]:
    """(encoded texts and class indexes, malformed lines with a status)."""
    good, bad = training_rows(lines, by)
    return encode_text(good, "text", vocab, max_len), bad


def scorable(
    lines: DataFrame,
    lexicon: dict[str, str] = DEFAULT_LEXICON,
    mode: str = "intended",
    col: str = "value",
) -> tuple[DataFrame, DataFrame]:
    """((value, text, tp) of the lines whose text names a pair, lines too short to have a text
    with a status). ``compat`` cuts one fragment more from the end of the text of ragged lines.
    """
    line = strip_line(F.col(col))
    tail = 5 if mode == "compat" else 4
    text = middle_text(F.col("value"), head=3, tail=tail, sep=",", width=8)
    rows = bind(lines.select(line.alias("value")), text=text)
    short = rows.filter(F.col("text").isNull()).select("value", F.lit("width").alias("status"))
    return tradable(bind(rows, tp=text_pair(F.col("text"), lexicon))), short


def batch_score(
    lines: DataFrame,
    model: PipelineModel | Head,
    lexicon: dict[str, str] = DEFAULT_LEXICON,
    mode: str = "intended",
) -> tuple[DataFrame, DataFrame]:
    """(value, text, tp and the predicted rating ``label``, which ``append_predictions`` writes;
    lines that are too short with a status)."""
    good, short = scorable(lines, lexicon, mode)
    return score(good, model).select("value", "text", "tp", "label"), short
