"""One named query per operator, over the derived views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsrate.functions import rating, text, vectors
from newsrate.lexicon import lexicon_frame
from newsrate.operators import encode, filters, interval, lookup, metrics, ordering
from newsrate.plans import epochs, jobs, model, views
from newsrate.schemas import LABELS, MARKED_COLUMNS, NEWS_COLUMNS, POST_COLUMNS, TIME_FORMAT
from newsrate.session import scratch_dir, use_utc, write_table
from newsrate.sinks import files as file_sinks
from newsrate.sinks import tables as table_sinks
from newsrate.sources import feeds
from newsrate.sources import files as file_sources
from newsrate.sources import tables as table_sources
from newsrate.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _time_text(df: DataFrame, col: str = "inputtime") -> DataFrame:
    return df.withColumn(col, F.date_format(col, TIME_FORMAT))


def _r(col: str | Column, name: str | None = None) -> Column:
    column = F.col(col) if isinstance(col, str) else col
    return F.round(column, 6).alias(name or col)


def _with_bad(good: DataFrame, bad: DataFrame) -> DataFrame:
    """All rows; the bad ones as their line and status."""
    return good.withColumn("status", F.lit("ok")).unionByName(bad, allowMissingColumns=True)


def _join(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), " ")


# Sources and sinks


@query
def scan_project(spark, d):
    return _time_text(table_sources.news_columns(views.news(spark, d)))


@query
def csv_news(spark, d):
    path = scratch_dir(spark, "csv-news")
    rows = views.plain_news(spark, d)
    file_sinks.append_csv(rows, path, NEWS_COLUMNS)
    # Every row once more with a field too few.
    file_sinks.append_csv(rows, path, ["id", "up_count", "hits"])
    good, bad = file_sources.read_news_csv(spark, path)
    return _with_bad(_time_text(good), bad)


@query
def line_scan(spark, d):
    path = scratch_dir(spark, "lines")
    file_sinks.append_text(views.raw_lines(spark, d), path)
    return file_sources.read_lines(spark, path)


@query
def marked_scan(spark, d):
    path = scratch_dir(spark, "marked")
    file_sinks.append_text(views.marked_lines(spark, d), path)
    return _with_bad(*file_sources.read_marked(spark, path))


@query
def feed_explode(spark, d):
    return feeds.read_feed_pages(views.feed_pages(spark, d))


@query
def bars_parse(spark, d):
    parsed = feeds.read_bars(views.bar_pages(spark, d))
    return parsed.select(
        "symbol", F.unix_millis("open_time").alias("open_ms"), _r("open"), _r("high"), _r("low")
    )


@query
def page_extract(spark, d):
    return views.table(spark, d, "pages").select(
        "page_id",
        text.id_from_href(F.col("url")).alias("tail_id"),
        text.url_host(F.col("url")).alias("host"),
        feeds.page_title(F.col("html")).alias("title"),
    )


@query
def page_posts(spark, d):
    return feeds.extract_posts(views.table(spark, d, "pages")).select(
        "page", "seq", "first", "second"
    )


@query
def hash_split(spark, d):
    train, valid = file_sources.train_valid(views.plain_news(spark, d))
    return ordering.union_pages(
        train.select("id", F.lit("train").alias("split")),
        valid.select("id", F.lit("valid").alias("split")),
    )


def _loaded(spark, d) -> str:
    path = scratch_dir(spark, "labelled")
    views.stored(spark, d).write.parquet(path)
    return path


@query
def insert_if_absent(spark, d):
    path = _loaded(spark, d)
    jobs.load_by_votes(views.arrivals(spark, d), path, views.STAND_IN)
    return _time_text(spark.read.parquet(path))


@query
def insert_count(spark, d):
    new = table_sinks.absent_rows(views.arrivals(spark, d), views.stored(spark, d))
    return metrics.insert_count(new)


@query
def csv_append(spark, d):
    path = scratch_dir(spark, "csv-append")
    cols = ["id", "time", "title", "risk"]
    rows = views.news(spark, d).withColumn("risk", F.lit(0))
    file_sinks.append_csv(rows, path, cols)
    file_sinks.append_csv(rows.drop("risk"), path, cols)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
    return spark.read.schema(schema).csv(path, multiLine=True, escape='"')


@query
def text_append(spark, d):
    path = scratch_dir(spark, "text-append")
    good, bad = jobs.repair_file(views.raw_lines(spark, d))
    file_sinks.append_text(good, path)
    file_sinks.append_text(bad, path)
    return file_sources.read_lines(spark, path)


# Scalar functions


@query
def epoch_text(spark, d):
    return views.news(spark, d).select("id", views.epoch_text("inputtime").alias("time"))


@query
def event_window(spark, d):
    rows = _time_text(views.news(spark, d))
    return rows.select("id", F.inline(F.array(text.event_window_ms(F.col("inputtime")))))


@query
def sanitize(spark, d):
    return views.table(spark, d, "documents").select(
        "doc_id", text.sanitize(F.col("text")).alias("clean")
    )


@query
def split_fields(spark, d):
    parts = text.split_fields(F.col("text"), strip=True)
    return views.table(spark, d, "documents").select(
        "doc_id",
        F.size(parts).alias("n_fields"),
        F.get(parts, F.lit(0)).alias("first_field"),
        F.get(parts, F.size(parts) - 1).alias("last_field"),
    )


@query
def repair_row(spark, d):
    return views.raw_lines(spark, d).select(
        "value",
        text.repair_row(F.col("value")).alias("repaired"),
        text.middle_text(F.col("value"), tail=5, sep=",", width=8).alias("short_middle"),
    )


@query
def repair_row_12(spark, d):
    return views.raw_lines(spark, d).select(
        "value",
        text.repair_row(F.col("value"), tail=8).alias("repaired"),
        text.middle_text(F.col("value"), tail=8, sep=",").alias("middle"),
    )


@query
def first_keyword(spark, d):
    words = tuple(views.STAND_IN)
    return views.news(spark, d).select(
        "id",
        text.first_keyword(F.col("title"), words).alias("title_word"),
        text.first_keyword(F.col("description"), words).alias("description_word"),
    )


@query
def keyword_pair(spark, d):
    words = tuple(views.STAND_IN)
    found = views.news(spark, d).select(
        "id", text.first_keyword(F.col("description"), words).alias("keyword")
    )
    lexicon = lexicon_frame(spark, views.STAND_IN)
    return lookup.lexicon_join(found, lexicon, "keyword").withColumn(
        "mapped", text.keyword_to_pair(F.col("keyword"), views.STAND_IN)
    )


@query
def lexicon_pairs(spark, d):
    lexicon = lexicon_frame(spark, views.STAND_IN)
    return lookup.lexicon_pairs(views.news(spark, d), "description", lexicon)


@query
def keyword_list(spark, d):
    """Keywords of one and two words, too many for one pattern."""
    description = F.col("description")
    return views.news(spark, d).select(
        "id",
        text.first_keyword(description, tuple(views.LONG_LIST)).alias("keyword"),
        text.trade_pair(F.col("title"), description, views.LONG_LIST).alias("tp"),
        text.keyword_match(F.col("title"), tuple(views.LONG_LIST)).alias("in_title"),
    )


@query
def trade_pair(spark, d):
    title, description = F.col("title"), F.col("description")
    return views.news(spark, d).select(
        "id",
        text.trade_pair(title, description, views.STAND_IN).alias("tp"),
        text.trade_pair(title, description, views.STAND_IN, "compat").alias("tp_compat"),
    )


@query
def vote_ratio(spark, d):
    ratio = rating.up_ratio(F.col("up_count"), F.col("down_count"))
    return views.news(spark, d).select("id", _r(ratio, "ratio"))


@query
def vote_rating(spark, d):
    rate = rating.vote_rating(F.col("up_count"), F.col("down_count"))
    return views.news(spark, d).select("id", rate.alias("rate"))


@query
def label_index(spark, d):
    rate = rating.vote_rating(F.col("up_count"), F.col("down_count"))
    return views.news(spark, d).select(
        "id",
        rating.label_index(rate).alias("label"),
        rating.label_index(F.col("up_count") - 10).alias("other_label"),
    )


@query
def trunc_int(spark, d):
    return views.table(spark, d, "events").select(
        "event_id", text.trunc_int(views.number_text()).alias("n")
    )


@query
def price_move(spark, d):
    move = rating.price_move(F.col("first_open"), F.col("high"), F.col("low"))
    return _joined(spark, d).select("id", _r(move["rise"], "rise"), _r(move["drop"], "drop"))


@query
def price_rating(spark, d):
    """Six-hour windows, so that both moves exceed a level in some rows."""
    move = rating.price_move(F.col("first_open"), F.col("high"), F.col("low"))
    return _joined(spark, d, 6 * 3600).select(
        "id", rating.price_rating(move["rise"], move["drop"]).alias("rate")
    )


@query
def url_part(spark, d):
    url = F.col("url")
    return views.table(spark, d, "pages").select(
        "page_id",
        text.url_host(url).alias("host"),
        text.user_from_url(url, "example.com").alias("user"),
    )


@query
def url_tail_id(spark, d):
    return views.table(spark, d, "pages").select(
        "page_id", text.id_from_href(F.col("url")).alias("tail_id")
    )


@query
def reply_body(spark, d):
    body = text.reply_body(F.col("first"), F.col("second"))
    return views.post_raw(spark, d).select("seq", body.alias("body"))


@query
def iso_plain(spark, d):
    return views.post_raw(spark, d).select("seq", text.iso_plain(F.col("datetime")).alias("time"))


def _vocabulary(spark, d) -> DataFrame:
    return write_table(encode.build_vocabulary(views.table(spark, d, "documents"), "text"), "vocab")


@query
def encode_text(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    return encode.encode_text(docs, "text", _vocabulary(spark, d)).select(
        "doc_id",
        "n_tokens",
        _join(F.col("input_ids")).alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_ids"),
        F.array_max("token_type_ids").alias("max_type"),
    )


def _head(spark, d) -> DataFrame:
    return views.table(spark, d, "embeddings").select(
        "vec_id",
        "label",
        vectors.linear_head(F.col("embedding"), views.head_weights()).alias("logits"),
    )


@query
def linear_head(spark, d):
    return _head(spark, d).select("vec_id", *[_r(F.get("logits", F.lit(k)), f"z{k}") for k in range(5)])


@query
def softmax(spark, d):
    probs = _head(spark, d).withColumn("p", vectors.softmax(F.col("logits")))
    return probs.select("vec_id", *[_r(F.get("p", F.lit(k)), f"p{k}") for k in range(5)])


@query
def argmax_label(spark, d):
    best = vectors.argmax(F.col("logits"))
    return _head(spark, d).select(
        "vec_id", best.alias("class_index"), rating.index_to_rate(best).alias("rate")
    )


@query
def head_scoring(spark, d):
    """Linear head, softmax, argmax and rating of every embedding."""
    rows = views.table(spark, d, "embeddings").select("vec_id", "embedding")
    return model.score_vectors(rows, "embedding", views.head_weights()).select(
        "vec_id", F.col("label").alias("rate"), _r(F.array_max("probs"), "confidence")
    )


@query
def cross_entropy(spark, d):
    label = F.col("label")
    return views.epoch_predictions(spark, d).select(
        "epoch",
        "pos",
        _r(vectors.cross_entropy(F.col("probs"), label), "loss"),
        _r(vectors.cross_entropy(F.col("probs"), label, "compat"), "loss_compat"),
    )


# Filters


@query
def keyword_filter(spark, d):
    docs = views.table(spark, d, "documents")
    strict = filters.keyword_filter(docs, "text", views.POST_TERMS)
    loose = filters.keyword_filter(docs, "text", views.POST_TERMS, "compat")
    return ordering.union_pages(
        strict.select("doc_id", F.lit("intended").alias("mode")),
        loose.select("doc_id", F.lit("compat").alias("mode")),
    )


@query
def since_cutoff(spark, d):
    rows = ordering.since(_time_text(views.news(spark, d)), "inputtime", views.CUTOFF)
    return rows.select("id", "inputtime")


@query
def take_while(spark, d):
    """Last feed page first, up to the first item at or before a time; items after it may be
    newer, and are not read."""
    rows = _time_text(views.news(spark, d)).withColumns(
        {"page": -F.floor(F.col("id") / views.PAGE_ITEMS), "pos": F.col("id") % views.PAGE_ITEMS}
    )
    return ordering.since(rows, "inputtime", views.EARLY, "compat").select("id", "inputtime")


@query
def until_empty_page(spark, d):
    pages = filters.ok_pages(views.feed_pages(spark, d))
    size = feeds.page_size(F.col("body"))
    return filters.until_empty_page(pages, size).select("page", size.alias("n_items"))


@query
def feed_quarantine(spark, d):
    broken = F.when(F.col("page") % 7 == 3, F.lit("<html>")).otherwise(F.col("body"))
    pages = views.feed_pages(spark, d).withColumn("body", broken)
    return jobs.feed_quarantine(pages).select("page", "status")


@query
def tradable_news(spark, d):
    rows = jobs.label_news(views.news(spark, d), views.STAND_IN)
    return filters.tradable(rows).select("id", "tp")


@query
def alerts(spark, d):
    rows = jobs.label_news(views.news(spark, d), views.STAND_IN)
    return filters.alerts(rows, "rate").select("id", "tp", "rate")


@query
def author_range(spark, d):
    posts = views.news(spark, d).select(
        "id",
        F.col("source").alias("author"),
        (F.col("lang") == "de").alias("is_repost"),
        F.to_date("inputtime").alias("date"),
    )
    found = filters.author_range(posts, "src1", "2024-01-05", "2024-01-20")
    return found.select("id", F.col("date").cast("string").alias("date"))


@query
def no_result_pages(spark, d):
    pages = views.table(spark, d, "pages")
    return filters.drop_no_result(pages, "html", "nicht").select("page_id")


@query
def quarantine(spark, d):
    good, bad = filters.check_rows(views.marked_lines(spark, d), 12, ints=(4, 5), rate_at=10)
    return ordering.union_pages(
        good.select("id", F.lit("ok").alias("status")), bad.select("id", "status")
    )


# Joins and aggregates


def _joined(spark, d, seconds: int = interval.WINDOW_SECONDS) -> DataFrame:
    return interval.interval_join(
        views.news(spark, d), views.bars(spark, d), seconds, symbol="sym"
    )


@query
def interval_join(spark, d):
    return _joined(spark, d).select(
        "id",
        F.col("sym").alias("symbol"),
        "n_bars",
        F.unix_micros("first_time").alias("first_us"),
        F.unix_micros("last_time").alias("last_us"),
    )


@query
def first_bar_after(spark, d):
    return interval.first_bar_after(_joined(spark, d)).select(
        "id", F.unix_micros("first_time").alias("first_us"), _r("first_open")
    )


@query
def bar_summary(spark, d):
    return interval.bar_summary(_joined(spark, d)).select(
        "id", _r("first_open"), _r("high"), _r("low"), "n_bars"
    )


@query
def batch_number(spark, d):
    rows = views.news(spark, d).select("id", "lang")
    return ordering.batch_number(rows, 4, ["id"], ["lang"])


def _batches(spark, d) -> DataFrame:
    rows = ordering.batch_number(
        views.scored_predictions(spark, d), model.BATCH_ROWS, ["pos"], ["epoch", "split"]
    )
    return metrics.batch_metrics(rows)


@query
def batch_metrics(spark, d):
    return _batches(spark, d).select("epoch", "split", "batch", _r("acc"), _r("loss"), "n")


@query
def epoch_metrics(spark, d):
    return metrics.epoch_metrics(_batches(spark, d)).select(
        "epoch", "split", _r("acc"), _r("loss"), _r("row_acc"), _r("row_loss")
    )


def _valid_epochs(spark, d) -> DataFrame:
    return metrics.epoch_metrics(_batches(spark, d)).filter("split = 'valid'")


@query
def best_epoch(spark, d):
    return metrics.best_epoch(_valid_epochs(spark, d)).select("epoch", _r("acc"))


@query
def running_best(spark, d):
    return metrics.running_best(_valid_epochs(spark, d)).select(
        "epoch", _r("acc"), _r("best_before"), "improved"
    )


@query
def dataset_size(spark, d):
    good, _ = jobs.repair_file(views.news_lines(spark, d))
    return metrics.dataset_size(jobs.training_rows(good)[0])


@query
def dedup_posts(spark, d):
    rows = views.table(spark, d, "conversations")
    return ordering.dedup(rows, "conv_id", "turn")


@query
def seeded_shuffle(spark, d):
    rows = views.news(spark, d).select("id", ordering.shuffle_key(7, "id").alias("shuffle_key"))
    return ordering.seeded_shuffle(rows, 7)


@query
def union_pages(spark, d):
    def part(name, key):
        return views.table(spark, d, name).select(
            F.lit(name).alias("origin"), F.col(key).alias("key"), "text"
        )

    return ordering.union_pages(
        part("documents", "doc_id"), part("conversations", "conv_id"), part("benchmark", "item_id")
    )


# Jobs


@query
def label_by_votes(spark, d):
    rows = jobs.label_by_votes(
        views.arrivals(spark, d), views.stored(spark, d), views.STAND_IN
    )
    return _time_text(rows)


@query
def mark_rows(spark, d):
    return jobs.mark_rows(views.news(spark, d), views.market_bars(spark, d), views.STAND_IN).select(
        *MARKED_COLUMNS, "status"
    )


@query
def ingest_feed(spark, d):
    return jobs.ingest_feed(views.feed_pages(spark, d), views.CUTOFF)


@query
def post_clean(spark, d):
    return jobs.post_clean(views.post_raw(spark, d), views.POST_TERMS).select(*POST_COLUMNS)


@query
def training_set(spark, d):
    """The repaired lines, and the raw lines of all documents, most of which are no news."""
    repaired, _ = jobs.repair_file(views.news_lines(spark, d))
    lines = repaired.unionByName(views.raw_lines(spark, d))
    vocab = write_table(encode.build_vocabulary(views.news(spark, d), "title"), "vocab")
    good, bad = jobs.training_set(lines, vocab)
    rows = good.select("text", "label", _join(F.col("input_ids")).alias("input_ids"))
    return _with_bad(rows, bad)


def _votes(spark, d) -> DataFrame:
    """(id, text, label) of all news."""
    rate = rating.vote_rating(F.col("up_count"), F.col("down_count"))
    return views.news(spark, d).select(
        "id", F.col("description").alias("text"), rating.label_index(rate).alias("label")
    )


@query
def fit_and_score(spark, d):
    """Scores of the model read back, next to those of the head in memory: the same, and probabilities
    that add up to 1."""
    train, valid = file_sources.train_valid(_votes(spark, d))
    path = scratch_dir(spark, "model")
    heads, _ = epochs.fit_epochs(train, key="id")
    result = model.evaluate(heads, valid)
    kept = heads[(result.best or len(heads)) - 1]
    model.save_best(kept, path)
    saved = model.score(valid.withColumnRenamed("label", "truth"), model.load_model(path))
    fitted = kept.predict(saved.withColumnRenamed("probs", "_saved"))
    return fitted.select(
        "id",
        "truth",
        (F.col("probs") == F.col("_saved")).alias("saved_equals_fitted"),
        _r(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x), "total"),
    )


@query
def train_epochs(spark, d):
    """Whether each epoch goes on from the last: its loss is lower than that of the epoch before."""
    _, seen = epochs.fit_epochs(_votes(spark, d), epochs=3, key="id")
    first = [None, *(h["loss"] for h in seen)]
    rows = [(h["epoch"], b is None or h["loss"] < b) for h, b in zip(seen, first)]
    return spark.createDataFrame(rows, "epoch int, better boolean")


@query
def fit_head(spark, d):
    rows = views.table(spark, d, "embeddings").withColumn(
        "label", (F.col("label") % views.HEAD_CLASSES).cast("int")
    )
    scored = model.predict_head(rows, model.fit_head(rows, "embedding"), "embedding")
    return scored.select(
        "vec_id", "label", vectors.argmax(F.col("probs")).alias("predicted")
    )


@query
def batch_score(spark, d):
    """(line, pair, whether the label is one of the list) of the appended predictions, read back."""
    heads, _ = epochs.fit_epochs(_votes(spark, d), epochs=1, key="id")
    path = scratch_dir(spark, "predictions")
    scored, _ = jobs.batch_score(views.news_lines(spark, d), heads[0], views.STAND_IN)
    file_sinks.append_predictions(scored, path)
    line = F.col("value")
    label = F.substring_index(line, ",", -1)
    rest = F.left(line, F.length(line) - F.length(label) - 1)
    tp = F.substring_index(rest, ",", -1)
    return file_sources.read_lines(spark, path).select(
        F.left(rest, F.length(rest) - F.length(tp) - 1).alias("value"),
        tp.alias("tp"),
        label.isin([str(x) for x in LABELS]).alias("known_label"),
    )


# Streams: the table is landed in files first, then read as a stream


def _stream(spark, *parts: DataFrame, name: str, files: int = 4) -> DataFrame:
    """A stream over tables that land one after the other, ``files`` at a time."""
    path = scratch_dir(spark, f"landed-{name}")
    schema = parts[0].schema
    for part in parts:
        same = part.select(*[F.col(f.name).cast(f.dataType) for f in schema])
        same.write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _finish(running) -> None:
    running.awaitTermination()


def _streamed(spark, df: DataFrame, name: str) -> DataFrame:
    path, checkpoint = scratch_dir(spark, name), scratch_dir(spark, f"{name}-checkpoint")
    _finish(streams.start_append(df, path, checkpoint))
    return spark.read.schema(df.schema).parquet(path)


@query
def stream_ingest(spark, d):
    """Two polls of the same feed; the second one finds every page again."""
    pages = filters.until_empty_page(views.feed_pages(spark, d), feeds.page_size(F.col("body")))
    polls = _stream(spark, pages, pages, name="pages")
    path, checkpoint = scratch_dir(spark, "ingest"), scratch_dir(spark, "ingest-checkpoint")
    _finish(streams.stream_ingest(polls, path, checkpoint, views.CUTOFF))
    return spark.read.parquet(path)


@query
def stream_dedup(spark, d):
    rows = _stream(spark, views.arrivals(spark, d).select("id", "inputtime"), name="arrivals")
    unique = streams.stream_dedup(rows, "id", "inputtime", "60 days")
    return _streamed(spark, unique.select("id"), "dedup")


@query
def stream_insert(spark, d):
    path = _loaded(spark, d)
    rows = _stream(spark, views.plain_news(spark, d), name="news")
    _finish(
        streams.stream_insert(
            rows,
            path,
            scratch_dir(spark, "insert-checkpoint"),
            prepare=lambda new: jobs.label_news(new, views.STAND_IN),
        )
    )
    return _time_text(spark.read.parquet(path))


@query
def stream_label(spark, d):
    rows = _stream(spark, views.plain_news(spark, d), name="news")
    return _time_text(_streamed(spark, streams.stream_label(rows, views.STAND_IN), "label"))


@query
def stream_interval(spark, d):
    """All news against all bars; one row far in the future on each side closes the windows."""
    far = F.timestamp_seconds(F.lit(views.START_EPOCH + 10 * 365 * 86400))
    news = views.news(spark, d).select("id", F.col("sym").alias("symbol"), "inputtime")
    bars = views.bars(spark, d)
    closing = use_utc(spark).range(1)
    last_news = closing.select(F.lit(-1).alias("id"), F.lit("").alias("symbol"), far.alias("inputtime"))
    last_bar = closing.select(
        F.lit("").alias("symbol"),
        far.alias("open_time"),
        *[F.lit(0.0).alias(c) for c in ("open", "high", "low")],
    )
    rated = streams.stream_interval(
        _stream(spark, news, last_news, name="news", files=64),
        _stream(spark, bars, last_bar, name="bars", files=64),
        # The test tables come in no order of time: nothing of their 30 days is late.
        delay="60 days",
    )
    return _streamed(spark, rated, "interval").filter("id >= 0").select(
        "id", _r("first_open"), _r("high"), _r("low"), "n_bars", "rate"
    )
