from datetime import datetime, timedelta

import pytest
from newsrate.plans.jobs import feed_rows, label_news
from newsrate.schemas import NEWS, NEWS_COLUMNS
from newsrate.session import scratch_dir
from newsrate.streaming.streams import (
    start_append,
    stream_dedup,
    stream_ingest,
    stream_insert,
    stream_label,
)
from test_sources_sinks import item, pages

START = datetime(2024, 1, 1)


@pytest.fixture
def landed(spark, scratch):
    """A folder that files arrive in, and a stream over it."""

    def make(name, schema):
        path = scratch(name)
        read = lambda: (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        )
        return (lambda df: df.coalesce(1).write.mode("append").parquet(path)), read

    return make


def news(spark, ids, title="eth"):
    rows = [(i, START + timedelta(minutes=i), title, "", 1, 0, 0, "") for i in ids]
    return spark.createDataFrame(rows, NEWS)


def test_ingest_continues_after_a_stop(spark, scratch, landed):
    first = pages(spark, (0, 200, [item(1, "5")]), (1, 500, "oops"))
    second = pages(spark, (2, 200, [item(2, "6")]))
    land, read = landed("pages", first.schema)
    for df in (first, second):
        land(df)
        stream_ingest(read(), scratch("news"), scratch("check")).awaitTermination()
    land(second)  # polled again
    stream_ingest(read(), scratch("news"), scratch("check")).awaitTermination()
    batch = feed_rows(first.union(second)).select(*NEWS_COLUMNS)
    assert sorted(spark.read.parquet(scratch("news")).collect()) == sorted(batch.collect())


def test_dedup_over_batches(spark, scratch, landed):
    land, read = landed("news", NEWS)
    land(news(spark, [1, 2, 2, 2, 3]))
    land(news(spark, [3, 4, 1]))
    unique = stream_dedup(read(), "id", "inputtime", "1 day")
    start_append(unique, scratch("out"), scratch("check")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(scratch("out")).collect()) == [1, 2, 3, 4]


def test_insert_is_idempotent(spark, scratch, landed):
    land, read = landed("news", NEWS)
    land(news(spark, [1, 2]))
    land(news(spark, [2, 3], "neo"))
    for check in ("check-1", "check-2"):  # the second run replays everything
        labelled = stream_label(read())
        stream_insert(labelled, scratch("target"), scratch(check)).awaitTermination()
    stored = spark.read.parquet(scratch("target")).collect()
    assert sorted((r.id, r.tp) for r in stored)[::2] == [(1, "ETH/USDT"), (3, "NEO/USDT")]
    assert len(stored) == 3


def test_label_equals_batch(spark, scratch, landed):
    land, read = landed("news", NEWS)
    df = news(spark, range(5))
    land(df)
    start_append(stream_label(read()), scratch("out"), scratch("check")).awaitTermination()
    assert sorted(spark.read.parquet(scratch("out")).collect()) == sorted(label_news(df).collect())


def test_scratch_dir_uses_the_shared_folder(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
