"""The streaming interval join against the batch form."""

import datetime as dt
import random

import pytest
from newsrate.operators.interval import interval_join
from newsrate.streaming.streams import _units, start_append, stream_interval
from pyspark.sql import functions as F

BASE = 1_700_000_000
FAR = BASE + 10**8


def at(second):
    return dt.datetime.fromtimestamp(second, dt.timezone.utc)


@pytest.mark.parametrize("seconds", [1, 59, 60, 61, 130, 1200])
def test_units_make_up_the_window(spark, seconds):
    starts = list(range(BASE, BASE + 121))
    df = spark.createDataFrame([(s,) for s in starts], "s long").select("s", _units(F.col("s"), seconds).alias("u"))
    for r in df.collect():
        covered = [x for u in r.u for x in (range(u.unit * 60, u.unit * 60 + 60) if u.span == 60 else [u.unit])]
        assert sorted(covered) == list(range(r.s, r.s + seconds + 1))
        assert len(r.u) <= 121 + seconds // 60


def test_equals_batch_with_many_news_in_one_second(spark, scratch):
    rng = random.Random(2)
    hot, seconds = 30_000, 130
    news = [(i, "A", at(BASE + 7)) for i in range(hot)]
    news += [(hot + i, rng.choice("ABCD"), at(BASE + rng.randint(0, 900) + rng.choice([0, 0.5]))) for i in range(300)]
    news += [(hot + 400, None, at(BASE + 5)), (hot + 401, "none", at(BASE + 6))]
    bars = [(s, at(BASE + x / 2), rng.uniform(9, 11), rng.uniform(10, 12), rng.uniform(8, 10))
            for s in "ABC" for x in sorted(rng.sample(range(2200), 300))]
    bars += [("A", at(BASE + 137), float("nan"), 12.5, None)] if ("A", at(BASE + 137)) not in {b[:2] for b in bars} else []
    kinds = "id long, symbol string, inputtime timestamp", "symbol string, open_time timestamp, open double, high double, low double"
    n, b = spark.createDataFrame(news, kinds[0]), spark.createDataFrame(bars, kinds[1])
    ends = [(-1, "", at(FAR))], [("", at(FAR), 1.0, 1.0, 1.0)]
    streams = []
    for name, df, end, kind in (("n", n, ends[0], kinds[0]), ("b", b, ends[1], kinds[1])):
        df.coalesce(2).write.parquet(scratch(name))
        spark.createDataFrame(end, kind).coalesce(1).write.mode("append").parquet(scratch(name))
        streams.append(spark.readStream.schema(kind).option("maxFilesPerTrigger", 64).parquet(scratch(name)))
    rated = stream_interval(*streams, seconds=seconds, delay="1 day")
    query = start_append(rated, scratch("out"), scratch("checkpoint"))
    query.awaitTermination()
    columns = ["id", "first_open", "high", "low", "n_bars"]
    got = spark.read.schema(rated.schema).parquet(scratch("out")).filter("id >= 0").select(*columns)
    wanted = interval_join(n, b, seconds).select(*columns)
    assert got.count() == len(news)
    assert got.exceptAll(wanted).count() == 0 and wanted.exceptAll(got).count() == 0
    assert wanted.filter("n_bars > 0").count() > hot
