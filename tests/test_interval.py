import random
from datetime import datetime, timedelta, timezone

import pytest
from newsrate.operators.interval import (
    bar_summary,
    first_bar_after,
    interval_join,
    unique_bars,
)
from newsrate.plans.jobs import bars_between, mark_rows

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
BAR = "symbol string, open_time timestamp, open double, high double, low double"


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def brute(news, bars, seconds):
    out = {}
    for i, symbol, t in news:
        hits = sorted(
            b for b in bars if b[0] == symbol and t <= b[1] <= t + timedelta(seconds=seconds)
        )
        out[i] = (
            (len(hits), hits[0][2], max(b[3] for b in hits), min(b[4] for b in hits))
            if hits
            else (0, None, None, None)
        )
    return out


def joined(spark, news, bars, seconds, **options):
    n = spark.createDataFrame(news, "id int, symbol string, inputtime timestamp")
    rows = interval_join(n, spark.createDataFrame(bars, BAR), seconds, **options).collect()
    assert len(rows) == len(news)
    return {r.id: (r.n_bars, r.first_open, r.high, r.low) for r in rows}


@pytest.mark.parametrize("seed,seconds,hot_rows", [(1, 60, 1_000_000), (2, 60, 3), (3, 7, 0)])
def test_equals_brute_force(spark, seed, seconds, hot_rows):
    r = random.Random(seed)
    news = [(i, r.choice("aab"), at(r.randrange(600))) for i in range(300)]
    stamps = {(r.choice("abc"), r.randrange(-50, 700) + r.choice([0, 0.25, 0.5])) for _ in range(500)}
    bars = [(s, at(t), r.random(), r.random() + 1, r.random() - 1) for s, t in sorted(stamps)]
    assert joined(spark, news, bars, seconds, hot_rows=hot_rows) == brute(news, bars, seconds)


def test_both_ends_are_inclusive(spark):
    bars = [("a", at(t), float(i), 1.0, 1.0) for i, t in enumerate([-0.5, 0, 1200, 1200.5])]
    assert joined(spark, [(1, "a", at(0)), (2, "a", at(3600)), (3, None, at(0))], bars, 1200) == {
        1: (2, 1.0, 1.0, 1.0),
        2: (0, None, None, None),
        3: (0, None, None, None),
    }


def test_one_hot_symbol_and_second(spark):
    """A third of all news in one second, a third of all bars in another one."""
    news = [(i, "a", at(5)) for i in range(400)] + [(1000 + i, "b", at(i)) for i in range(800)]
    bars = [("a", at(6 + i / 1000), 1.0 + i, 2.0 + i, 0.5) for i in range(500)]
    bars += [("b", at(i), 1.0, 2.0, 0.5) for i in range(900)]
    assert joined(spark, news, bars, 60, hot_rows=50) == brute(news, bars, 60)


def test_rows_without_a_key(spark):
    news = [(i, None, None) for i in range(200)] + [(200, "a", at(0)), (201, "a", None)]
    got = joined(spark, news, [("a", at(0), 1.0, 1.0, 1.0)], 60)
    assert len(got) == 202 and got[200][0] == 1 and got[0][0] == got[201][0] == 0


def test_hot_rows_are_spread(spark):
    """The salt stays a join key: constant salts would be turned into a filter."""
    n = spark.createDataFrame([(1, "a", at(0))], "id int, symbol string, inputtime timestamp")
    b = spark.createDataFrame([("a", at(1), 1.0, 1.0, 1.0)], BAR)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = interval_join(n, b)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert sum("_salt" in line for line in shuffles) == 2


def test_no_pair_is_formed(spark):
    n = spark.createDataFrame([(1, "a", at(0))], "id int, symbol string, inputtime timestamp")
    b = spark.createDataFrame([("a", at(1), 1.0, 1.0, 1.0)], BAR)
    rows = interval_join(n, b)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "ReusedExchange" in plan  # the summaries are computed once


def test_parts_and_nan(spark):
    nan = float("nan")
    bars = spark.createDataFrame(
        [("a", at(1), 1.0, nan, nan), ("a", at(2), 9.0, 3.0, 0.5), ("a", at(2), 9.0, 3.0, 0.5)], BAR
    )
    n = spark.createDataFrame([(1, "a", at(0))], "id int, symbol string, inputtime timestamp")
    rows = interval_join(n, unique_bars(bars))
    assert tuple(bar_summary(rows).first()) == (1, 1.0, 3.0, 0.5, 2)
    assert first_bar_after(rows).select("id", "first_open").first() == (1, 1.0)


def test_mark_rows_modes(spark):
    news = spark.createDataFrame(
        [
            (1, at(0), "eth", "the ETH story", 1, 0, 5, "u"),
            (2, at(0), "eth", "nothing", 1, 0, 5, "u"),
            (3, at(9999), "", "neo", 1, 0, 5, "u"),
        ],
        "id long, inputtime timestamp, title string, description string, up_count int,"
        " down_count int, hits long, url string",
    )
    bars = spark.createDataFrame([("ETHUSDT", at(60), 100.0, 108.0, 99.5)], BAR)
    rows = {r.id: r for r in mark_rows(news, bars).collect()}
    assert sorted(rows) == [1, 3]
    assert (rows[1].tp, rows[1].rate, rows[1].status) == ("ETH/USDT", 2, "rated")
    assert (rows[3].tp, rows[3].rate, rows[3].status) == ("NEO/USDT", None, "no_bars")
    assert (rows[1].risk, rows[1].cat, rows[1].time) == (0, 1, "2024-01-01 00:00:00")
    compat = {r.id: r.tp for r in mark_rows(news, bars, mode="compat").collect()}
    assert compat == {1: "ETH/USDT", 2: "", 3: "NEO/USDT"}
    by_title = {r.id for r in mark_rows(news, bars, text="title").select("id").collect()}
    assert by_title == {1, 2}
    wide = spark.createDataFrame([("x", at(t), 1.0, 1.0, 1.0) for t in (-1, 0, 11199, 11200)], BAR)
    assert [r.open_time for r in bars_between(news, wide, 1200).orderBy("open_time").collect()] == [
        r.open_time for r in wide.collect()[1:3]
    ]
    assert bars_between(news.limit(0), wide, 1200).count() == 0
