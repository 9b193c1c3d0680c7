import json
from datetime import datetime

from newsrate.plans.jobs import (
    feed_rows,
    ingest_feed,
    label_by_votes,
    label_news,
    post_clean,
    repair_file,
    scorable,
    training_rows,
    with_defaults,
)
from newsrate.schemas import NEWS, NEWS_COLUMNS, POST_COLUMNS
from newsrate.sinks.files import append_csv, append_predictions, append_text
from newsrate.sinks.tables import absent_rows, insert_if_absent
from newsrate.sources.feeds import extract_posts, read_bars, read_feed_pages
from newsrate.sources.files import read_lines, read_marked, read_news_csv, train_valid
from newsrate.sources.tables import jdbc_options


def item(i, t, **more):
    return {
        "id": i, "inputtime": t, "title": 'a, "b"', "description": "d,e", "up_count": "3",
        "down_count": 1, "hits": 7, "url": "u", **more,
    }


def pages(spark, *rows):
    data = [(p, s, b if isinstance(b, str) else json.dumps({"data": b})) for p, s, b in rows]
    return spark.createDataFrame(data, "page int, status int, body string")


def test_jdbc_options():
    got = jdbc_options("jdbc:x", "news", (1, 9), 4, {"user": "u"})
    assert got["fetchsize"] == "1000" and got["numPartitions"] == "4" and got["user"] == "u"
    assert (got["partitionColumn"], got["lowerBound"], got["upperBound"]) == ("id", "1", "9")


def test_feed_items(spark):
    df = pages(spark, (0, 200, [item(1, "5", extra=1), item("2", 6)]), (1, 200, '{"data":null}'))
    rows = read_feed_pages(df).orderBy("pos").collect()
    assert [(r.page, r.pos, r.id, r.inputtime, r.up_count) for r in rows] == [
        (0, 0, 1, "5", 3), (0, 1, 2, "6", 3),
    ]
    assert "extra" not in rows[0].asDict()


def test_ingest_feed(spark):
    df = pages(
        spark,
        (0, 200, [item(1, "100"), item(2, "90")]),
        (1, 500, "oops"),
        (2, 200, [item(3, "10"), item(4, "80")]),
        (3, 200, []),
        (4, 200, [item(5, "99")]),
    )
    cut = "1970-01-01 00:00:10"
    assert sorted(r.id for r in ingest_feed(df).collect()) == [1, 2, 3, 4]
    assert sorted(r.id for r in ingest_feed(df, cut).collect()) == [1, 2, 4]
    assert sorted(r.id for r in ingest_feed(df, cut, "compat").collect()) == [1, 2]
    first = ingest_feed(df).filter("id = 1").first()
    assert (first.title, first.description) == ("a  b", "d e")
    assert first.inputtime == "1970-01-01 00:01:40"
    assert feed_rows(df).count() == 5


def test_bars(spark):
    body = '[[1704067200000,"1.5","2",1,"extra"],["x","1","bad","1"]]'
    df = spark.createDataFrame([("A", body), ("B", "[]"), ("C", None)], "symbol string, body string")
    rows = read_bars(df).collect()
    assert tuple(rows[0]) == ("A", datetime(2024, 1, 1), 1.5, 2.0, 1.0)
    assert (rows[1].open_time, rows[1].high) == (None, None) and len(rows) == 2


def test_posts(spark):
    html = (
        '<html><article><a href="/p/9"><time datetime="2024-01-01T00:00:00.000Z"></time></a>'
        "<p>回复 \n@bob</p><p>Buy <b>crypto</b> &amp; co</p></article>"
        '<article><a href="/p/"><time datetime="t"></a><p>crypto</p></article>'
        '<article><a href="/p/10"><time datetime="t"></a><p>nothing</p></article>'
        '<article><a href="/p/9"><time datetime="t"></a><p>crypto again</p></article></html>'
    )
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id int, html string")
    raw = extract_posts(df)
    assert [r.href for r in raw.orderBy("seq").collect()] == ["/p/9", "/p/", "/p/10", "/p/9"]
    got = post_clean(raw).collect()
    assert [tuple(r) for r in got] == [("9", "Buy crypto & co", "2024-01-01 00:00:00")]
    assert got[0].asDict().keys() == dict.fromkeys(POST_COLUMNS).keys()
    assert sorted(r.tweet_id for r in post_clean(raw, mode="compat").collect()) == ["10", "9"]


def test_csv_round_trip(spark, scratch):
    rows = [
        (1, datetime(2024, 1, 1), 'a "q", b', " line\nbreak ", 1, None, 5, "u"),
        (2, None, None, "back\\slash", 0, 0, 0, ""),
    ]
    df = spark.createDataFrame(rows, NEWS)
    append_csv(df, scratch("csv"), NEWS_COLUMNS)
    append_csv(df.filter("id = 2"), scratch("csv"), ["id"] + NEWS_COLUMNS[1:])
    append_csv(df, scratch("csv"), ["id", "title"])
    with open(scratch("csv") + "/long.csv", "w") as f:
        f.write("3,2024-01-01 00:00:00,t,d,part two,1,2,3,u\n4,,t,d,many,0,0,u\n")
    good, bad = read_news_csv(spark, scratch("csv"))
    got = sorted(map(tuple, good.collect()), key=lambda r: r[0])
    assert got == [rows[0], rows[1][:7] + (None,), rows[1][:7] + (None,)]
    lines = sorted(tuple(r) for r in bad.collect())
    assert [r[0][:7] for r in lines] == ['1,"a ""', "2,", "3,2024-", "4,,t,d,"]
    assert {r[1] for r in lines} == {"record"} and (good.count(), bad.count()) == (3, 4)
    assert sorted(r.id for r in good.select("id").collect()) == [1, 2, 2]


def test_lines_and_repair(spark, scratch):
    with open(scratch("lines.txt"), "wb") as f:
        f.write("1,t,a,b c,1,2,3,u\r\n2,t,a,x,y,1,2,3,u\n3,short\r4,t,a,b,1,2,3,u".encode())
    good, bad = repair_file(read_lines(spark, scratch("lines.txt")))
    append_text(good, scratch("out"))
    assert sorted(r.value for r in read_lines(spark, scratch("out")).collect()) == [
        "1,t,a,b c,1,2,3,u", "2,t,a,x y,1,2,3,u", "4,t,a,b,1,2,3,u",
    ]
    assert [tuple(r) for r in bad.collect()] == [("3,short", "width")]


def test_marked(spark, scratch):
    with open(scratch("m.csv"), "w") as f:
        f.write("1,t,title,desc,1,2,3,u,0,ETH/USDT,-1.0,1\n2,t,a,b,1,2,3,u,0,,,1\n3,short\n")
    good, bad = read_marked(spark, scratch("m.csv"))
    assert sorted(map(tuple, good.collect())) == [("a", "b", "", 0), ("title", "desc", "ETH/USDT", -1)]
    assert [tuple(r) for r in bad.collect()] == [("3,short", "width")]
    texts, rest = training_rows(read_lines(spark, scratch("m.csv")), by="marked")
    assert [tuple(r) for r in rest.collect()] == [("3,short", "width")]
    assert sorted(map(tuple, texts.collect())) == [("b", 2), ("desc", 1)]


def test_training_rows_by_votes(spark):
    lines = ["1,t,up,d,9,0,3,u", "2,t,none,d,0,0,3,u", "3,t,bad,d,x,0,3,u", "4,t,a,b,c,1,1,3,u"]
    df = spark.createDataFrame([(x,) for x in [*lines, None]], "value string")
    good, bad = training_rows(df)
    assert sorted(map(tuple, good.collect())) == [("none", 2), ("up", 4)]
    assert {tuple(r) for r in bad.collect()} == {(lines[2], "int"), (lines[3], "width"), (None, "width")}


def test_scorable_modes(spark):
    lines = ["1,t,x,a neo,1,2,3,u", "2,t,x,a,eth,1,2,3,u", "3,t,x,nothing,1,2,3,u", "4"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    good, short = scorable(df)
    assert sorted(r.tp for r in good.collect()) == ["ETH/USDT", "NEO/USDT"]
    assert [tuple(r) for r in short.collect()] == [("4", "width")]
    assert [r.tp for r in scorable(df, mode="compat")[0].collect()] == ["NEO/USDT"]


def test_append_predictions(spark, scratch):
    df = spark.createDataFrame([("a,b", "ETH/USDT", 2)], "value string, tp string, label int")
    append_predictions(df, scratch("p"))
    assert read_lines(spark, scratch("p")).first().value == "a,b,ETH/USDT,2"


def news(spark, rows):
    full = [(i, t, title, "", 1, 0, 0, "") for i, t, title in rows]
    return spark.createDataFrame(full, NEWS)


def test_insert_if_absent(spark, scratch):
    day = [datetime(2024, 1, d) for d in range(1, 5)]
    batch = news(spark, [(1, day[1], "late"), (1, day[0], "early"), (2, day[0], "b")])
    path = scratch("target")
    assert insert_if_absent(batch, path) == 2
    assert insert_if_absent(batch, path) == 0
    more = news(spark, [(2, day[0], "changed"), (3, day[3], "c")])
    assert insert_if_absent(more, path, prune=False) == 1
    assert insert_if_absent(more.limit(0), path) == 0
    stored = spark.read.parquet(path)
    assert sorted((r.id, r.title) for r in stored.collect()) == [(1, "early"), (2, "b"), (3, "c")]
    assert absent_rows(more, stored).count() == 0
    keyless = news(spark, [(None, day[0], "x"), (4, day[0], "y")])
    assert insert_if_absent(keyless, path) == 1


def test_insert_from_a_growing_source(spark, scratch):
    """Rows that arrive between the two reads of a batch never double a stored key."""
    day, path, landed = datetime(2024, 1, 1), scratch("target"), scratch("landed")
    news(spark, [(1, day, "old"), (9, day, "old")]).write.parquet(path)
    news(spark, [(4, day, "a"), (5, day, "b")]).write.parquet(landed)

    def late(rows):
        # Runs after the key range was read and before the rows are.
        news(spark, [(9, day, "again"), (5, day, "b")]).write.mode("append").parquet(landed)
        return rows.sparkSession.read.schema(NEWS).parquet(landed).join(rows.select("id"), "id", "left_semi").dropDuplicates(["id"])

    assert insert_if_absent(spark.read.schema(NEWS).parquet(landed), path, prepare=late) == 2
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 4, 5, 9]


def test_label_by_votes(spark):
    target = news(spark, [(1, None, "x")])
    rows = label_by_votes(news(spark, [(1, None, "eth"), (2, None, "neo")]), target).collect()
    assert [(r.id, r.tp, r.rate, r.cat) for r in rows] == [(2, "NEO/USDT", 2, 1)]
    assert with_defaults(target).first().rate == -101
    assert label_news(target).columns == NEWS_COLUMNS + ["tp", "rate", "cat"]


def test_split_is_stable(spark):
    train, valid = train_valid(spark.range(1000))
    assert train.count() + valid.count() == 1000 and 50 < valid.count() < 200
    assert train.intersect(valid).count() == 0
