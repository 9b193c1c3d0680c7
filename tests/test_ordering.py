import re

from newsrate.operators.filters import (
    alerts,
    author_range,
    check_rows,
    drop_no_result,
    ok_pages,
    require_id,
    tradable,
    until_empty_page,
    with_pair,
)
from newsrate.operators.lookup import lexicon_join, lexicon_pairs, unique_side_join
from newsrate.lexicon import DEFAULT_LEXICON, lexicon_frame
from newsrate.operators.ordering import (
    batch_number,
    global_position,
    keep_first,
    seeded_shuffle,
    since,
    take_while,
    union_pages,
)
from newsrate.functions.text import text_pair
from pyspark.sql import functions as F


def test_keep_first_with_hot_copies(spark):
    rows = [(1, 5, "x")] * 300 + [(1, 4, "first"), (2, 1, "b"), (2, 1, "a"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "id int, seq int, v string")
    got = sorted(map(tuple, keep_first(df, "id", "seq").collect()), key=str)
    assert got == [(1, 4, "first"), (2, 1, "a"), (None, 1, "n")]


def test_keep_first_equals_row_number(spark):
    df = spark.range(500).select(
        (F.col("id") % 37).alias("id"), F.hash("id").alias("seq"), F.col("id").alias("v")
    )
    df.createOrReplaceTempView("t")
    expected = spark.sql(
        "SELECT id, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, v) r"
        " FROM t) WHERE r = 1"
    )
    got = keep_first(df, ["id"], ["seq"])
    assert sorted(got.collect()) == sorted(expected.collect())


def feed(spark, rows):
    return spark.createDataFrame(rows, "page int, pos int, t string")


def test_take_while_and_since(spark):
    rows = [(0, 0, "9"), (0, 1, "7"), (1, 0, "5"), (1, 1, "8"), (2, 0, "1")]
    df = feed(spark, rows)
    kept = lambda d: sorted(r.t for r in d.collect())
    assert kept(since(df, "t", "5")) == ["7", "8", "9"]
    assert kept(since(df, "t", "5", "compat")) == ["7", "9"]
    assert kept(since(df, "t", "0", "compat")) == ["1", "5", "7", "8", "9"]
    assert kept(take_while(df, ["page", "pos"], F.lit(None).cast("boolean"))) == [
        "1", "5", "7", "8", "9",
    ]
    ordered = feed(spark, [(i, 0, f"{99 - i:02d}") for i in range(50)])
    assert kept(since(ordered, "t", "70", "compat")) == kept(since(ordered, "t", "70"))


def test_pages(spark):
    rows = [(0, 200, 2), (1, 500, 0), (2, 200, 3), (3, 200, 0), (4, 200, 9), (5, 200, None)]
    df = spark.createDataFrame(rows, "page int, status int, n int")
    good = ok_pages(df)
    assert [r.page for r in until_empty_page(good, F.col("n")).orderBy("page").collect()] == [0, 2]
    full = df.filter("n > 0")
    assert until_empty_page(full, F.col("n"), max_pages=4).count() == 2


def test_global_position(spark):
    rows = [(i * 7919 % 1000, "ab"[i % 3 == 0]) for i in range(1000)] + [(5000, None)]
    df = spark.createDataFrame(rows, "k int, g string").repartition(7)
    got = {r.k: r.position for r in global_position(df, ["k"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}
    for group in ("a", "b", None):
        placed = global_position(df, ["k"], ["g"]).filter(F.col("g").eqNullSafe(group))
        pairs = sorted((r.k, r.position) for r in placed.collect())
        assert [p for _, p in pairs] == list(range(len(pairs)))
    sizes = batch_number(df, 300, ["k"]).groupBy("batch").count().orderBy("batch").collect()
    assert [(r.batch, r["count"]) for r in sizes] == [(0, 300), (1, 300), (2, 300), (3, 101)]


def test_seeded_shuffle_repeats(spark):
    df = spark.range(200).repartition(5)
    one, two = ([r.id for r in seeded_shuffle(df, s).collect()] for s in (1, 1))
    other = [r.id for r in seeded_shuffle(df, 2).collect()]
    assert one == two != other
    assert sorted(one) == sorted(other) == list(range(200))


def test_shuffle_splits_exact_copies(spark):
    df = spark.range(4000).select(F.lit(1).alias("id"), F.lit("x").alias("v")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = seeded_shuffle(df, 1).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 4000 and len(sizes) > 1


def test_union_pages(spark):
    assert union_pages(spark.range(2), spark.range(3), spark.range(1)).count() == 6


def test_unique_side_join_beyond_broadcast(spark):
    left = spark.createDataFrame([("a", 1)] * 200 + [("b", 2), ("z", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "k string, w int")
    for how in ("left", "inner"):
        small = sorted(map(str, unique_side_join(left.repartition(6), right, ["k"], how).collect()))
        large = unique_side_join(left.repartition(6), right, ["k"], how, limit=1)
        assert sorted(map(str, large.collect())) == small


def test_lexicon_pairs_equal_the_pattern(spark):
    texts = ["neo eth neo", "nothing", "x eth2 BNB", "比特币 up", "", None, "daſh eth", "ETH daſh"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    lexicon = lexicon_frame(spark)
    expected = {
        r.id: r.p
        for r in df.select("id", text_pair(F.col("t"), DEFAULT_LEXICON).alias("p")).collect()
        if r.p != ""
    }
    del expected[5]  # a null text is no hit
    for limit in (100, 1):
        got = {r.id: r.pair for r in lexicon_pairs(df, "t", lexicon, limit=limit).collect()}
        assert got == expected
    same = spark.createDataFrame([(1, "eth"), (1, "neo"), (1, "eth")], "id int, t string")
    assert lexicon_pairs(same, "t", lexicon).count() == 3
    keyed = df.select("id", F.upper("t").alias("kw"))
    assert lexicon_join(keyed, lexicon, "kw").filter("pair is not null").count() == 0


def test_row_filters(spark):
    df = spark.createDataFrame(
        [(1, "", 0), (2, "A/B", 1), (3, None, -1)], "id int, tp string, label int"
    )
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(tradable(df)) == [2]
    assert ids(with_pair(df)) == [2]
    assert ids(with_pair(df, "compat")) == [1, 2]
    assert ids(alerts(df)) == [2, 3]
    assert ids(require_id(df, "tp")) == [2]
    assert ids(drop_no_result(df.fillna("你输入的词没有找到任何结果!", ["tp"]), "tp")) == [1, 2]


def test_author_range(spark):
    rows = [(1, "x", False, "2024-01-01"), (2, "x", True, "2024-01-01"), (3, "x", False, "2024-01-02"),
            (4, "y", False, "2024-01-01"), (5, "x", False, "2023-12-31")]
    df = spark.createDataFrame(rows, "id int, author string, is_repost boolean, date string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(author_range(df, "x", "2024-01-01", "2024-01-02")) == [1]
    assert ids(author_range(df, "x")) == [1, 3, 5]


def test_check_rows(spark):
    lines = ["1,t,a,b,3,4,5,u", "1,t,a,b,x,4,5,u", "1,t,a", "1,t,a,b,3,4,5,u,v", None, " 1,t,a,b,3,4,5,\n"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    good, bad = check_rows(df, 8, ints=(4, 5))
    assert good.count() == 2
    assert sorted(r.status for r in bad.collect()) == ["int", "width", "width", "width"]
    rated = [f"{r},1" for r in ("2", "-100", "x", "", "1.9")]
    good, bad = check_rows(spark.createDataFrame([(x,) for x in rated], "value string"), 2, rate_at=0)
    assert good.count() == 3
    assert sorted(r.status for r in bad.collect()) == ["label", "rate"]


def test_pages_beyond_any_number_and_broken_pages(spark):
    from newsrate.plans.jobs import feed_quarantine, ingest_feed

    item = '{"id":%d,"inputtime":"%s","title":"t","description":"d","up_count":1,"down_count":0,"hits":1,"url":"u"}'
    body = lambda i, time="1700000000": '{"data":[%s]}' % (item % (i, time))
    rows = [(0, 200, body(1)), (1, 200, "<html>"), (2, 200, body(2, "soon")), (25000, 200, body(3)),
            (9, 200, '{"error":"rate limit"}'), (10, 200, '{"data":"later"}'), (11, 200, "[1]"),
            (25001, 200, '{"data":null}'), (25002, 200, body(4))]
    pages = spark.createDataFrame(rows, "page int, status int, body string")
    assert {r.id for r in ingest_feed(pages).collect()} == {1, 3}
    bad = sorted(tuple(r) for r in feed_quarantine(pages).select("page", "status").collect())
    assert bad == [(1, "body"), (2, "time"), (9, "data"), (10, "data"), (11, "body")]
    for end in ('{"data":[]}', '{"data":{}}', '{"data":""}', '{"data":0}', '{"data":false}', '{"data": null}'):
        ended = spark.createDataFrame([(0, 200, body(1)), (1, 200, end), (2, 200, body(2))], pages.schema)
        assert [r.id for r in ingest_feed(ended).collect()] == [1], end


def test_landed_pages_are_parsed_once_and_pruned(spark, scratch):
    from newsrate.plans.jobs import feed_quarantine, ingest_feed
    from newsrate.sources.feeds import land_pages

    item = '{"id":%d,"inputtime":"1700000000","title":"t","description":"d","up_count":1,"down_count":0,"hits":1,"url":"u"}'
    rows = [(i, 200, '{"data":[%s]}' % (item % i)) for i in range(0, 9000, 500)]
    rows += [(2600, 200, '{"data":[]}'), (700, 500, '{"data":[]}'), (900, 200, "{}")]
    land_pages(spark.createDataFrame(rows, "page long, status int, body string"), scratch("landed"))
    table = spark.read.parquet(scratch("landed"))
    found = ingest_feed(table)
    assert sorted(r.id for r in found.collect()) == [0, 500, 1000, 1500, 2000, 2500]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*page_range#\d+L? <= 2\)", plan), plan
    assert "from_json" not in plan and "JsonToStructs" not in plan
    assert [tuple(r) for r in feed_quarantine(table).collect()] == [(900, None, "data")]
    # A later poll lands more pages.
    land_pages(spark.createDataFrame([(1, 200, '{"data":[%s]}' % (item % 1))], "page long, status int, body string"), scratch("landed"))
    assert ingest_feed(spark.read.parquet(scratch("landed"))).count() == 7


def test_positions_by_many_groups(spark):
    """Few and many groups, a hot one, and missing parts of a key."""
    rows = [(i, None if i % 5 == 0 else "" if i % 5 == 1 else "hot", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, g string, h int").repartition(5)
    want = {}
    for i, g, h in rows:
        want[i] = sum(1 for j, *k in rows if k == [g, h] and j < i)
    for limit, hot in ((100, 100), (1, 100), (1, 5)):
        got = global_position(df, ["id"], ["g", "h"], limit, hot).collect()
        assert {r.id: r.position for r in got} == want
