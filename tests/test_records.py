"""Splittable CSV with line breaks in fields, against Spark's own reader of whole files."""

import random

import pytest
from newsrate.schemas import NEWS_COLUMNS
from newsrate.sinks.files import append_csv
from newsrate.sources.files import read_news_csv
from newsrate.sources.records import csv_records, ends_inside
from pyspark.sql import functions as F

FIELDS = ["", "a", "x y", '"q"', '"two\nlines"', '"a,b"', '"say ""hi"""', '""', '"\n\n"', 'in "the" field',
          '"""\n"""', "é日", 'tail"', '"closed"rest', '"a\n""b"",\n c"', "5"]


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


@pytest.fixture
def splits(spark):
    """Sets the size of a split."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def small(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield small
    for n, v in before.items():
        spark.conf.set(n, v)


def by_machine(text):
    """Records by a machine over single characters."""
    out, record, state, i = [], "", "start", 0
    while i < len(text):
        c = text[i]
        if state == "quoted" and c == '"' and text[i + 1 : i + 2] == '"':
            record, i = record + c, i + 1
        elif state == "quoted":
            state = "rest" if c == '"' else "quoted"
        elif c == "\n":
            out.append(record)
            record, state, i = "", "start", i + 1
            continue
        elif c == ",":
            state = "start"
        elif c == '"' and state == "start":
            state = "quoted"
        elif state == "start":
            state = "plain"
        record, i = record + c, i + 1
    return sorted(r for r in [*out, record] if r)


@pytest.mark.parametrize("size", [16, 90, 1 << 20])
def test_records_equal_a_machine(spark, splits, tmp_path, size):
    rng = random.Random(size)
    rows = [",".join(rng.choice(FIELDS) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts = ["\n".join(rows) + "\n", "\n\n".join(rows[:9]), "", "\n", '"never\nclosed\n,a', "a,b" + "\n" * 5]
    for i, text in enumerate(texts):
        write(tmp_path / f"{i}.csv", text)
    splits(size)
    got = csv_records(spark, str(tmp_path))
    want = sorted(r.rstrip("\n") if "never" in r else r for t in texts for r in by_machine(t))
    assert sorted(r.value for r in got.collect()) == want


def test_state_of_a_line():
    assert ends_inside('a,"b', False) and ends_inside("b", True) and ends_inside('"",', True)
    assert not ends_inside('a"b,c', False) and not ends_inside('b"', True)
    assert ends_inside('b","c', True) and not ends_inside('"a""b","","c"d,"e"', False)


@pytest.mark.parametrize("size", [700, 1 << 20])
def test_news_equal_the_one_task_read(spark, splits, tmp_path, size):
    rng = random.Random(3)
    texts = ["plain", 'a "quoted" word', "one\ntwo\n\nthree", "comma, here", '"', "", None, "日本\n語", "x" * 300]
    rows = [(i, 1_700_000_000 + i, rng.choice(texts), rng.choice(texts), i, i % 3, i, "u") for i in range(400)]
    kind = "id long, t long, title string, description string, up_count int, down_count int, hits long, url string"
    news = spark.createDataFrame(rows, kind).withColumn("inputtime", F.timestamp_seconds("t"))
    path = str(tmp_path / "news")
    append_csv(news.coalesce(1), path, NEWS_COLUMNS)
    append_csv(news.limit(30).coalesce(1), path, ["id", "title", "hits"])
    write(tmp_path / "news" / "bad.csv", '1,soon,"a\nb",c,1,2,3,u\n\n2,2024-01-01 00:00:00,t,d,x,1,1,u\n')
    schema = news.select(*NEWS_COLUMNS).schema.add("_record", "string")
    whole = spark.read.schema(schema).csv(
        path, multiLine=True, quote='"', escape='"', timestampFormat="yyyy-MM-dd HH:mm:ss",
        columnNameOfCorruptRecord="_record",
    ).cache()
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(r) for r in whole.filter("_record IS NULL").drop("_record").collect()), key=key)
    splits(size)
    good, bad = read_news_csv(spark, path)
    assert good.rdd.getNumPartitions() > (8 if size == 700 else 0)
    assert sorted(map(tuple, good.collect()), key=key) == want and len(want) == 400
    records = sorted(r.value for r in bad.collect())
    assert len(records) == 32 and '1,soon,"a\nb",c,1,2,3,u' in records
    assert whole.filter("_record IS NOT NULL").count() == 32
