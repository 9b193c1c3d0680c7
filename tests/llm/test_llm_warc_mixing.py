"""The archive's exact round trip; apportionment against the plain highest-quotient rule."""

import hashlib

import pytest
from pyspark.sql import functions as F

from newsrate.llm import mixing, warc

PAGES = "page_id long, url string, html string, payload string"


def test_archive_round_trip(spark, scratch):
    big, odd = "<p>é</p>" * 200, "x" * 999
    rows = [(1, "u1", big, ""), (2, "u2\r\nX-Page-ID: 9", big, ""), (3, None, big, ""), (3, "again", big, ""),
            (4, "u", odd, ""), (5, "u", odd, ""), (6, "u", None, ""), (None, "u", big, ""), (7, "u", "", "")]
    path = scratch("warc")
    warc.write_archive(spark.createDataFrame(rows, PAGES), path)
    got = warc.page_records(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        body = {1: big, 2: big, 3: big, 4: odd, 5: odd, 6: "", None: big, 7: ""}[r.page_id].encode()
        assert r.payload_bytes == len(body)
        assert r.payload_digest == hashlib.sha1(body).hexdigest()
        refers = 3 if r.page_id in (1, 2, None) else None
        assert (r.record_type, r.refers_to) == ("revisit" if refers else "response", refers)
    assert spark.read.parquet(path + "/payloads").count() == 3
    for r in warc.read_archive(spark, path).collect():
        head, rest = bytes(r.record).split(b"\r\n\r\n", 1)
        length = int(head.split(b"Content-Length: ")[1])
        assert len(rest) == length + 4 and rest.endswith(b"\r\n\r\n")
        if b"WARC-Type: response" in head:
            assert rest[:-4].endswith(bytes(r.payload))


def test_only_null_ids_are_responses(spark, scratch):
    pages = spark.createDataFrame([(None, "u", "y" * 2000, "")] * 2, PAGES)
    warc.write_archive(pages, scratch("w"))
    got = warc.page_records(spark, scratch("w")).collect()
    assert [(r.record_type, r.refers_to) for r in got] == [("response", None)] * 2


def test_empty_archive(spark, scratch):
    warc.write_archive(spark.createDataFrame([], PAGES), scratch("e"))
    assert warc.page_records(spark, scratch("e")).count() == 0


def test_altered_payload_stops_the_read(spark, scratch):
    warc.write_archive(spark.createDataFrame([(1, "u", "body", "")], PAGES), scratch("a"))
    store = spark.read.parquet(scratch("a") + "/payloads")
    other = scratch("b")
    spark.read.parquet(scratch("a") + "/headers").write.parquet(other + "/headers")
    store.withColumn("payload", F.lit(b"else")).write.parquet(other + "/payloads")
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(spark, other).collect()


def plain_targets(sizes, weights=(3, 1, 2), rate=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, rest, open_ = dict.fromkeys(order, 0.0), rate * sum(sizes.values()), set(order)
    while rest > 1e-9 and open_:
        total, more = sum(w[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += rest * w[s] / total
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                more += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
        rest = more
    return target


def test_mix(spark):
    texts = [("a", 500), ("b", 3000), (None, 900), ("é", 40), ("zero", 0), ("c", 2500)]
    rows, i = [], 0
    for source, words in texts:
        for part in (words // 2, words // 3, words - words // 2 - words // 3):
            rows.append((i, "w " * part, source, 1, "x"))
            i += 1
    rows += [(i, None, "b", 1, "x"), (None, "p q", "b", 1, "x"), (7, "p q", "b", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, key string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    expected = {sizes[s]: t for s, t in plain_targets(sizes).items()}
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(expected[r.source_size], abs=1e-6)
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    for size, t in taken.items():
        assert abs(t - expected[size]) <= mixing.BLOCK_WORDS / 2 + 1e-6
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_groups_do_not_change_the_mix(spark, monkeypatch):
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"),
    )
    whole = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "GROUP_ROWS", 7)
    assert sorted(map(str, mixing.mix(docs).collect())) == whole


def test_quotas_are_highest_quotients(spark):
    target = {"a": 1000.0, "b": 333.0, "c": 70.0, "d": 3.0}
    frame = spark.createDataFrame([(s, t) for s, t in target.items()], "source string, target double")
    quotas = mixing.shard_quotas(frame, 5, 10).collect()
    for upto in range(5):
        have = {s: sum(q.quota for q in quotas if q.source == s and q.shard <= upto) for s in target}
        seats = dict.fromkeys(target, 0)
        for _ in range(sum(have.values())):
            best = max(seats, key=lambda s: target[s] / (2 * seats[s] + 1))
            seats[best] += 1
        assert seats == have


def test_payloads_are_stored_once_without_a_broadcast_too(spark, scratch, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_OWNERS", 0)
    rows = [(i % 5, "u", "z" * 1500 if i % 2 else None, "") for i in range(20)]
    warc.write_archive(spark.createDataFrame(rows, PAGES), scratch("s"))
    assert spark.read.parquet(scratch("s") + "/payloads").count() == 2
    got = warc.page_records(spark, scratch("s")).collect()
    assert sorted((r.payload_bytes, r.refers_to) for r in got if r.payload_bytes and r.page_id == 1) == [(1500, 4)] * 2
