"""Resampling against a plain re-statement."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from newsrate.llm import resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, longest=2):
    words = WORD.findall(lowered(text))
    runs = [
        " ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)
    ]
    return len(words), [zlib.crc32(r.encode()) for r in runs]


def expected(docs, target, buckets, percent, longest=2):
    own = [(d, *features(t, longest)) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in own:
        s.update(x % buckets for x in f)
    for x in target:
        t.update(y % buckets for y in features(x, longest)[1])
    all_s, all_t = s.total(), t.total()
    rows = []
    for d, n, f in own:
        gain = [
            math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
            for b in (x % buckets for x in f)
        ]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d, n, len(f), weight, score))
    long_enough = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(long_enough) * percent // 100
    out = [(d, f, w, sc, i + 1 if i < drawn else None) for i, (d, _, f, w, sc) in enumerate(long_enough)]
    return out + [(d, f, w, sc, None) for d, n, f, w, sc in rows if n < 20]


LONG = "Straße 12,no  gap-joined über alles\tand the end of IT " * 6
DOCS = [
    (1, "the cat sat on the mat " * 10), (2, "THE CAT sat\x00on  the_mat " * 9), (3, None), (4, ""),
    (5, "... !!"), (6, LONG), (6, LONG), (None, LONG), (7, "one two"), (8, "x" * 50_000),
    (9, "a b " * 20_000), (10, "日本語 ÄÖ é́ İ " * 8), (11, "dog ran far away " * 6), (-3, "cat mat sat " * 8),
]
TARGET = ["The cat sat on a mat.", None, "", "cat cat über", LONG]


@pytest.mark.parametrize("longest, percent", [(2, 50), (1, 100), (3, 25)])
def test_equals_restatement(spark, longest, percent):
    docs = spark.createDataFrame(
        [(d, t, 0, "x") for d, t in DOCS], "doc_id long, text string, rank int, buckets string"
    )
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, n_words int")
    got = rs.resample(docs.repartition(5), target, 97, longest, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        expected(DOCS, TARGET, 97, percent, longest), key=str
    )


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert rs.resample(none, docs).count() == 0
    got = sorted(map(tuple, rs.resample(docs, none, 50).collect()), key=str)
    assert got == sorted(expected(DOCS, [], 50, 25), key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    wanted = [r.text for r in target.select("text").collect()]
    got = sorted(map(tuple, rs.resample(docs, target).collect()), key=str)
    assert got == sorted(expected(rows, wanted, 10_000, 25), key=str)
