"""Near duplicates against all pairs, components against a plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsrate.llm import near_dup
from newsrate.llm.components import components


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(5)]))


def smallest(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(5, 150))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    passage = " ".join(word() for _ in range(60))
    texts += [f"{passage} {' '.join(word() for _ in range(30))}" for _ in range(30)]
    texts += [None, "", "  \n", "one", "One", "two words", "two\twords", "É a", "é a", texts[0], texts[0].upper()]
    return dict(enumerate(texts))


def test_equals_all_pairs(spark):
    texts = corpus()
    sets = {d: shingles(t) for d, t in texts.items()}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    expected = smallest(texts, links)
    rows = [(d, t, "x", 1) for d, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, rep int")
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs.repartition(3)).collect()}
    assert {d: r.component_id for d, r in got.items()} == expected
    assert all(r.n_shingles == len(sets[d]) for d, r in got.items())
    assert all(r.kept == (d == r.component_id) for d, r in got.items())
    assert sum(not r.kept for r in got.values()) > 50


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_dup.near_duplicates(docs).collect()), key=str)
    expected = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 2, None, True), (None, 0, None, True)]
    assert got == sorted(expected, key=str)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_one_error_in_a_chunk_shares_a_key():
    rng = np.random.default_rng(0)
    one = rng.integers(0, 1 << 16, near_dup.SYMBOLS).astype("u2")
    two = one.copy()
    for c in range(near_dup.CHUNKS):  # two errors in all chunks but one: the largest distance
        two[c * near_dup.CHUNK + np.arange(2)] ^= 1
    two[0] ^= 1
    assert (one != two).sum() == near_dup.DISTANCE
    assert set(near_dup.index_keys(one[None])[0]) & set(near_dup.index_keys(two[None])[0])


def test_a_chunk_forms_a_pair_once(spark):
    # Two signatures that differ in one symbol shared five keys in each other chunk.
    one = np.arange(near_dup.SYMBOLS, dtype="<u2")
    two, far = one.copy(), one + np.uint16(500)
    two[7] += 1
    rows = [(i, bytearray(s.tobytes())) for i, s in enumerate([one, two, far])]
    classes = spark.createDataFrame(rows, "rep long, symbols binary")
    keys = near_dup._keys(classes, near_dup.CHUNKS)
    same = keys.alias("m").join(keys.alias("o"), "key").filter("m.rep < o.rep")
    assert same.count() == (near_dup.CHUNKS - 1) * near_dup.CHUNK + 1
    pairs = same.filter(near_dup._once("m", "o")).select("m.rep", F.col("o.rep").alias("other"))
    assert [tuple(r) for r in pairs.collect()] == [(0, 1)] * near_dup.CHUNKS


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    links += [(i, i + 1) for i in range(300, 340)] + [(500, 500)]
    expected = smallest({n for link in links for n in link}, links)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {n: c for n, c in expected.items() if n != c}
