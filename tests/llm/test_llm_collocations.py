"""Collocations against a plain re-statement; the tree against counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from newsrate.llm import collocations as col


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(docs, longest=5, least=100, percent=100, top=2000):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    key = (lang, tuple(words[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    cands = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    covered = set()
    for (lang, w), a in cands.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                part = w[i : i + size]
                if 100 * a >= percent * f[lang, part]:
                    covered.add((lang, part))
    rows = []
    for (lang, w), a in cands.items():
        if (lang, w) in covered:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, w[:k]], f[lang, w[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        rows.append((lang, " ".join(w), a, left, right, n[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, i, *r[1:]) for i, r in enumerate(best[:top], 1)]
    return sorted(out)


def corpus(seed, rows=120, words=9):
    rng = random.Random(seed)
    alphabet = ["a", "b", "A", "the", "of", "ünd", "x\x00", "x\x01", "c-d", "日本", "\x1f", " ", "z" * 50][:words]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; ", "\x0b", "?!"]
    docs = []
    for i in range(rows):
        text = "".join(rng.choice(alphabet) + rng.choice(marks) for _ in range(rng.randint(0, 60)))
        docs.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return docs + [("en", None), ("de", ""), (None, " \n. "), ("en", "the of a " * 400), ("xx", "b")] * 2


def frame(spark, docs, parts=3):
    rows = [(i, t, lang, 1, "p") for i, (lang, t) in enumerate(docs)]
    kind = "doc_id long, text string, lang string, n int, phrase string"
    return spark.createDataFrame(rows, kind).repartition(parts)


@pytest.mark.parametrize(
    "seed, longest, least, percent, top, budget, chunk",
    [
        (1, 5, 5, 100, 2000, 2_000_000, 1 << 20),
        (2, 5, 3, 100, 7, 50, 64),  # prefixes are extended, chunks are small
        (3, 3, 4, 60, 2000, 1, 1000),  # all prefixes are over the budget
        (4, 2, 2, 100, 5, 200, 17),
    ],
)
def test_equals_restatement(spark, monkeypatch, seed, longest, least, percent, top, budget, chunk):
    monkeypatch.setattr(col, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(col, "RANKED_ROWS", 20)
    monkeypatch.setattr(col, "MOST_HEAVY", 10_000)
    monkeypatch.setattr(col, "BLOCK_BITS", 1 << 13)
    docs = corpus(seed)
    got = col.collocations(frame(spark, docs), longest, least, percent, top, budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == expected(docs, longest, least, percent, top)


def test_rare_runs_make_no_long_suffixes(spark, monkeypatch):
    rng = random.Random(9)
    pair = [("en", f"ab cd w{i % 9} ef gh v{i % 7}") for i in range(80)]
    mixed = [("en", " ".join(rng.choice(["ab cd", "ef gh", "x", "y", "z"]) for _ in range(30))) for _ in range(60)]
    made = []
    kept = col.grouped_suffixes
    monkeypatch.setattr(col, "grouped_suffixes", lambda *a: made.append(kept(*a)) or made[-1])
    docs = pair + mixed
    got = col.collocations(frame(spark, docs, 1), least=20)
    assert sorted(map(tuple, got.collect())) == expected(docs, least=20)
    runs = Counter()
    for _, text in docs:
        words = text.split()
        runs.update("\0".join(words[i : i + k]) for k in (2, 3) for i in range(len(words) - k + 1))
    for r in made[0].collect():
        words = r.suffix.split("\0")
        assert len(words) >= 2
        for k in (2, 3):
            for i in range(len(words) - k + 1):
                assert runs["\0".join(words[i : i + k])] >= 20


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    got = sorted(map(tuple, col.collocations(docs, least=10).collect()))
    assert got and got == expected(rows, least=10)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert col.collocations(docs).count() == 0
    assert col.collocations(frame(spark, [("en", None), (None, "rare words here")])).count() == 0


def test_products_beyond_64_bits(spark):
    rows = [("x", "a\0b", 2, 4 * 10**12), ("x", "a", 1, 5 * 10**12), ("x", "b", 1, 6 * 10**12)]
    nodes = spark.createDataFrame(rows, "lang string, phrase string, words int, n long")
    totals = spark.createDataFrame([("x", 9 * 10**13)], "lang string, n long")
    (r,) = col.scored_phrases(nodes, totals, 100).collect()
    assert r.score == 1000 * 4 * 10**12 * 9 * 10**13 // (5 * 10**12 * 6 * 10**12)
    assert (r.a, r.l, r.r) == (4 * 10**12, 5 * 10**12, 6 * 10**12)


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_tree_over_batches(size):
    rng = random.Random(size)
    leaves = sorted(
        ("en" if rng.random() < 0.7 else "de", [rng.choice("abc") for _ in range(rng.randint(1, 4))])
        for _ in range(300)
    )
    n = np.array([rng.randint(1, 9) for _ in leaves])
    tree, got = col.Tree(4, 1, set()), []
    for i in range(0, len(leaves), size):
        part = leaves[i : i + size]
        langs, texts = pa.array([a for a, _ in part]), pa.array(["\0".join(w) for _, w in part])
        got += tree.add(langs, texts, n[i : i + size])
    got += tree.close()
    counts = Counter()
    for (lang, words), m in zip(leaves, n):
        for d in range(1, len(words) + 1):
            counts[lang, "\0".join(words[:d]), d] += int(m)
    assert len(got) == len(counts) and {g[:3]: g[3] for g in got} == counts


def test_packing_and_filter(spark):
    loads = np.random.default_rng(0).integers(0, 40, 500)
    groups = col.pack(loads, 1000)
    sums = np.bincount(groups, loads)
    assert len(sums) == -(-loads.sum() // 1000) and sums.max() <= 1000 + 40
    words = [("en", f"w{i}") for i in range(3000)] + [("dé", "日本")]
    bits = col.word_filter(spark.createDataFrame(words, "lang string, prefix string"))
    place = np.array([col.prefix_hash(a, w.encode()) % (len(bits) * 8) for a, w in words])
    assert (bits[place >> 3] >> (place & 7).astype("u1") & 1).all()
    assert np.unpackbits(bits).sum() <= len(words)
