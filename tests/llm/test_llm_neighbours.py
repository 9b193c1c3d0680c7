"""The nearest-neighbour classifier: exact votes, bounds, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest

from newsrate.llm import neighbours as nb

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def space(tables):
    return nb.fit(*tables)


def fold(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 4


def brute_force(space, text):
    """Every labelled vector compared one by one, without blocks, caches or the sparse form."""
    x = np.zeros(len(space.places))
    for term, n in nb.term_counts(text).items():
        if term in space.places:
            x[space.places[term]] = np.log1p(n) * space.weight[space.places[term]]
    v = x @ space.project
    v /= max(np.linalg.norm(v), 1e-12)
    near = sorted(((float(u @ v), y) for u, y in zip(space.vectors, space.labels)), reverse=True)
    power = [(max(s, 0.0) ** nb.SHARPNESS, y) for s, y in near[: nb.NEIGHBOURS]]
    total = sum(p for p, _ in power)
    return sum(p * y for p, y in power) / total if total else space.rate


def test_scores_equal_brute_force_and_hold_out(tables, space):
    docs, labels = tables
    got = {r.doc_id: r for r in nb.neighbour_quality(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys() and len(got) == docs.count()
    for key, r in got.items():
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (fold(key) == 2)
    wrong = [k for k in texts if abs(got[k].score - brute_force(space, texts[k])) > 1e-3]
    # Neighbours of equal similarity at the border are interchangeable.
    assert len(wrong) <= len(texts) // 100
    known = [(r.quality, got[r.doc_id]) for r in labels.collect() if r.doc_id in got]
    held = [(q, r.predicted) for q, r in known if r.held_out]
    assert sum(q == p for q, p in held) >= 0.97 * len(held)
    assert sum(p == 0 for q, p in held if q == 0) >= 0.8 * sum(q == 0 for q, _ in held)


def test_axes_keep_the_leading_directions():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(60, 9, False)).astype("i4"), rng.integers(1, 9, 9)) for _ in range(900)]
    weight = rng.uniform(0.5, 2, 60)
    axes = nb.latent_axes(rows, weight, 5)
    dense = nb._dense(rows, weight)
    best = np.linalg.svd(dense, full_matrices=False)[1][:5]
    assert np.linalg.norm(dense @ axes) ** 2 >= 0.98 * (best**2).sum()
    assert np.allclose(axes.T @ axes, np.eye(5), atol=1e-5)


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    docs = spark.createDataFrame([(i % 50, f"t{i % 70}") for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i % 50, i % 2, 0) for i in range(100)] + [(None, 1, 0), (3, None, 0)],
        "doc_id long, quality int, toxic int",
    )
    rows = nb.labelled_rows(docs.repartition(7), labels, 40)
    again = nb.labelled_rows(docs, labels.repartition(3), 40)
    assert rows.count() == 40
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))
    # Equal rows count once: (id, text) repeats, its label does not change.
    distinct = nb.labelled_rows(docs, labels, 10_000).count()
    used = {i for i in range(50) if fold(i) != 2}
    assert distinct == len({(i % 50, i % 70) for i in range(900) if i % 50 in used})


ODD = [
    (None, None), (None, "good words here"), (1, ""), (1, ""), (2, " \n\t "), (3, "x" * 200_000),
    (4, "Ab!! CD!! EF!! " * 20_000), (5, "\x00\x01 日本語"), (6, "fine plain words stand here."),
]


def test_odd_rows(spark, tables):
    docs, labels = tables
    extra = spark.createDataFrame(
        [(k, t, 1, 0.5, 9) for k, t in ODD],
        "doc_id long, text string, label int, score double, quality int",
    )
    got = nb.neighbour_quality(extra, labels.withColumn("text", labels.toxic.cast("string")))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1


def test_empty_tables(spark, tables):
    docs, labels = tables
    assert nb.neighbour_quality(docs.limit(0), labels).count() == 0
    few = spark.createDataFrame(ODD, "doc_id long, text string")
    assert {r.score for r in nb.neighbour_quality(few, labels.limit(0)).collect()} == {0.5}
    one = spark.createDataFrame([(6, 1)], "doc_id long, quality int")
    assert {r.score for r in nb.neighbour_quality(few, one).collect()} == {1.0}
