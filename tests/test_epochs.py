"""Epochs of one fit against a plain re-statement."""

import numpy as np
import pytest
from newsrate.plans.epochs import BETAS, EPSILON, Head, fit_epochs, token_ids
from newsrate.plans.model import evaluate, fit_and_score, load_model
from pyspark.sql import functions as F

FEATURES, BATCHES, CLASSES = 32, 4, 5


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)] + ["up", "down", "up up"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(150)]
    data = [(i, t, 4 if "up" in t else 0 if "down" in t else int(rng.integers(1, 4))) for i, t in enumerate(texts)]
    data += [(150, None, 2), (151, "", 2), (152, "up " * 5000, 4), (153, "down", None), (154, "up", 4), (154, "up", 4)]
    df = spark.createDataFrame(data, "id int, text string, label int").repartition(3)
    return df.withColumn("probs", F.lit("clash")).drop("probs")


def restated(df, epochs, rate, seed=0):
    """The same training with dense matrices, on the driver."""
    text = F.col("text")
    ids, batch = token_ids(text, FEATURES), F.pmod(F.xxhash64(text, F.col("id")), F.lit(BATCHES))
    got = df.filter("label is not null").select("label", ids.alias("ids"), batch.alias("b")).collect()
    n = len(got)
    counts = np.array([np.bincount(r.ids, minlength=FEATURES) for r in got], "f8")
    idf = np.log((n + 1) / ((counts > 0).sum(0) + 1))
    x = counts * idf / np.maximum(1, counts.sum(1, keepdims=True))
    x = np.hstack([x, np.ones((n, 1))])
    y, b = np.array([r.label for r in got]), np.array([r.b for r in got])
    w, m, v = (np.zeros((FEATURES + 1, CLASSES)) for _ in range(3))
    rng, step, out = np.random.default_rng(seed), 0, []
    for _ in range(epochs):
        losses, accs = [], []
        for k in rng.permutation(BATCHES):
            xs, ys = x[b == k], y[b == k]
            z = xs @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            losses.append(-np.log(p[range(len(ys)), ys]).mean())
            accs.append((p.argmax(1) == ys).mean())
            g = xs.T @ (p - np.eye(CLASSES)[ys]) / len(ys)
            step += 1
            m, v = BETAS[0] * m + (1 - BETAS[0]) * g, BETAS[1] * v + (1 - BETAS[1]) * g * g
            w = w - rate * (m / (1 - BETAS[0] ** step)) / (np.sqrt(v / (1 - BETAS[1] ** step)) + EPSILON)
        out.append((w, np.mean(losses), np.mean(accs)))
    return out


def test_epochs_go_on_and_equal_the_restatement(rows):
    heads, history = fit_epochs(rows, 3, BATCHES, 0.1, features=FEATURES, key="id")
    wanted = restated(rows, 3, 0.1)
    for head, seen, (w, loss, acc) in zip(heads, history, wanted):
        assert np.allclose(head.weights, w, atol=1e-8)
        assert seen["loss"] == pytest.approx(loss) and seen["acc"] == pytest.approx(acc)
    first, _ = fit_epochs(rows, 1, BATCHES, 0.1, features=FEATURES, key="id")
    assert np.allclose(first[0].weights, heads[0].weights, atol=1e-10)
    assert [h["loss"] for h in history] == sorted((h["loss"] for h in history), reverse=True)


def test_best_epoch_is_kept(spark, rows, scratch):
    known = rows.filter("label is not null and id < 154")
    wanted = restated(known, 3, 0.5)
    heads, _ = fit_epochs(known, 3, BATCHES, 0.5, features=FEATURES, key="id")
    result, scored = fit_and_score(
        known, known, scratch("best"), epochs=3, batches=BATCHES, learning_rate=0.5, features=FEATURES
    )
    acc = {r.epoch: r.acc for r in evaluate(heads, known).epochs.collect()}
    assert {r.epoch: r.acc for r in result.epochs.collect()} == pytest.approx(acc)
    best = max(acc.values())
    assert result.best == min(e for e, a in acc.items() if a == best)
    kept = load_model(scratch("best"))
    assert np.allclose(kept.weights, wanted[result.best - 1][0], atol=1e-8)
    probs = {r.id: r.probs for r in scored.collect()}
    assert all(sum(p) == pytest.approx(1.0) for p in probs.values()) and len(probs) == known.count()


def test_odd_tables(spark):
    none = spark.createDataFrame([], "id int, text string, label int")
    heads, history = fit_epochs(none, 2, 2, features=8)
    assert len(heads) == 2 and not heads[1].weights.any() and history[0]["loss"] is None
    assert heads[0].predict(none).count() == 0
    df = spark.createDataFrame([(1, None, "x"), (2, "a " * 3, "y")], "id int, text string, weights string")
    found = Head(np.ones(8), np.zeros((9, 5))).predict(df).collect()
    assert [r.probs for r in found] == [pytest.approx([0.2] * 5)] * 2


def test_one_part_a_core_travels(spark, rows):
    # Before, each task of a step sent one row for every feature that it had seen.
    from newsrate.plans import epochs

    ids = rows.repartition(64).select(token_ids(F.col("text"), 1 << 16).alias("ids"))
    sent = spark.sparkContext.accumulator(0)

    def total(batches):
        n = sum(b.num_rows for b in batches)
        sent.add(1)
        return np.full(3 * epochs.BLOCK // 2, float(n))

    size = 3 * epochs.BLOCK // 2
    assert (epochs.summed(ids, size, total) == rows.count()).all()
    assert sent.value <= spark.sparkContext.defaultParallelism
    seen = ids.select(F.explode(F.array_distinct("ids")).alias("f")).groupBy("f").count().collect()
    want = np.full(1 << 16, np.log(rows.count() + 1))
    want[[r.f for r in seen]] -= np.log([r["count"] + 1 for r in seen])
    assert np.allclose(epochs.inverse_frequencies(ids, 1 << 16), want)


def test_evaluation_reads_a_text_once(rows, monkeypatch):
    from newsrate.plans import model

    calls = []
    known = rows.filter("label is not null and id < 154")
    heads, _ = fit_epochs(known, 3, BATCHES, 0.5, features=FEATURES, key="id")
    split = model.token_ids
    monkeypatch.setattr(model, "token_ids", lambda *args: calls.append(1) or split(*args))
    got = {r.epoch: r.acc for r in evaluate(heads, known).epochs.collect()}
    assert len(calls) == 1
    for e, head in enumerate(heads, 1):
        assert {r.epoch: r.acc for r in evaluate([head], known).epochs.collect()}[1] == pytest.approx(got[e])
