from newsrate.operators import encode
from newsrate.operators.encode import build_vocabulary, encode_text
from newsrate.operators.metrics import (
    batch_metrics,
    best_epoch,
    dataset_size,
    epoch_metrics,
    running_best,
    score_rows,
)
from newsrate.operators.ordering import batch_number
from newsrate.plans.jobs import batch_score, training_set
from newsrate.plans.model import (
    fit_and_score,
    fit_head,
    load_model,
    predict,
    predict_head,
    score_vectors,
)
from pytest import approx


def test_vocabulary(spark):
    df = spark.createDataFrame([("b a b",), ("C b 买",), (None,)], "t string")
    got = [tuple(r) for r in build_vocabulary(df, "t").orderBy("token_id").collect()]
    assert got == [("b", 106), ("a", 107), ("c", 108), ("买", 109)]
    assert [r.token for r in build_vocabulary(df, "t", 1).collect()] == ["b"]


def test_encode_both_ways(spark):
    vocab = spark.createDataFrame([("a", 106), ("b", 107), ("买", 108)], "token string, token_id int")
    texts = ["A b", "zz 买b", "", None, "a " * 20, "a b", "A b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = encode_text(df, "t", vocab, 8).orderBy("id").collect()
    assert [r.n_tokens for r in rows] == [2, 3, 0, 0, 20, 2, 2]
    columns = ["id", "t", "input_ids", "token_type_ids", "attention_mask", "n_tokens"]
    small = [tuple(r[c] for c in columns[:5]) for r in rows]
    assert small[0][2:] == ([101, 106, 107, 102, 0, 0, 0, 0], [0] * 8, [1, 1, 1, 1, 0, 0, 0, 0])
    assert small[1][2] == [101, 100, 108, 107, 102, 0, 0, 0]
    assert small[2][2] == small[3][2] == [101, 102] + [0] * 6
    assert small[4][2:] == ([101] + [106] * 6 + [102], [0] * 8, [1] * 8)
    # Beyond the broadcast, with a word that is hot.
    large = encode_text(df, "t", vocab, 8, limit=1, hot_rows=3).orderBy("id").collect()
    assert [tuple(r[c] for c in columns) for r in large] == [
        (*s, r.n_tokens) for s, r in zip(small, rows)
    ]


def test_encode_joins_only_rare_words(spark, monkeypatch):
    # Of a vocabulary beyond the broadcast the first words travel; others and unknown ones are joined.
    df = spark.createDataFrame(
        [(i, f"a b a b a b rare{i % 3} new{i}") for i in range(30)] + [(30, None), (31, "b a")],
        "id int, t string",
    )
    words = [("a", 106), ("b", 107), *((f"rare{k}", 108 + k) for k in range(3))]
    vocab = spark.createDataFrame(words, "token string, token_id int")
    joined = []
    join = encode.unique_side_join

    def counted(left, *args):
        joined.append(left.count())
        return join(left, *args)

    monkeypatch.setattr(encode, "unique_side_join", counted)
    want = encode_text(df, "t", vocab, 10).orderBy("id").collect()
    assert not joined
    got = encode_text(df, "t", vocab, 10, limit=2, hot_rows=3).orderBy("id").collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in want]
    assert joined[0] == 60  # 30 * 8 + 2 occurrences in all


def test_training_set(spark):
    lines = spark.createDataFrame([("1,t,a b,d,9,0,3,u",), ("bad",)], "value string")
    vocab = spark.createDataFrame([("a", 106)], "token string, token_id int")
    good, bad = training_set(lines, vocab, max_len=5)
    assert [tuple(r) for r in bad.collect()] == [("bad", "width")]
    rows = good.collect()
    assert [(r.text, r.label, r.input_ids) for r in rows] == [("a b", 4, [101, 106, 100, 102, 0])]


def test_mean_of_batch_means(spark):
    probs = [0.9, 0.1], [0.1, 0.9]
    rows = [(1, "valid", i, probs[i == 4], 0) for i in range(5)]
    df = spark.createDataFrame(
        rows, "epoch int, split string, pos int, probs array<double>, label int"
    )
    numbered = batch_number(score_rows(df), 4, ["pos"], ["epoch", "split"])
    row = epoch_metrics(batch_metrics(numbered)).first()
    assert (row.acc, row.row_acc) == (0.5, approx(0.8))
    assert tuple(dataset_size(df).first()) == (5, 1)


def test_best_epoch(spark):
    def epochs(*acc):
        return spark.createDataFrame(list(enumerate(acc, 1)), "epoch int, acc double")

    some = epochs(0.0, 0.5, 0.5, 0.4)
    assert tuple(best_epoch(some).first()) == (2, 0.5)
    assert tuple(best_epoch(epochs(0.0, 0.0)).first()) == (None, None)
    flags = running_best(some).orderBy("epoch").collect()
    assert [r.improved for r in flags] == [False, True, False, False]


def test_fit_save_score(spark, scratch):
    words = [("down eth", 0), ("flat eth", 2), ("up eth", 4)]
    rows = [(i, *words[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, text string, label int")
    result, scored = fit_and_score(df, df, scratch("model"), features=1024)
    assert result.best == 1 and result.epochs.count() == 2
    assert sorted((r.epoch, r.split, r.acc) for r in result.splits.collect()) == [
        (e, split, approx(1.0)) for e in (1, 2) for split in ("train", "valid")
    ]
    assert scored.filter("label = truth - 2").count() == 90
    model = load_model(scratch("model"))
    assert sum(predict(df, model).first().probs) == approx(1.0)
    lines = spark.createDataFrame([("1,t,x,up eth,1,2,3,u",), ("2,t,x,none,1,2,3,u",)], "value string")
    assert [tuple(r) for r in batch_score(lines, model)[0].collect()] == [
        ("1,t,x,up eth,1,2,3,u", "up eth", "ETH/USDT", 2)
    ]


def test_heads(spark):
    rows = [(i, [float(i % 3 == k) for k in range(3)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v array<float>, label int")
    fitted = predict_head(df, fit_head(df, "v"), "v").collect()
    assert all(max(range(3), key=r.probs.__getitem__) == r.label for r in fitted)
    scored = score_vectors(df.drop("label"), "v", [[1, 0, 0], [0, 1, 0], [0, 0, 1]]).collect()
    assert all(r.label == r.id % 3 - 2 and sum(r.probs) == approx(1.0) for r in scored)
