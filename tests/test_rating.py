from newsrate.functions import rating, vectors
from pyspark.sql import functions as F
from pytest import approx


def test_vote_rating(spark):
    cases = [
        (0, 0, 0), (9, 1, 1), (10, 1, 2), (6, 4, 0), (61, 39, 1), (9, 11, -1), (46, 54, 0),
        (3, 17, -2), (16, 84, -1), (0, 5, -2), (1, 0, 2), (None, 1, None),
    ]
    df = spark.createDataFrame(cases, "up int, down int, expected int")
    got = df.select(rating.vote_rating(F.col("up"), F.col("down")), "expected").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_price_rating(spark):
    cases = [
        (0.08, 0.08, -2), (0.09, 0.08, 2), (0.08, 0.09, -2), (0.02, 0.02, -1), (0.02, 0.08, -2),
        (0.08, 0.02, 2), (0.03, 0.02, 1), (0.075, 0.01, 1), (0.01, 0.075, -1), (0.01, 0.01, 0),
        (None, None, None),
    ]
    df = spark.createDataFrame(cases, "rise double, drop double, expected int")
    got = df.select(rating.price_rating(F.col("rise"), F.col("drop")), "expected").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_price_move_of_zero_is_null(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0), (4.0, 5.0, 3.0)], "o double, h double, l double")
    got = df.select(rating.price_move(F.col("o"), F.col("h"), F.col("l")).alias("m")).collect()
    assert tuple(got[0].m) == (None, None)
    assert tuple(got[1].m) == (0.25, 0.25)


def test_labels(column):
    assert column(rating.label_index, [-2, 2, -100, None], "int") == [0, 4, None, None]
    assert column(rating.index_to_rate, [0, 4, 5, -1, None], "int") == [-2, 2, None, None, None]


def test_softmax_argmax(column):
    values = [[1.0, 2.0, 3.0], [1000.0, 1000.0], [5.0]]
    probs = column(vectors.softmax, values, "array<double>")
    assert [sum(p) for p in probs] == [approx(1.0)] * 3
    assert probs[1] == [0.5, 0.5]
    assert column(vectors.argmax, values + [[1.0, 3.0, 3.0]], "array<double>") == [2, 0, 0, 1]


def test_cross_entropy(column):
    p = [[0.25, 0.75]]
    one = F.lit(1)
    assert column(lambda c: vectors.cross_entropy(c, one), p, "array<double>") == [
        approx(0.2876820724)
    ]
    assert column(lambda c: vectors.cross_entropy(c, one, "compat"), p, "array<double>") == [
        approx(0.4740769841)
    ]


def test_linear_head(column):
    got = column(
        lambda c: vectors.linear_head(c, [[1, 0], [1, -1]], [0.5, 0]),
        [[1.0, 2.0], None, [0.0, 3.0]],
        "array<float>",
    )
    assert got == [[1.5, -1.0], None, [0.5, -3.0]]


def test_prices_that_are_no_numbers_and_many_votes(spark):
    from pyspark.sql import functions as F

    from newsrate.functions.rating import price_move, price_rating, vote_rating

    nan = float("nan")
    rows = [(nan, 1.0, 1.0), (1.0, nan, 1.0), (1.0, 1.0, nan), (1.0, 1.09, 1.0)]
    df = spark.createDataFrame(rows, "o double, h double, l double")
    move = price_move(F.col("o"), F.col("h"), F.col("l"))
    rated = df.select(price_rating(move["rise"], move["drop"]).alias("r")).collect()
    assert [r.r for r in rated] == [None, None, None, 2]
    many = spark.createDataFrame([(2147483647, 2147483647)], "u int, d int")
    assert many.select(vote_rating(F.col("u"), F.col("d")).alias("r")).first().r == 0
