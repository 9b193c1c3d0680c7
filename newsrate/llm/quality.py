"""Quality by weak supervision.

Rules vote good (1) or bad (-1) or abstain (0). What a rule votes on good and on bad texts is not
given: expectation-maximisation estimates it, with the share of bad texts, from the counts of vote
patterns (3 to the number of rules at most) of all rows that pass the base test, until it settles. A text is
kept when its posterior probability of being good is at least ``LEAST_POSTERIOR`` and it does not fail the base test.

The rules' accuracies are bounded (``TRUSTED``): each votes bad on at most 0.2 % of the good texts and on 5 to
90 % of the bad ones. Without bounds the likelihood is free to take any dependence between rules for the two
classes, and bad texts that a single rule knows become good ones. What the bounds cost: a kind of bad text
that only one rule knows and that is rarer than about 1 % cannot be told from false votes and is kept.

Everything over rows is DataFrame expressions; texts are read once and only their counts are written.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsrate.functions.binding import bind
from newsrate.llm.common import stored, word_list

SPACES = " \t\n\x0b\f\r"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
LEAST_POSTERIOR = 0.5
#: Settled when no pattern's posterior moves more than this; that takes 20 to 300 rounds.
SETTLED, MOST_ROUNDS = 1e-9, 20_000
#: A text with a bad vote begins as bad with this probability, others as good.
FIRST = 0.9
SMOOTHING = 0.5

COUNTS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_exclaim n_ends"
).split()


class Bounds(NamedTuple):
    """The largest share of good texts a rule calls bad, the least and the largest share of bad texts it
    finds, and of bad texts among all."""

    most_false: float
    found: tuple[float, float]
    share: tuple[float, float]


LOOSE = Bounds(0.99, (0.01, 0.99), (0.001, 0.5))
TRUSTED = Bounds(0.002, (0.05, 0.9), (0.001, 0.5))


def _pairs(values: Column, step: int, count: Column) -> Column:
    """Hashes of each value with that ``step`` places on, ``count`` of them."""
    n = F.greatest(count, F.lit(0))
    return F.zip_with(
        F.slice(values, F.lit(1), n),
        F.slice(values, F.lit(1 + step), n),
        lambda a, b: F.xxhash64(a, b),
    )


def _removed(text: Column, pattern: str) -> Column:
    """How many characters match."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ``COUNTS``) of every whole text; a null text counts as empty.

    Words that stand in an eight-word window found twice: windows are hashed in three doublings;
    only where some hash comes again are they sorted, and the places that the repeated ones cover
    are added up.
    """
    df = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    df = bind(df, words=word_list(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != F.lit(""))
    df = bind(df, lines=lines, n=F.size("words"))
    df = df.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w)).cast("long").alias("word_chars"),
        _removed(F.col("text"), "[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _removed(F.col("text"), r"\p{Lu}+").cast("long").alias("n_upper"),
        _removed(F.col("text"), "!+").cast("long").alias("n_exclaim"),
        _removed(F.col("text"), "[.!?]+").cast("long").alias("n_ends"),
        "n",
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    kept = [c for c in df.columns if c != "h"]
    for step in (1, 2, 4):
        df = bind(df, g=_pairs(F.col("h"), step, F.col("n") - (2 * step - 1)))
        df = df.select(*kept, F.col("g").alias("h"))
    some = F.size(F.array_distinct("h")) < F.size("h")
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = bind(df, p=F.when(some, placed))
    again = F.transform(
        F.filter(
            F.transform("p", lambda x, k: F.struct(
                x["i"].alias("i"),
                (
                    F.coalesce(F.get("p", k - 1)["x"] == x["x"], F.lit(False))
                    | F.coalesce(F.get("p", k + 1)["x"] == x["x"], F.lit(False))
                ).alias("twice"),
            )),
            lambda x: x["twice"],
        ),
        lambda x: x["i"],
    )
    df = bind(df, at=F.sort_array(again))
    covered = F.aggregate(
        F.transform("at", lambda x, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - x, F.lit(WINDOW))
        )),
        F.lit(0),
        lambda a, x: a + x,
    )
    return df.select(
        "doc_id",
        *[c for c in COUNTS if c != "n_repeat_words"],
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The rules' votes, from the counts; whole numbers only, so no division."""
    c = {name: F.col(name) for name in COUNTS}
    words, chars = c["n_words"], c["word_chars"]
    return {
        "length": _vote(words < LEAST_WORDS, words >= 50),
        "symbols": _vote(c["n_symbols"] * 100 > words * 10, c["n_symbols"] * 100 <= words),
        "repeats": _vote(
            c["n_repeat_words"] * 100 > words * 25, c["n_repeat_words"] * 100 <= words * 5
        ),
        "lines": _vote(
            c["n_dup_lines"] * 100 > c["n_lines"] * 30, c["n_dup_lines"] * 100 <= c["n_lines"] * 5
        ),
        "capitals": _vote(c["n_upper"] * 100 > chars * 40, c["n_upper"] * 100 <= chars * 15),
        "exclaims": _vote(c["n_exclaim"] * 100 > words * 25, c["n_exclaim"] * 100 <= words),
        "ends": _vote(
            (c["n_ends"] == 0) & (words >= 60), (c["n_ends"] * 100 >= words) & (c["n_ends"] * 3 <= words)
        ),
        "word_size": _vote(
            (chars > words * 15) | (chars * 2 < words * 5), (chars <= words * 10) & (chars >= words * 3)
        ),
    }


def _odds(model: dict[str, dict[int, float]], prior: float) -> Column:
    """Log odds of good to bad, given the votes; to abstain says nothing."""
    total = F.lit(math.log(prior / (1 - prior)))
    for name, table in model.items():
        vote = F.when(F.col(name) == -1, table[-1]).when(F.col(name) == 1, table[1])
        total = total + vote.otherwise(0.0)
    return total


Pattern = tuple[tuple[int, ...], int]


def settle(
    patterns: list[Pattern], rules: int, bounds: Bounds = LOOSE, rounds: int = MOST_ROUNDS
) -> tuple[list[tuple[float, float]], float, bool]:
    """(share of bad votes on bad and on good texts by rule, share of bad texts, whether it settled)
    from the vote patterns and their rows. Of each class a rule's share is over the rows it votes on,
    clipped to its bounds, which is the bounded maximum of a round."""
    total = sum(n for _, n in patterns)
    bad = [FIRST if -1 in votes else 1 - FIRST for votes, _ in patterns]
    accuracy, share, settled = [(0.5, 0.5)] * rules, 0.5, not patterns
    clip = lambda x, low, high: min(max(x, low), high)
    for _ in range(rounds if patterns else 0):
        rows = sum(n * p for (_, n), p in zip(patterns, bad))
        share = clip((rows + SMOOTHING) / (total + 2 * SMOOTHING), *bounds.share)
        odds = [math.log(share / (1 - share))] * len(patterns)
        for j in range(rules):
            sums = {(v, k): SMOOTHING for v in (-1, 1) for k in (0, 1)}
            for (votes, n), p in zip(patterns, bad):
                if votes[j]:
                    sums[votes[j], 1] += n * p
                    sums[votes[j], 0] += n * (1 - p)
            found = clip(sums[-1, 1] / (sums[-1, 1] + sums[1, 1]), *bounds.found)
            false = min(sums[-1, 0] / (sums[-1, 0] + sums[1, 0]), bounds.most_false)
            accuracy[j] = found, false
            ratio = {-1: math.log(found / false), 0: 0.0, 1: math.log((1 - found) / (1 - false))}
            odds = [o + ratio[votes[j]] for o, (votes, _) in zip(odds, patterns)]
        now = [1 / (1 + math.exp(-o)) for o in odds]
        settled = max(abs(x - y) for x, y in zip(now, bad)) < SETTLED
        bad = now
        if settled:
            break
    return accuracy, share, settled


def estimate(votes: DataFrame, bounds: Bounds = LOOSE) -> tuple[dict[str, dict[int, float]], float]:
    """(log likelihood ratios good to bad by rule and vote, share of good) by
    expectation-maximisation.

    ``votes`` has a column per rule. Only the counts of vote patterns come to the driver, 3 to the
    number of rules at most. Without rows all rules are uninformative. An estimate that does not
    settle is an error.
    """
    names = votes.columns
    counted = votes.groupBy(*names).agg(F.count(F.lit(1)).alias("_rows")).collect()
    patterns = sorted((tuple(r[n] for n in names), r["_rows"]) for r in counted)
    accuracy, share, settled = settle(patterns, len(names), bounds)
    if not settled:
        raise RuntimeError(f"the estimate did not settle in {MOST_ROUNDS} rounds")
    model = {
        n: {-1: math.log(false / found), 1: math.log((1 - false) / (1 - found))}
        for n, (found, false) in zip(names, accuracy)
    }
    return model, 1 - share


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    posterior), one row per input row, repeated rows and null ids included. A text without words
    fails the base test."""
    found = stored(counts(docs, id_col, text_col), "quality")
    votes = rules()
    failed = (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT
    )
    voted = found.select("*", *[v.alias(n) for n, v in votes.items()])
    model, prior = estimate(voted.filter(~failed).select(*votes), TRUSTED)
    posterior = 1 / (1 + F.exp(-_odds(model, prior)))
    return voted.select(
        F.col("doc_id").alias(id_col), *COUNTS[:5], failed.alias("base_failed"),
        (~failed & (posterior >= LEAST_POSTERIOR)).alias("kept"), posterior.alias("posterior"),
    )
