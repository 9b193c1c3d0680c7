"""Quality, licences, toxicity, decontamination and the language model."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from newsrate.llm import decontaminate, language_model, licenses, quality, toxicity

RNG = random.Random(3)
LINES = ["the cat sat on the mat.", "a b c d e f g h i j", "", " \t", "x # y | z", "ÉCOLE!!"]
TEXTS = [None, "", " ", "\n\n", "one", "a b c d e f g h " * 9, "für " * 40] + [
    "\n".join(RNG.choice(LINES) for _ in range(RNG.randint(1, 30))) for _ in range(40)
]


def documents(spark, texts, extra="n_words int"):
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {
        k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)
    }
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    docs = documents(spark, TEXTS).union(documents(spark, TEXTS[:3]))
    got = quality.quality(docs).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        n, chars, symbols, lines, repeats = base_counts(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols) == (n, chars, symbols)
        assert (r.n_dup_lines, r.n_repeat_words) == (lines, repeats)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    assert quality.quality(docs.limit(0)).count() == 0


def test_estimates_find_a_wrong_rule(spark):
    rng = random.Random(1)
    rows, truth = [], []
    for _ in range(3000):
        good = rng.random() < 0.8
        vote = lambda p: (1 if good else -1) * (1 if rng.random() < p else -1)  # noqa: E731, B023
        rows.append((vote(0.95), vote(0.9) if rng.random() < 0.7 else 0, vote(0.93), vote(0.5) if rng.random() < 0.1 else 0))
        truth.append(good)
    model, prior = quality.estimate(spark.createDataFrame(rows, "a int, b int, c int, d int"))
    assert prior == pytest.approx(0.8, abs=0.06)
    assert model["a"][-1] < -1.5 and model["c"][1] > 1
    assert abs(model["d"][-1]) < 1.5 < abs(model["a"][-1])
    odds = [math.log(prior / (1 - prior)) + sum(model[k].get(v, 0) for k, v in zip("abcd", r)) for r in rows]
    assert np.mean([(o > 0) == t for o, t in zip(odds, truth)]) > 0.95


def votes_by_hand(patterns, bounds, rounds):
    """The verdicts of bounded expectation-maximisation, restated over arrays."""
    votes = np.array([v for v, _ in patterns])
    rows = np.array([n for _, n in patterns], float)
    p = np.where((votes == -1).any(1), 0.9, 0.1)
    for _ in range(rounds):
        share = np.clip(((rows * p).sum() + 0.5) / (rows.sum() + 1), *bounds.share)
        cast = lambda v, w: ((votes == v) * (rows * w)[:, None]).sum(0) + 0.5
        found = np.clip(cast(-1, p) / (cast(-1, p) + cast(1, p)), *bounds.found)
        false = np.minimum(cast(-1, 1 - p) / (cast(-1, 1 - p) + cast(1, 1 - p)), bounds.most_false)
        odds = np.log(share / (1 - share)) + ((votes == -1) @ np.log(found / false) + (votes == 1) @ np.log((1 - found) / (1 - false)))
        p = 1 / (1 + np.exp(-odds))
    return p < 0.5


def verdicts(patterns, rounds=quality.MOST_ROUNDS):
    accuracy, share, settled = quality.settle(patterns, len(patterns[0][0]), quality.TRUSTED, rounds)
    odds = lambda v: math.log(share / (1 - share)) + sum(
        {-1: math.log(f / g), 0: 0.0, 1: math.log((1 - f) / (1 - g))}[x] for x, (f, g) in zip(v, accuracy)
    )
    return [odds(v) < 0 for v, _ in patterns], settled


@pytest.mark.parametrize("junk", [10, 20, 75, 400])
def test_verdict_holds_when_the_estimate_settles(junk):
    # Of 1000 texts ``junk`` are known to one rule only; two other rules fail together on four clean ones.
    patterns = [
        ((1, 1, 1, 1, 1, 1, 1, 1), 900), ((0, 1, 1, 1, 1, 1, 1, 1), 30), ((1, 1, 0, 0, 1, 1, 1, 1), 40),
        ((1, 1, -1, -1, 1, 1, 1, 1), 1), ((1, 1, 0, -1, 1, 1, 1, 1), 3), ((1, -1, 1, 1, 1, 1, 1, 1), junk),
    ]
    short, _ = verdicts(patterns, 50)
    long, _ = verdicts(patterns, 500)
    whole, settled = verdicts(patterns)
    assert settled and short == long == whole
    assert whole == votes_by_hand(patterns, quality.TRUSTED, 3000).tolist()
    assert whole[:3] == [True] * 3 and not whole[5]
    assert quality.settle([], 8, quality.TRUSTED)[2]


def test_quality_finds_junk_known_to_one_rule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "quality AS good")
    got = quality.quality(docs).filter("not base_failed").join(labels, "doc_id").groupBy("good", "kept").count().collect()
    n = {(r.good, r.kept): r["count"] for r in got}
    assert n[0, False] >= 25 and n[0, False] + n.get((0, True), 0) == 28
    assert n.get((1, False), 0) <= 0.01 * n[1, True]


def test_license_template_regions():
    auto = licenses.compile_template("use [[only]] under {{2}} the terms [[a [[b]]]]", "x")
    end = lambda t: auto.end(t.encode().split(), 0)
    assert end("use under the terms") == 4
    assert end("use only under p q the terms a b") == 9
    assert end("use only under p q r the terms") is None
    assert end("use under terms") is None
    for bad in ("{{2}} a", "[[a]]", "a [[b", "a ]]"):
        with pytest.raises(ValueError):
            licenses.compile_template(bad, "x")


def test_license_scan(spark):
    texts = [
        None, "", "Under the MIT-License, under (the) mit LICENSE",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
        "CC-BY NC", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "the mit", "licenseé under the mit licenseé", "x " * 5000 + "cc by nc",
    ]
    got = {r.doc_id: r for r in licenses.license_scan(documents(spark, texts)).collect()}
    assert (got[0].n_words, got[0].first_word, got[0].labels, got[0].score) == (0, None, "", 0.0)
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (2, 0, 4, "mit")
    assert got[3].base_labels == "apache-2" and got[3].score == 1.0
    assert got[4].labels == "cc-by-nc" and got[5].base_labels == "" and got[5].labels == "mit"
    assert got[6].n_base == got[7].n_base == 0
    assert (got[8].n_words, got[8].first_word) == (5003, 5000)


def test_toxicity(spark):
    rng = random.Random(2)
    words = [f"w{i}x" for i in range(300)]
    texts, toxic = [], []
    for _ in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic.append(int(rng.random() < 0.3))
        if toxic[-1]:
            text.insert(rng.randrange(len(text)), rng.choice(["scoundrelish", "scoundrelly", "vile"]))
        if rng.random() < (0.6 if toxic[-1] else 0.1):  # the group is named more often in abuse
            text.append("women")
        texts.append(" ".join(text).title())
    docs = documents(spark, texts + [None, "", "we met women"])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(texts) + 3
    held = [i for i in range(len(texts)) if got[i].held_out]
    assert held == [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.97
    assert got[900].score == got[901].score < 0.5 and got[902].predicted == 0
    rows = toxicity.training_rows(docs, labels, 10**6)
    assert {r.toxic for r in rows} == {0, 1}
    weights, _ = toxicity.fit(rows)
    assert sum(weights.get(f, 0) for f in toxicity.word_features(b"women")) < 1.0
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8)))
    items = [[word() for _ in range(n)] for n in (12, 20, 48, 59, 150)]
    texts, expected = [], set()
    for i in range(120):
        text = [word() for _ in range(rng.randint(0, 400))]
        if i % 3 == 0:
            k = rng.randrange(len(items))
            passage = list(items[k])
            if i % 2 and len(passage) > 15:  # a paraphrase: a tenth of the words replaced
                for j in rng.sample(range(len(passage) - 6), len(passage) // 10):
                    passage[j] = word()
            at = rng.randint(0, len(text))
            text[at:at] = passage
            expected.add((i, k))
        texts.append(" ".join(text).title())
    docs = documents(spark, [*texts, None, ""])
    bench = [(k, " ".join(t) + ".") for k, t in enumerate(items)] + [(9, None), (None, "a b"), (10, "")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    in_blocks = decontaminate.leaks(docs, benchmark, block_items=3).collect()
    assert {(r.doc_id, r.item_id) for r in in_blocks} == expected
    twice = docs.union(docs).withColumn("item_id", docs.doc_id).withColumn("words", docs.text)
    assert decontaminate.leaks(twice, benchmark).count() == 2 * len(found)
    assert decontaminate.leaks(docs.limit(0), benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_leaks_recall_against_the_check_on_words(spark):
    rng = random.Random(8)
    folder = "/root/testdata/sf0.01"
    hosts = [decontaminate.word_ids(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").limit(300).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    queries = decontaminate.passages(items)
    pool = np.concatenate(hosts).tolist()
    rows = [(i, bytearray(h.tobytes())) for i, h in enumerate(hosts)]
    index = decontaminate.index_of(spark.createDataFrame(rows, "doc_id long, words binary"), queries)
    wanted, got = set(), set()
    cases = []
    for p in queries:
        for share in (0.62, 0.7, 0.85):
            kept = p.words.copy()
            body = range(len(kept) - len(p.answer) if share < 0.8 else len(kept))
            lost = rng.sample(body, len(kept) - math.ceil(share * len(kept)))
            kept[lost] = rng.choices(pool, k=len(lost))
            host = rng.choice(hosts)
            cases.append(np.concatenate([host[:300], kept, host[300:600]]).astype("u4"))
        spread = [x for w in p.words.tolist() for x in [w, *rng.choices(pool, k=rng.random() < 0.4)]]
        cases.append(np.concatenate([rng.choice(hosts)[:200], np.array(spread, "u4")]).astype("u4"))
    for doc, ids in enumerate(cases):
        one = decontaminate.Texts.of([doc], [ids])
        wanted |= {m[:2] for m in decontaminate.matches(one, index, -np.inf)}
        got |= {m[:2] for m in decontaminate.matches(one, index)}
    assert got <= wanted and len(wanted) >= 0.9 * len(cases)
    assert len(got) >= 0.98 * len(wanted)
    for doc, ids in enumerate(cases[:40]):
        # Without any index: every window and every passage.
        starts = [max(0, w * decontaminate.BLOCK - decontaminate.PASSAGE_WORDS) for w in range(-(-len(ids) // decontaminate.BLOCK))]
        ends = [(w + 2) * decontaminate.BLOCK + decontaminate.PASSAGE_WORDS for w in range(len(starts))]
        brute = {(doc, p.item_id) for p in queries for a, b in zip(starts, ends)
                 if p.present(set(ids[a:b].tolist())) >= decontaminate.LCS_WITH_ANSWER and decontaminate.matched(ids[a:b], p)}
        assert brute == {m for m in wanted if m[0] == doc}
    # The same together, in slices, and for a text of many slices.
    together = decontaminate.matches(decontaminate.Texts.of(list(range(len(cases))), cases), index)
    assert {m[:2] for m in together} == got
    long = np.concatenate(cases[:400] * 2).astype("u4")
    assert len(long) > 2 * decontaminate.SLICE * decontaminate.BLOCK
    items = {m[1] for m in decontaminate.matches(decontaminate.Texts.of([None, 1], [long, long]), index)}
    assert items >= {i for d, i in got if d < 400}


def test_common_subsequence():
    rng = random.Random(6)
    for _ in range(60):
        a = [rng.randrange(6) for _ in range(rng.randint(0, 20))]
        b = [rng.randrange(6) for _ in range(rng.randint(1, 20))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        passage = decontaminate.Passage(0, np.array(b, "u4"), np.array(b[-1:], "u4"))
        assert decontaminate.common_subsequence(a, passage) == table[-1][-1]
        assert passage.present(set(a)) * len(b) >= table[-1][-1]


def test_language_model_gradients():
    rng = np.random.default_rng(1)
    params = {k: v.astype("f4") for k, v in language_model.first_params(rng.random(1024) * 9).items()}
    params["C"] += rng.standard_normal(params["C"].shape).astype("f4") * 0.3
    params["O"] += rng.standard_normal(params["O"].shape).astype("f4") * 0.3
    inputs, targets = rng.integers(0, 1024, (5, 3)), rng.integers(0, 1024, (5, 3))
    targets[3:, 2] = -1
    h = np.zeros((3, language_model.HIDDEN), "f4")
    _, _, grads, _ = language_model.window_gradients(params, inputs, targets, h)
    for name in params:
        move = rng.standard_normal(params[name].shape).astype("f4")
        losses = []
        for sign in (1, -1):
            moved = {**params, name: params[name] + sign * np.float32(3e-3) * move}
            losses.append(language_model.window_gradients(moved, inputs, targets, h)[0])
        assert (losses[0] - losses[1]) / 6e-3 == pytest.approx(float((grads[name] * move).sum()), rel=0.05, abs=0.05)


def test_different_words_of_a_block_are_hashed_once(monkeypatch):
    texts = [None, "", " \t", "a b", " Lead  trail ", "É é\x0bx\x1cy", "a a\x00 b\r\nA", "日本 \u3000b"] * 4
    whole = pa.array(["x"] + texts + ["x"], pa.string())
    known = language_model.Known(np.unique(language_model.word_hashes("a b trail é"))[::-1], np.arange(4) + 1)
    for together in 1, 20, 1 << 20:
        monkeypatch.setattr(language_model, "TOGETHER", together)
        got = list(known.found(whole.slice(1, len(texts))))
        assert len(got) == len(texts)
        for text, (hashes, at) in zip(texts, got):
            expected = language_model.word_hashes(text)
            assert hashes.tolist() == expected.tolist()
            assert at.tolist() == known.find(expected).tolist()
    seen = []
    monkeypatch.setattr(language_model, "xxh3_64_intdigest", lambda w: seen.append(w) or len(seen))
    list(known.found(pa.array(["the cat the", "cat The"] * 50)))
    assert sorted(w for w in seen if w) == [b"cat", b"the"]
    assert list(known.found(pa.array([], pa.string()))) == []


def test_language_model(spark):
    rng = random.Random(9)
    nxt = {f"a{i}": f"a{(i * 7 + 3) % 40}" for i in range(40)}
    texts = []
    for _ in range(500):
        w = f"a{rng.randrange(40)}"
        text = []
        for _ in range(rng.randint(1, 60)):
            text.append(w)
            w = nxt[w] if rng.random() < 0.9 else f"a{rng.randrange(40)}"
        texts.append(" ".join(text))
    texts += [None, "", "A1 never seen zzz", "a1 " * 3000]
    got = language_model.scores(documents(spark, texts, "c int"), frequent=20, replicas=1, rounds=3).collect()
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in train for w in (texts[i] or "").lower().split())
    c["\n"] = len(train)
    n, v = sum(c.values()), len(c)
    for r in got:
        tokens = (texts[r.doc_id] or "").lower().split() + ["\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
        assert r.held_out == (r.doc_id not in train)
    held = [r for r in got if r.held_out and r.doc_id < 500]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 5
    empty = language_model.scores(documents(spark, texts[:0], "c int"))
    assert empty.count() == 0


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_every_training_row_is_in_one_round(spark, rounds):
    texts = [f"w{i} w{i % 7}" for i in range(60)] + ["same text"] * 20
    train = documents(spark, texts, "c int").select("text")
    data = spark.range(1000).withColumnRenamed("id", "seed")
    parts = [data.filter(language_model.in_round(r, rounds)) for r in range(rounds)]
    assert sorted(x.seed for p in parts for x in p.collect()) == list(range(1000))
    known = language_model.Known(np.empty(0, "i8"), np.empty(0, "i8"))
    _, learned = language_model.train_model(train, known, np.ones(language_model.VOCABULARY + 2), 2, rounds)
    assert learned == 80 * 3


def test_every_word_is_learned_from(spark):
    words = [0, 1, 3, 191, 192, 193, 400, 5000]
    train = documents(spark, [" ".join(f"w{i % 50}" for i in range(n)) for n in words], "c int").select("text")
    known = language_model.Known(np.empty(0, "i8"), np.empty(0, "i8"))
    _, learned = language_model.train_model(train, known, np.ones(language_model.VOCABULARY + 2), 2, 2)
    assert learned == sum(n + 1 for n in words)
    ids = np.arange(1, 1001)
    parts = language_model.cut(ids)
    assert np.concatenate([p[1:] for p in parts]).tolist() == ids.tolist()
    assert [p[0] for p in parts] == [language_model.END, *(p[-1] for p in parts[:-1])]


def test_network_knows_most_tokens():
    assert language_model.VOCABULARY > 16000 and language_model.VOCABULARY + 2 <= 1 << 16


def test_state_is_carried_across_windows():
    rng = np.random.default_rng(2)
    params = language_model.first_params(np.ones(1024))
    params["C"] += rng.standard_normal(params["C"].shape).astype("f4")
    texts = [rng.integers(0, 1024, n) for n in (1, 16, 17, 50, 200)]
    together = language_model.log_probabilities(params, texts)
    for text, whole in zip(texts, together):
        table = params["E"] @ params["W"] + params["b"]
        h, last, total = np.zeros((1, language_model.HIDDEN), "f4"), 0, 0.0
        for t in text:
            h = language_model.step(table[[last]], h, params["U"])[0]
            total += language_model.outputs(h, np.array([t]), params)[0]
            last = t
        assert whole == pytest.approx(total, rel=1e-4)


def test_words_are_found_by_their_hash():
    rng = np.random.default_rng(4)
    hashes = np.unique(np.concatenate([rng.integers(-(1 << 62), 1 << 62, 5000), np.arange(200), [-1, -(1 << 63), (1 << 63) - 1]]))
    known = language_model.Known(hashes, rng.integers(1, 99, len(hashes)))
    for wanted in (hashes, hashes + 1, np.empty(0, "i8")):
        there = set(hashes.tolist())
        at = known.find(wanted)
        assert [a >= 0 for a in at.tolist()] == [h in there for h in wanted.tolist()]
        assert (known.hashes[at[at >= 0]] == wanted[at >= 0]).all()
    assert language_model.Known(np.empty(0, "i8"), np.empty(0, "i8")).find(hashes).max() == -1


def test_replicas_are_averaged_by_what_they_learned(spark, monkeypatch):
    """Parts by size, two levels of means: the same as a mean of the replicas at once."""
    monkeypatch.setattr(language_model, "REPLICA_SYMBOLS", 40)
    texts = [" ".join(f"w{(i * j) % 9}" for j in range(1 + i % 30)) for i in range(60)]
    train = documents(spark, texts, "c int").select("text")
    known = language_model.Known(np.empty(0, "i8"), np.empty(0, "i8"))
    counts = np.zeros(language_model.SYMBOLS)
    counts[0], counts[1] = 60, sum(len(t.split()) for t in texts)
    params, learned = language_model.train_model(train, known, counts, 1, 1)
    assert learned == counts.sum()
    assert [v.shape for v in params.values()] == [v.shape for v in language_model.first_params(counts).values()]
    assert all(np.isfinite(v).all() for v in params.values()) and np.abs(params["C"]).max() > 0
    rng = np.random.default_rng(5)
    sets = [(int(n), rng.standard_normal(6).astype("f4")) for n in rng.integers(1, 50, 9)]
    row = lambda i: {"shard": i % 3, "block": 7, "tokens": sets[i][0], "numbers": sets[i][1].tobytes()}
    table = lambda rows: pa.Table.from_pylist(rows, schema=language_model.MEAN)
    level = [language_model.mean_block(table([row(i) for i in range(9) if i % 3 == k])).to_pylist()[0] for k in range(3)]
    (got,) = language_model.mean_block(table(level)).to_pylist()
    mean = sum(n * x for n, x in sets) / sum(n for n, _ in sets)
    assert got["tokens"] == sum(n for n, _ in sets)
    assert np.frombuffer(got["numbers"], "f4") == pytest.approx(mean, abs=1e-5)


def test_texts_are_coded_once_for_training_and_scoring(spark, monkeypatch):
    """The network learns from and scores the symbols that one pass over the texts has stored."""
    texts = ["a b a c", None, "", "c  A unseen", "b " * 300] * 6
    found, kept = [], language_model.train_model
    monkeypatch.setattr(language_model, "train_model", lambda train, *a: found.append((train, a[0])) or kept(train, *a))
    rows = language_model.scores(documents(spark, texts, "c int"), frequent=3, replicas=1, rounds=1).collect()
    (train, known), = found
    assert train.columns == ["symbols"]
    docs = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    expected = [x.astype("<u2").tobytes() for x in known.symbols_of(pa.array(docs, pa.string()))]
    assert sorted(bytes(r.symbols) for r in train.collect()) == sorted(expected)
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))


def test_bias_as_a_factor_gives_the_same_gradients(monkeypatch):
    rng = np.random.default_rng(3)
    params = {k: v.astype("f4") for k, v in language_model.first_params(rng.random(1024) * 9).items()}
    params["C"] += rng.standard_normal(params["C"].shape).astype("f4") * 0.3
    params["O"] += rng.standard_normal(params["O"].shape).astype("f4") * 0.3
    h = np.tanh(rng.standard_normal((500, language_model.HIDDEN))).astype("f4")
    targets = rng.integers(0, 1024, 500)
    found = []
    monkeypatch.setattr(language_model, "ROWS", 64)
    for safe in True, False:
        monkeypatch.setattr(language_model, "tame", lambda weights, bias: safe)
        grads = {k: np.zeros_like(v) for k, v in params.items()}
        found.append([*language_model.outputs(h, targets, params, grads), *(grads[k] for k in "CcOo")])
    for a, b in zip(*found):
        assert a == pytest.approx(b, rel=1e-3, abs=1e-4)
    # The gradients of all biases add up to nothing.
    assert [float(found[0][i].sum()) for i in (3, 5)] == pytest.approx([0, 0], abs=1e-2)
    weights, bias = np.full((2, 24), 0.5, "f4"), np.full(2, 5, "f4")
    x = weights[:1] @ weights.T
    logp, share, weight = language_model.picked(x, bias, ([0], [1]), True, True)
    assert logp == pytest.approx([-math.log(2)], rel=1e-5)
    assert (x * share[:, None] * weight)[0] == pytest.approx([0.5, -0.5], rel=1e-5)


def test_wide_weights_are_scored_without_overflow():
    rng = np.random.default_rng(6)
    params = language_model.first_params(rng.random(100) * 9)
    h = np.tanh(rng.standard_normal((50, language_model.HIDDEN))).astype("f4")
    targets = rng.integers(0, 100, 50)
    for size in (1, 300):
        params["C"] = (rng.standard_normal(params["C"].shape) * size).astype("f4")
        params["O"] = (rng.standard_normal(params["O"].shape) * size).astype("f4")
        starts = language_model.class_starts(100)
        got = language_model.outputs(h, targets, params)
        for i, t in enumerate(targets):
            k = int(np.searchsorted(starts, t, "right")) - 1
            total = 0.0
            for x, j in ((h[i] @ params["C"] + params["c"], k),
                         ((params["O"] @ h[i] + params["o"])[starts[k] : starts[k + 1]], t - starts[k])):
                x = x.astype("f8")
                total += x[j] - x.max() - math.log(np.exp(x - x.max()).sum())
            assert got[i] == pytest.approx(total, rel=1e-3, abs=1e-3)


def test_presence_looks_at_the_rarest_words_first():
    rng = np.random.default_rng(2)
    every = bytes(range(128)).decode() + "äÄßЖ x"
    words = re.findall(rb"[0-9a-z\x80-\xff]+", every.encode().lower())
    assert decontaminate.LETTERS and decontaminate.word_ids(every).tolist() == [
        zlib.crc32(w) for w in words
    ]
    terms = np.arange(100, dtype="u4")
    queries = [
        decontaminate.Passage(i, rng.integers(0, 100, n).astype("u4"), terms[:1])
        for i, n in enumerate([48, 48, 47, 20, 3, 1])
    ]
    columns = np.full((6, 48), 100)
    for i, q in enumerate(queries):
        columns[i, : len(q.words)] = q.words
    index = decontaminate.Index(terms, np.ones(100, "f4"), None, None, queries, columns)
    texts = decontaminate.Texts.of([1, 2], [rng.integers(0, 140, n).astype("u4") for n in (900, 300)])
    pairs = [(w, q) for w in range(texts.blocks) for q in range(6) if w not in texts.first - 1]
    windows, found = map(np.array, zip(*pairs))
    got = decontaminate.present(texts, index, texts.known(terms), windows, found)
    begins = [0, 900]
    size = decontaminate.BLOCK
    want = []
    for w, q in pairs:
        t = int(np.searchsorted(texts.first, w, "right")) - 1
        at = (w - texts.first[t]) * size
        own = texts.ids[begins[t] : texts.ends[t]]
        near = set(own[max(0, at - 48) : at + 2 * size + 48].tolist())
        want.append(queries[q].present(near) >= decontaminate.LCS_WITH_ANSWER - 1e-9)
    assert got.tolist() == want and 0 < sum(want) < len(want)
