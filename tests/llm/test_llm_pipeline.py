"""The queries against their SQL, the pipeline against its stages' rules on a small table."""

import os

import corpus_pipeline
import pytest
from __spark_entry__ import queries
from compare import connect, differences

from newsrate.llm.oracles import ORACLES
from newsrate.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


def test_all_are_registered():
    assert {n.split("_")[0] for n in queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert queries()["pipeline"] is corpus_pipeline.run


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = corpus_pipeline.scratch_dir(spark, f"test-{name}")
        out = stage(spark, docs, SF_DIR)
        assert out.columns == columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        if name == "near_duplicates":
            assert docs.select("doc_id").distinct().count() == docs.count()
            assert corpus_pipeline.near_dup.near_duplicates(docs).filter("not kept").count() == 0
        if name == "decontamination":
            benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
            texts = [r.text for r in docs.collect()]
            assert not any(b.text in t for b in benchmark for t in texts if t)
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).orderBy("start").collect()
    assert len(last) == sizes[-1]
    assert [r.doc_id for r in last] == sorted(r.doc_id for r in last)
    at = 0
    for r in last:
        assert r.start == at
        at += r.n_tokens


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 1), (1, "", "en", "a", 0, 1), (2, "same text here", "en", None, 3, 1), (3, "same text here", None, "b", 3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            some = stage(spark, some, SF_DIR)
            assert some.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, some, SF_DIR).count() == some.count()


def test_stage_finds_pairs_from_080_on(spark):
    # Texts of 104 distinct words have 100 shingles; ends of n other words leave 100 - n in common.
    rows, expected = [], []
    for i, n in enumerate([9, 9, 10, 10, 11, 11, 12, 13]):
        words = [f"w{i}x{k}" for k in range(104)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-n] + [f"v{i}x{k}" for k in range(n)]))]
        expected += [2 * i] if (100 - n) / (100 + n) >= 0.8 else [2 * i, 2 * i + 1]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).collect())
    assert kept == expected
    at_85 = corpus_pipeline.near_dup.near_duplicates(docs)
    assert at_85.filter("not kept").count() == 0


def test_stages_keep_rows_with_null_and_repeated_ids(spark):
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").filter("length(text) > 0").first().text
    text = lambda k, n=40: " ".join(f"{k}w{i}" for i in range(n))
    schema = "doc_id long, text string, source string"

    def kept(stage, rows):
        return sorted((tuple(r) for r in stage(spark, spark.createDataFrame(rows, schema), SF_DIR).collect()), key=str)

    # Two texts under id 5, of which one is a copy; a copy without an id; one row three times.
    rows = [(1, text("a"), "x"), (5, text("a"), "x"), (5, text("b"), "x"), (None, text("b"), "x"), (None, text("c"), "x")]
    rows += [(7, text("d"), "x")] * 3 + [(None, None, None), (None, "", None)]
    clean = [rows[0], rows[2], rows[4], rows[5], rows[8], rows[9]]
    assert kept(corpus_pipeline.drop_near_duplicates, rows) == sorted(clean, key=str)

    leaky = [(None, f"{text('e')} {benchmark} {text('f')}", "x"), (3, f"{benchmark} {text('g')}", "x")]
    clean = [(None, text("h"), "x"), (3, text("i"), "x"), (3, text("i"), "x"), (None, None, None)]
    assert kept(corpus_pipeline.drop_leaks, leaky + clean) == sorted(clean, key=str)

    # One source gives 1.5 times its words: each row once or twice, half of them twice.
    rows = [(None, text(f"j{i}", 32), "x") for i in range(20)] + [(9, text(f"k{i}", 32), "x") for i in range(20)]
    mixed = kept(corpus_pipeline.mix_sources, rows)
    assert set(mixed) == set(rows) and len(mixed) == 60
