"""From documents to token files: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsrate.llm import decontaminate, mixing, near_dup, toxicity, wavelet
from newsrate.llm.common import discard, discarding, stored
from newsrate.operators.lookup import is_small
from newsrate.session import scratch_dir

#: Near duplicates are linked from this similarity on; op3's own contract says 85. At 0.8, 24 chunks
#: of signature miss about 4 in ten million pairs.
SIMILARITY_PERCENT, CHUNKS = 80, 24

#: The key of a row of documents inside the pipeline: ids may be null or repeated.
ROW = "_pipeline_row"
FILE, PLACE, TIMES = "_pipeline_file", "_pipeline_place", "_pipeline_times"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Keys of rows travel to the texts up to this number (and the size of a broadcast); beyond, both
#: are shuffled.
BROADCAST_ROWS = 2_000_000


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique ``ROW`` that stays the same; as they are if they are numbered. Rows of
    files are numbered by file and place, so no text is written again; others are stored."""
    if ROW in docs.columns:
        return docs
    try:
        placed = docs.select(
            "*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE)
        )
        paths = placed.select(FILE).distinct()
    except AnalysisException:
        return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    names = sorted(r[0] for r in paths.collect())  # one per file
    files = docs.sparkSession.createDataFrame(list(enumerate(names)), f"{ROW} long, {FILE} string")
    row = F.col(ROW) * (1 << 36) + F.col(PLACE)
    return placed.join(F.broadcast(files), FILE).select(*docs.columns, row.alias(ROW))


def _keyed(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Join with a stored table that holds each ``ROW`` once: the texts stay where they are while the
    table can be broadcast."""
    small = is_small(keys, BROADCAST_ROWS)
    return rows.join(F.broadcast(keys) if small else keys, ROW, how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Its fit reads labelled documents of ``docs``.
    Null, empty and wordless texts get the score of a text without features."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    score = toxicity.scorer(spark, *model)
    return docs.filter(score(F.col("text")) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest id, or any of them. Null, empty and wordless
    texts are in no group and stay."""
    rows = numbered(docs)
    with discarding() as keep:
        found = near_dup.near_duplicates(rows, ROW, percent=SIMILARITY_PERCENT, chunks=CHUNKS)
        member = F.struct(F.col("doc_id").isNull(), "doc_id", ROW).alias("_member")
        members = found.join(rows.select(ROW, "doc_id"), ROW).select("component_id", member)
        kept = members.groupBy("component_id").agg(F.min("_member").alias("_member"))
        kept = stored(kept.select(F.col(f"_member.{ROW}").alias(ROW)), "kept")
        keep(kept)
    return _keyed(rows, kept, "left_semi").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null, empty and wordless texts hold none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = numbered(docs)
    with discarding() as keep:
        found = decontaminate.leaks(rows, benchmark, ROW).select(F.col("doc_id").alias(ROW))
        hits = stored(found.distinct(), "leaks")
        keep(hits)
    return _keyed(rows, hits, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, once for each begun pass over them (twice at most). Null, empty
    and wordless texts have no words to take and go."""
    rows = numbered(docs)
    with discarding() as keep:
        times = mixing.mix(rows, row_col=ROW).filter("taken > 0").select(
            ROW, F.ceil(F.col("taken") / F.col("size")).cast("int").alias(TIMES)
        )
        times = stored(times, "times")
        keep(times)
    again = F.explode(F.sequence(F.lit(1), F.col(TIMES)))
    taken = _keyed(rows, times, "inner").select(*docs.columns, again.alias(TIMES))
    return taken.drop(TIMES)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document of the token files, as they read back; null texts count as empty."""
    path = scratch_dir(spark, "llm-tokens")
    wavelet.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return wavelet.read_token_files(spark, path)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Training, hashing with xxh3, the latent space and the tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs.drop(ROW), sf_dir)
