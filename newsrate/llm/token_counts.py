"""Token counts of whole texts by a two-tier look-up on the map side.

A text is cut into pre-tokens: a run of white space with the word after it. The byte-level
tokenizer never merges over the end of a word, so a text has as many tokens as its pre-tokens
together. Tier one is a compact table of frequent pre-tokens and their lengths, broadcast: the
entries of the tokenizer's own vocabulary, which are its training text's frequent strings, so the
table is bounded by the vocabulary. Tier two is a bounded cache in each worker, filled by encoding
what the table lacks. No pre-token is ever shuffled.

Two kinds of text go to the library whole, as cutting them could change the count: those with a
special token's string and those with white space outside ASCII.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsrate.llm.common import BoundedCache

#: White space with the word after it, which ends after an ASCII letter that no letter follows: no
#: token reaches over that place. Else up to the next white space.
UNIT = re.compile(
    rb"[\t-\r ]*+[A-Za-z\x80-\xff]*[A-Za-z](?![A-Za-z\x80-\xff])|[\t-\r ]*+[^\t-\r ]+|[\t-\r ]+"
)
#: White space, or what some Unicode version or language takes for it, outside ``[\t-\r ]``.
ODD_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"

CACHED_UNITS = 400_000
LONGEST_CACHED = 64

_ready: dict[str, tuple] = {}


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def frequent_lengths(path: str) -> dict[bytes, int]:
    """Pre-tokens among the vocabulary's entries, with their numbers of tokens."""
    tokenizer = load_tokenizer(path)
    ids = sorted(tokenizer.get_vocab(with_added_tokens=False).values())
    texts = [t for t in tokenizer.decode_batch([[i] for i in ids]) if "\ufffd" not in t]
    units = [t for t in texts if UNIT.fullmatch(t.encode()) and t.strip(" \t\n\r\x0b\x0c")]
    coded = tokenizer.encode_batch(units, add_special_tokens=False)
    return {u.encode(): len(c.ids) for u, c in zip(units, coded)}


def _worker(path: str, table: dict[bytes, int]):
    """Tokenizer, the pattern of texts to encode whole, and the look-up of this worker."""
    if path not in _ready:
        tokenizer = load_tokenizer(path)
        special = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        whole = re.compile("|".join([ODD_SPACE, *special]))

        def length(unit: bytes) -> int:
            return len(tokenizer.encode(unit.decode(), add_special_tokens=False).ids)

        _ready[path] = tokenizer, whole, BoundedCache(length, CACHED_UNITS, table)
    return _ready[path]


def count_tokens(texts, path: str, table: dict[bytes, int]) -> list[int]:
    tokenizer, whole, lengths = _worker(path, table)
    out = []
    for text in texts:
        if not text:
            out.append(0)
        elif whole.search(text):
            out.append(len(tokenizer.encode(text, add_special_tokens=False).ids))
        else:
            units = UNIT.findall(text.encode())
            if max(map(len, units)) > LONGEST_CACHED:
                out.append(
                    sum(
                        lengths[u] if len(u) <= LONGEST_CACHED else lengths.compute(u)
                        for u in units
                    )
                )
            else:
                out.append(sum(map(lengths.__getitem__, units)))
    return out


def n_tokens(spark: SparkSession, text: Column, path: str) -> Column:
    """The number of tokens of a text column; null and empty give 0."""
    table = spark.sparkContext.broadcast(frequent_lengths(path))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(count_tokens(texts, path, table.value), dtype="int64")

    return counted(text)


def token_counts(
    docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per input row, repeated rows and null ids
    included. A null text counts as empty: 0 bytes, 0 tokens. Nothing is truncated."""
    text = F.col(text_col)
    return docs.select(
        id_col,
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        n_tokens(docs.sparkSession, text, path).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
