"""Words, codecs of worker caches, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsrate.session import write_table

#: A word as the contracts define it, for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "BoundedCache", "crc_fold", "discard", "discarding", "stored", "word_list", "words_of"]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased. ``bytes.split`` and ``bytes.lower`` know
    ASCII only, which is exactly the definition."""
    return text.encode().lower().split() if text else []


def word_list(text: Column) -> Column:
    """The words of a text as an array of strings, case kept; null and blank give no words."""
    return F.filter(
        F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != F.lit("")
    )


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    table = write_table(df, f"llm-{name}")
    if _open:
        _open[-1].append(table)
    return table


_open: list[list[DataFrame]] = []


@contextmanager
def discarding() -> Iterator[Callable[[DataFrame], None]]:
    """Inside, all tables that ``stored`` writes are deleted at the end, but for those handed to the
    function that this yields."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _open.append(made)
    try:
        yield kept.append
    finally:
        _open.remove(made)
        for table in made:
            if not any(table is k for k in kept):
                discard(table)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``stored`` returned. Nothing that still reads it may run
    later."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class BoundedCache(dict):
    """A dict that computes missing values and holds 2 * ``limit`` of them at most. When the
    newer ``limit`` are full they become the older ones, and the older are dropped unless they
    are asked for again, so frequent keys stay. ``first`` is kept for good."""

    def __init__(self, compute, limit: int, first: dict | None = None):
        super().__init__(first or {})
        self.compute, self.limit, self.first, self.older = compute, limit, first or {}, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit + len(self.first):
            self.older = dict(self)
            self.clear()
            self.update(self.first)
        self[key] = value
        return value

    def hold(self, values: dict) -> None:
        """Take up values that were computed together, ``limit`` of them at most."""
        if len(self) + len(values) > self.limit + len(self.first):
            self.older = dict(self)
            self.clear()
            self.update(self.first)
        self.update(islice(values.items(), self.limit))
