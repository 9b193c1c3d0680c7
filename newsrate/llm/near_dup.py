"""Near duplicates by MinHash and a multi-index Hamming join.

A document is the set of its distinct five-word shingles. Its signature has ``SYMBOLS`` MinHash
symbols of 16 bits; two sets of Jaccard similarity J differ in each symbol with probability 1 - J.
Signatures are cut into ``CHUNKS`` chunks of five symbols. Two signatures that differ in at most
``DISTANCE`` = 2 * CHUNKS - 1 symbols differ in at most one symbol of some chunk (pigeonhole), so
each chunk is indexed once for each symbol left out: all pairs up to that distance share a key.
At J = 0.85 more than ``DISTANCE`` of 70 symbols differ once in about ten million pairs. Candidates
are confirmed on the full sets. The similarity and the number of chunks are parameters of
``near_duplicates``; a lower similarity needs more chunks (0.8: 24 of them).

A key may be shared by very many documents. First equal sets become one class. Then the documents
of a key are compared with its smallest one only; what that links is one component, and only
documents of different components under one key are compared further, so neither copies nor
groups of near copies are expanded into pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from newsrate.llm.common import stored, words_of
from newsrate.llm.components import components
from newsrate.operators.lookup import fits_broadcast

SHINGLE_WORDS = 5
CHUNKS, CHUNK = 14, 5
SYMBOLS = CHUNKS * CHUNK
DISTANCE = 2 * CHUNKS - 1
SIMILARITY_PERCENT = 85
#: Ids (8 bytes each) that may be broadcast to pick out the texts of candidates.
BROADCAST_IDS = 2_000_000


@cache
def _hashing(symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scale, shift and key salt of each symbol."""
    random = np.random.default_rng(20240501)
    scale = random.integers(0, 1 << 31, symbols, dtype="u4") * np.uint32(2) + np.uint32(1)
    shift = random.integers(0, 1 << 32, symbols, dtype="u4")
    return scale, shift, random.integers(0, 1 << 63, symbols, dtype="u8")


_PRIME = np.uint64(0x9E3779B97F4A7C15)

MAPS = [f"m{i}" for i in range(16)]
MAP_BITS = 64 * len(MAPS)


def sketch_columns(chunks: int) -> list[str]:
    return [f"s{i}" for i in range(-(-chunks * CHUNK // 16))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, "u8")
    hashes = np.fromiter(map(xxh3_64_intdigest, words), "u8", n)
    size = min(n, SHINGLE_WORDS)
    shingles = np.full(n - size + 1, size, "u8")
    for k in range(size):
        shingles = (shingles * _PRIME) ^ hashes[k : n - size + 1 + k]
        shingles = _mix(shingles)
    return np.unique(shingles)


def signature(shingles: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """``symbols`` 16-bit symbols of a set that is not empty."""
    scale, shift, _ = _hashing(symbols)
    least = np.full(symbols, 0xFFFFFFFF, "u4")
    short = (shingles >> np.uint64(32)).astype("u4")
    for at in range(0, len(short), 1024):
        block = short[None, at : at + 1024] * scale[:, None] + shift[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("u2")


def _packed(symbols: np.ndarray) -> np.ndarray:
    """Four bits of each symbol, sixteen to an integer: rows of ``sketch_columns``."""
    n = symbols.shape[1]
    bits = np.zeros((len(symbols), -(-n // 16) * 16), "u8")
    bits[:, :n] = symbols & 15
    steps = np.arange(16, dtype="u8") * np.uint64(4)
    return (bits.reshape(len(symbols), -1, 16) << steps).sum(2, dtype="u8").view("i8")


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    """One bit for each shingle, by its hash, in ``MAPS`` integers."""
    bits = np.zeros(MAP_BITS, bool)
    bits[(shingles & np.uint64(MAP_BITS - 1)).astype("i8")] = True
    return np.packbits(bits).view("i8")


def _sketches(docs: DataFrame, chunks: int) -> DataFrame:
    size, names = chunks * CHUNK, sketch_columns(chunks)

    def sketched_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, rows, maps = [], [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py())
                sizes.append(len(shingles))
                keys.append(hashlib.md5(shingles.tobytes()).digest())
                maps.append(_bitmap(shingles))
                empty = np.zeros(size, "u2")
                rows.append(signature(shingles, size) if len(shingles) else empty)
            symbols = np.array(rows, "<u2").reshape(-1, size)
            packed = _packed(symbols)
            maps = np.array(maps, "i8").reshape(-1, len(MAPS))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array([r.tobytes() for r in symbols], pa.binary()),
                    *[pa.array(packed[:, i]) for i in range(len(names))],
                    *[pa.array(maps[:, i]) for i in range(len(MAPS))],
                ],
                ["doc_id", "n_shingles", "set_key", "symbols", *names, *MAPS],
            )

    kind = ", ".join(f"{s} long" for s in names + MAPS)
    return docs.mapInArrow(
        sketched_rows, f"doc_id long, n_shingles long, set_key binary, symbols binary, {kind}"
    )


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """Rows of keys: for each chunk and each symbol left out of it, the other four."""
    chunks = symbols.reshape(len(symbols), -1, CHUNK).astype("u8")
    keys = np.empty(chunks.shape, "u8")
    for out in range(CHUNK):
        value = np.zeros(chunks.shape[:2], "u8")
        for k in range(CHUNK):
            if k != out:
                value = (value << np.uint64(16)) | chunks[:, :, k]
        keys[:, :, out] = value
    return _mix(keys.reshape(symbols.shape) ^ _hashing(symbols.shape[1])[2]).view("i8")


def _keys(classes: DataFrame, chunks: int) -> DataFrame:
    """(key, rep, out): ``out`` is the symbol that the key leaves out, null for the first of a chunk."""
    size = chunks * CHUNK

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                symbols = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2")
                keys = index_keys(symbols.reshape(-1, size))
                ids = part.column(0).to_numpy()
                first = np.tile(np.arange(size) % CHUNK == 0, part.num_rows)
                columns = [keys.ravel(), np.repeat(ids, size), symbols.astype("i4")]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns[:2]), pa.array(columns[2], mask=first)],
                    ["key", "rep", "out"],
                )

    return classes.select("rep", "symbols").mapInArrow(keyed, "key long, rep long, out int")


def _once(left: str, right: str) -> Column:
    """Whether two classes under one key are compared there. Two that also agree in the symbol left out
    share all keys of the chunk, and the first of these serves."""
    return F.coalesce(F.col(f"{left}.out") != F.col(f"{right}.out"), F.lit(True))


def _similar(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b, text_a, text_b) whose whole sets reach the similarity."""

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def of(doc: int, text: pa.Scalar) -> np.ndarray:
            if doc not in sets:
                if len(sets) >= 64:
                    sets.clear()
                sets[doc] = shingle_set(text.as_py())
            return sets[doc]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(*batch.columns):  # one pair of texts at a time
                one, two = of(a.as_py(), x), of(b.as_py(), y)
                both = len(np.intersect1d(one, two, assume_unique=True))
                union = len(one) + len(two) - both
                keep.append(union > 0 and 100 * both >= percent * union)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirmed


def _close(left: str, right: str, percent: int, chunks: int) -> Column:
    """Whether two classes can be similar. Their symbols differ in no more than
    2 * ``chunks`` - 1 places, by four bits each, which never shows more than truly differ. And with
    D elements in one set only and sizes m and n, a similarity of 0.85 needs 185 D <= 15 (m + n);
    each bit that differs between the bitmaps is such an element."""
    far = F.lit(0)
    for s in sketch_columns(chunks):
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        far = far + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    apart = F.lit(0)
    for m in MAPS:
        apart = apart + F.bit_count(F.col(f"{left}.{m}").bitwiseXOR(F.col(f"{right}.{m}")))
    sizes = F.col(f"{left}.n_shingles") + F.col(f"{right}.n_shingles")
    whole, part = 100 + percent, 100 - percent
    return (far <= 2 * chunks - 1) & (apart * whole <= sizes * part)


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar by their full sets. Only texts of candidates travel."""
    needed = stored(
        pairs.select(F.col("a").alias("doc_id"))
        .union(pairs.select(F.col("b").alias("doc_id")))
        .distinct(),
        "candidates",
    )
    if fits_broadcast(needed, BROADCAST_IDS):
        needed = F.broadcast(needed)
    texts = docs.join(needed, "doc_id", "left_semi")
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(_similar(percent), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = SIMILARITY_PERCENT,
    chunks: int = CHUNKS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per input row.

    Documents are linked from a similarity of ``percent`` hundredths on; ``component_id`` is the smallest id that
    can be reached, ``kept`` marks the row that has it. Texts without words have no shingles and
    are linked with nothing. Rows without an id keep a null ``component_id`` and are kept; rows
    that share an id each belong to the component of their own text.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = stored(_sketches(docs, chunks), "sketches")
    known = sketched.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(
        known.groupBy("set_key", "n_shingles", "symbols", *sketch_columns(chunks), *MAPS).agg(
            F.min("doc_id").alias("rep")
        ),
        "classes",
    )
    links = _links(classes, docs, percent, chunks)
    labels = components(links)
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("_name")
    )
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_key"))
    return (
        sketched.select("doc_id", "n_shingles", own.alias("set_key"))
        .join(named, "set_key", "left")
        .select(
            F.col("doc_id").alias(id_col),
            "n_shingles",
            F.coalesce("_name", "doc_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )


def _links(classes: DataFrame, docs: DataFrame, percent: int, chunks: int) -> DataFrame:
    """Links (a, b) that give the components of all links between classes."""
    keys = _keys(classes, chunks)
    shared = (
        keys.groupBy("key")
        .agg(F.min("rep").alias("leader"), F.max("rep").alias("_last"))
        .filter(F.col("leader") < F.col("_last"))
        .drop("_last")
    )
    index = stored(keys.join(shared, "key"), "index")
    sketch = classes.select("rep", "n_shingles", *sketch_columns(chunks), *MAPS)

    stars = index.filter("rep != leader").select("leader", "rep").distinct()
    near = (
        stars.join(sketch.alias("r"), "rep")
        .join(sketch.withColumnRenamed("rep", "leader").alias("l"), "leader")
        .filter(_close("l", "r", percent, chunks))
    )
    first = stored(near.select(F.col("leader").alias("a"), F.col("rep").alias("b")), "stars")
    first = stored(_confirmed(first, docs, percent), "links")

    # Documents of one key that are still apart.
    labels = components(first)
    leaders = labels.select(F.col("node").alias("leader"), F.col("component").alias("_main"))
    placed = (
        index.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .join(leaders, "leader", "left")
        .select(
            "key",
            "rep",
            "out",
            "leader",
            F.coalesce("component", "rep").alias("comp"),
            F.coalesce("_main", "leader").alias("main"),
        )
    )
    placed = stored(placed, "placed")
    apart = placed.filter("comp != main").select("key").distinct()
    rest = placed.filter("rep != leader").join(apart, "key", "left_semi").join(sketch, "rep")
    others = rest.filter("comp != main").alias("o")
    pairs = (
        rest.alias("m")
        .join(
            others,
            (F.col("m.key") == F.col("o.key"))
            & (F.col("m.comp") != F.col("o.comp"))
            & ((F.col("m.comp") == F.col("m.main")) | (F.col("m.rep") < F.col("o.rep")))
            & _once("m", "o")
            & _close("m", "o", percent, chunks),
        )
        .select(F.least("m.rep", "o.rep").alias("a"), F.greatest("m.rep", "o.rep").alias("b"))
        .distinct()
    )
    second = _confirmed(stored(pairs, "pairs"), docs, percent)
    return first.union(second)
