"""Token ids as one wavelet matrix per shard.

A shard file holds the ids of consecutive documents as bit planes, highest bit first. Each plane
is stably parted into zeros and ones before the next, and carries the number of ones before each
block of 512 bits. From that one compressed file any id can be read (``access``), counted up to a
place (``rank``) and looked up by occurrence (``select``) without unpacking the rest.
"""

from __future__ import annotations

import gc
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsrate.llm.common import BoundedCache
from newsrate.llm.token_counts import load_tokenizer

BLOCK = 512
CACHED_WORDS = 500_000
#: Texts that are cut and whose new words are encoded together.
BLOCK_CHARS = 1 << 23
LONGEST_CACHED = 64
#: Words that the library sees as one text, and those that go to it at once.
SIDE_BY_SIDE, AT_ONCE = 64, 1 << 14
#: Places of a plane that are parted together: as much as stays in a core's cache.
PARTED = 1 << 16
MAGIC = b"WMX1"
HEAD = struct.Struct("<4sBQQ")

SHARD_TYPE = "part int, shard int, n_docs long, n_tokens long, data binary"
DOC_TYPE = "part int, shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"

_ready: dict[str, Encoder] = {}


class WaveletMatrix:
    def __init__(self, n: int, planes: list[tuple[int, np.ndarray, np.ndarray]]):
        #: planes: (zeros, packed bits, ones before each block), highest bit first
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        seq, planes = ids, []
        for b in reversed(range(max(1, int(ids.max(initial=0)).bit_length()))):
            ones = (seq & seq.dtype.type(1 << b)) != 0
            packed = np.packbits(ones, bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % (BLOCK // 8)))
            counts = np.bitwise_count(packed.view("<u8")).reshape(-1, BLOCK // 64).sum(1)
            before = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
            low, high = 0, len(seq) - int(before[-1])
            planes.append((high, packed, before))
            parted = np.empty_like(seq)
            for at in range(0, len(seq), PARTED):
                part, one = seq[at : at + PARTED], ones[at : at + PARTED]
                places = np.flatnonzero(one)
                parted[high : high + len(places)] = part.take(places)
                high += len(places)
                places = np.flatnonzero(~one)
                parted[low : low + len(places)] = part.take(places)
                low += len(places)
            seq = parted
        return cls(len(ids), planes)

    def ids(self) -> np.ndarray:
        """All ids: the partings undone from the lowest plane up."""
        wide = len(self.planes) > 16
        seq = np.zeros(self.n, "<u4" if wide else "<u2")
        before = np.empty_like(seq)
        for b, (zeros, packed, _) in enumerate(reversed(self.planes)):
            ones = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            seq[zeros:] |= seq.dtype.type(1 << b)
            low, high = 0, zeros
            for at in range(0, self.n, PARTED):
                part, one = before[at : at + PARTED], ones[at : at + PARTED]
                places = np.flatnonzero(one)
                part[places] = seq[high : high + len(places)]
                high += len(places)
                places = np.flatnonzero(~one)
                part[places] = seq[low : low + len(places)]
                low += len(places)
            seq, before = before, seq
        return seq

    def _ones(self, plane: int, i: int) -> int:
        _, packed, before = self.planes[plane]
        block = i // BLOCK
        bits = packed[block * BLOCK // 8 : (i + 7) // 8]
        extra = int(np.bitwise_count(bits).sum())
        if i % 8:
            extra -= (int(bits[-1]) >> (i % 8)).bit_count()
        return int(before[block]) + extra

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p, (zeros, packed, _) in enumerate(self.planes):
            bit = int(packed[i >> 3]) >> (i & 7) & 1
            ones = self._ones(p, i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` before ``i`` stand under the lowest plane."""
        start, end = 0, i
        for p, (zeros, _, _) in enumerate(self.planes):
            a, b = self._ones(p, start), self._ones(p, end)
            if value >> (len(self.planes) - 1 - p) & 1:
                start, end = zeros + a, zeros + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, value: int, i: int) -> int:
        """How often ``value`` stands before place ``i``."""
        if value >> len(self.planes):
            return 0
        start, end = self._range(value, min(i, self.n))
        return end - start

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit."""
        _, packed, before = self.planes[plane]
        at = before if bit else np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(at, k, side="right")) - 1
        bits = np.unpackbits(
            packed[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little"
        )
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(at[block])])

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of ``value``; IndexError if there is none."""
        if k < 0 or k >= self.rank(value, self.n):
            raise IndexError(k)
        at = self._range(value, self.n)[0] + k
        for p in reversed(range(len(self.planes))):
            zeros = self.planes[p][0]
            if value >> (len(self.planes) - 1 - p) & 1:
                at = self._select_bit(p, 1, at - zeros)
            else:
                at = self._select_bit(p, 0, at)
        return at


def pack_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    import zstandard

    matrix = WaveletMatrix.build(ids)
    known = np.array([d is not None for d in doc_ids], dtype=bool)
    out = [
        HEAD.pack(MAGIC, len(matrix.planes), matrix.n, len(doc_ids)),
        np.packbits(known).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array(lengths, "<u4").tobytes(),
    ]
    for zeros, packed, before in matrix.planes:
        out += [struct.pack("<Q", zeros), packed.tobytes(), before.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack_shard(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    magic, bits, n, docs = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a wavelet matrix shard")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        values = np.frombuffer(raw, kind, count, at)
        at += values.nbytes
        return values

    known = np.unpackbits(take("u1", (docs + 7) // 8), count=docs).astype(bool)
    doc_ids = [int(d) if k else None for d, k in zip(take("<i8", docs), known)]
    lengths = take("<u4", docs)
    blocks, planes = -(-n // BLOCK), []
    for _ in range(bits):
        zeros = int(take("<u8", 1)[0])
        planes.append((zeros, take("u1", blocks * BLOCK // 8), take("<u4", blocks + 1)))
    return WaveletMatrix(n, planes), doc_ids, lengths


#: A part of small letters of ASCII and Latin-1 in UTF-8. No normaliser changes them as they stand
#: here. The tokenizer drops white space and merges neither over it nor from such a letter to what
#: is no letter, so a text is encoded part by part.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_BYTES = np.arange(256)
SMALL_ASCII = (_BYTES >= ord("a")) & (_BYTES <= ord("z"))
SMALL_LATIN = (_BYTES >= 0x9F) & (_BYTES <= 0xBF) & (_BYTES != 0xB7)
LETTER = SMALL_ASCII | (_BYTES >= 0x80)


def cut_words(words: pa.Array) -> pa.Array:
    """The words cut in two, one after the other: letters up to a small one that no letter follows,
    and what comes next. Either may be empty."""
    if not len(words):
        return words
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, "i8", len(words) + 1)
    data = data or pa.py_buffer(b"")
    text = np.append(np.frombuffer(data, "u1", offsets[-1]), np.uint8(0))  # the zero ends the last word
    starts, ends = offsets[:-1], offsets[1:]
    other = np.flatnonzero(~LETTER[text])
    at = np.minimum(other[np.searchsorted(other, starts)], ends)
    last, before = text[np.maximum(at - 1, 0)], text[np.maximum(at - 2, 0)]
    small = SMALL_ASCII[last] | SMALL_LATIN[last] & (before == 0xC3) & (at - starts > 1)
    cuts = np.empty(2 * len(words) + 1, "i8")
    cuts[0::2] = offsets
    cuts[1::2] = np.where(small & (at > starts), at, starts)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), data])


def values(words: pa.Array) -> list[bytes]:
    """The bytes of each word of an array that is no slice."""
    if not len(words):
        return []
    _, ends, data = words.buffers()
    ends, data = np.frombuffer(ends, "i8", len(words) + 1).tolist(), bytes(data or b"")
    return [data[a:b] for a, b in zip(ends, ends[1:])]


class Encoder:
    """Ids of texts as little-endian 32-bit integers, from a bounded cache of the two parts that
    words are cut into. Of a block of texts each different word is cut once, each different part is
    looked up once, and the ids are copied to all places of the word. Parts that the cache lacks are
    encoded together, many in one text."""

    def __init__(self, path: str):
        # Imported after ``load_tokenizer`` has set the library's environment.
        self.tokenizer = load_tokenizer(path)
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content.lower().encode() for t in added]
        normal = self.tokenizer.normalizer
        self.folds = normal is not None and normal.normalize_str("A") == "a"
        self.model = self.tokenizer.model
        # The library's own cache of merges: here each part comes once.
        self.model._resize_cache(0)
        #: The merges alone, for parts as they spell them with white space between.
        self.merges = Tokenizer(self.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        #: Whether an id ends a word, which its string shows.
        self.suffix = getattr(self.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if self.suffix and t.endswith(self.suffix)]] = True
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        #: Letters beyond ASCII as the merges spell them.
        self.spelled = {chr(c): cut(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        self.parts = BoundedCache(self.part, CACHED_WORDS)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def part(self, part: bytes) -> bytes:
        return self.together([part])[0]

    def together(self, parts: list[bytes]) -> list[bytes]:
        """The ids of some different parts that are not in the cache."""
        # Plain ones are neither normalised nor split: straight to the merges.
        plain = [p for p in parts if PLAIN.fullmatch(p)] if self.suffix else []
        text = b" ".join(plain).decode()
        for letter, spelled in self.spelled.items():
            text = text.replace(letter, spelled)
        words, runs = text.split(), []
        for at in range(0, len(words), AT_ONCE):
            some = words[at : at + AT_ONCE]
            texts = [" ".join(some[i : i + SIDE_BY_SIDE]) for i in range(0, len(some), SIDE_BY_SIDE)]
            coded = self.merges.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(c.ids for c in coded), "<u4")
            ends, data = (4 * np.flatnonzero(self.last[ids]) + 4).tolist(), ids.tobytes()
            runs += [data[a:b] for a, b in zip([0, *ends], ends)]
        found = dict(zip(plain, runs, strict=True))
        return [found[p] if p in found else self.whole(p.decode()) for p in parts]

    def runs(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each of some different parts."""
        found = list(map(self.parts.get, parts))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        older = {parts[i]: ids for i in lacking if (ids := self.parts.older.get(parts[i])) is not None}
        new = [parts[i] for i in lacking if parts[i] not in older]
        older.update(zip(new, self.together(new)))
        for i in lacking:
            found[i] = older[parts[i]]
        self.parts.hold({p: ids for p, ids in older.items() if len(p) <= LONGEST_CACHED})
        return found

    def seen_whole(self, text: str) -> bool:
        """Whether the library must see a text whole: with a special token's string, and everywhere
        if the tokenizer keeps capitals apart."""
        folded = text.encode().lower()
        return not self.folds or any(s in folded for s in self.special)

    def block(self, texts: list[str | None]) -> Iterator[bytes]:
        whole = {i: t for i, t in enumerate(texts) if t and self.seen_whole(t)}
        cut = pa.array(["" if i in whole else t or "" for i, t in enumerate(texts)], pa.large_string())
        split = pc.ascii_split_whitespace(pc.ascii_lower(cut))
        words = split.values.dictionary_encode()
        parts = cut_words(words.dictionary).dictionary_encode()
        coded = pa.array(self.runs(values(parts.dictionary)), pa.large_binary()).take(parts.indices)
        # The ids of a word are those of its two parts.
        _, offsets, data = coded.buffers()
        offsets = np.ascontiguousarray(np.frombuffer(offsets, "i8", len(coded) + 1)[::2])
        buffers = [None, pa.py_buffer(offsets), data]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers).take(words.indices)
        _, offsets, data = coded.buffers()
        ends = np.frombuffer(offsets, "i8", len(coded) + 1)[split.offsets.to_numpy()].tolist()
        ids = memoryview(data or b"")
        for i in range(len(texts)):
            yield self.whole(whole[i]) if i in whole else bytes(ids[ends[i] : ends[i + 1]])

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each whole text; none for null and empty ones."""
        held: list[str | None] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= BLOCK_CHARS:
                yield from self.block(held)
                held, size = [], 0
                # What a block took would stay with the worker, through all later stages too.
                pa.default_memory_pool().release_unused()
        yield from self.block(held)
        held.clear()
        pa.default_memory_pool().release_unused()


def encoder(path: str) -> Encoder:
    if path not in _ready:
        _ready[path] = Encoder(path)
    return _ready[path]


def drop_encoders() -> None:
    """Free this worker's encoders, which would stay for all later stages. An encoder and its cache
    refer to each other, so this takes the collector."""
    if _ready:
        _ready.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def encode(text: str | None, path: str) -> bytes:
    return next(encoder(path).block([text]))


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 1,
    shard_tokens: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode whole texts and write them in ascending id order, one wavelet matrix per about
    ``shard_tokens`` ids (a longer document stays whole), each in one row of a Parquet file that
    Spark writes. Every document ends with ``end_id``. Null texts count as empty; null ids come
    first; rows of one id are ordered by a hash of their text, exact copies in any order."""
    text = F.col(text_col)
    order = [
        F.col("doc_id").asc_nulls_first(),
        F.col("_tie"),
        F.col("_row"),
    ]
    # The row number lets copies of one row be dealt to several ranges.
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("_tie"),
        F.monotonically_increasing_id().alias("_row"),
    )
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = 0, 0
        chunks: list[bytes] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, held
            ids = np.frombuffer(b"".join(chunks), "<u4")
            small = ids.astype("<u2") if int(ids.max()) < 1 << 16 else ids
            row = [part, shard, len(doc_ids), len(ids), pack_shard(small, doc_ids, lengths)]
            chunks.clear(), doc_ids.clear(), lengths.clear()
            shard, held = shard + 1, 0
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, kinds)], names
            )

        names = ["part", "shard", "n_docs", "n_tokens", "data"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = (t.as_py() for t in batch.column(2))
            coded = encoder(tokenizer).encode_all(texts)
            for p, d, ids in zip(batch.column(0), batch.column(1), coded):
                ids += end
                part = p.as_py()
                chunks.append(ids), doc_ids.append(d.as_py()), lengths.append(len(ids) // 4)
                held += len(ids) // 4
                if held >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(
        shards, SHARD_TYPE
    ).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files' own bits. ``start``
    is the number of ids of all documents before it."""
    files = spark.read.schema(SHARD_TYPE).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()  # the files are written
        for batch in batches:
            for p, s, data in zip(
                batch.column("part"), batch.column("shard"), batch.column("data")
            ):
                matrix, doc_ids, lengths = unpack_shard(data.as_py())
                ids = matrix.ids().astype("<u4")
                ends = np.cumsum(lengths, dtype="int64")
                starts = ends - lengths
                view = memoryview(ids).cast("B")
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts, ends)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, p.as_py(), "int32")),
                        pa.array(np.full(n, s.as_py(), "int32")),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(starts),
                        pa.array(lengths.astype("int64")),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["part", "shard", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    rows = files.select("part", "shard", "data").mapInArrow(documents, DOC_TYPE)
    sizes = files.select("part", "shard", "n_tokens")
    # Running sums in two steps: over parts (one row each), then over the shards of each part.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(parts, "part").select(
        "part",
        "shard",
        (F.col("_base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("_offset"),
    )
    return rows.join(offsets, ["part", "shard"]).select(
        "doc_id",
        (F.col("_offset") + F.col("local_start")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
