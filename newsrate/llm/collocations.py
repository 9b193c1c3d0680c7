"""Phrase collocations by vertical partitioning of a word-level suffix tree.

Every occurrence of a frequent pair of words starts a suffix, cut after ``LONGEST`` words, at the end of its
piece, and before a run of up to ``MARKED`` words that is too rare to stand in a phrase. Words alone are counted
apart. Prefixes of words are counted first:
while a prefix has more occurrences than a task should get, it is extended by a word and its
extensions are counted. The prefixes left over are packed into groups of at most that many
occurrences. Each group is one partition: its suffixes are sorted, so the leaves of the subtrees come in
order, and the number of occurrences of every node is the total of the leaves under it. Only the
path to the current leaf is held, whatever the size of a subtree.

A phrase's cuts are looked up among the counted nodes; what lies inside a longer phrase as frequent is
dropped; the best of each language are ranked, first in parts, then together.

What is broadcast has a fixed bound: bitmaps of the frequent words' and runs' hashes (``FILTER_BITS``
each; what is let through wrongly only adds rows, its count decides), the prefixes over the budget (at
most ``MOST_HEAVY`` of a length, since the budget grows with the corpus), and the group of each of
``BINS`` prefix bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsrate.llm.common import discard, stored
from newsrate.operators.lookup import unique_side_join

LONGEST = 5
LEAST_COUNT = 100
COVERED_PERCENT = 100
TOP = 2000
SCALE = 1000
#: Suffixes in one group, groups at least, and prefixes over the budget at most.
BUDGET, LEAST_GROUPS, MOST_HEAVY = 2_000_000, 64, 100_000
BINS = 1 << 14
FILTER_BITS = 1 << 29
#: Words in the longest runs that have a bitmap.
MARKED = 3
#: Bits of the runs' bitmap that one task adds up.
BLOCK_BITS = 1 << 22
CHUNK_WORDS = 1 << 21
#: Candidates ranked together in the first round.
RANKED_ROWS = 100_000
MISSING_LANG = "und"

# Words never hold these bytes: full stops, which end a piece, stand for the NUL of a text inside the
# operator, and NUL, the smallest byte, joins words. Sorted suffixes of one prefix are then
# next to each other.
NUL_IN_WORD, JOIN = b".", b"\0"
_PIECES = bytes.maketrans(b"\0.,;:!?\n\x0b\x0c\r", NUL_IN_WORD + b"\n" * 10)
#: Ends a piece in a list of words.
END = b""


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of each piece of a text; A-Z lower-cased."""
    if text:
        for piece in text.encode().lower().translate(_PIECES).split(b"\n"):
            if words := piece.split():
                yield words


@dataclass
class Chunk:
    """Words of one language as codes into their distinct values; ``end`` ends a piece."""

    lang: str
    codes: np.ndarray
    words: pa.Array
    end: int


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """The words of (lang, text) rows in chunks of about ``CHUNK_WORDS``. A text is cut between
    pieces, so memory follows the chunk, not the text."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def coded() -> Iterator[Chunk]:
        for lang, words in held.items():
            found = pa.array(words, pa.binary()).dictionary_encode()
            end = pc.index(found.dictionary, END).as_py()
            yield Chunk(lang, found.indices.to_numpy(), found.dictionary, end)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for words in pieces(text.as_py()):
                held.setdefault(lang, []).extend(words)
                held[lang].append(END)
                size += len(words) + 1
                if size >= CHUNK_WORDS:
                    yield from coded()
                    size = 0
    yield from coded()


def prefix_hash(lang: str, prefix: bytes) -> int:
    """As ``native_hash`` of the joined words."""
    return zlib.crc32(prefix, zlib.crc32(lang.encode() + JOIN))


def native_hash(lang: Column, prefix: Column) -> Column:
    return F.crc32(F.concat(lang.cast("binary"), F.lit(bytearray(JOIN)), prefix.cast("binary")))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, prefix, n) of all words; the row without a prefix counts the words of its language."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            n = np.bincount(c.codes, minlength=len(c.words))
            n[c.end] = n.sum() - n[c.end]
            words = c.words.cast(pa.string()).to_pylist()
            words[c.end] = None
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.lang] * len(n)), pa.array(words, pa.string()), pa.array(n)],
                ["lang", "prefix", "n"],
            )

    found = texts.mapInArrow(counts, "lang string, prefix string, n long")
    return found.groupBy("lang", "prefix").agg(F.sum("n").alias("n"))


def word_filter(words: DataFrame) -> np.ndarray:
    """Bits of the hashes of (lang, prefix), 16 to 32 a word and ``FILTER_BITS`` in all at most."""
    bits = min(FILTER_BITS, max(1 << 15, 1 << int(16 * words.count()).bit_length()))
    place = F.pmod(native_hash(F.col("lang"), F.col("prefix")), F.lit(bits)).cast("long")
    maps = (
        words.select((place + 1).alias("place"))  # Spark's bitmaps count from 1
        .groupBy(F.bitmap_bucket_number("place").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    )
    out = np.zeros(bits // 8, "u1")
    for r in maps.collect():  # bits / 32768 rows of 4 KB at most
        start = (r.part - 1) * len(r.bits)
        out[start : start + len(r.bits)] = np.frombuffer(bytes(r.bits), "u1")
    return out


@dataclass
class Plan:
    """How suffixes are cut and where they go."""

    longest: int
    #: Bitmaps by hash, of words and of runs of 2, 3, ... words as far as these are counted.
    words: np.ndarray
    runs: list[np.ndarray]
    #: Prefixes over the budget, as (lang, words joined).
    heavy: set[tuple[str, bytes]]
    #: The group of each bin of prefixes.
    groups: np.ndarray


def _has(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (place & 7).astype("u1") & 1).astype(bool)


def run_places(words: list[np.ndarray], bits: int) -> np.ndarray:
    """The places of runs of words, given by their hashes, among ``bits`` (a power of two)."""
    run = words[0].astype("u8")
    for word in words[1:]:
        run = run << np.uint64(32) ^ run >> np.uint64(32) ^ word.astype("u8")
        run = (run ^ run >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return (run >> np.uint64(65 - bits.bit_length())).astype("i8")


def fitting(c: Chunk, plan: Plan, shortest: int) -> list[np.ndarray]:
    """For runs of 1, 2, ... words, whether the run at each place may be frequent, as far as there are
    bitmaps and up to ``shortest`` words."""
    hashes = word_hashes(c)
    known = _has(plan.words, hashes % np.uint32(len(plan.words) * 8))
    known[c.end] = False
    found = hashes[c.codes]
    fits = [known[c.codes]]
    for n in range(2, max(len(plan.runs) + 1, shortest) + 1):
        fit = fits[-1][:-1] & fits[-1][1:]
        if n - 2 < len(plan.runs):
            bits, at = plan.runs[n - 2], np.flatnonzero(fit)
            fit[at] = _has(bits, run_places([found[at + i] for i in range(n)], len(bits) * 8))
        fits.append(fit)
    return fits


def suffixes(
    c: Chunk, plan: Plan, longest: int, shortest: int
) -> tuple[list[np.ndarray], np.ndarray]:
    """(codes of the first, second, ... word, number) of the distinct suffixes of a chunk that have
    ``shortest`` words or more, cut after ``longest`` words; the code is -1 after a suffix's end."""
    fits = fitting(c, plan, shortest)
    starts = np.flatnonzero(fits[shortest - 1])
    fits = [np.append(fit, np.zeros(longest + n, bool)) for n, fit in enumerate(fits)]
    codes = np.append(c.codes, np.zeros(longest, "i4"))
    columns = [codes[starts]]
    running = np.ones(len(starts), bool)
    for i in range(1, longest):
        n = min(i, len(fits) - 1)  # the longest known run that ends here
        running &= fits[n][starts + i - n]
        columns.append(np.where(running, codes[starts + i], -1).astype("i4"))
    names = [f"w{i}" for i in range(longest)]
    grouped = pa.table([pa.array(col) for col in columns], names).group_by(names, use_threads=False)
    found = grouped.aggregate([([], "count_all")])
    return [found[n].to_numpy() for n in names], found["count_all"].to_numpy()


def word_hashes(c: Chunk) -> np.ndarray:
    hashed = partial(_crc, zlib.crc32(c.lang.encode() + JOIN))
    return np.fromiter(map(hashed, c.words.to_pylist()), "u4", len(c.words))


def _crc(seed: int, word: bytes) -> int:
    return zlib.crc32(word, seed)


def joined(words: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """The words of each row, joined; columns end with -1."""
    parts = [words.take(pa.array(col, pa.int32(), mask=col < 0)) for col in columns]
    separator = pa.scalar(JOIN, pa.binary())
    return pc.binary_join_element_wise(*parts, separator, null_handling="skip")


def cut_prefixes(
    c: Chunk, columns: list[np.ndarray], plan: Plan
) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """For each length from 1 on, (rows, prefixes, extended): the first words of the rows whose
    shorter prefixes are all over the budget, and which of them are extended further."""
    rows = np.arange(len(columns[0]))
    longest = len(columns)
    for n in range(1, longest + 1):
        if not len(rows):
            return
        if n == 1:
            heavy = {w for lang, w in plan.heavy if lang == c.lang and JOIN not in w}
            table = c.words
            hit = np.array([w in heavy for w in table.to_pylist()], bool)
            prefixes, over = table.take(pa.array(columns[0])), hit[columns[0]]
        else:
            prefixes = joined(c.words, [col[rows] for col in columns[:n]])
            over = np.array([(c.lang, w) in plan.heavy for w in prefixes.to_pylist()], bool)
        longer = columns[n][rows] >= 0 if n < longest else np.zeros(len(rows), bool)
        over = over & longer
        yield rows, prefixes, over
        rows = rows[over]


def _extended(c: Chunk, columns: list, n: np.ndarray, plan: Plan, length: int) -> pa.Table:
    """(lang, prefix, n) of the prefixes of ``length`` words in a chunk that extend heavy ones."""
    prefixes, counts = pa.array([], pa.binary()), n[:0]
    for step, (rows, found, _) in enumerate(cut_prefixes(c, columns, plan), 1):
        if step == length:
            prefixes, counts = found, n[rows]
    table = pa.table([prefixes, pa.array(counts, pa.int64())], ["prefix", "n"])
    table = table.group_by("prefix").aggregate([("n", "sum")])
    return pa.table(
        [pa.array([c.lang] * len(table), pa.string()), table["prefix"].cast(pa.string()), table["n_sum"]],
        ["lang", "prefix", "n"],
    )


def extension_counts(texts: DataFrame, plan: Plan, length: int) -> DataFrame:
    """(lang, prefix, n) of the prefixes of ``length`` words that extend heavy ones."""
    shared = texts.sparkSession.sparkContext.broadcast(plan)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for c in chunks(batches):
            columns, n = suffixes(c, plan, length, length)
            yield from _extended(c, columns, n, plan, length).to_batches()

    found = texts.mapInArrow(counts, "lang string, prefix string, n long")
    return found.groupBy("lang", "prefix").agg(F.sum("n").alias("n"))


def run_counts(texts: DataFrame, plan: Plan, length: int, least: int, bits: int) -> DataFrame:
    """One pass over the runs of ``length`` words whose shorter runs are frequent, stored. Rows with a
    ``block`` hold the places and numbers of a chunk's runs in that part of the bitmap, a number above
    ``least`` as ``least``; rows without one are (lang, prefix, n) of the runs that extend heavy prefixes."""
    shared = texts.sparkSession.sparkContext.broadcast(plan)
    block_bits, kind = min(bits, BLOCK_BITS), np.min_scalar_type(least)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for c in chunks(batches):
            columns, n = suffixes(c, plan, length, length)
            hashes = word_hashes(c)
            places = run_places([hashes[col] for col in columns], bits)
            order = np.argsort(places, kind="stable")
            places = places[order]
            starts = np.flatnonzero(np.diff(places, prepend=-1))
            sums = np.add.reduceat(n[order], starts) if len(starts) else np.zeros(0, "i8")
            places, sums = places[starts], np.minimum(sums, least).astype(kind)
            blocks = np.unique(places // block_bits)
            ends = np.searchsorted(places, (blocks + 1) * block_bits)
            parts = list(zip(np.append(0, ends[:-1])[: len(ends)].tolist(), ends.tolist()))
            local = (places % block_bits).astype("u4")
            extended = _extended(c, columns, n, plan, length)
            none = len(extended)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(extended["lang"].to_pylist() + [None] * len(blocks), pa.string()),
                    pa.array(extended["prefix"].to_pylist() + [None] * len(blocks), pa.string()),
                    pa.array(extended["n"].to_pylist() + [None] * len(blocks), pa.int64()),
                    pa.array([None] * none + blocks.tolist(), pa.int32()),
                    pa.array([None] * none + [local[a:b].tobytes() for a, b in parts], pa.binary()),
                    pa.array([None] * none + [sums[a:b].tobytes() for a, b in parts], pa.binary()),
                ],
                ["lang", "prefix", "n", "block", "places", "counts"],
            )

    kinds = "lang string, prefix string, n long, block int, places binary, counts binary"
    return stored(texts.mapInArrow(counts, kinds), "runs")


def run_filter(runs: DataFrame, least: int, bits: int) -> np.ndarray:
    """The bits of the runs counted ``least`` times or more. A task adds up one block."""
    block_bits, kind = min(bits, BLOCK_BITS), np.min_scalar_type(least)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, places, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                total = totals.setdefault(block, np.zeros(block_bits, "u4"))
                total[np.frombuffer(places.as_buffer(), "u4")] += np.frombuffer(counts.as_buffer(), kind)
        bitmaps = [np.packbits(t >= least, bitorder="little").tobytes() for t in totals.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array(bitmaps, pa.binary())], ["block", "bits"]
        )

    rows = runs.filter(F.col("block").isNotNull()).select("block", "places", "counts")
    rows = rows.repartitionById(bits // block_bits, F.col("block"))
    out = np.zeros(bits // 8, "u1")
    for r in rows.mapInArrow(merged, "block int, bits binary").collect():  # bits / 8 bytes
        start = r.block * (block_bits // 8)
        out[start : start + block_bits // 8] = np.frombuffer(bytes(r.bits), "u1")
    return out


def pack(loads: np.ndarray, budget: int) -> np.ndarray:
    """Bins of prefixes into groups, largest first, each into the group with the smallest load. There
    are as many groups as the total needs."""
    groups = max(1, -(-int(loads.sum()) // budget))
    out, filled = np.zeros(len(loads), "i4"), np.zeros(groups)
    for b in np.argsort(-loads, kind="stable"):
        out[b] = filled.argmin()
        filled[out[b]] += loads[b]
    return out


def partition_prefixes(
    texts: DataFrame, words: DataFrame, total: int, longest: int, least: int, budget: int
) -> Plan:
    """The plan: prefixes over the budget are extended until none is, or they are whole suffixes. The
    passes that count all pairs and triples also count those that extend prefixes."""
    budget = max(1, min(budget, total // LEAST_GROUPS), -(-total // MOST_HEAVY))
    bits = min(FILTER_BITS, max(1 << 15, 1 << int(total).bit_length()))
    plan = Plan(longest, word_filter(words), [], set(), np.zeros(BINS, "i4"))
    loads = np.zeros(BINS, "i8")
    counted, marked, passes = words, min(MARKED, longest), []
    for length in range(1, longest + 1):
        over = F.col("n") > budget
        heavy = counted.filter(over).collect() if length < longest else []  # at most MOST_HEAVY
        light = counted.filter(~over) if length < longest else counted
        place = F.pmod(native_hash(F.col("lang"), F.col("prefix")), F.lit(BINS))
        for r in light.groupBy(place.alias("bin")).agg(F.sum("n").alias("n")).collect():
            loads[r.bin] += r.n
        plan.heavy |= {(r.lang, r.prefix.encode()) for r in heavy}
        if length < marked:
            passes.append(run_counts(texts, plan, length + 1, least, bits))
            plan.runs.append(run_filter(passes[-1], least, bits))
            counted = passes[-1].filter(F.col("block").isNull()).groupBy("lang", "prefix")
            counted = counted.agg(F.sum("n").alias("n"))
        elif heavy:
            counted = extension_counts(texts, plan, length + 1)
        if not heavy and length + 1 >= marked:
            break
        counted = stored(counted.filter(F.col("n") >= least), "prefixes")
    for runs in passes:
        discard(runs)
    plan.groups = pack(loads, budget)
    return plan


def grouped_suffixes(texts: DataFrame, plan: Plan) -> DataFrame:
    """(part, lang, suffix, n): the distinct suffixes of each chunk, of two words or more, and the group
    of their prefix."""
    shared = texts.sparkSession.sparkContext.broadcast(plan)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for c in chunks(batches):
            columns, n = suffixes(c, plan, plan.longest, min(2, plan.longest))
            part = np.zeros(len(n), "i4")
            hashed = partial(_crc, zlib.crc32(c.lang.encode() + JOIN))
            for step, (at, prefixes, over) in enumerate(cut_prefixes(c, columns, plan), 1):
                if step == 1:
                    place = word_hashes(c)[columns[0]]
                else:
                    place = np.fromiter(map(hashed, prefixes.to_pylist()), "u4", len(at))
                part[at] = plan.groups[place % np.uint32(BINS)]
            yield from pa.table(
                [
                    pa.array(part),
                    pa.array([c.lang] * len(n)),
                    joined(c.words, columns).cast(pa.string()),
                    pa.array(n, pa.int64()),
                ],
                ["part", "lang", "suffix", "n"],
            ).to_batches(max_chunksize=1 << 16)

    return texts.mapInArrow(rows, "part int, lang string, suffix string, n long")


class Tree:
    """The path to the current leaf of sorted suffixes, with the totals of its nodes so far.
    Nodes of ``least`` leaves or more are given out, and those of heavy prefixes, whose leaves lie
    in several groups, whatever their total is here."""

    def __init__(self, longest: int, least: int, heavy: set[tuple[str, bytes]]):
        self.longest, self.least = longest, least
        self.heavy = {(lang, prefix.decode()) for lang, prefix in heavy}
        self.heavy_starts = {prefix.split("\0")[0] for _, prefix in self.heavy}
        self.last: list[str] = []
        #: By number of words: (lang, phrase, total) of the open node.
        self.path: dict[int, tuple[str, str, int]] = {}

    def _close(self, words: int, out: list) -> None:
        lang, phrase, total = self.path.pop(words, ("", "", 0))
        if total and (total >= self.least or (lang, phrase) in self.heavy):
            out.append((lang, phrase, words, total))

    def close(self) -> list:
        out: list = []
        for words in list(self.path):
            self._close(words, out)
        return out

    def add(self, langs: pa.Array, leaves: pa.Array, n: np.ndarray) -> list:
        """Takes leaves in order; returns the nodes that end as (lang, phrase, words, n)."""
        m, out = len(leaves), []
        split = pc.split_pattern(leaves, "\0")
        flat = split.flatten().dictionary_encode()
        length = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        first = np.cumsum(length) - length
        codes = np.full((m, self.longest + 1), -1, "i8")
        codes[:, 0] = langs.dictionary_encode().indices.to_numpy()
        for d in range(1, self.longest + 1):
            at = np.flatnonzero(length >= d)
            codes[at, d] = flat.indices.to_numpy()[first[at] + d - 1]
        #: How many columns a leaf shares with the one before it.
        same = np.zeros(m, "i8")
        same[1:] = (codes[1:] == codes[:-1]).cumprod(1).sum(1)
        for a, b in zip(self.last, [langs[0].as_py(), *split[0].as_py()]):
            if a != b:
                break
            same[0] += 1
        self.last = [langs[m - 1].as_py(), *split[m - 1].as_py()]
        starts_heavy = np.array([w in self.heavy_starts for w in flat.dictionary.to_pylist()], bool)

        def node(row: int, d: int) -> tuple[str, str]:
            words = flat.dictionary.take(pa.array(codes[row, 1 : d + 1])).to_pylist()
            return langs[row].as_py(), "\0".join(words)

        for d in range(1, self.longest + 1):
            here = length >= d
            starts = np.flatnonzero(here & (same <= d))
            sums = np.concatenate([[0], np.cumsum(np.where(here, n, 0))])
            if d in self.path:
                lang, phrase, total = self.path[d]
                total += int(sums[starts[0] if len(starts) else m])
                self.path[d] = lang, phrase, total
            if not len(starts):
                continue
            self._close(d, out)
            totals = np.diff(sums[np.append(starts, m)])
            wanted = (totals >= self.least) | starts_heavy[codes[starts, 1]]
            for i in np.flatnonzero(wanted[:-1]).tolist():
                self.path[d] = *node(int(starts[i]), d), int(totals[i])
                self._close(d, out)
            self.path[d] = *node(int(starts[-1]), d), int(totals[-1])
        return out


def count_nodes(texts: DataFrame, words: DataFrame, plan: Plan, least: int) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of at least ``least`` occurrences, words joined. Those of
    one word come from ``words``, since not every occurrence starts a suffix."""
    shared = texts.sparkSession.sparkContext.broadcast(plan.heavy)
    longest = plan.longest
    schema = pa.schema(
        [("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())]
    )

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(longest, least, shared.value)

        def batch(found: list) -> pa.RecordBatch:
            found = [node for node in found if node[2] > 1]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * 4, schema.types)],
                schema=schema,
            )

        for rows in batches:
            if rows.num_rows:
                yield batch(tree.add(rows.column(0), rows.column(1), rows.column(2).to_numpy()))
        yield batch(tree.close())

    groups = int(plan.groups.max()) + 1
    leaves = grouped_suffixes(texts, plan).repartitionById(groups, F.col("part"))
    leaves = leaves.sortWithinPartitions("lang", "suffix").select("lang", "suffix", "n")
    found = leaves.mapInArrow(nodes, "lang string, phrase string, words int, n long")
    # Only nodes of heavy prefixes come from more than one group.
    whole = found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    single = words.select("lang", F.col("prefix").alias("phrase"), F.lit(1).alias("words"), "n")
    return whole.filter(F.col("n") >= least).union(single)


def _exact(*factors: Column) -> Column:
    """A product in 38 decimal digits; beyond them Spark fails instead of rounding."""
    out = F.lit(1).cast("decimal(38,0)")
    for f in factors:
        out = (out * f.cast("decimal(19,0)")).cast("decimal(38,0)")
    return out


def scored_phrases(nodes: DataFrame, totals: DataFrame, covered_percent: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases that no longer one covers. ``nodes`` and
    ``totals`` are stored tables. Every part of a phrase occurs at least as often as the phrase, so
    a longer phrase covers one only if one that is longer by a single word does."""
    words = F.split("phrase", "\\x00")
    joined_words = [
        F.concat_ws("\0", F.slice(words, F.lit(1), F.col("k"))).alias("left"),
        F.concat_ws("\0", F.slice(words, F.col("k") + 1, F.col("words"))).alias("right"),
    ]
    cuts = (
        nodes.filter("words >= 2")
        .withColumnRenamed("n", "a")
        .select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        .select("lang", "phrase", "words", "a", "k", *joined_words)
    )
    part = nodes.select("lang", "phrase", "n")
    cuts = cuts.join(part.toDF("lang", "left", "l"), ["lang", "left"])
    cuts = stored(cuts.join(part.toDF("lang", "right", "r"), ["lang", "right"]), "cuts")
    lasting = F.lit(100) * F.col("a")
    covered = cuts.filter("words >= 3 AND k = 1").filter(
        lasting >= F.lit(covered_percent) * F.col("r")
    ).select("lang", F.col("right").alias("phrase")).union(
        cuts.filter("words >= 3 AND k = words - 1")
        .filter(lasting >= F.lit(covered_percent) * F.col("l"))
        .select("lang", F.col("left").alias("phrase"))
    )
    whole = unique_side_join(cuts, totals, ["lang"], "inner")
    score = F.call_function(
        "div", _exact(F.lit(SCALE), F.col("a"), F.col("n")), _exact(F.col("l"), F.col("r"))
    )
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut")
    best = whole.groupBy("lang", "phrase", "a", "n").agg(lowest)
    return best.join(covered, ["lang", "phrase"], "left_anti").select(
        "lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score"
    )


def ranked(phrases: DataFrame, top: int) -> DataFrame:
    """The ``top`` phrases of each language with their ``rank``. Many phrases of one language are
    ranked in parts first, so that no task sorts them all."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]

    def first(df: DataFrame, *by) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order))
        return df.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)

    parts = -(-phrases.count() // RANKED_ROWS)
    if parts > 1:
        phrases = first(phrases, F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    return first(phrases)


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST_COUNT,
    covered_percent: int = COVERED_PERCENT,
    top: int = TOP,
    budget: int = BUDGET,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of 2 to ``longest`` words
    with at least ``least`` occurrences, best first.

    Null, empty and wordless texts add nothing; an empty table gives no row. Rows without a
    language are those of ``und``. Repeated rows count each time. Other columns are not read.
    Equal scores go by count and then by phrase, so every rank is defined."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(MISSING_LANG))
    texts = docs.select(lang.alias("lang"), F.col(text_col).alias("text"))
    frequent = (F.col("n") >= least) | F.col("prefix").isNull()
    counts = stored(word_counts(texts).filter(frequent), "words")
    words = counts.filter(F.col("prefix").isNotNull())
    totals = counts.filter(F.col("prefix").isNull()).select("lang", "n")
    total = words.agg(F.sum("n")).first()[0] or 0
    plan = partition_prefixes(texts, words, total, longest, least, budget)
    nodes = stored(count_nodes(texts, words, plan, least), "nodes")
    # Words joined by spaces, and the NULs of the text back in their place.
    spaced = F.replace("phrase", F.lit("\0"), F.lit(" "))
    plain = F.replace(spaced, F.lit(NUL_IN_WORD.decode()), F.lit("\0")).alias("phrase")
    scored = scored_phrases(nodes, totals, covered_percent)
    columns = ["a", "l", "r", "n", "score"]
    found = stored(scored.select("lang", plain, *columns), "phrases")
    return ranked(found, top).select("lang", "rank", "phrase", *columns)
