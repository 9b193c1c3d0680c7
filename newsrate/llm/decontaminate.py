"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of ``BLOCK`` words, two neighbours form a window. Windows and
benchmark passages are TF-IDF vectors over the benchmark's terms (document frequencies of the whole
corpus). A randomised SVD of all windows and the benchmark gives a latent space: every task sums
A'(A Omega) over its own windows, the sums are added up and only a terms x rank matrix reaches the
driver. In that space each window is compared with each benchmark passage by cosine; words that are in
no passage count for nothing there, so cosines do not fall as the corpus grows. Candidates are confirmed
on words: by the longest common subsequence with the text around the window, or a shorter one where the
passage's answer, its last words, stands there too.

The benchmark is a stated query set, taken in blocks of at most ``BLOCK_ITEMS`` items and
``BLOCK_CHARS`` characters (or one item); only a block is ever broadcast. All documents are searched
whole, ``SLICE`` windows at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsrate.llm.common import stored

BLOCK = 16
PASSAGE_WORDS = 48
BLOCK_ITEMS, BLOCK_CHARS = 2000, 2_000_000
SLICE = 2048
#: Texts are looked up together up to this many words; a longer one alone.
TOGETHER = 200_000
RANK, OVERSAMPLING = 64, 8
#: Weight of the benchmark's own rows in the decomposition, against all windows.
BENCHMARK_ENERGY = 4.0
#: Finds all but a few in a thousand of the paraphrases that the check on words accepts.
COSINE = 0.4
LCS, LCS_WITH_ANSWER = 0.8, 0.6
ANSWER_SHARE = 0.25
TERM_ROWS = 256

#: Letters and digits as they are, A-Z lower-cased, all other bytes as spaces.
LETTERS = bytes(
    c if c >= 128 or chr(c).isalnum() else ord(" ") for c in (ord(chr(b).lower()) if b < 128 else b for b in range(256))
)
MATCH_TYPE = "doc_id long, item_id long, start long, similarity double, cosine double"


def word_ids(text: str | None) -> np.ndarray:
    """The words of a text (letters and digits, A-Z lower-cased) as 32-bit hashes."""
    words = text.encode().translate(LETTERS).split() if text else []
    return np.fromiter(map(zlib.crc32, words), "u4", len(words))


@dataclass
class Passage:
    item_id: int
    words: np.ndarray
    answer: np.ndarray

    def __post_init__(self):
        #: The places of each word as bits.
        self.places: dict[int, int] = {}
        for i, w in enumerate(self.words.tolist()):
            self.places[w] = self.places.get(w, 0) | 1 << i

    def present(self, words: set[int]) -> float:
        """The share of the passage whose words are among ``words``: never less than that of a
        common subsequence."""
        found = self.places.keys() & words
        return sum(self.places[w].bit_count() for w in found) / len(self.words)


def passages(items: list[tuple[int, str | None]]) -> list[Passage]:
    """Items in equal parts of at most ``PASSAGE_WORDS`` words. Items without words give none."""
    out = []
    for item, text in items:
        ids = word_ids(text)
        if item is not None and len(ids):
            for part in np.array_split(ids, -(-len(ids) // PASSAGE_WORDS)):
                last = max(1, round(len(part) * ANSWER_SHARE))
                out.append(Passage(item, part, part[-last:]))
    return out


def common_subsequence(text: list[int], wanted: Passage) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    full = v = (1 << len(wanted.words)) - 1
    for w in text:
        if places := wanted.places.get(w):
            u = v & places
            v = ((v + u) | (v - u)) & full
    return len(wanted.words) - v.bit_count()


def _contains(text: np.ndarray, wanted: np.ndarray) -> bool:
    n = len(wanted)
    starts = np.flatnonzero(text[: max(0, len(text) - n + 1)] == wanted[0])
    return any((text[s : s + n] == wanted).all() for s in starts)


def matched(text: np.ndarray, passage: Passage) -> float:
    """The share of the passage found in order in ``text``; 0 if that is not enough."""
    share = common_subsequence(text.tolist(), passage) / len(passage.words)
    if share >= LCS or share >= LCS_WITH_ANSWER and _contains(text, passage.answer):
        return share
    return 0.0


def _columns(terms: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that are terms, and their columns."""
    at = np.searchsorted(terms, ids)
    at[at == len(terms)] = 0
    known = np.flatnonzero(terms[at] == ids)
    return known, at[known]


def _windows(rows: np.ndarray, place: np.ndarray, blocks: int) -> np.ndarray:
    """Sums of ``rows`` by window; window i covers blocks i and i + 1."""
    sums = np.zeros((blocks + 1, rows.shape[1]), "f4")
    if len(place):
        block = place // BLOCK
        first = np.flatnonzero(np.diff(block, prepend=-1))
        sums[block[first]] = np.add.reduceat(rows, first, axis=0)
    return sums[:-1] + sums[1:]


@dataclass
class Texts:
    """Word ids of some texts, one after the other. Each text begins on a block of its own, with an
    empty block before it, so no window holds words of two texts."""

    docs: list
    ids: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    """Its first block by text."""
    blocks: int

    @classmethod
    def of(cls, docs: list, parts: list[np.ndarray]) -> Texts:
        sizes = np.array([len(x) for x in parts], "i8")
        ends = np.cumsum(1 - -sizes // BLOCK)
        return cls(docs, np.concatenate(parts), np.cumsum(sizes), ends + sizes // -BLOCK, int(ends[-1]))

    def known(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words that are terms: their texts, places and columns."""
        at, col = _columns(terms, self.ids)
        sizes = np.diff(self.ends, prepend=0)
        text = np.repeat(np.arange(len(sizes)), sizes)[at]
        return text, at + (self.first * BLOCK - self.ends + sizes)[text], col

    def slices(self, place: np.ndarray) -> Iterator[tuple[int, int, slice]]:
        """(first window, number of blocks, words) of ``SLICE`` windows each; the last window of a
        slice stands on one block more."""
        for at in range(0, self.blocks, SLICE):
            low, high = np.searchsorted(place, [at * BLOCK, (at + SLICE + 1) * BLOCK])
            if low < high:
                yield at, min(SLICE + 1, self.blocks - at), slice(low, high)

    def empty(self, at: int) -> np.ndarray:
        """The windows from ``at`` on, within a slice, that begin on an empty block."""
        gaps = self.first - 1 - at
        return gaps[(gaps >= 0) & (gaps < SLICE)]


def _texts(batches) -> Iterator[Texts]:
    docs, parts, n = [], [], 0
    for batch in batches:
        for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            docs.append(doc)
            parts.append(np.frombuffer(ids.as_buffer(), "u4"))
            n += len(parts[-1])
            if n >= TOGETHER or len(docs) >= TOGETHER:
                yield Texts.of(docs, parts)
                docs, parts, n = [], [], 0
    if docs:
        yield Texts.of(docs, parts)


def document_frequencies(words: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each term stands, and the number of documents."""
    spark = words.sparkSession
    known = spark.sparkContext.broadcast(terms)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = np.zeros(len(known.value) + 1, "i8"), 0
        size = max(1, len(known.value))
        for texts in _texts(batches):
            text, _, col = texts.known(known.value)
            n[:-1] += np.bincount(np.unique(text * size + col) % size, minlength=len(n) - 1)
            docs += len(texts.docs)
        n[-1] = docs
        places = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(n[places])], ["term", "n"])

    rows = words.mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(terms) + 1, "i8")
    for r in rows.collect():  # one row per term of the block
        out[r.term] = r.n
    return out[:-1], int(out[-1])


def corpus_product(
    words: DataFrame, terms: np.ndarray, idf: np.ndarray, omega: np.ndarray
) -> tuple[np.ndarray, float]:
    """A'(A omega) and the squared norm of A, the TF-IDF matrix of all windows."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast((terms, idf.astype("f4"), omega.astype("f4")))
    width = omega.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, omega = shared.value
        total, energy = np.zeros((len(terms), width), "f8"), 0.0
        weighted = omega * idf[:, None]
        for texts in _texts(batches):
            _, place, col = texts.known(terms)
            energy += 2 * float((idf[col] ** 2).sum())
            for at, blocks, rows in texts.slices(place):
                here, own = place[rows] - at * BLOCK, col[rows]
                seen = _windows(weighted[own], here, blocks)
                seen[texts.empty(at)] = 0
                seen[SLICE:] = 0
                # A word stands in the window of its block and in that before it.
                block = here // BLOCK
                back = seen[block]
                back[block > 0] += seen[block[block > 0] - 1]
                order = np.argsort(own, kind="stable")
                first = np.flatnonzero(np.diff(own[order], prepend=-1))
                which = own[order[first]]
                total[which] += np.add.reduceat(back[order], first, axis=0) * idf[which, None]
        starts = range(0, len(terms), TERM_ROWS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([-1, *starts], pa.int64()),
                pa.array(
                    [np.float64(energy).tobytes()]
                    + [total[s : s + TERM_ROWS].tobytes() for s in starts],
                    pa.binary(),
                ),
            ],
            ["start", "rows"],
        )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(rows.as_buffer(), "f8")
                held[s] = held[s] + values if s in held else values.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())],
            ["start", "rows"],
        )

    kind = "start long, rows binary"
    found = words.mapInArrow(sums, kind).repartition("start").mapInArrow(added, kind).collect()
    total, energy = np.zeros((len(terms), width)), 0.0
    for r in found:  # one row per TERM_ROWS terms
        values = np.frombuffer(r.rows, "f8")
        if r.start < 0:
            energy = float(values[0])
        else:
            total[r.start : r.start + TERM_ROWS] = values.reshape(-1, width)
    return total, energy


def latent_space(product: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of A from G = A'A omega (Nystroem)."""
    core = omega.T @ product
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(initial=0), 1e-12) * 1e-10
    half = product @ (vectors[:, good] / np.sqrt(values[good]))
    return np.linalg.svd(half, full_matrices=False)[0][:, :rank]


@dataclass
class Index:
    """A block of passages in the latent space."""

    terms: np.ndarray
    idf: np.ndarray
    project: np.ndarray
    query: np.ndarray
    queries: list[Passage]
    columns: np.ndarray
    """The terms of each passage's words, the rarest first, padded with the number of terms."""


def own_terms(queries: list[Passage], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passages x terms matrix of occurrences by its entries: passage and term of each word."""
    sizes = [len(p.words) for p in queries]
    cols = np.searchsorted(terms, np.concatenate([p.words for p in queries]))
    return np.repeat(np.arange(len(queries)), sizes), cols


def index_of(words: DataFrame, queries: list[Passage]) -> Index:
    """The latent space of all windows and the passages, and the passages in it."""
    terms = np.unique(np.concatenate([p.words for p in queries]))
    df, docs = document_frequencies(words, terms)
    idf = np.log((1.0 + docs) / (1.0 + df)) + 0.1
    row, col = own_terms(queries, terms)
    first = np.flatnonzero(np.diff(row, prepend=-1))

    def own(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[col] * idf[col, None], first, axis=0)

    omega = np.random.default_rng(11).standard_normal((len(terms), RANK + OVERSAMPLING))
    product, energy = corpus_product(words, terms, idf, omega)
    cell, times = np.unique(row * len(terms) + col, return_counts=True)
    squares = (times * idf[cell % len(terms)]) ** 2
    norm = np.sqrt(np.bincount(cell // len(terms), squares, len(queries)))
    weight = BENCHMARK_ENERGY * max(energy, 1.0) / squares.sum()
    np.add.at(product, col, weight * own(omega)[row] * idf[col, None])
    space = latent_space(product, omega, RANK)
    placed = own(space)
    # The cosine, relative to what the space keeps of the passage itself.
    kept = np.maximum((placed**2).sum(1), 1e-9)
    query = (placed * (norm / kept)[:, None]).T.astype("f4")
    project = (space * idf[:, None]).astype("f4")
    columns = np.full((len(queries), max(len(p.words) for p in queries)), len(terms))
    columns[row, np.arange(len(row)) - first[row]] = col[np.lexsort((-idf[col], row))]
    return Index(terms, idf.astype("f4"), project, query, queries, columns)


#: Blocks before a window and after its first block that its surroundings reach.
BEFORE, AFTER = PASSAGE_WORDS // BLOCK, 1 + PASSAGE_WORDS // BLOCK
#: Cells of the table of terms by window.
CELLS = 1 << 24


def present(
    texts: Texts, index: Index, word: tuple, windows: np.ndarray, queries: np.ndarray
) -> np.ndarray:
    """For pairs of window and passage, windows ascending: whether enough of the passage's words stand
    around the window, in its text. ``word`` are texts, places and columns of the known words."""
    text, place, col = word
    good = np.zeros(len(windows), bool)
    sizes = np.array([len(p.words) for p in index.queries])
    needed = LCS_WITH_ANSWER * sizes - 1e-9
    # If all the others stood there, so many of the rarest half would still be needed.
    half = -(-index.columns.shape[1] // 2)
    of_half = needed - np.maximum(0, sizes - half)
    last = np.concatenate([texts.first[1:] - 1, [texts.blocks]])
    step = max(1, CELLS // (len(index.terms) + 1))
    table = np.zeros((min(step, SLICE), len(index.terms) + 1), bool)
    step = len(table)
    done = 0
    while done < len(windows):
        begin = windows[done]
        until = np.searchsorted(windows, begin + step)
        low, high = np.searchsorted(place, [(begin - BEFORE) * BLOCK, (begin + step + AFTER) * BLOCK])
        block, own, t = place[low:high] // BLOCK, col[low:high], text[low:high]
        table[:] = False
        for k in range(-AFTER, BEFORE + 1):
            w = block + k
            here = (w >= begin) & (w < begin + step) & (w >= texts.first[t]) & (w < last[t])
            table[w[here] - begin, own[here]] = True
        for at in range(done, until, 1 << 16):
            part = np.arange(at, min(until, at + (1 << 16)))
            found = np.zeros(len(part), "i8")
            for columns, least in (index.columns[:, :half], of_half), (index.columns[:, half:], needed):
                q = queries[part]
                cells = ((windows[part] - begin) * table.shape[1])[:, None] + columns[q]
                found += table.ravel().take(cells).sum(1)
                keep = found >= least[q]
                part, found = part[keep], found[keep]
            good[part] = True
        done = until
    return good


def matches(texts: Texts, index: Index, cosine: float = COSINE) -> list[tuple]:
    """(doc, item, first word of the region, share, cosine) of the items that the texts hold. A
    ``cosine`` of ``-inf`` leaves the candidate search out."""
    _, place, col = word = texts.known(index.terms)
    best: dict[tuple[int, int], tuple] = {}
    begins = np.concatenate([[0], texts.ends])
    for at, blocks, rows in texts.slices(place):
        here, own = place[rows] - at * BLOCK, col[rows]
        sums = _windows(index.project[own], here, blocks)[:SLICE]
        length = np.sqrt(_windows(index.idf[own, None] ** 2, here, blocks)[:SLICE])
        near = (sums @ index.query) / np.maximum(length, 1e-6)
        windows, found = np.nonzero(near >= cosine)
        gap = np.zeros(SLICE + 1, bool)
        gap[texts.empty(at)] = True
        keep = ~gap[windows]
        windows, found = windows[keep] + at, found[keep]
        keep = present(texts, index, word, windows, found)
        windows, found = windows[keep], found[keep]
        owner = np.searchsorted(texts.first, windows, "right") - 1
        last, around, start = -1, texts.ids, 0
        for w, q, t in zip(windows.tolist(), found.tolist(), owner.tolist()):
            p = index.queries[q]
            key = t, p.item_id
            if key in best and best[key][3] == 1.0:
                continue
            if w != last:
                ids = texts.ids[begins[t] : begins[t + 1]]
                first = (w - int(texts.first[t])) * BLOCK
                start = max(0, first - PASSAGE_WORDS)
                around = ids[start : first + 2 * BLOCK + PASSAGE_WORDS]
                last = w
            share = matched(around, p)
            if share > (best[key][3] if key in best else 0.0):
                best[key] = (texts.docs[t], p.item_id, start, share, float(near[w - at, q]))
    return [found for found in best.values() if found[0] is not None]


def _search_block(words: DataFrame, queries: list[Passage]) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(index_of(words, queries))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _texts(batches):
            out = matches(texts, shared.value)
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.float64()] * 2)],
                ["doc_id", "item_id", "start", "similarity", "cosine"],
            )

    return words.mapInArrow(search, MATCH_TYPE)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(doc_id, item_id, start, similarity, cosine): which documents hold which items, the word
    from which the matching region was read, the share of the passage found there in order, and
    the cosine. Null or empty texts and items match nothing; rows with a null id on either side
    are left out; repeated rows give their matches again, repeated items once. A very long text is searched
    in slices of windows."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_ids(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.binary())], ["doc_id", "words"]
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = stored(source.mapInArrow(coded, "doc_id long, words binary"), "words")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-size.n // block_items), -(-(size.chars or 0) // BLOCK_CHARS))
    found = None
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        queries = passages(sorted(map(tuple, part.collect()), key=str))
        if queries:
            hits = _search_block(words, queries)
            found = hits if found is None else found.union(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], MATCH_TYPE)
    return found
