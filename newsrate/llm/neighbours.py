"""A quality classifier by nearest neighbours in a latent semantic space.

A text is a TF-IDF vector over terms: its words, the forms of its words (letters, capitals, digits and
marks, runs shortened) and levels of how much of it is a word or a line again. Document frequencies cover all
documents; terms are further weighted by how far they tell the labelled classes apart. A randomised
SVD of the labelled rows gives the latent space. Their vectors are broadcast, every document is
compared with all of them exactly, in blocks, and its nearest neighbours vote by similarity.

Only the labelled rows are sampled: at most ``MAX_ROWS`` of them, chosen by hash. ``MAX_TERMS`` and
``RANK`` bound what is broadcast; neither grows with the documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsrate.llm.common import BoundedCache, crc_fold, stored

MAX_ROWS = 4_000
MAX_TERMS, LEAST_DOCS, LONGEST_TERM = 4_096, 5, 40
RANK, OVERSAMPLING, ROUNDS = 48, 16, 4
NEIGHBOURS, SHARPNESS = 25, 4
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
CACHED_WORDS = 200_000
BLOCK_ROWS, BLOCK_CHARS = 512, 1 << 22

#: What a byte is in a word's form; bytes of other scripts' letters count as small letters.
_FORM = bytes(
    97 if 97 <= b <= 122 or b > 127 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b
    for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)
#: A repeated share of a text is a term for each of these levels that it reaches.
SHARES = tuple(2.0**-i for i in range(6, 0, -1))
SHARE_TERMS = {
    kind: tuple(b"again:%s:%d" % (kind, i) for i in range(len(SHARES))) for kind in (b"word", b"line")
}


def word_terms(word: bytes) -> tuple[bytes, ...]:
    """The word itself and its form. Long words have no term of their own, long forms are cut."""
    form = b"form:" + _RUN.sub(rb"\1", word.translate(_FORM))[:LONGEST_TERM]
    return (form,) if len(word) > LONGEST_TERM else (b"word:" + word.lower(), form)


def term_counts(text: str | None, terms_of=word_terms) -> dict[bytes, int]:
    """How often each term occurs in a text."""
    if not text:
        return {}
    raw = text.encode()
    words = raw.split()
    out: dict[bytes, int] = {}
    for word, n in Counter(words).items():
        for term in terms_of(word):
            out[term] = out.get(term, 0) + n
    lines = [line for line in raw.split(b"\n") if line.strip()]
    again = {b"word": sum(map(eq, words, words[1:])), b"line": len(lines) - len(set(lines))}
    for kind, n in again.items():
        share = n / max(1, len(words if kind == b"word" else lines))
        for term, level in zip(SHARE_TERMS[kind], SHARES):
            if share >= level:
                out[term] = 1
    return out


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled rows outside the held-out fold, stored. Rows
    are taken in the order of a hash of id, text and label; equal rows count once. Only keys are
    shuffled: the keys taken, at most ``max_rows``, are then broadcast to the texts."""
    known = labels.filter(
        F.col("quality").isNotNull()
        & F.col("doc_id").isNotNull()
        & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    ).select("doc_id", (F.col("quality") > 0).cast("int").alias("label"))
    content = F.xxhash64("text").alias("content")
    keys = docs.select("doc_id", content).join(known, "doc_id").distinct()
    place = F.xxhash64("doc_id", "label", "content")
    taken = stored(keys.orderBy(place, "doc_id", "label", "content").limit(max_rows), "taken")
    texts = docs.select("doc_id", "text", content).join(F.broadcast(taken), ["doc_id", "content"])
    rows = texts.groupBy("doc_id", "content", "label").agg(F.first("text").alias("text"))
    return stored(rows.select("text", "label"), "labelled")


def vocabulary(rows: DataFrame, max_terms: int) -> dict[bytes, int]:
    """Places of the terms that most of the labelled rows hold."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for text in batch.column(0):
                found.update(term_counts(text.as_py()).keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                ["term", "n"],
            )

    parts = rows.select("text").mapInArrow(counts, "term binary, n long")
    docs = parts.groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    best = docs.orderBy(F.desc("n"), "term").limit(max_terms).collect()
    return {bytes(r.term): i for i, r in enumerate(best)}


def _known_terms(places: dict[bytes, int]) -> BoundedCache:
    """A worker's cache from a word to the places of its terms."""

    def known(word: bytes) -> tuple[int, ...]:
        return tuple(places[t] for t in word_terms(word) if t in places)

    return BoundedCache(known, CACHED_WORDS)


def text_blocks(texts: list) -> Iterator[list]:
    """``texts`` in blocks of at most ``BLOCK_ROWS`` and about ``BLOCK_CHARS``."""
    block: list = []
    chars = 0
    for text in texts:
        block.append(text)
        chars += len(text or "")
        if len(block) == BLOCK_ROWS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def block_counts(texts: list, places: dict[bytes, int], cache: BoundedCache) -> np.ndarray:
    """The numbers of all known terms (columns) in a block of texts: ``term_counts`` of each, with
    every distinct word of the block looked up once."""
    words: list[bytes] = []
    sizes = []
    out = np.zeros((len(texts), len(places)), "i4")
    again = np.zeros((len(texts), 2))
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        found = raw.split()
        words += found
        sizes.append(len(found))
        lines = [line for line in raw.split(b"\n") if line.strip()]
        again[i, 1] = (len(lines) - len(set(lines))) / max(1, len(lines))
    if not words:
        return out
    coded = pa.array(words, pa.binary()).dictionary_encode()
    codes, row = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), sizes)
    terms = [cache[w] for w in coded.dictionary.to_pylist()]
    flat = out.reshape(-1)
    for i in range(2):
        place = np.array([t[i] if len(t) > i else -1 for t in terms], "i8")[codes]
        at = place >= 0
        flat += np.bincount(row[at] * len(places) + place[at], minlength=len(flat)).astype("i4")
    same = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    again[:, 0] = np.bincount(row[1:][same], minlength=len(texts)) / np.maximum(1, sizes)
    for kind, names in enumerate(SHARE_TERMS.values()):
        for term, level in zip(names, SHARES):
            if term in places:
                out[:, places[term]] = again[:, kind] >= level
    return out


def document_frequencies(docs: DataFrame, places: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term stands, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _known_terms(shared.value)
        n = np.zeros(len(shared.value) + 1, "i8")
        for batch in batches:
            for texts in text_blocks(batch.column(0).to_pylist()):
                n[:-1] += np.count_nonzero(block_counts(texts, shared.value, cache), axis=0)
            n[-1] += batch.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["term", "n"])

    parts = docs.select("text").mapInArrow(counts, "term long, n long")
    out = np.zeros(len(places) + 1, "i8")
    for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row per term
        out[r.term] = r.n
    return out[:-1], int(out[-1])


def contrast(docs_with: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How far the classes differ in each term: the absolute log odds ratio, by documents."""
    ones, zeros = max(1, labels.sum()), max(1, (1 - labels).sum())
    share = (docs_with + 0.5) / (np.array([[zeros], [ones]]) + 1.0)
    return np.abs(np.diff(np.log(share / (1 - share)), axis=0))[0]


@dataclass
class Space:
    """Term weights, the projection, and the labelled vectors with their labels."""

    places: dict[bytes, int]
    weight: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    rate: float


def _dense(rows: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> np.ndarray:
    """Weighted rows of length 1; rows without terms stay 0."""
    out = np.zeros((len(rows), len(weight)), "f4")
    for row, (at, n) in zip(out, rows):
        row[at] = np.log1p(n) * weight[at]
    return _unit(out)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _blocks(rows: list) -> Iterator[list]:
    return (rows[i : i + BLOCK_ROWS] for i in range(0, len(rows), BLOCK_ROWS))


def latent_axes(rows: list, weight: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of the weighted rows, by subspace iteration from a random
    start; the rows are made dense a block at a time."""
    rank = min(rank, len(weight))
    width = min(len(weight), rank + OVERSAMPLING)
    basis = np.random.default_rng(12).standard_normal((len(weight), width))
    for _ in range(ROUNDS):
        product = np.zeros_like(basis)
        for block in _blocks(rows):
            dense = _dense(block, weight).astype("f8")
            product += dense.T @ (dense @ basis)
        basis = np.linalg.qr(product)[0]
    core = np.zeros((width, width))
    for block in _blocks(rows):
        inner = _dense(block, weight) @ basis
        core += inner.T @ inner
    values, vectors = np.linalg.eigh(core)
    order = np.argsort(-values)[:rank]
    return (basis @ vectors[:, order[values[order] > 1e-9]]).astype("f4")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Space:
    rows = labelled_rows(docs, labels, max_rows)
    places = vocabulary(rows, MAX_TERMS)
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _known_terms(shared.value)
        for batch in batches:
            found = [
                (np.flatnonzero(row).astype("i4"), row[row > 0].astype("i8"))
                for texts in text_blocks(batch.column(0).to_pylist())
                for row in block_counts(texts, shared.value, cache)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([a.tobytes() for a, _ in found], pa.binary()),
                    pa.array([n.tobytes() for _, n in found], pa.binary()),
                ],
                ["label", "terms", "counts"],
            )

    # At most ``max_rows`` rows of at most ``MAX_TERMS`` terms.
    found = rows.mapInArrow(counted, "label int, terms binary, counts binary").collect()
    found = sorted((r.label, bytes(r.terms), bytes(r.counts)) for r in found)
    y = np.array([label for label, _, _ in found], "f8")
    sparse = [(np.frombuffer(t, "i4"), np.frombuffer(n, "i8")) for _, t, n in found]
    docs_with = np.zeros((2, len(places)))
    for label, (at, _) in zip(y, sparse):
        docs_with[int(label)][at] += 1
    df, n = document_frequencies(docs, places)
    weight = (np.log((1.0 + n) / (1.0 + df)) + 0.1) * contrast(docs_with, y)
    project = latent_axes(sparse, weight, RANK) if places else np.zeros((0, 0), "f4")
    vectors = [_unit(_dense(b, weight) @ project) for b in _blocks(sparse)]
    return Space(
        places,
        weight,
        project,
        np.concatenate([*vectors, np.zeros((0, project.shape[1]), "f4")]),
        y,
        float(y.mean()) if len(y) else 0.5,
    )


def votes(space: Space, counts: np.ndarray) -> np.ndarray:
    """Scores of a block of texts: the labels of the nearest labelled vectors, weighted by the
    similarity. Exact: the product with all labelled vectors is formed. A text's length needs no
    norm before its projection has one."""
    weighted = np.log1p(counts, dtype="f4") * space.weight.astype("f4")
    near = _unit(weighted @ space.project) @ space.vectors.T
    k = min(NEIGHBOURS, near.shape[1])
    if not k:
        return np.full(len(counts), space.rate)
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    power = np.maximum(np.take_along_axis(near, at, 1).astype("f8"), 0.0) ** SHARPNESS
    total = power.sum(1)
    share = (power * space.labels[at]).sum(1) / np.maximum(total, 1e-300)
    return np.clip(np.where(total > 0, share, space.rate), 0.0, 1.0)


def scorer(docs: DataFrame, space: Space):
    """A function from a text column to its score."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        space = shared.value
        cache = _known_terms(space.places)
        for texts in batches:
            parts = [
                votes(space, block_counts(block, space.places, cache))
                for block in text_blocks(texts.tolist())
            ]
            yield pd.Series(np.concatenate([*parts, np.zeros(0)]))

    return score


def neighbour_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; repeated rows and null ids included.

    Only the text enters a score. Null and empty texts, and texts that share no term with the
    labelled rows, get the share of label 1 among those; without labelled rows every score is 0.5.
    Neighbours of equal similarity at the border of the ``NEIGHBOURS`` nearest are interchangeable.
    Held-out rows are those whose crc32 of the id is 2 modulo 4; they are never learned from."""
    score = scorer(docs, fit(docs, labels, max_rows))
    return docs.select(
        "doc_id",
        (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        score(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
