"""Language-model scores of whole documents by a gated recurrent network in numpy.

Words are counted over all training documents. The ``VOCABULARY`` most frequent ones, the end and
one symbol for all other words are the network's symbols; the output softmax is factored into a
class and a word of that class. Classes are cut by rank so that frequent words share small ones.
Another word costs its symbol and its share among all such words.

Training is data-parallel and reads every word: training documents are cut into stretches of at most
``STRETCH`` symbols, each of which is learned from once. Replicas train on their parts by truncated
backpropagation (windows of ``WINDOW`` symbols, the state carried through a stretch; stretches of one
length together) and are averaged after each of ``ROUNDS`` rounds, on Spark and block by block. Their
number grows with the training words, ``REPLICA_SYMBOLS`` a round for each at most. Scoring reads whole
documents in windows with the state carried across them.

Counts of the ``FREQUENT`` most frequent words are broadcast; the words beyond them are looked up by
a join on their hash.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from newsrate.llm.common import crc_fold, stored, words_of

FOLDS, HELD_OUT = 5, 1
FREQUENT = 300_000
#: Symbols 0 and 1 are the end and all other words.
END, OTHER = 0, 1
SYMBOLS = 128 * 128
VOCABULARY = SYMBOLS - 2
EMBEDDING, HIDDEN = 16, 24
STRETCH, WINDOW, BATCH = 192, 16, 1024
ROUNDS, REPLICAS, REPLICA_SYMBOLS = 2, 6, 1 << 23
#: Numbers in one block of parameters when replicas are averaged.
BLOCK = 1 << 13
#: Parameters that are updated together, and rows of outputs: as much as stays in a core's cache.
UPDATED, ROWS = 1 << 15, 1 << 12
RATE = 1.2e-2
SCORE_BATCH = 1024
#: Bytes of texts whose words are found together; a longer text alone.
TOGETHER = 1 << 23

Params = dict[str, np.ndarray]


def word_hashes(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(xxh3_64_intdigest, words), "u8", len(words)).view("i8")


def hashed(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of consecutive texts: the hashes of their different words, the words as places among
    these, and where each text begins and, last, the block ends. The words of a text are those of
    ``word_hashes``, but each different one of a block is hashed once."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes, dtype="i8") // TOGETHER
    for first, end in zip(*(np.searchsorted(block, np.unique(block), side) for side in ("left", "right"))):
        # Taken, not sliced: Arrow lower-cases the wrong bytes of a slice that was cast.
        part = texts.take(pa.array(np.arange(first, end))).cast(pa.large_string()).fill_null("")
        split = pc.ascii_split_whitespace(pc.ascii_lower(part))
        found = split.values.dictionary_encode()
        codes, (_, ends, data) = found.indices.to_numpy(), found.dictionary.buffers()
        ends, data = np.frombuffer(ends, "i8", len(found.dictionary) + 1).tolist(), bytes(data or b"")
        words = [data[a:b] for a, b in zip(ends, ends[1:])]
        # White space at either end of a text leaves an empty word there.
        empty = np.array([not w for w in words], bool)
        keep = ~empty[codes]
        starts = np.append(0, np.cumsum(keep))[split.offsets.to_numpy()]
        hashes = np.fromiter(map(xxh3_64_intdigest, words), "u8", len(words)).view("i8")
        yield hashes, codes[keep], starts


# The network.


def class_starts(symbols: int) -> np.ndarray:
    """The first symbol of each class and the end of the last one. Symbols stand by falling
    frequency, sizes grow with the rank; the end and the symbol of other words are alone."""
    classes = max(math.isqrt(symbols) // 2, 1)
    squares = (np.linspace(0, 1, classes + 1) ** 2 * symbols).astype("i8")
    return np.unique(np.concatenate([np.arange(min(symbols, 3)), squares]))


def first_params(counts: np.ndarray) -> Params:
    """Random inner weights; the output biases make the untrained network the unigram model of
    ``counts`` (by symbol)."""
    rng = np.random.default_rng(3)
    starts = class_starts(len(counts))
    p = counts + 0.5
    mass = np.add.reduceat(p, starts[:-1])
    normal = lambda *shape: rng.standard_normal(shape).astype("f4")
    return {
        "E": normal(len(counts), EMBEDDING) * np.float32(0.3),
        "W": normal(EMBEDDING, 3 * HIDDEN) * np.float32(EMBEDDING**-0.5),
        "b": np.zeros(3 * HIDDEN, "f4"),
        "U": normal(HIDDEN, 3 * HIDDEN) * np.float32(HIDDEN**-0.5),
        "C": np.zeros((HIDDEN, len(mass)), "f4"),
        "c": np.log(mass / p.sum()).astype("f4"),
        "O": np.zeros((len(counts), HIDDEN), "f4"),
        "o": np.log(p / np.repeat(mass, np.diff(starts))).astype("f4"),
    }


def flat(params: Params) -> np.ndarray:
    return np.concatenate([v.ravel() for v in params.values()])


def views(numbers: np.ndarray, like: Params) -> Params:
    """Parameters shaped as ``like`` that are parts of one array."""
    ends = np.cumsum([v.size for v in like.values()])[:-1]
    return {k: x.reshape(v.shape) for (k, v), x in zip(like.items(), np.split(numbers, ends))}


def dump(params: Params) -> bytes:
    out = io.BytesIO()
    np.savez(out, **params)
    return out.getvalue()


def load(data: bytes) -> Params:
    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}


def gates(x: np.ndarray) -> np.ndarray:
    """The columns of the update gate, the reset gate and the new state, one after the other, each
    in a block of its own."""
    return np.ascontiguousarray(x.reshape(len(x), 3, HIDDEN).transpose(1, 0, 2))


def gated(x: np.ndarray, h: np.ndarray, U: np.ndarray):
    """One step of the gated unit on ``gates``: the new state and what the way back needs."""
    a = np.matmul(h, U)
    zr = x[:2] + a[:2]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r = zr
    c = r * a[2]
    c += x[2]
    np.tanh(c, out=c)
    new = h - c
    new *= z
    new += c
    return new, (h, z, r, c, a[2])


def step(x: np.ndarray, h: np.ndarray, U: np.ndarray):
    """``gated`` with the gates side by side."""
    return gated(gates(x), h, gates(U))


def tame(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no exponential of ``weights`` times a state, which is within -1 and 1, plus ``bias``
    or its product with another can overflow or vanish."""
    sums = np.abs(weights) @ np.ones(weights.shape[-1], "f4")
    return float((sums + np.abs(bias)).max(initial=0)) < 40


def picked(x: np.ndarray, bias: np.ndarray, which: tuple, back: bool, safe: bool) -> tuple[np.ndarray, ...]:
    """Log softmax of the rows of ``x`` plus ``bias`` at ``which``. Then what the exponentials, which
    ``x`` becomes, are to be multiplied with for shares: by row and by column. With ``back`` they
    are less the ones at ``which``, so the products are the gradient of its negative. If it is ``safe``,
    the bias is only a factor of a column; else it is added and the largest of each row taken off first."""
    if safe:
        weight = np.exp(bias)
        chosen = x[which] + bias[which[1]]
    else:
        weight = np.ones_like(bias)
        x += bias
        x -= x.max(axis=1, keepdims=True)
        chosen = x[which]
    np.exp(x, out=x)
    total = x @ weight
    if back:
        x[which] -= total / weight[which[1]]
    return chosen - np.log(total), 1 / total, weight


def outputs(h: np.ndarray, targets: np.ndarray, params: Params, grads: Params | None = None):
    """Natural log probabilities of the targets; with ``grads`` the gradients of their negative sum
    are added to the output weights' there, and those for the states are returned too."""
    back = grads is not None
    starts = class_starts(len(params["o"]))
    order = np.argsort(targets.astype("u2"), kind="stable")
    h, targets = h.take(order, axis=0), targets[order]
    cls = np.searchsorted(starts, targets, "right") - 1
    at, safe = np.arange(len(targets)), tame(params["C"].T, params["c"])
    x = np.empty((len(h), params["C"].shape[1]), "f4")
    part, share, weight = np.empty(len(h)), np.empty((len(h), 1), "f4"), np.float32(1)
    for first in range(0, len(h), ROWS):
        rows = slice(first, first + ROWS)
        own = np.matmul(h[rows], params["C"], out=x[rows])
        part[rows], share[rows, 0], weight = picked(own, params["c"], (at[: len(own)], cls[rows]), back, safe)
    safe = tame(params["O"], params["o"])
    ends = np.searchsorted(cls, np.arange(len(starts)))
    if back:
        grads["C"] += (h * share).T @ x * weight
        grads["c"] += share[:, 0] @ x * weight
        down = x @ (params["C"] * weight).T
        down *= share
    for k in np.flatnonzero((np.diff(ends) > 0) & (np.diff(starts) > 1)):
        rows, words = slice(ends[k], ends[k + 1]), slice(starts[k], starts[k + 1])
        own = h[rows]
        x = own @ params["O"][words].T
        logp, share, weight = picked(x, params["o"][words], (at[: len(own)], targets[rows] - starts[k]), back, safe)
        part[rows] += logp
        if back:
            grads["O"][words] += x.T @ (own * share[:, None]) * weight[:, None]
            grads["o"][words] += share @ x * weight
            more = x @ (params["O"][words] * weight[:, None])
            more *= share[:, None]
            down[rows] += more
    logp = np.empty_like(part)
    logp[order] = part
    if not back:
        return logp
    back_again = np.empty_like(down)
    back_again[order] = down
    return logp, back_again


def window_gradients(
    params: Params, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, grads: Params | None = None
):
    """Loss, number of targets, gradients (in ``grads`` if given, which is zero) and last state of one
    window. ``targets`` are -1 where a text is over."""
    T, B = inputs.shape
    grads = grads or {k: np.zeros_like(v) for k, v in params.items()}
    used = np.flatnonzero(np.bincount(inputs.ravel(), minlength=len(params["E"])))
    places = np.zeros(len(params["E"]), "i8")
    places[used] = np.arange(len(used))
    places = places[inputs]
    table, U = gates(params["E"][used] @ params["W"] + params["b"]), gates(params["U"])
    states, kept = np.empty((T, B, HIDDEN), "f4"), []
    for t in range(T):
        h, memo = gated(table.take(places[t], axis=1), h, U)
        states[t] = h
        kept.append(memo)
    valid = np.flatnonzero(targets.ravel() >= 0)
    flat_states, flat_targets = states.reshape(-1, HIDDEN), targets.ravel()
    if len(valid) == T * B:
        logp, down = outputs(flat_states, flat_targets, params, grads)
    else:
        logp, dh = outputs(flat_states[valid], flat_targets[valid], params, grads)
        down = np.zeros((T * B, HIDDEN), "f4")
        down[valid] = dh
    down = down.reshape(T, B, HIDDEN)
    dx, dU = np.empty((3, T, B, HIDDEN), "f4"), np.zeros_like(U)
    ahead, back = np.zeros((B, HIDDEN), "f4"), U.transpose(0, 2, 1)
    for t in reversed(range(T)):
        before, z, r, c, a = kept[t]
        d = down[t] + ahead
        da = dx[:, t]
        stays = 1 - z
        stays *= d
        pc = c * c
        np.subtract(1, pc, out=pc)
        pc *= stays
        np.subtract(before, c, out=da[0])
        da[0] *= z
        da[0] *= stays
        np.multiply(pc, r, out=da[2])
        np.multiply(da[2], a, out=da[1])
        np.subtract(1, r, out=r)
        da[1] *= r
        dU += np.matmul(before.T, da)
        ahead = d
        ahead *= z
        for k in range(3):
            ahead += da[k] @ back[k]
        da[2] = pc
    grads["U"] += dU.transpose(1, 0, 2).reshape(HIDDEN, -1)
    dx = dx.reshape(3, T * B, HIDDEN)
    order = np.argsort(places.ravel().astype("u2"), kind="stable")
    first = np.searchsorted(places.ravel()[order], np.arange(len(used)))
    embedded, ones = params["E"].take(inputs.ravel(), axis=0).T, np.ones(T * B, "f4")
    dE = np.zeros((T * B, EMBEDDING), "f4")
    for k in range(3):
        gate = slice(k * HIDDEN, (k + 1) * HIDDEN)
        dE += dx[k] @ params["W"][:, gate].T
        grads["W"][:, gate] += embedded @ dx[k]
        grads["b"][gate] += ones @ dx[k]
    grads["E"][used] += np.add.reduceat(dE.take(order, axis=0), first, axis=0)
    return -float(logp.sum()), len(valid), grads, h


class Trainer:
    """Adam over all parameters, which are parts of one array."""

    def __init__(self, params: Params):
        self.all = flat(params)
        self.params = views(self.all, params)
        self.gradient, self.m, self.v, self.spare = np.zeros((4, len(self.all)), "f4")
        self.grads = views(self.gradient, params)
        self.steps = self.tokens = 0

    def update(self, n: int) -> None:
        """One step along the mean gradient of ``n`` symbols, which is zero afterwards."""
        self.steps += 1
        share, rate = np.float32(1 / max(n, 1)), np.float32(RATE / (1 - 0.9**self.steps))
        root = np.float32((1 - 0.999**self.steps) ** -0.5)
        for at in range(0, len(self.all), UPDATED):
            part = slice(at, at + UPDATED)
            g, m, v, spare = self.gradient[part], self.m[part], self.v[part], self.spare[part]
            g *= share
            v *= np.float32(0.999)
            np.multiply(g, g, out=spare)
            spare *= np.float32(0.001)
            v += spare
            m *= np.float32(0.9)
            g *= np.float32(0.1)
            m += g
            np.sqrt(v, out=spare)
            spare *= root
            spare += np.float32(1e-8)
            np.divide(m, spare, out=spare)
            spare *= rate
            self.all[part] -= spare
            g[:] = 0

    def learn_all(self, stretches: Iterator[np.ndarray]) -> None:
        """Learn from stretches of about one length together, the rest at the end."""
        waiting: dict[int, list[np.ndarray]] = {}
        for ids in stretches:
            same = waiting.setdefault((len(ids) - 2) // WINDOW, [])
            same.append(ids)
            if len(same) == BATCH:
                self.learn(waiting.pop((len(ids) - 2) // WINDOW))
        rest = [ids for k in sorted(waiting) for ids in waiting[k]]
        for at in range(0, len(rest), BATCH):
            self.learn(rest[at : at + BATCH])

    def learn(self, texts: list[np.ndarray]) -> None:
        """Truncated backpropagation over stretches side by side. A stretch is the symbol before it
        and its own."""
        texts = sorted(texts, key=len, reverse=True)
        lengths = np.array([len(ids) - 1 for ids in texts])
        inputs = np.full((lengths[0], len(texts)), END, "i8")
        targets = np.full((lengths[0], len(texts)), -1, "i8")
        for i, ids in enumerate(texts):
            targets[: lengths[i], i] = ids[1:]
            inputs[: lengths[i], i] = ids[:-1]
        h = np.zeros((len(texts), HIDDEN), "f4")
        for at in range(0, lengths[0], WINDOW):
            active = int(np.searchsorted(-lengths, -at))
            part = slice(at, at + WINDOW), slice(active)
            _, n, _, h = window_gradients(self.params, inputs[part], targets[part], h[:active], self.grads)
            self.update(n)
            self.tokens += n


def log_probabilities(params: Params, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probabilities of whole symbol sequences, in windows with the state carried.
    Windows are longer where few texts go on."""
    total = np.zeros(len(texts))
    table, U = gates(params["E"] @ params["W"] + params["b"]), gates(params["U"])
    sizes = np.array([len(x) for x in texts], "i8")
    by_length = np.argsort(-sizes, kind="stable")
    for first in range(0, len(texts), SCORE_BATCH):
        which = by_length[first : first + SCORE_BATCH]
        lengths = sizes[which]
        symbols = np.concatenate([texts[i] for i in which])
        starts = np.cumsum(lengths) - lengths
        h, last = np.zeros((len(which), HIDDEN), "f4"), np.full(len(which), END)
        at = 0
        while at < lengths[0]:
            active = int(np.searchsorted(-lengths, -at))
            end = min(at + max(WINDOW, SCORE_BATCH * WINDOW // active), int(lengths[0]))
            states, targets, rows = [], [], np.searchsorted(-lengths, -np.arange(at, end))
            for t, n in zip(range(at, end), rows):
                h = gated(table.take(last[:n], axis=1), h[:n], U)[0]
                last = symbols[starts[:n] + t]
                states.append(h)
                targets.append(last)
            logp = outputs(np.concatenate(states), np.concatenate(targets), params)
            who = np.arange(len(logp)) - np.repeat(np.cumsum(rows) - rows, rows)
            total[which[:active]] += np.bincount(who, logp, active)
            at = end
    return total


# The corpus.


class Known:
    """Counts and symbols of the frequent words, found by the first bits of their hash."""

    BITS = 20

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        by_count = np.lexsort((hashes, -counts))[:VOCABULARY]
        symbols = np.full(len(hashes), OTHER, "u2")
        symbols[by_count] = np.arange(len(by_count)) + 2
        order = np.argsort(hashes.view("u8"))
        self.hashes, self.counts, self.symbols = hashes[order], counts[order], symbols[order]
        self.first = np.searchsorted(self.slots(self.hashes), np.arange((1 << self.BITS) + 1))
        self.first = self.first.astype("i4")

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes.view("u8") >> np.uint64(64 - self.BITS)).view("i8")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash stands, -1 if it does not."""
        slots = self.slots(hashes)
        at, end = self.first[slots], self.first[slots + 1]
        found = np.full(len(hashes), -1, "i4")
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            same = self.hashes[here] == hashes[left]
            found[left[same]] = here[same]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return found

    def found(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the hashes of its words and where these stand, -1 if they do not."""
        for hashes, codes, starts in hashed(texts):
            at, own = self.find(hashes)[codes], hashes[codes]
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                yield own[a:b], at[a:b]

    def symbols_of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The symbols of each text. Binary values are symbols already."""
        if pa.types.is_binary(texts.type):
            yield from (np.frombuffer(t.as_buffer(), "<u2") for t in texts)
        else:
            yield from (self.symbol_ids(at) for _, at in self.found(texts))

    def symbol_ids(self, at: np.ndarray) -> np.ndarray:
        """The symbols of a text's words, found at ``at``, and of its end."""
        ids = np.full(len(at) + 1, OTHER, "u2")
        known = at >= 0
        ids[:-1][known] = self.symbols[at[known]]
        ids[-1] = END
        return ids


def count_words(train: DataFrame) -> DataFrame:
    """(hash, c) of all words of the training texts; combined in each task before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, codes, _ in hashed(batch.column(0)):
                n = np.bincount(codes, minlength=len(hashes))
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[used]), pa.array(n[used])], ["hash", "c"])

    rows = train.select("text").mapInArrow(counted, "hash long, c long")
    return rows.groupBy("hash").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The words from the smallest count on at which there are at most ``most``."""
    # Counts by their power of two, finer where the limit falls.
    level = F.floor(F.log2(F.col("c").cast("double")) * 8)
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["level"]):
        if total + r.n > most:
            break
        total, least = total + r.n, r["level"]
    if least is None:
        return np.empty(0, "i8"), np.empty(0, "i8")
    rows = counts.filter(level >= int(least)).toArrow()
    return rows.column("hash").to_numpy(), rows.column("c").to_numpy()


def in_round(r: int, rounds: int) -> Column:
    """Whether a row is learned from in round ``r``: one hash, so each row is in one round."""
    return F.pmod(F.xxhash64("seed"), F.lit(rounds)) == r


def cut(ids: np.ndarray) -> list[np.ndarray]:
    """The consecutive stretches of a text's symbols, each after the symbol before it."""
    ids = np.concatenate([np.array([END], ids.dtype), ids])
    return [ids[at : at + STRETCH + 1] for at in range(0, len(ids) - 1, STRETCH)]


MEAN = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("tokens", pa.int64()), ("numbers", pa.binary())])
MEAN_DDL = "shard int, block int, tokens long, numbers binary"


def mean_block(rows: pa.Table) -> pa.Table:
    """One row: the mean of a block of parameters, by tokens. Summed in the order of the numbers, so
    that reruns agree."""
    order = sorted(rows.to_pylist(), key=lambda x: (x["tokens"], x["numbers"]))
    tokens = sum(x["tokens"] for x in order)
    mean = sum(np.frombuffer(x["numbers"], "f4") * (x["tokens"] / tokens) for x in order)
    first = order[0]
    return pa.Table.from_pylist(
        [{**first, "tokens": tokens, "numbers": mean.astype("f4").tobytes()}], schema=MEAN
    )


def train_model(
    train: DataFrame, known: Known, counts: np.ndarray, replicas: int, rounds: int
) -> tuple[Params, int]:
    """``rounds`` rounds of replicas, averaged by the symbols they learned from, and the number of
    symbols learned from in all rounds. ``train`` has texts or, as binary, their symbols. ``counts`` are those of the symbols in ``train``; there are
    ``replicas`` replicas, or more if that would be over ``REPLICA_SYMBOLS`` for each. One parameter
    set (about 2.7 MB) comes to the driver in a round."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(known)
    replicas = max(replicas, math.ceil(float(counts.sum()) / rounds / REPLICA_SYMBOLS))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out, seeds = [], []
                for symbols in shared.value.symbols_of(batch.column(0).slice(at, 500)):
                    seed = xxh3_64_intdigest(symbols.tobytes())
                    for i, ids in enumerate(cut(symbols)):
                        out.append(ids.astype("<u2").tobytes())
                        seeds.append(xxh3_64_intdigest(i.to_bytes(8, "little"), seed) >> 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seeds, pa.int64()), pa.array(out, pa.binary())], ["seed", "ids"]
                )

    data = stored(train.mapInArrow(stretches, "seed long, ids binary"), "stretches")
    params, learned = first_params(counts), 0
    shards = math.isqrt(replicas)
    for r in range(rounds):
        begin = spark.sparkContext.broadcast(dump(params))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer, part = Trainer(load(begin.value)), 0

            def rows() -> Iterator[np.ndarray]:
                nonlocal part
                for batch in batches:
                    part = batch.column(1)[0].as_py()
                    for ids in batch.column(0):
                        yield np.frombuffer(ids.as_buffer(), "<u2").astype("i8")

            trainer.learn_all(rows())
            for k, at in enumerate(range(0, len(trainer.all), BLOCK)):
                if trainer.tokens:
                    numbers = trainer.all[at : at + BLOCK].tobytes()
                    row = [part % shards], [k], [trainer.tokens], [numbers]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(row, MEAN.types)], MEAN.names
                    )

        # Copies of one stretch are spread too: the part comes from the seed and the row's task.
        part = F.pmod(F.xxhash64("seed", F.spark_partition_id()), F.lit(replicas)).cast("int")
        found = (
            data.filter(in_round(r, rounds))
            .withColumn("part", part)
            .repartitionById(replicas, F.col("part"))
            .sortWithinPartitions("seed")
            .select("ids", "part")
            .mapInArrow(learn, MEAN_DDL)
            .groupBy("block", "shard")
            .applyInArrow(mean_block, MEAN_DDL)
            .groupBy("block")
            .applyInArrow(mean_block, MEAN_DDL)
            .collect()
        )
        if found:
            learned += found[0].tokens
            blocks = [x.numbers for x in sorted(found, key=lambda x: x.block)]
            params = views(np.frombuffer(b"".join(blocks), "f4"), params)
    return params, learned


#: What is known of a document before the network is: its symbols, the share of ``score`` that other
#: words cost, and the hashes of the words beyond the broadcast ones.
CODED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
    "extra double, symbols binary, rare array<long>"
)


def scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent: int = FREQUENT,
    replicas: int = REPLICAS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    A text's tokens are its words and one end; null and empty texts are an end alone. Rows whose
    crc32 of the id is 1 modulo 5 are held out, all others (null ids too) are learned from. Words
    never seen in training count 0. ``score`` is the model's log10 probability of the whole text.
    Without training rows both models know nothing and give every token the same share.
    """
    spark: SparkSession = docs.sparkSession
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        (crc_fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"),
    )
    train = source.filter(~F.col("held_out"))
    counts = stored(count_words(train), "counts")
    ends = train.count()
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, distinct = size.n + ends, size.v + (ends > 0)
    known = Known(*frequent_words(counts, frequent))
    by_symbol = np.zeros(SYMBOLS, "f8")
    inside = known.symbols != OTHER
    by_symbol[known.symbols[inside]] = known.counts[inside]
    by_symbol[END] = ends
    other = size.n - by_symbol[2:].sum()
    by_symbol[OTHER] = other
    norm = float(np.log10(n_train + 0.5 * (distinct + 1)))
    other_norm = float(np.log10(other + 0.5 * (size.v - inside.sum() + 1)))
    end_score, end_known = float(np.log10(ends + 0.5)), int(ends > 0)
    shared = spark.sparkContext.broadcast(known)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        logs = np.log10(known.counts + 0.5)
        for batch in batches:
            n, found_n, base, extra, rare, symbols = [], [], [], [], [], []
            for hashes, at in known.found(batch.column("text")):
                left = hashes[at < 0]
                symbols.append(known.symbol_ids(at).astype("<u2").tobytes())
                at = at[at >= 0]
                own = logs[at]
                outside = known.symbols[at] == OTHER
                n.append(len(hashes) + 1)
                found_n.append(len(own) + end_known)
                base.append(own.sum() + end_score - norm * (len(hashes) + 1))
                extra.append(own[outside].sum() - other_norm * (outside.sum() + len(left)))
                rare.append(left)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rare])]).astype("i4")
            values = np.concatenate([np.empty(0, "i8"), *rare])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(n, pa.int64()),
                    pa.array(found_n, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(extra, pa.float64()),
                    pa.array(symbols, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                ],
                [c.split()[0] for c in CODED.split(", ")],
            )

    # Each text is cut, looked up and coded once, for training and scoring.
    rows = source.withColumn("row", F.monotonically_increasing_id())
    coded = stored(rows.mapInArrow(code, CODED), "coded")
    train = coded.filter(~F.col("held_out")).select("symbols")
    trained = spark.sparkContext.broadcast(dump(train_model(train, known, by_symbol, replicas, rounds)[0]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = load(trained.value)
        for batch in batches:
            texts = [np.frombuffer(t.as_buffer(), "<u2") for t in batch.column("symbols")]
            model = log_probabilities(params, texts) / np.log(10) + batch.column("extra").to_numpy()
            scored = batch.select(["row", "doc_id", "held_out", "n_tokens", "n_known", "base"])
            yield scored.append_column("score", pa.array(model, pa.float64()))

    kinds = CODED.split("extra")[0] + "score double"
    part = stored(coded.drop("rare").mapInArrow(score, kinds), "scores")
    rare = coded.select("row", F.explode("rare").alias("hash"))
    rare = rare.groupBy("row", "hash").agg(F.count(F.lit(1)).alias("times"))
    found = rare.join(counts, "hash", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("_log"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("_known"),
    )
    more = F.coalesce("_log", F.lit(0.0))
    return part.join(found, "row", "left").select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
