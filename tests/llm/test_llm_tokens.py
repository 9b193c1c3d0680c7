"""Token counts and token files against the library itself."""

import gc
import subprocess
import sys
import weakref
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsrate.llm import token_counts as tc
from newsrate.llm import wavelet

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_LIBRARY, WORD_LIBRARY = tc.load_tokenizer(BYTE_BPE), tc.load_tokenizer(WORD_BPE)
TRICKY = [
    None, "", " ", "\n\n  \n", "a  b   c", "it's  'll don't", " lead", "trail  ", "x  y", "a 　b",
    "end<|endoftext|> of <|startoftext|>\n\nx", "é ́a", "ΣΣ Σ", "\r\n\tmixed \x0b\x0cspace",
    "\x1c a\x1f b", "日本語 текст 12345", "\U0001f600\U0001f600 a", "word " * 3000, "x" * 5000, "\x00 \x01",
]


@pytest.fixture(scope="module")
def table():
    return tc.frequent_lengths(BYTE_BPE)


def test_counts_equal_library(table):
    expected = [len(BYTE_LIBRARY.encode(t or "", add_special_tokens=False).ids) for t in TRICKY]
    assert tc.count_tokens(TRICKY, BYTE_BPE, table) == expected


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'st1 \n\t é́ <|>.!日"), max_size=30))
def test_any_text(text):
    expected = len(BYTE_LIBRARY.encode(text, add_special_tokens=False).ids)
    assert tc.count_tokens([text], BYTE_BPE, {}) == [expected]
    ids = np.frombuffer(wavelet.encode(text, WORD_BPE), "<u4").tolist()
    assert ids == WORD_LIBRARY.encode(text, add_special_tokens=False).ids


def test_each_part_is_looked_up_once():
    words = ["Haanth", "ouen", "thé", "naïve", "日本", "x1", "ß", "öÉ", "\x00a", "é́"]
    marks = ["", ".", ",", "!?", "·", "'s", "-Ab", "É."]
    texts = [f"{w}{m}  {w}{m}\n{m}{w}" for w in words for m in marks] + [None, "", " \t"]
    encoder = wavelet.Encoder(WORD_BPE)
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)]
        assert got == [WORD_LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder = wavelet.Encoder(WORD_BPE)
    list(encoder.block([w + m for w in ["haanth", "ouen", "thé"] for m in [".", ",", "!?", "'s"]]))
    assert set(encoder.parts) == {x.encode() for x in ["haanth", "ouen", "thé", ".", ",", "!?", "'s"]}
    assert list(encoder.block([])) == [] and list(encoder.block([None, ""])) == [b"", b""]


def test_cache_stays_bounded():
    cache = tc.BoundedCache(len, 2, {b"a": 7})
    assert [cache[k] for k in (b"a", b"bb", b"ccc", b"dddd", b"a")] == [7, 2, 3, 4, 7]
    assert len(cache) <= 3


def test_cache_takes_up_values_within_its_bound():
    cache = tc.BoundedCache(len, 3, {b"a": 7})
    cache.hold({b"bb": 2, b"ccc": 3})
    cache.hold({b"dddd": 4, b"eeeee": 5})
    assert dict(cache) == {b"a": 7, b"dddd": 4, b"eeeee": 5} and cache.older == {b"a": 7, b"bb": 2, b"ccc": 3}
    cache.hold({bytes([i]): i for i in range(9)})
    assert len(cache) == 4 and cache[b"a"] == 7


def test_a_block_cuts_each_word_once_and_encodes_new_parts_together(monkeypatch):
    cut, encoded = [], []
    kept, together = wavelet.cut_words, wavelet.Encoder.together
    monkeypatch.setattr(wavelet, "cut_words", lambda words: cut.append(len(words)) or kept(words))
    monkeypatch.setattr(wavelet.Encoder, "together", lambda self, p: encoded.append(sorted(p)) or together(self, p))
    monkeypatch.setattr(wavelet, "SIDE_BY_SIDE", 2)
    monkeypatch.setattr(wavelet, "AT_ONCE", 3)
    monkeypatch.setattr(wavelet, "CACHED_WORDS", 6)
    encoder = wavelet.Encoder(WORD_BPE)
    long = "x" * 70 + "é"
    blocks = [["ab thé, ab. naïve", "ab thé, x1 ß öÿ"], ["thé, ab. neu", None, long + " " + long], ["ab ß"], []]
    for texts in blocks:
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.block(texts)]
        assert got == [WORD_LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(encoder.parts) <= 6
    # ab, thé, | ab. naïve x1 ß öÿ
    assert cut[0] == 7
    assert encoded[0] == sorted(x.encode() for x in ["ab", "thé", ",", "", ".", "naïve", "x", "1", "ß", "öÿ"])
    assert len(encoded) == len(blocks)


def test_token_counts_frame(spark, column):
    rows = [(1, "a b", 0), (1, "a b", 0), (None, None, 1), (2, "x " * 2000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, tc.token_counts(docs, BYTE_BPE).collect()), key=str)
    assert got == sorted(
        [(1, 3, 2, False), (1, 3, 2, False), (None, 0, 0, False), (2, 4000, 2001, True)], key=str
    )
    assert tc.token_counts(docs.limit(0), BYTE_BPE).count() == 0


@pytest.mark.parametrize("n, top", [(1, 1), (511, 3), (512, 49408), (3000, 40), (2000, 70000)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype("<u4")
    data = wavelet.pack_shard(ids, [5, None], [n - 1, 1])
    matrix, doc_ids, lengths = wavelet.unpack_shard(data)
    assert matrix.ids().tolist() == ids.tolist()
    assert doc_ids == [5, None] and lengths.tolist() == [n - 1, 1]
    for i in range(0, n, max(1, n // 50)):
        v = int(ids[i])
        assert matrix.access(i) == v
        assert matrix.rank(v, i) == int((ids[:i] == v).sum())
        assert matrix.select(v, matrix.rank(v, i)) == i
    assert matrix.rank(1 << 20, n) == 0
    with pytest.raises(IndexError):
        matrix.select(int(ids[0]), n)
    with pytest.raises(IndexError):
        matrix.access(n)


def test_token_files(spark, scratch):
    rows = [(i, t, "clash") for i, t in enumerate(TRICKY)] + [(None, "null id", "")] * 2
    rows += [(3, "again", ""), (3, "again", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = scratch("tokens")
    wavelet.write_token_files(docs.repartition(5), path, WORD_BPE, shard_tokens=500)
    got = wavelet.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(
        (r[0] for r in rows), key=lambda d: -1 if d is None else d
    )
    texts = {}
    for d, t, _ in rows:
        ids = WORD_LIBRARY.encode(t or "", add_special_tokens=False).ids + [1]
        texts.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in got:
        assert r.start == at
        texts[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert spark.read.parquet(path).count() >= 3


def test_no_documents(spark, scratch):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = scratch("tokens")
    wavelet.write_token_files(docs, path, WORD_BPE)
    assert wavelet.read_token_files(spark, path).count() == 0


KEPT_BY_A_WORKER = """
import re
import sys
from newsrate.llm import wavelet

def used():
    return int(re.search(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10

encoder = wavelet.encoder(sys.argv[1])
text = " ".join(f"w{i * 7919 % 2000}x" for i in range(1200))
before = used()
tokens = sum(len(ids) // 4 for ids in encoder.encode_all(text for _ in range(3000)))
print(tokens > 3_000_000, used() - before)
"""


def test_encoders_are_freed_when_they_are_dropped():
    wavelet.encode("a cat", WORD_BPE)
    kept = weakref.ref(wavelet.encoder(WORD_BPE))
    gc.disable()
    try:
        wavelet.drop_encoders()
        assert kept() is None and not wavelet._ready
    finally:
        gc.enable()


def test_worker_keeps_little_of_the_blocks_it_encoded():
    """A worker stays for the stages after: 137 MB were kept of these 25 MB of text."""
    run = [sys.executable, "-c", KEPT_BY_A_WORKER, WORD_BPE]
    whole, kept = subprocess.run(run, capture_output=True, text=True, check=True).stdout.split()
    assert whole == "True" and int(kept) < 70
