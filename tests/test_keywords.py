"""The automaton finds what the pattern finds."""

import random

import pytest
from newsrate.functions import keywords, text
from newsrate.functions.keywords import Matcher, first_listed, folded, is_word_char, listed_pair
from newsrate.lexicon import DEFAULT_LEXICON, KEYWORDS
from pyspark.sql import functions as F
from test_text import PROBES

WORDS = ("new york", "new", "york city", "eth", "e.t", "ethereum classic", "classic", "dash", "ſ", "İx", "straße",
         "ΣΑΣ", "比特", "比特币", "c++", "-x", "x-", "kelvin", "a a", "a", "ﬁt", "ǆ", "ᾳ", "")
PIECES = [w for w in WORDS if w] + [w.upper() for w in WORDS] + [
    "K", "elvin", "daſh", "σας", "ΣΑς", " ", " ", "  ", "\n", ".", "_", "1", "é", "́", "ı", "i", "STRASSE", "ſ", "٣",
]


def both(spark, texts, words):
    pattern = F.regexp_extract("t", text.whole_word_pattern(words), 1)
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    rows = df.select("t", pattern.alias("p"), first_listed(F.col("t"), words).alias("a")).collect()
    return [(r.t, r.p, r.a) for r in rows]


def test_probes_and_default_words(spark):
    assert len(PROBES) >= 21
    for t, p, a in both(spark, PROBES + ["daſh eth", "eth daſh"], KEYWORDS):
        assert a == p, t


def test_random_texts_with_words_of_several_parts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    found = both(spark, texts, WORDS)
    assert [x for x in found if x[1] != x[2]] == []
    assert len({p for _, p, _ in found}) > 40


def test_pairs_equal_the_pattern(spark, column, monkeypatch):
    probes = PROBES + ["daſh eth", "x daſh", "DASH daſh"]
    wanted = column(text.text_pair, probes)
    assert column(lambda c: listed_pair(c, DEFAULT_LEXICON), probes) == wanted
    kept = column(lambda c: text.trade_pair(c, F.lit("neo up")), probes)
    matched = column(lambda c: text.keyword_match(c, KEYWORDS), probes)
    monkeypatch.setattr(text, "PATTERN_WORDS", 3)
    assert column(text.text_pair, probes) == wanted
    assert column(lambda c: text.trade_pair(c, F.lit("neo up")), probes) == kept
    assert column(lambda c: text.keyword_match(c, KEYWORDS), probes) == matched


def test_large_list():
    words = tuple(f"w{i} v{i}" for i in range(50_000)) + ("w7",)
    found = Matcher(words)
    assert found.first("x W7 V7, w9 v9") == "W7 V7" and found.first("w7 v8") == "w7"
    assert found.first("w7v7") == "" and found.first(None) is None and found.first("") == ""
    assert Matcher(()).first("a") == "" and found.first("w" * 100_000 + " w49999 v49999") == "w49999 v49999"


def test_folding_as_an_expression(spark):
    chars = [chr(i) for i in range(32, 0x2FFF) if chr(i).isalpha()]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    odd = {r.c for r in df.select("c", folded(F.col("c")).alias("f")).collect() if r.f != keywords.fold(r.c)}
    assert odd <= {"İ"}  # lower case of two characters
    assert is_word_char("_") and is_word_char("²") and not is_word_char("‿")


def test_missing_library(monkeypatch):
    monkeypatch.setattr(keywords, "ahocorasick", None)
    with pytest.raises(ImportError):
        Matcher(("a",))
