import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from newsrate.functions import text
from newsrate.lexicon import DEFAULT_LEXICON, FILTER_TERMS, KEYWORDS
from pyspark.sql import functions as F

PROBES = [
    "买eth币", "BTC 比特币 up", "ETH/usdt", "ethereum", "_eth", "eth2", "x²eth", "、eth。", "neo eth",
    "daſh x", "eth‿x", "", "fıl", "eth́", "Bitcoin's eth", "a.eth-b", "LINK", "étc etc", "eth\nneo",
    "比特币eth", "İota iota",
]


def by_python(s: str) -> str:
    hit = re.search("|".join(rf"\b{w}\b" for w in KEYWORDS), s, re.IGNORECASE)
    return hit.group(0) if hit else ""


def test_lexicon():
    assert len(KEYWORDS) == len(set(KEYWORDS)) == len(DEFAULT_LEXICON) == 36
    assert len(set(DEFAULT_LEXICON.values())) == 35
    assert DEFAULT_LEXICON["bitcoin"] == DEFAULT_LEXICON["比特币"] == "BTC/USDT"
    assert len(FILTER_TERMS) == 24


def test_first_keyword_probes(column):
    assert column(text.first_keyword, PROBES) == [by_python(s) for s in PROBES]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ethneoETH _-,.买币ſ²1\n", max_size=12), min_size=40, max_size=80))
def test_first_keyword_equals_python(column, values):
    assert column(text.first_keyword, values) == [by_python(s) for s in values]


def pair_by_python(s: str):
    hit = by_python(s)
    return DEFAULT_LEXICON.get(hit.lower()) if hit else ""


def test_text_pair_probes(column):
    assert column(text.text_pair, PROBES) == [pair_by_python(s) for s in PROBES]
    # The Kelvin sign lower-cases to k; the ligature fi is no hit; a sharp s ends no word.
    odd = ["\u212anc", "K KNC", "ﬁl", "ETHß eth", "x\u0130ota iota"]
    assert column(text.text_pair, odd) == [pair_by_python(s) for s in odd]
    assert column(text.text_pair, [None]) == [None]


def test_any_keyword(column):
    greek = {"\u03bf\u03b4\u03bf\u03c3": "X/USDT", "two words": "Y/USDT"}
    values = ["\u039f\u0394\u039f\u03a3", "a Two words b", "two  words"]
    assert column(lambda c: text.text_pair(c, greek), values)[1:] == ["Y/USDT", ""]
    assert column(lambda c: text.first_keyword(c, tuple(greek)), values)[0] == values[0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.lists(
            st.one_of(
                st.sampled_from([*KEYWORDS, "ETH", "Fil", "fıl", "DAſH", "LİNK", "Knc", "ﬁl", "É"]),
                st.sampled_from(list(" .,-_2²\u0301买\n'")),
                st.characters(max_codepoint=0x250, exclude_categories=["Cs"]),
            ),
            max_size=8,
        ).map("".join),
        min_size=60,
        max_size=100,
    )
)
def test_text_pair_equals_python(column, values):
    assert column(text.text_pair, values) == [pair_by_python(s) for s in values]


def test_keyword_to_pair(column):
    assert column(text.keyword_to_pair, ["ETH", "比特币", "daſh", "", None]) == [
        "ETH/USDT", "BTC/USDT", None, None, None,
    ]


def test_trade_pair_modes(spark):
    rows = [
        ("eth up", "neo", "ETH/USDT", "ETH/USDT"),
        ("nothing", "neo", "NEO/USDT", ""),
        ("daſh", "neo", "NEO/USDT", "NEO/USDT"),
        ("daſh", "", "", ""),
        ("", "", "", ""),
    ]
    df = spark.createDataFrame(rows, "t string, d string, intended string, compat string")
    for mode in ("intended", "compat"):
        got = df.select(text.trade_pair(F.col("t"), F.col("d"), mode=mode), mode).collect()
        assert [r[0] for r in got] == [r[1] for r in got]


def test_keyword_match_modes(column):
    values = ["", "!!", "hello", "Crypto!", "cryptos"]
    assert column(lambda c: text.keyword_match(c, FILTER_TERMS), values) == [
        False, False, False, True, False,
    ]
    assert column(lambda c: text.keyword_match(c, FILTER_TERMS, "compat"), values) == [
        False, False, True, True, True,
    ]


def test_repair_row(column):
    values = [
        "a,b,c,d,e,f,g",
        "a,b,c,d,e,f,g,h",
        "a,b,c,d,e,f,g,h,i",
        "a,b,c,d,,x,1,2,,",
        "a,b,c,,e,f,g,h",
        None,
    ]
    assert column(text.repair_row, values) == [
        None,
        "a,b,c,d,e,f,g,h",
        "a,b,c,d e,f,g,h,i",
        "a,b,c,d  x,1,2,,",
        "a,b,c,,e,f,g,h",
        None,
    ]


def test_repair_row_twelve(column):
    line = ",".join("abcdefghijklmn")
    assert column(lambda c: text.repair_row(c, tail=8), [line]) == ["a,b,c,d e f,g,h,i,j,k,l,m,n"]
    assert column(lambda c: text.middle_text(c, tail=8, sep=","), [line]) == ["d,e,f"]
    nine = "a,b,c,d,e,f,g,h,i"
    assert column(lambda c: text.middle_text(c, tail=4, sep=",", width=8), [nine]) == ["d,e"]
    assert column(lambda c: text.middle_text(c, tail=5, sep=",", width=8), [nine]) == ["d"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["", "x", " y "]), min_size=1, max_size=14), min_size=20))
def test_repair_properties(column, lines):
    values = [",".join(f) for f in lines]
    repaired = column(text.repair_row, values)
    for before, after in zip(values, repaired):
        assert (after is None) == (before.count(",") < 7)
        assert after is None or after.count(",") == 7
    assert column(text.repair_row, repaired) == repaired


def test_split_and_strip(column):
    assert column(text.split_fields, ["a,,b,,"]) == [["a", "", "b", "", ""]]
    values = [" 　a,b\x1f ", "a b", "\xa0"]
    assert column(text.strip_line, values) == [v.strip() for v in values]


def test_trunc_int(column):
    values = ["", "1.9", "-1.9", "x", "1e2", "nan", "inf", "1.0d", " 2 ", ".5", "1e20", None]
    assert column(text.trunc_int, values) == [
        0, 1, -1, None, 100, None, None, None, 2, 0, None, None,
    ]


def test_times(column):
    assert column(text.epoch_to_text, ["0", "1704067200", "x"]) == [
        "1970-01-01 00:00:00", "2024-01-01 00:00:00", None,
    ]
    window = column(text.event_window_ms, ["2024-01-01 00:00:00", "bad"])
    assert tuple(window[0]) == (1704067200000, 1704068400000)
    assert tuple(window[1]) == (None, None)
    assert column(text.iso_plain, ["2024-01-01T00:00:00.000Z"]) == ["2024-01-01 00:00:00"]


def test_links(column):
    url = "https://twitter.com/someone/status/12"
    assert column(text.user_from_url, [url, "https://x.org/a"]) == ["someone", None]
    assert column(text.id_from_href, [url, "/a/12/b"]) == ["12", ""]


def test_sanitize_line_symbol(column):
    assert column(text.sanitize, ['a,"b",c']) == ["a b c"]
    assert column(text.pair_symbol, ["ETH/USDT"]) == ["ETHUSDT"]
    assert column(lambda c: text.to_line(c, F.lit(1), F.lit(None)), ["a"]) == ["a,1,"]


def test_reply_body(spark):
    rows = [("回复 \n@a", "own"), ("plain", "second"), ("回复 \n@a", None)]
    df = spark.createDataFrame(rows, "f string, s string")
    got = df.select(text.reply_body(F.col("f"), F.col("s"))).collect()
    assert [r[0] for r in got] == ["own", "plain", None]


def test_tokens(column):
    values = ["BTC回调 up-down ÉTÉ_1", "plain ASCII, ok", "", None, "für 々x"]
    pattern = column(
        lambda c: F.regexp_extract_all(F.lower(c), F.lit(text.TOKEN_PATTERN), F.lit(0)), values
    )
    assert column(text.tokens, values) == pattern
    assert pattern[0] == ["btc", "回", "调", "up", "down", "été_1"]
