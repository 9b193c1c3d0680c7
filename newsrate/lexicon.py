"""Keyword lists. They are data: every operator takes them as an argument."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The default keywords, in match order.
KEYWORDS = (
    "bitcoin", "eth", "fil", "比特币", "link", "iost", "ada", "algo", "atom", "avax",
    "bal", "bch", "bnb", "comp", "dash", "doge", "eos", "etc", "iota", "knc", "ltc",
    "neo", "omg", "ont", "qtum", "sushi", "theta", "trx", "vet", "xlm", "xmr", "xrp",
    "xtz", "zec", "zil", "zrx",
)

# Keywords whose asset code is not the keyword itself, and the quote asset.
ASSET_CODES = {"bitcoin": "BTC", "比特币": "BTC"}
QUOTE_ASSET = "USDT"

# The default post filter; 13 of the 24 entries are empty.
FILTER_TERMS = (
    "coin", "bitcoin", "cryptocurrency", "virtual", "currency", "crypto", "doge",
    "eth", "usdt", "busd", "binance",
) + ("",) * 13


def pairs_for(keywords, asset_codes=ASSET_CODES, quote=QUOTE_ASSET) -> dict[str, str]:
    """Keyword -> trading pair, in keyword order."""
    return {k: f"{asset_codes.get(k, k.upper())}/{quote}" for k in keywords}


DEFAULT_LEXICON = pairs_for(KEYWORDS)


def lexicon_frame(spark: SparkSession, lexicon: dict[str, str] = DEFAULT_LEXICON) -> DataFrame:
    """The lexicon as a table (keyword, pair, ord)."""
    rows = [(k, p, i) for i, (k, p) in enumerate(lexicon.items())]
    return spark.createDataFrame(rows, "keyword string, pair string, ord int")
