"""Text expressions: matching, repair, cleaning, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsrate.functions.binding import let
from newsrate.functions.keywords import PATTERN_WORDS, first_listed, listed_pair
from newsrate.lexicon import DEFAULT_LEXICON
from newsrate.schemas import TIME_FORMAT

# Letters, digits and the underscore, in every script (so CJK characters are word characters).
WORD = r"[\p{L}\p{N}_]"
_PLAIN = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")

# Characters that count as white space at the ends of a line.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# How a reply starts in the page text, and the notice of an empty search.
REPLY_START = "回复 \n@"
NO_RESULT_PHRASE = "你输入的词没有找到任何结果"

# A token is one Han character or one run of other word characters.
HAN = r"\p{IsHan}"
TOKEN_PATTERN = rf"{HAN}|[\p{{L}}\p{{N}}_&&[^{HAN}]]+"
# Plain code point ranges around the Han blocks: testing the script of every letter is slow.
HAN_RANGES = r"[\u2e80-\ufad9\x{16fe2}-\x{3ffff}]"


def _quote(word: str) -> str:
    return "".join(c if c in _PLAIN or ord(c) > 127 else "\\" + c for c in word)


def whole_word_pattern(words) -> str:
    """A Java pattern that finds any of ``words`` as a whole word, ignoring case; group 1."""
    words = [w for w in dict.fromkeys(words) if w]
    if not words:
        raise ValueError("no words to match")
    return f"(?iu)(?<!{WORD})({'|'.join(map(_quote, words))})(?!{WORD})"


def first_keyword(col: Column, words=tuple(DEFAULT_LEXICON)) -> Column:
    """Leftmost whole-word, case-insensitive hit of any word, else ``''``. Long lists go through an
    automaton."""
    if len(words) > PATTERN_WORDS:
        return first_listed(col, words)
    return F.regexp_extract(col, whole_word_pattern(words), 1)


def _pair_map(lexicon: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in lexicon.items() for x in kv])


def keyword_to_pair(col: Column, lexicon: dict[str, str] = DEFAULT_LEXICON) -> Column:
    """Keyword -> pair, case folded; NULL when the keyword is unknown."""
    return F.element_at(_pair_map(lexicon), F.lower(col))


def text_pair(col: Column, lexicon: dict[str, str] = DEFAULT_LEXICON) -> Column:
    """Pair of the first keyword: ``''`` without a keyword, NULL when the hit has no pair."""
    if len(lexicon) > PATTERN_WORDS:
        return listed_pair(col, lexicon)
    return keyword_to_pair(first_keyword(col, tuple(lexicon)), {"": "", **lexicon})


def trade_pair(
    title: Column,
    description: Column,
    lexicon: dict[str, str] = DEFAULT_LEXICON,
    mode: str = "intended",
) -> Column:
    """Pair found in the title, else in the description, else ``''``.

    ``compat`` falls back only when the title's hit has no pair, not when there is no hit.
    """
    if mode == "compat":
        return F.coalesce(text_pair(title, lexicon), text_pair(description, lexicon), F.lit(""))
    if len(lexicon) > PATTERN_WORDS:
        found = [F.nullif(text_pair(c, lexicon), F.lit("")) for c in (title, description)]
        return F.coalesce(*found, F.lit(""))
    words_ = tuple(lexicon)
    return F.coalesce(
        keyword_to_pair(first_keyword(title, words_), lexicon),
        keyword_to_pair(first_keyword(description, words_), lexicon),
        F.lit(""),
    )


def pair_symbol(col: Column) -> Column:
    return F.replace(col, F.lit("/"), F.lit(""))


def keyword_match(col: Column, terms, mode: str = "intended") -> Column:
    """True when any term occurs as a whole word. In ``compat`` an empty term matches every
    text that has at least one word character."""
    if mode == "compat" and "" in terms:
        return col.rlike(WORD)
    if len(terms) > PATTERN_WORDS:
        return first_listed(col, terms) != ""
    return col.rlike(whole_word_pattern(terms))


def sanitize(col: Column) -> Column:
    """Comma -> space, double quotes removed."""
    return F.replace(F.replace(col, F.lit(","), F.lit(" ")), F.lit('"'), F.lit(""))


def strip_line(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def split_fields(col: Column, strip: bool = False) -> Column:
    """Comma fields of a line; trailing empty fields are kept."""
    return F.split(strip_line(col) if strip else col, ",")


def _middle(fields: Column, head: int, tail: int, sep: str, width: int) -> Column:
    n = F.size(fields)
    surplus = F.slice(fields, F.lit(head + 1), n - head - tail)
    return F.when(n > width, F.array_join(surplus, sep)).when(
        n == width, F.get(fields, F.lit(head))
    )


def middle_text(
    col: Column, head: int = 3, tail: int = 4, sep: str = " ", width: int | None = None
) -> Column:
    """The free-text field of a line whose text may itself hold commas; NULL if too short."""
    size = head + 1 + tail if width is None else width
    return let(split_fields(col), lambda f: _middle(f, head, tail, sep, size))


def repair_row(col: Column, head: int = 3, tail: int = 4, sep: str = " ") -> Column:
    """Join the surplus middle fields of a ragged line into one field.

    A line of exactly ``head + 1 + tail`` fields is unchanged, a shorter one gives NULL.
    """
    width = head + 1 + tail

    def joined(f: Column) -> Column:
        n = F.size(f)
        line = F.concat_ws(
            ",",
            F.slice(f, F.lit(1), F.lit(head)),
            _middle(f, head, tail, sep, width),
            F.slice(f, n - tail + 1, F.lit(tail)),
        )
        return F.when(n >= width, line)

    return let(split_fields(col), joined)


def to_line(*cols: Column) -> Column:
    """Fields joined with commas; NULL counts as empty."""
    return F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def trunc_int(col: Column) -> Column:
    """Number text -> integer, truncated toward zero; empty -> 0; unparsable -> NULL."""
    number = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    value = F.when(col.rlike(number), col.try_cast("double")).try_cast("int")
    return F.when(col == "", F.lit(0)).otherwise(value)


def epoch_to_text(col: Column) -> Column:
    """Epoch seconds (number or text) -> ``yyyy-MM-dd HH:mm:ss`` in the session zone."""
    return F.from_unixtime(col.try_cast("bigint"), TIME_FORMAT)


def event_window_ms(col: Column, seconds: int = 1200) -> Column:
    """Time text -> struct(start_ms, end_ms) of the window that starts there."""
    start = F.unix_seconds(F.try_to_timestamp(col, F.lit(TIME_FORMAT))) * F.lit(1000)
    return F.struct(start.alias("start_ms"), (start + F.lit(seconds * 1000)).alias("end_ms"))


def user_from_url(col: Column, host: str = "twitter.com") -> Column:
    """Path part after ``host/``; NULL when the host does not occur."""
    return F.nullif(F.regexp_extract(col, f"(?<={_quote(host)}/)[^/]+", 0), F.lit(""))


def url_host(col: Column) -> Column:
    return F.nullif(F.regexp_extract(col, r"^[a-z]+://([^/?#]+)", 1), F.lit(""))


def id_from_href(col: Column) -> Column:
    """Trailing digits of a link; ``''`` when there are none."""
    return F.regexp_extract(col, "[0-9]+$", 0)


def reply_body(first: Column, second: Column, start: str = REPLY_START) -> Column:
    """A reply shows its own text in the second block."""
    return F.when(first.startswith(start), second).otherwise(first)


def iso_plain(col: Column) -> Column:
    """``2024-01-01T00:00:00.000Z`` -> ``2024-01-01 00:00:00``."""
    return F.replace(F.replace(col, F.lit("T"), F.lit(" ")), F.lit(".000Z"), F.lit(""))


def words(col: Column) -> Column:
    """Lower-cased whole words, as the keyword match sees them."""
    return F.regexp_extract_all(F.lower(col), F.lit(f"{WORD}+"), F.lit(0))


def tokens(col: Column) -> Column:
    """Lower-cased tokens. Same result as ``TOKEN_PATTERN``, but texts without Han characters
    (all ASCII ones at once) skip the search for them."""
    may_have_han = (F.octet_length(col) > F.length(col)) & col.rlike(HAN_RANGES)
    spaced = F.when(may_have_han, F.regexp_replace(col, f"({HAN})", " $1 ")).otherwise(col)
    return words(spaced)
