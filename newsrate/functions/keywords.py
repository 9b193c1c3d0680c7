"""Large keyword lists: an Aho-Corasick automaton in place of one pattern.

Same hits as ``whole_word_pattern``: case is ignored by simple folding, a hit is a whole word or several,
the leftmost hit counts, and among those that start there the first listed. (Patterns overlook letters
beyond U+FFFF before a hit; here they are word characters too.) The time is that of reading
the text, whatever the number of keywords. The list travels with the function (Spark broadcasts it when
it is large), each worker builds the automaton once.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # then only lists within one pattern can be matched
    ahocorasick = None

#: Lists up to this length are matched by one pattern, inside generated code.
PATTERN_WORDS = 256


def fold_char(c: str) -> str:
    """Simple case folding as patterns do it: to upper case, then to lower, one character each."""
    upper = c.upper()
    upper = upper if len(upper) == 1 else c
    return upper.lower()[0]


@cache
def _fold_table() -> dict[int, str]:
    return {i: f for i in range(sys.maxunicode + 1) if (f := fold_char(chr(i))) != chr(i)}


def fold(text: str) -> str:
    """Case folded; as many characters as before."""
    return text.lower() if text.isascii() else text.translate(_fold_table())


@cache
def lower_differs() -> tuple[str, str]:
    """The characters whose folding is not their lower case, and what they fold to."""
    odd = [i for i in range(sys.maxunicode + 1) if fold_char(chr(i)) != chr(i).lower()]
    lowered = {chr(i).lower()[0]: fold_char(chr(i)) for i in odd}
    lowered = {a: b for a, b in lowered.items() if a != b}
    return "".join(lowered), "".join(lowered.values())


def folded(col: Column) -> Column:
    """The same folding as an expression."""
    return F.translate(F.lower(col), *lower_differs())


@lru_cache(maxsize=1 << 16)
def is_word_char(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


class Matcher:
    """Finds the first of ``words`` in a text."""

    def __init__(self, words: tuple[str, ...]):
        if ahocorasick is None:
            raise ImportError("lists beyond one pattern need pyahocorasick")
        self.sizes = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(words):
            key = fold(word)
            self.sizes.append(len(key))
            if key and not self.automaton.exists(key):
                self.automaton.add_word(key, i)
        self.longest = max(self.sizes, default=0)
        if len(self.automaton):
            self.automaton.make_automaton()

    def first(self, text: str | None) -> str | None:
        """The text of the first hit; ``''`` without one, None for a null text."""
        if text is None or not text or not len(self.automaton):
            return text and ""
        low = fold(text)
        best = None
        for end, i in self.automaton.iter(low):
            start = end + 1 - self.sizes[i]
            if best is not None and end + 1 - self.longest > best[0]:
                break
            if best is not None and (start, i) > best:
                continue
            before = start and is_word_char(text[start - 1])
            after = end + 1 < len(text) and is_word_char(text[end + 1])
            if not before and not after:
                best = start, i
        return "" if best is None else text[best[0] : best[0] + self.sizes[best[1]]]


@lru_cache(maxsize=8)
def matcher(words: tuple[str, ...]) -> Matcher:
    """One automaton per worker and list."""
    return Matcher(words)


def first_listed(col: Column, words) -> Column:
    """As ``first_keyword``, for lists of any length."""
    words = tuple(dict.fromkeys(w for w in words if w))

    @F.arrow_udf("string")
    def found(texts: pa.Array) -> pa.Array:
        first = matcher(words).first
        return pa.array(map(first, texts.to_pylist()), pa.string())

    return found(col)


def listed_pair(col: Column, lexicon: dict[str, str]) -> Column:
    """As ``text_pair``, for lexicons of any length."""
    words = tuple(dict.fromkeys(w for w in lexicon if w))

    @F.arrow_udf("string")
    def found(texts: pa.Array) -> pa.Array:
        first, pairs = matcher(words).first, {**lexicon, "": ""}
        hits = map(first, texts.to_pylist())
        return pa.array([h if h is None else pairs.get(h.lower()) for h in hits], pa.string())

    return found(col)
