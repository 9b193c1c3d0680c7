"""Licence scans by template markup.

A template is the wording of a licence text with optional regions ``[[ ... ]]`` and replaceable
regions ``{{n}}`` (up to n words of any kind). It is compiled into an automaton over words:
mandatory words are steps, an optional region can be skipped, a replaceable one loops over any
words up to its length. A text is accepted where all mandatory words stand exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a lower-cased text: all but ASCII characters that are neither letters nor digits.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases that give a label by themselves.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Wording of licence notices, in markup.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
     "software and associated documentation files {{8}} to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license [[version 2 0]] {{6}} you may not use this file "
     "except in compliance with the license"),
    ("apache-2", "[[licensed]] under the apache license [[version]] 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with "
     "or without fee is hereby granted"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms "
     "of the gnu general public license as published by the free software foundation"),
    ("gpl", "under the [[terms of the]] gnu general public license {{4}} version"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "creative commons attribution noncommercial [[{{2}}]] license"),
    ("cc-by", "licensed under [[a]] [[the]] creative commons attribution [[4 0]] [[international]] license"),
    ("cc0", "to the extent possible under law {{6}} has waived all copyright"),
    ("all-rights-reserved", "all rights reserved"),
)

MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)\}\}|[0-9a-z]+")


@dataclass
class Automaton:
    """States 0..final; steps by word; ``free`` states also loop over any word, a bounded number
    of times, as that many states; ``skips`` lead on without a word."""

    label: str
    steps: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    free: dict[int, int] = field(default_factory=dict)
    skips: dict[int, set[int]] = field(default_factory=dict)

    def _new(self) -> int:
        self.steps.append({})
        return len(self.steps) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skips.get(todo.pop(), ()):
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    @property
    def final(self) -> int:
        return len(self.steps) - 1

    def end(self, words: list[bytes], start: int) -> int | None:
        """The place after the longest accepted run from ``start``; None if there is none."""
        states, best, i = self.closure({0}), None, start
        while states:
            if self.final in states:
                best = i
            if i == len(words):
                break
            w = words[i]
            reached = {self.steps[s][w] for s in states if w in self.steps[s]}
            states = self.closure(reached | {self.free[s] for s in states if s in self.free})
            i += 1
        return best

    def first_words(self) -> set[bytes]:
        return {w for s in self.closure({0}) for w in self.steps[s]}


def compile_template(markup: str, label: str) -> Automaton:
    """The automaton of a template. It must begin with a word or an optional region of words, so
    that it is only tried where it can begin."""
    auto, at, opened = Automaton(label), 0, []
    for m in MARK.finditer(markup):
        token = m.group()
        if token == "[[":
            opened.append(at)
        elif token == "]]":
            if not opened:
                raise ValueError(f"]] without [[ in {markup!r}")
            auto.skips.setdefault(opened.pop(), set()).add(at)
        elif m.group(1):
            begins = []
            for _ in range(int(m.group(1))):
                begins.append(at)
                new = auto._new()
                auto.free[at] = new
                at = new
            for b in begins:
                auto.skips.setdefault(b, set()).add(at)
        else:
            new = auto._new()
            auto.steps[at][token.encode()] = new
            at = new
    if opened:
        raise ValueError(f"[[ without ]] in {markup!r}")
    start = auto.closure({0})
    if start & auto.free.keys() or auto.final in start:
        raise ValueError(f"a template must begin with words: {markup!r}")
    return auto


@lru_cache(maxsize=16)
def compiled(phrases: tuple, templates: tuple) -> tuple[dict[bytes, list[tuple]], frozenset]:
    """(automata by first word with whether they are phrases, first words)."""
    by_word: dict[bytes, list[tuple]] = {}
    for base, rows in ((True, [(p, label) for p, label in phrases]), (False, [(m, label) for label, m in templates])):
        for markup, label in rows:
            auto = compile_template(markup, label)
            for w in auto.first_words():
                by_word.setdefault(w, []).append((base, auto))
    return by_word, frozenset(by_word)


def scan(text: str | None, phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> dict:
    """Counts, places and labels of one whole text. ``score`` is a tenth of the words of the
    longest accepted run, 1 at most: 0 where nothing is accepted, 1 for notices of ten words."""
    words = WORD.findall(text.encode().lower()) if text else []
    by_word, starts = compiled(phrases, templates)
    n_base, first, last, base, labels, longest = 0, None, None, set(), set(), 0
    if not starts.isdisjoint(words):
        for i in [i for i, w in enumerate(words) if w in starts]:
            for is_base, auto in by_word[words[i]]:
                end = auto.end(words, i)
                if end is None:
                    continue
                labels.add(auto.label)
                longest = max(longest, end - i)
                if is_base:
                    base.add(auto.label)
                    n_base += 1
                    first, last = i if first is None else first, i
    return {
        "n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last,
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)),
        "score": min(1.0, longest / 10),
    }


RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double"
)


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: tuple = PHRASES,
    templates: tuple = TEMPLATES,
) -> DataFrame:
    """One row per input row: (id, n_words, n_base, first_word, last_word, base_labels, labels,
    score). Null texts count as empty: no words, empty labels, null places, score 0. Repeated
    rows and null ids are scanned like others."""

    @F.pandas_udf(RESULT)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = pd.DataFrame([scan(t, phrases, templates) for t in texts], columns=COLUMNS)
            for c in ("first_word", "last_word"):
                rows[c] = rows[c].astype("Int64")
            yield rows

    return docs.select(id_col, found(F.col(text_col)).alias("_found")).select(id_col, "_found.*")


COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
