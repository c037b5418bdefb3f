"""Licence scans: matching statistics over a generalised suffix automaton of licence words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, small_batches, text_or_empty

#: Phrases whose places are all counted, with their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording of public licences and notices, with their labels (fixed values).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-any", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("warranty-disclaimer", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
]
#: A match counts from this many words; matches chain over gaps of at most MOST_GAP words; a chain labels from this share of its template.
LEAST_MATCH, MOST_GAP, LEAST_COVER = 3, 4, 0.75
#: A span is denied by one of these among the NEAR words before it or in a gap of its chain (fixed values).
DENIALS, NEAR = {b"not", b"never", b"neither", b"nor", b"cannot", b"without", b"isn", b"aren", b"wasn"}, 2


def family_of(label: str) -> str:
    """A label without its version: what a text supports that does not repeat the template's version."""
    return re.sub(r"-[0-9.]+$", "", label)


@dataclass
class Chain:
    """Matches with one template, in order: where they lie in the text and in the template, and the text's gaps between them."""

    first: int
    end: int
    covered: list[tuple[int, int]]
    gaps: list[tuple[int, int]] = field(default_factory=list)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


@dataclass
class State:
    """Of a generalised suffix automaton: `length` of its longest string, its suffix link, its moves, where it ends."""

    length: int
    link: int = -1
    moves: dict[int, int] = field(default_factory=dict)
    ends: list[tuple[int, int]] = field(default_factory=list)


class Automaton:
    """Generalised suffix automaton of the templates' words, built on line, template after template from the root."""

    def __init__(self, templates: list[list[int]]) -> None:
        self.states = [State(0)]
        self.sizes = [len(t) for t in templates]
        last_of: list[list[int]] = []
        for words in templates:
            last, path = 0, []
            for word in words:
                last = self._extend(last, word)
                path.append(last)
            last_of.append(path)
        for number, path in enumerate(last_of):
            for place, state in enumerate(path):
                self.states[state].ends.append((number, place))
        self._inherit()

    def _extend(self, last: int, word: int) -> int:
        states = self.states
        known = states[last].moves.get(word)
        if known is not None:
            return known if states[known].length == states[last].length + 1 else self._split(last, word, known)
        new = len(states)
        states.append(State(states[last].length + 1))
        at = last
        while at >= 0 and word not in states[at].moves:
            states[at].moves[word] = new
            at = states[at].link
        if at < 0:
            states[new].link = 0
        else:
            known = states[at].moves[word]
            states[new].link = known if states[known].length == states[at].length + 1 else self._split(at, word, known)
        return new

    def _split(self, at: int, word: int, known: int) -> int:
        states = self.states
        copy = len(states)
        states.append(State(states[at].length + 1, states[known].link, dict(states[known].moves)))
        while at >= 0 and states[at].moves.get(word) == known:
            states[at].moves[word] = copy
            at = states[at].link
        states[known].link = copy
        return copy

    def _inherit(self) -> None:
        """Every state ends wherever a state that links to it ends."""
        for state in sorted(range(1, len(self.states)), key=lambda i: -self.states[i].length):
            link = self.states[state].link
            if link > 0:
                self.states[link].ends = sorted(set(self.states[link].ends) | set(self.states[state].ends))

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """Matching statistics: per place the state and length of the longest template substring that ends there."""
        state = length = 0
        for place, word in enumerate(words):
            while state and word not in self.states[state].moves:
                state = self.states[state].link
                length = self.states[state].length
            if word in self.states[state].moves:
                state = self.states[state].moves[word]
                length += 1
            else:
                state = length = 0
            yield place, state, length


class Scanner:
    """Base phrases and templates in one automaton, with the labels of each."""

    def __init__(self, base: dict[str, str], templates: list[tuple[str, str]]) -> None:
        texts = [words_of(t) for t in [*base, *(t for _, t in templates)]]
        self.labels = [*base.values(), *(label for label, _ in templates)]
        self.base = len(base)
        self.vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.automaton = Automaton([[self.vocabulary[w] for w in t] for t in texts])
        # Per template the places of its version: words with a digit.
        self.versions = [[i for i, w in enumerate(t) if any(48 <= b <= 57 for b in w)] for t in texts]
        sizes, states = self.automaton.sizes, self.automaton.states
        self.least = min([LEAST_MATCH, *(n for n in sizes[:self.base] if n)])
        # Per state the base phrases that end with it, by the length they need: a phrase is the longest string of its own
        # state, and every state that links there, through others or not, ends with it as well.
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in states]
        for state in sorted(range(1, len(states)), key=lambda i: states[i].length):
            own = [(n, sizes[n]) for n, end in states[state].ends if n < self.base and end + 1 == sizes[n] == states[state].length]
            self.phrases[state] = own + self.phrases[states[state].link]

    def scan(self, text: str) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
        """(words, base places (label, first, end), spans (label, first, end, cover)) of a whole text."""
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], dtype=np.int32)
        known = np.flatnonzero(np.concatenate([[0], (ids > 0).view(np.int8), [0]]))
        places: list[tuple[str, int, int]] = []
        chains: dict[int, list[Chain]] = {}
        if len(known):
            breaks = np.flatnonzero(np.diff(known) > 1)
            firsts = known[np.concatenate([[0], breaks + 1])] - 1
            ends = known[np.concatenate([breaks, [len(known) - 1]])]
            for first, end in zip(firsts.tolist(), ends.tolist()):
                if end - first >= self.least:
                    self._run(ids[first:end].tolist(), first, places, chains)
        return len(words), places, self._spans(words, chains)

    def _run(self, ids: list[int], first: int, places: list, chains: dict[int, list[Chain]]) -> None:
        matched = list(self.automaton.stream(ids))
        for place, state, length in matched:
            for phrase, size in self.phrases[state]:
                if size <= length:
                    end = first + place + 1
                    places.append((self.labels[phrase], end - size, end))
            # A match is maximal where the next place does not prolong it.
            if length >= LEAST_MATCH and (place + 1 == len(matched) or matched[place + 1][2] <= length):
                for template, at in self.automaton.states[state].ends:
                    if template >= self.base and length <= at + 1:
                        self._chain(chains.setdefault(template, []), first + place + 1 - length, first + place + 1, at + 1 - length, at + 1)

    @staticmethod
    def _chain(chains: list[Chain], first: int, end: int, from_: int, to: int) -> None:
        """Lengthen the last chain of a template by a later match, or begin one."""
        if chains:
            last = chains[-1]
            reached = last.covered[-1][1]
            new = min(end - max(first, last.end), to - max(from_, reached))
            if first - last.end <= MOST_GAP and end > last.end and to > reached and new > 0:
                last.gaps.append((last.end, end - new))
                last.covered.append((to - new, to))
                last.end = end
                return
            if end <= last.end:
                return
        chains.append(Chain(first, end, [(from_, to)]))

    def _spans(self, words: list[bytes], chains: dict[int, list[Chain]]) -> list[tuple[str, int, int, float]]:
        """Chains that cover enough and are not denied: of the template's label, or of its family where its version is not covered."""
        exact, loose = [], []
        for template, found in chains.items():
            label = self.labels[template]
            for chain in found:
                cover = sum(b - a for a, b in chain.covered) / self.automaton.sizes[template]
                around = [(max(0, chain.first - NEAR), chain.first), *chain.gaps]
                if cover < LEAST_COVER or any(w in DENIALS for a, b in around for w in words[a:b]):
                    continue
                whole = all(any(a <= v < b for a, b in chain.covered) for v in self.versions[template])
                (exact if whole else loose).append((label if whole else family_of(label), chain.first, chain.end, cover))
        # A family is left out where a member of it is named at the same place.
        named = [(family_of(label), first, end) for label, first, end, _ in exact]
        rest = [s for s in set(loose) if not any(s[0] == f and s[1] < end and first < s[2] for f, first, end in named)]
        return sorted(exact + rest)


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("places", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("cover", T.DoubleType())]))),
])


def scan_licenses(
    docs: DataFrame, text: str = "text", base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None
) -> DataFrame:
    """(row {all columns}, scan {n_words, places, spans}) of every whole text.

    `places` are the places of the base phrases (words from 0, end exclusive); `spans` are
    the chained long matches with a template and the share of it they cover. A template that names a version gives
    its label only where the version is matched too, else the label of its family (`apache` for Version 1.1). A span with a
    denial in a gap or up to two words before it ("is not licensed under") is none; places are never denied. Null text
    is empty and has no words; every row keeps its own scan, an empty table gives none. Columns keep
    their names inside the struct `row`. Texts stream word by word, whatever their length.
    """
    scanner = Scanner(BASE if base is None else base, TEMPLATES if templates is None else templates)

    @F.pandas_udf(RESULT)
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in parts:
            found = [scanner.scan(t) for t in series]
            yield pd.DataFrame({
                "n_words": [n for n, _, _ in found],
                "places": [[dict(zip(("label", "first", "end"), p)) for p in places] for _, places, _ in found],
                "spans": [[dict(zip(("label", "first", "end", "cover"), s)) for s in spans] for _, _, spans in found],
            })

    return small_batches(docs).select(F.struct("*").alias("row"), text_or_empty(text).alias("_text")).select("row", scan("_text").alias("scan"))
