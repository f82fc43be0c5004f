"""Licence scan: a generalised suffix automaton of licence words, streamed over every text.

The automaton holds all substrings (of words) of a small set of templates. Feeding it a text gives the
matching statistics: at each word, the longest suffix read so far that occurs in some template. Base
phrases are found where a state reaches a phrase's state in the suffix-link tree with enough words
matched; long matches are chained per template, in order, into covered template spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spectroloom.llm import textops as X

# The phrases and labels that the scan always reports.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wordings of public licences and notices, by label.
TEMPLATES = {
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

# What tells a wording from others that share most of its words; a text has to hold these words of
# it in one piece.
TELLING = {
    "gpl": "GNU General Public License",
    "gpl-2.0": "General Public License, version 2",
    "gpl-3.0": "General Public License, version 3",
    "lgpl": "Lesser General Public License",
    "apache-2.0": "Apache License, Version 2.0",
    "mit": "free of charge, to any person obtaining a copy of this software",
    "bsd": "source and binary forms, with or without modification",
    "mpl-2.0": "Mozilla Public License, v. 2.0",
    "cc-by-4.0": "Creative Commons Attribution 4.0 International",
    "cc-by-nc-4.0": "CC BY-NC 4.0",
    "mit-notice": "MIT License",
    "apache-2.0-notice": "Apache License, Version 2.0",
    "unlicense": "free and unencumbered software",
}

#: Matches of fewer words than this are not chained.
MIN_MATCH = 3
#: Part of a template's words that a chain must cover for its label.
MIN_COVER = 0.6
#: Words that a chain may skip between two matches, in the text and in the template.
MAX_GAP = 12

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: bigint, last: bigint, cover: double>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def phrase_words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word ids."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.at: list[list[tuple[int, int]]] = [[]]  # templates and their words where the state's strings end

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.at.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, template: int, symbols: list[int]) -> None:
        last = 0
        for i, symbol in enumerate(symbols):
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
                self.at[last].append((template, i))
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
            last = new
            self.at[last].append((template, i))

    def spread(self) -> None:
        """After the last add(): give every state the ends of all states below it in the suffix-link tree."""
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.at[self.link[state]] += self.at[state]

    def statistics(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """``(state, words matched)`` after each symbol; -1 is a word of no template."""
        state = matched = 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                matched += 1
            yield state, matched


class LicenseModel:
    """The automaton of templates and base phrases, with lookups for the scan."""

    def __init__(self, base: dict[str, str], templates: dict[str, str], telling: dict[str, str]) -> None:
        names = [*base.items(), *((t, label) for label, t in templates.items())]
        self.labels = [label for _, label in names]
        words = [phrase_words(t) for t, _ in names]
        self.sizes = [len(w) for w in words]
        self.telling = [self._place(w, phrase_words(telling[label])) if i >= len(base) and label in telling else (0, 0) for i, (w, label) in enumerate(zip(words, self.labels))]
        vocabulary = sorted({w for ws in words for w in ws})
        ids = {w: i for i, w in enumerate(vocabulary)}
        column = pa.array([w.decode() for w in vocabulary], pa.large_string())
        hashes = np.concatenate([w.hashes for _, _, w in X.word_chunks(column, X.ALNUM_WORDS, True)])
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.automaton = SuffixAutomaton()
        for i, ws in enumerate(words):
            self.automaton.add(i, [ids[w] for w in ws])
        self.automaton.spread()
        self.run = min([MIN_MATCH, *self.sizes])
        ends: dict[int, list[int]] = {}
        for i in range(len(base)):
            state = 0
            for w in words[i]:
                state = self.automaton.next[state][ids[w]]
            ends.setdefault(state, []).append(i)
        self.base_at: list[tuple[int, ...]] = [()] * len(self.automaton.next)  # base phrases that end a state's longest string
        for state in sorted(range(len(self.base_at)), key=self.automaton.length.__getitem__):
            if state:
                self.base_at[state] = self.base_at[self.automaton.link[state]] + tuple(ends.get(state, ()))

    @staticmethod
    def _place(words: list[bytes], phrase: list[bytes]) -> tuple[int, int]:
        """Where a wording has its telling words."""
        found = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        if not found:
            raise ValueError(f"{b' '.join(phrase)!r} is not in the wording")
        return found[0], found[0] + len(phrase)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self.known[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        same = self.hashes[at] == hashes[maybe]
        out[maybe[same]] = self.ids[at[same]]
        return out

    def scan(self, start: int, symbols: list[int], places: list, matches: list) -> None:
        """Add the base phrases and long matches of a run of template words that begins at ``start``."""
        sam, before = self.automaton, (0, 0)
        for i, (state, matched) in enumerate([*sam.statistics(symbols), (0, 0)]):
            if before[1] >= MIN_MATCH and matched <= before[1]:  # the match before ended here
                matches += ((start + i - before[1], before[1], template, end - before[1] + 1) for template, end in sam.at[before[0]])
            for phrase in self.base_at[state]:
                if self.sizes[phrase] <= matched:
                    places.append((start + i - self.sizes[phrase] + 1, phrase))
            before = (state, matched)

    def chain(self, matches: list[tuple[int, int, int, int]]) -> dict[int, tuple[float, int, int]]:
        """Of each template whose telling words one match holds: the best covered part, and the chain's first and last word.

        A chain has matches in order in text and template, with short gaps. Of two that a match may follow, one
        with the telling words goes before one with more words.
        """
        best: dict[int, tuple[float, int, int]] = {}
        ends: dict[int, list[tuple[int, int, bool, int, int]]] = {}
        for at, n, template, place in sorted(matches):
            chains = ends[template] = [c for c in ends.get(template, ()) if c[0] >= at - MAX_GAP]
            before = max(((c[2], c[3], -c[4]) for c in chains if c[0] <= at and c[1] <= place <= c[1] + MAX_GAP), default=(False, 0, -at))
            lo, hi = self.telling[template]
            told, covered, begin = before[0] or (place <= lo and place + n >= hi), n + before[1], -before[2]
            chains.append((at + n, place + n, told, covered, begin))
            if told:
                best[template] = max(best.get(template, (0.0, 0, 0)), (min(1.0, covered / self.sizes[template]), begin, at + n - 1))
        return best


def _scan_batch(model: LicenseModel, batch: pa.RecordBatch) -> pa.RecordBatch:
    n = batch.num_rows
    n_words, n_base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    base_labels, labels, spans = [""] * n, [""] * n, [[] for _ in range(n)]
    for i, j, w in X.word_chunks(batch.column(1), X.ALNUM_WORDS, True):
        n_words[i:j] = w.counts()
        ids = model.word_ids(w.hashes)
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            continue
        doc = np.searchsorted(w.first, known, "right") - 1
        cut = np.flatnonzero((np.diff(known) != 1) | (np.diff(doc) != 0)) + 1
        begin, end = np.r_[0, cut], np.r_[cut, len(known)]
        keep = end - begin >= model.run
        found: dict[int, tuple[list, list]] = {}
        for b, e in zip(begin[keep].tolist(), end[keep].tolist()):
            d = int(doc[b])
            places, matches = found.setdefault(d, ([], []))
            model.scan(int(known[b] - w.first[d]), ids[known[b:e]].tolist(), places, matches)
        for d, (places, matches) in found.items():
            own = {model.labels[p] for _, p in places}
            told = {t: c for t, c in model.chain(matches).items() if t >= len(BASE_PHRASES)}
            if places:
                n_base[i + d] = len(places)
                first[i + d], last[i + d] = min(places)[0], max(places)[0]
            spans[i + d] = sorted((model.labels[t], begin, end, c) for t, (c, begin, end) in told.items() if c >= MIN_COVER)
            base_labels[i + d] = ",".join(sorted(own))
            labels[i + d] = ",".join(sorted(own | {s[0] for s in spans[i + d]}))
            score[i + d] = 1.0 if places else max((c for c, _, _ in told.values()), default=0.0)
    where = pa.array(first < 0)
    none = pa.scalar(None, pa.int64())
    columns = [batch.column(0), pa.array(n_words), pa.array(n_base), pc.if_else(where, none, pa.array(first)), pc.if_else(where, none, pa.array(last)), pa.array(base_labels), pa.array(labels), pa.array(score), pa.array([[dict(zip(("label", "first", "last", "cover"), s)) for s in own] for own in spans], _SPAN)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base phrase places, labels, the best covered part of a template, and covered spans.

    A template counts only where its telling words (name, version) lie in the chain. ``score`` is 1 with a base
    phrase; ``spans`` are the labelled templates' first and last words and covered parts.

    A null or empty text has no words, no place and the score 0. Rows are judged on their own, so
    repeated rows and ids give repeated results; null ids are kept; other columns are not read.
    """
    model = LicenseModel(BASE_PHRASES, TEMPLATES, TELLING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _scan_batch(model, batch)

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, SCHEMA)
