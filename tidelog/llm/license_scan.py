"""Licence detection with a generalised suffix automaton over licence tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import small_batches

#: Every byte that is not part of a word becomes a blank: words are [0-9a-z] and bytes of characters beyond ASCII.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Fixed phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Well-known wording of licences: each text is a template, named by its label.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "released under the terms of the mit license",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"],
    "cc-by-nc": ["this work is licensed under a creative commons attribution noncommercial license", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
}


class Automaton:
    """A suffix automaton of several word sequences, with the places where they end."""

    def __init__(self, sequences: list[list[bytes]]):
        self.go: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        #: state -> (sequence, end) of one occurrence of the state's words
        self.at: list[tuple[int, int]] = [(-1, 0)]
        for s, words in enumerate(sequences):
            last = 0
            for end, word in enumerate(words, 1):
                last = self._extend(last, word, (s, end))
        self.words = {w for g in self.go for w in g}

    def _copy(self, p: int, q: int, word: bytes) -> int:
        """Split off from q the words that p and its suffixes reach."""
        c = len(self.go)
        self.go.append(dict(self.go[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.at.append(self.at[q])
        self.link[q] = c
        while p >= 0 and self.go[p].get(word) == q:
            self.go[p][word] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, word: bytes, at: tuple[int, int]) -> int:
        if (q := self.go[last].get(word)) is not None:
            return q if self.len[q] == self.len[last] + 1 else self._copy(last, q, word)
        new, p = len(self.go), last
        self.go.append({})
        self.link.append(0)
        self.len.append(self.len[last] + 1)
        self.at.append(at)
        while p >= 0 and word not in self.go[p]:
            self.go[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][word]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._copy(p, q, word)
        return new

    def state(self, words: list[bytes]) -> int:
        s = 0
        for w in words:
            s = self.go[s][w]
        return s


class Scanner:
    """Phrases (every place counts) and templates (long matches are chained into covered spans)."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]], least: int, cover: float, gap: int):
        texts = [(p, label, True) for p, label in phrases.items()] + [(t, label, False) for label, ts in templates.items() for t in ts]
        self.labels = [label for _, label, _ in texts]
        self.sizes = [len(t.split()) for t, _, _ in texts]
        sequences = [t.encode().split() for t, _, _ in texts]
        self.auto = a = Automaton(sequences)
        self.n_phrases, self.least, self.cover, self.gap = len(phrases), least, cover, gap
        #: the phrases that end where a state with a match of some length does: (words needed, label, words)
        own: dict[int, list[tuple[int, str]]] = {}
        for words, (_, label, _) in zip(sequences[: len(phrases)], texts, strict=False):
            own.setdefault(a.state(words), []).append((len(words), label))
        self.ends: dict[int, list[tuple[int, str]]] = {}
        for s in range(len(a.go)):
            found, v = [], s
            while v > 0:
                found += own.get(v, [])
                v = a.link[v]
            if found:
                self.ends[s] = found
        #: places of each template's n-grams of `least` words, to anchor a match in every template that holds it
        self.grams: dict[tuple, list[tuple[int, int]]] = {}
        for t, words in enumerate(sequences):
            for i in range(len(words) - least + 1):
                self.grams.setdefault(tuple(words[i : i + least]), []).append((t, i))
        self.sequences = sequences

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, set, set, float]:
        """Base places, first start, last start, base labels, method labels, score."""
        a, ends, least = self.auto, self.ends, self.least
        go, link, length, known = a.go, a.link, a.len, a.words
        n, first, last, base = 0, None, None, set()
        runs: list[tuple[int, int]] = []  # maximal matches of `least` words or more: [start, end)
        state = size = 0
        for i, w in enumerate(words):
            if w not in known:
                if size >= least:
                    runs.append((i - size, i))
                state = size = 0
                continue
            if w not in go[state]:
                if size >= least:
                    runs.append((i - size, i))
                while state > 0 and w not in go[state]:
                    state = link[state]
                size = length[state]
            state = go[state].get(w, 0)
            size = size + 1 if state else 0
            if state in ends:
                for need, label in ends[state]:
                    if need <= size:
                        at = i + 1 - need
                        n += 1
                        first = at if first is None or at < first else first
                        last = at if last is None or at > last else last
                        base.add(label)
        if size >= least:
            runs.append((len(words) - size, len(words)))
        more, score = self._chain(words, runs) if runs else (set(), 0.0)
        return n, first, last, base, more, 1.0 if base else score

    def _chain(self, words: list[bytes], runs: list[tuple[int, int]]) -> tuple[set, float]:
        """Chain matches of one template, in order and not far apart, into spans; the words covered decide."""
        hits: dict[int, list[tuple[int, int, int]]] = {}
        upto: dict[tuple[int, int], int] = {}  # where the last match of a template at an offset ended
        done = 0
        for lo, hi in runs:
            # Each place of a run may begin a match with a template that others of its words do not stand in.
            for at in range(max(lo, done), hi - self.least + 1):
                for t, i in self.grams.get(tuple(words[at : at + self.least]), ()):
                    if upto.get((t, i - at), 0) > at:
                        continue
                    k = self.least
                    while at + k < len(words) and i + k < self.sizes[t] and self.sequences[t][i + k] == words[at + k]:
                        k += 1
                    upto[t, i - at] = at + k
                    hits.setdefault(t, []).append((at, i, k))
            done = max(done, hi - self.least + 1)
        found, best = set(), 0.0
        for t, places in hits.items():
            chains: list[list[int]] = []  # [end in text, end in template, words covered]
            for lo, i, k in sorted(places):
                # Places come in order: what ends more than `gap` words before this one is out of reach of all that follow.
                chains = [c for c in chains if lo - c[0] <= self.gap]
                fit = max((c for c in chains if c[0] <= lo and c[1] <= i), key=lambda c: c[2], default=None)
                covered = k + (fit[2] if fit else 0)
                chains.append([lo + k, i + k, covered])
                share = covered / self.sizes[t]
                if t >= self.n_phrases:
                    best = max(best, min(1.0, share))
                    if share >= self.cover:
                        found.add(self.labels[t])
        return found, best


def _scan(batches: Iterator[pa.RecordBatch], scanner: tuple) -> Iterator[pa.RecordBatch]:
    scan = Scanner(*scanner).scan
    for batch in batches:
        rows = []
        for text in batch.column(batch.num_columns - 1):
            words = (text.as_py() or "").encode().translate(WORDS).split()
            n, first, last, base, more, score = scan(words)
            rows.append((len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), score))
        out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=[*batch.schema.names[:-1], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict | None = None, templates: dict | None = None,
                 least: int = 6, cover: float = 0.5, gap: int = 12) -> DataFrame:
    """Licence phrases and covered licence text of every whole text; one row for each row, in one pass without a shuffle.

    A suffix automaton of all phrases and templates streams each text's words and keeps the longest match that ends at each
    word. Places where a phrase ends are counted, each. Where that match is `least` words or longer, every template that holds
    `least` of its words in a row gives a match, as long as it goes on; a template's matches are chained, in order, without
    overlap and at most `gap` words apart; a template covered to the share `cover` gives its label. score is 1 with a phrase,
    else the best share covered.

    Null or empty text: no words, no labels ('' strings), score 0. Null keys stay null; repeated rows give repeated rows;
    an empty table gives no rows. Other columns are not looked at.
    """
    args = (PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates, least, cover, gap)
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return small_batches(docs).select(F.col(key), F.col(text).alias("text")).mapInArrow(partial(_scan, scanner=args), schema)
