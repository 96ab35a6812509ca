"""Licence scan: a generalised suffix automaton of licence words gives matching statistics of streamed texts.

The automaton holds every run of words of all templates.  A text's words are streamed through it: at each word
it knows the longest run ending there that occurs in some template.  Runs that can't go on and have at least
``MIN_MATCH`` words are matches, at every place of a template where they occur.  For each template the matches of a text
are chained by dynamic programming: in a chain both the places in the text and those in the template go up, gaps in the
text are at most ``MAX_GAP`` words, and words where two matches overlap count once; each match extends the chain that
covers most.  So words that were put in between, or a repeated part, don't break a chain.  The chains that cover most
are the spans, as long as they don't overlap in the text; a span that covers at least ``COVER`` of the template's words
gives the template's label, and the score is the largest share of a template covered by one span.

Templates are notices and whole licences, paragraph by paragraph: the fixed ones below, or ``templates_of`` a folder.

Only words of the licences' own vocabulary can lengthen a run, so words are first looked up by hash for a whole
batch, and the automaton is run over stretches of known words alone; every other word sets it back.

The base labels are those of exact phrases, counted at every place.

Defined cases: a null or empty text has no words, null positions, empty labels and score 0; texts of any length are
streamed whole; repeated rows give repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Templates by label, the words of widely used licences and notices, one a paragraph.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "released under the mit license",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ],
    "lgpl": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "cc": [
        "licensed under cc by nc 4 0",
        "licensed under cc by sa 4 0",
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "zlib": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "boost": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ],
}
MIN_MATCH = 4
MAX_GAP = 8
COVER = 0.8


class Automaton:
    """A suffix automaton of several sequences of small integers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, index of its last word) of the state's runs
        for k, seq in enumerate(sequences):
            last = 0
            for i, x in enumerate(seq):
                last = self._add(last, x)
                self.ends[last].add((k, i))
        for s in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.len.append(length)
        self.ends.append(set())
        return len(self.len) - 1

    def _split(self, p: int, x: int, q: int) -> int:
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, x: int) -> int:
        if x in self.next[last]:
            q = self.next[last][x]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, x, q)
        new, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, x, q)
        return new

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(index after the run, its length, state) of the runs that the next word doesn't lengthen."""
        s = n = 0
        for i, x in enumerate(words):
            t = self.next[s].get(x)
            if t is None and n >= least:
                yield i, n, s
            while t is None and s > 0:
                s = self.link[s]
                n = self.len[s]
                t = self.next[s].get(x)
            s, n = (t, n + 1) if t is not None else (0, 0)
        if n >= least:
            yield len(words), n, s


class Licences:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.labels = [label for label, several in templates.items() for _ in several]
        texts = [t.split() for several in templates.values() for t in several]
        vocabulary = sorted({w for t in texts for w in t} | {w for p in phrases for w in p.split()})
        number = {w: k for k, w in enumerate(vocabulary)}
        hashes = common.hash_words(vocabulary)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.sizes = [len(t) for t in texts]
        self.automaton = Automaton([[number[w] for w in t] for t in texts])
        self.phrases = [(label, [number[w] for w in p.split()]) for p, label in phrases.items()]

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 for those that no licence has."""
        k = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[k] == words, self.order[k], -1)

    def base(self, ids: np.ndarray, doc: np.ndarray) -> dict[str, np.ndarray]:
        """Where each label's phrase begins."""
        out = {}
        for label, phrase in self.phrases:
            m = len(ids) - len(phrase) + 1
            ok = np.zeros(0, bool) if m <= 0 else doc[:m] == doc[len(phrase) - 1 :]
            for k, x in enumerate(phrase if m > 0 else ()):
                ok &= ids[k : k + m] == x
            out[label] = np.flatnonzero(ok)
        return out

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Spans of one text: template, first word, word after the last, words covered.  matches: first word, length, state."""
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for at, n, state in matches:
            for k, last in self.automaton.ends[state]:
                anchors.setdefault(k, []).append((at + n, last + 1, n))
        out = []
        for k, own in anchors.items():
            own.sort()
            covered, start = [n for _, _, n in own], [end - n for end, _, n in own]
            for i, (end, t_end, n) in enumerate(own):
                for j in range(i - 1, -1, -1):
                    e, t, _ = own[j]
                    if e < end - n - MAX_GAP:
                        break
                    twice = max(0, e - (end - n), t - (t_end - n))
                    if twice < n and t < t_end and covered[j] + n - twice > covered[i]:
                        covered[i], start[i] = covered[j] + n - twice, start[j]
            begins: list[int] = []  # of the spans taken, which don't overlap, in order
            ends: list[int] = []
            for i in sorted(range(len(own)), key=lambda i: (-covered[i], own[i][0])):
                end = own[i][0]
                place = bisect_left(begins, start[i])
                if begins and (covered[i] < COVER * self.sizes[k] or (place and ends[place - 1] > start[i]) or (place < len(begins) and begins[place] < end)):
                    continue
                begins.insert(place, start[i])
                ends.insert(place, end)
                out.append((k, start[i], end, covered[i]))
        return out

    def spans(self, ids: np.ndarray, doc: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, int, int]]]:
        """For each text with matches: its chains, by words from the text's beginning."""
        known = ids >= 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        begin, end = edge[0::2], edge[1::2]
        long = end - begin >= MIN_MATCH
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for lo, hi in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            cuts = first[np.searchsorted(first, lo, "right") : np.searchsorted(first, hi, "left")]
            for a, b in zip([lo, *cuts.tolist()], [*cuts.tolist(), hi], strict=True):
                if b - a < MIN_MATCH:
                    continue
                d = int(doc[a])
                for after, n, state in self.automaton.matches(ids[a:b].tolist(), MIN_MATCH):
                    matches.setdefault(d, []).append((a + after - n - int(first[d]), n, state))
        return {d: self.chains(m) for d, m in matches.items()}


def templates_of(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Templates of a folder of licence texts, label.txt each (label-2.txt: more of a label): one a paragraph of at least MIN_MATCH words."""
    out: dict[str, list[str]] = {}
    for r in spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:-\d+)?(?:\.[^./]*)?$", 1).alias("label")).orderBy("label", "value").collect():
        for paragraph in re.split(r"\n\s*\n", r["value"]):
            words = _WORDS.findall(paragraph.translate(_LOWER))
            if len(words) >= MIN_MATCH:
                out.setdefault(r["label"], []).append(" ".join(words))
    return out


_WORDS, _LOWER = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {k: k + 32 for k in range(65, 91)}

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per document: SCHEMA."""

    def look(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        licences = Licences(templates, phrases)
        for b in common.batches(rows):
            n = b.num_rows
            words, first = common.word_hashes(*common.utf8(b.column(1)))
            ids = licences.ids(words)
            doc = np.repeat(np.arange(n), np.diff(first))
            places, base = np.zeros(n, np.int64), [set() for _ in range(n)]
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            for label, at in licences.base(ids, doc).items():
                np.add.at(places, doc[at], 1)
                np.minimum.at(low, doc[at], at - first[doc[at]])
                np.maximum.at(high, doc[at], at - first[doc[at]])
                for d in np.unique(doc[at]):
                    base[d].add(label)
            found = licences.spans(ids, doc, first)
            labels = [base[d] | {licences.labels[k] for k, _, _, c in found.get(d, ()) if c >= COVER * licences.sizes[k]} for d in range(n)]
            score = [max((c / licences.sizes[k] for k, _, _, c in found.get(d, ())), default=0.0) for d in range(n)]
            none = places == 0
            columns = [b.column(0), pa.array(np.diff(first)), pa.array(places), pa.array(low, mask=none), pa.array(high, mask=none), pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    common.arrow_bytes(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(look, SCHEMA)


SPANS = "doc_id long, label string, template int, first_word long, last_word long, share double"


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """One row for every span of a document that covers at least COVER of a template: SPANS."""

    def look(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        licences = Licences(templates, {})
        for b in common.batches(rows):
            words, first = common.word_hashes(*common.utf8(b.column(1)))
            found = licences.spans(licences.ids(words), np.repeat(np.arange(b.num_rows), np.diff(first)), first)
            ids = b.column(0).to_pylist()
            rows_ = [(ids[d], licences.labels[k], k, lo, hi - 1, c / licences.sizes[k]) for d, all_ in sorted(found.items()) for k, lo, hi, c in sorted(all_) if c >= COVER * licences.sizes[k]]
            columns = list(zip(*rows_, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "label", "template", "first_word", "last_word", "share"])

    common.arrow_bytes(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(look, SPANS)
