"""License scans: words of texts run through a suffix automaton of all templates, long matches chained into spans.

The automaton holds every run of words of every template. A text goes through it word by word, and at each word it
says how long the longest run is that ends there and occurs in a template (the matching statistics), and where. Short
templates (phrases) are found where that run ends with one of them. Of long ones, runs of ``SEED`` words and more that
cannot be lengthened are chained: in a text's order and the template's, with at most ``GAP`` words between them. A chain
that covers ``share`` of its template's words is a span of it, so a licence with names filled in, words changed or a
paragraph left out is still met.

Words outside the templates' pairs of neighbours cannot be in a run of two, so the walk begins and ends with stretches
of known pairs, and most texts are never walked.

Defined results: null and empty texts have no words, no places and score 0; very long texts are scanned whole, and a
chain looks back only as far as gaps allow; repeated rows, equal and null ids get a row each; of chains that cover as
much, the first by label and place counts; an empty table gives an empty result; other columns, of any name, are ignored.
"""

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, prepare, release, texts

# The phrases of the base rule with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Other names of licences with their labels.
NAMES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "2 clause bsd license": "bsd-2-clause",
    "3 clause bsd license": "bsd-3-clause",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "dual licensed under mit and apache": "mit",
}

# The wording of licences and of notices that stand for them, with their labels.
TEXTS = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
     to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
     whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
     permission notice shall be included in all copies or substantial portions of the Software."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
     granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
     that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
     conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
     list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
     products derived from this software without specific prior written permission."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
     the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
     law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
     CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
     limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
     License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
     This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
     MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
     Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
     version."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
     distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
     use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
     or non-commercial, and by any means."""),
    ("cc-by", """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this
     license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View,
     CA 94042, USA."""),
]

SEED, GAP = 4, 30
_OTHER = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """ASCII letters and digits, lower-cased, and whatever is outside ASCII; all else separates."""
    return text.encode().lower().translate(_OTHER).split()


class Automaton:
    """The suffix automaton of several word sequences: each state stands for runs that end in the same places."""

    def __init__(self, phrases: list[tuple[str, list[bytes]]], long: list[tuple[str, list[bytes]]]):
        """phrases and long templates, as (label, words)."""
        self.phrases, self.long = phrases, long
        self.number: dict[bytes, int] = {}
        sequences = [[self.number.setdefault(w, len(self.number)) for w in words] for _, words in [*phrases, *long]]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set] = [set()]  # (sequence, place of the last word), of the states that a prefix leads to
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].add((k, at))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):  # places of longer runs are places of their ends too
            ends[self.link[state]] |= ends[state]
        n, sizes = len(phrases), [len(s) for s in sequences]
        #: For each state the long templates' places in it; and the phrases that the runs of it, or ends of them, are: (length, phrase).
        self.places = [sorted((k - n, at) for k, at in e if k >= n) for e in ends]
        whole: list[list[tuple[int, int]]] = [[] for _ in ends]
        for k, sequence in enumerate(sequences[:n]):
            state = 0
            for word in sequence:
                state = self.next[state][word]
            whole[state].append((sizes[k], k))
        self.whole: list[list[tuple[int, int]]] = [[] for _ in ends]
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.whole[state] = whole[state] + self.whole[self.link[state]]
        wide = len(self.number) + 1
        self.pairs = np.zeros((wide, wide), bool)
        for sequence in sequences:
            self.pairs[sequence[:-1], sequence[1:]] = True

    def _new(self, length: int, ends: list[set]) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def _split(self, state: int, word: int, ends: list[set]) -> int:
        """The state for the runs of ``state`` and the word; runs in it that are longer than these leave for a state of their own."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        short = self._new(self.length[state] + 1, ends)
        self.next[short], self.link[short] = dict(self.next[target]), self.link[target]
        self.link[target] = short
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = short
            state = self.link[state]
        return short

    def _extend(self, last: int, word: int, ends: list[set]) -> int:
        """The state for the sequence up to ``last`` and the word."""
        if word in self.next[last]:  # another template has this run
            return self._split(last, word, ends)
        made = self._new(self.length[last] + 1, ends)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = made
            state = self.link[state]
        self.link[made] = self._split(state, word, ends) if state >= 0 else 0
        return made

    def statistics(self, words: list[int]):
        """(state, length of the longest run) at each word."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length

    def runs(self, words: list[bytes]):
        """Stretches in which all neighbours are a template's: (place of the first word, numbers of the words)."""
        none = len(self.number)
        lookup = self.number.get
        ids = np.fromiter((lookup(w, none) for w in words), np.int64, len(words))
        near = self.pairs[ids[:-1], ids[1:]] if len(ids) > 1 else np.zeros(0, bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            yield a, ids[a : b + 1].tolist()


def chains(anchors: list[tuple[int, int, int]], size: int, gap: int) -> list[tuple[int, int, int]]:
    """(words of the template that are covered, start, stop) of the best chains that share no anchor.

    anchors: (start in the text, start in the template, length), sorted. In a chain both ends rise; what two anchors share counts once.
    """
    best, before, starts = [], [], [a[0] for a in anchors]
    longest = max((a[2] for a in anchors), default=0)
    for i, (at, own, n) in enumerate(anchors):
        score, from_ = n, -1
        for j in range(bisect_left(starts, at - gap - longest), i):
            a, b, m = anchors[j]
            shared = max(a + m - at, b + m - own, 0)
            if at - (a + m) <= gap and own - (b + m) <= size // 2 and shared < n and a < at and b < own and best[j] + n - shared > score:
                score, from_ = best[j] + n - shared, j
        best.append(score)
        before.append(from_)
    used, out = set(), []
    for i in sorted(range(len(anchors)), key=lambda i: (-best[i], anchors[i])):
        path, k = [], i
        while k >= 0 and k not in used:
            path.append(k)
            k = before[k]
        if k >= 0 or not path:
            continue  # its beginning belongs to a better chain
        used.update(path)
        out.append((best[i], anchors[path[-1]][0], anchors[i][0] + anchors[i][2]))
    return out


def scan_words(auto: Automaton, words: list[bytes], share: float, seed: int = SEED, gap: int = GAP) -> tuple[list, list]:
    """The phrases' places, (phrase, first word), and the spans of long templates, (template, first word, word behind, share covered); the best chain of a template is given even below ``share``."""
    places, anchors = [], {}
    for begin, numbers in auto.runs(words):
        found = [*auto.statistics(numbers), (0, 0)]
        for i, (state, length) in enumerate(found[:-1]):
            for size, phrase in auto.whole[state]:
                if size <= length:
                    places.append((phrase, begin + i - size + 1))
            if length >= seed and found[i + 1][1] <= length:  # no longer run goes through here
                for k, last in auto.places[state]:
                    anchors.setdefault(k, []).append((begin + i - length + 1, last - length + 1, length))
    spans = []
    for k, own in anchors.items():
        size = len(auto.long[k][1])
        ranked = [(covered / size, start, stop) for covered, start, stop in chains(sorted(own), size, gap)]
        spans += [(k, start, stop, min(part, 1.0)) for i, (part, start, stop) in enumerate(ranked) if part >= share or i == 0]
    return places, spans


def templates() -> Automaton:
    return Automaton([(label, words_of(x)) for x, label in [*BASE.items(), *NAMES.items()]], [(label, words_of(x)) for label, x in TEXTS])


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long,share:double>>"


def scan(docs: DataFrame, share: float = 0.6) -> DataFrame:
    """One row per document: words, places of base phrases, labels, score and spans.

    spans: what was found, in words of the text, phrases with share 1 and long templates with what is covered of them, which is at least ``share``.
    score: 1 with a phrase, else the largest share of a long template that a chain covers, be it a span or not.
    """
    prepare(docs.sparkSession)

    def run(batches):
        release()
        auto = templates()
        names = [label for label, _ in auto.phrases]
        for batch in pieces(batches):
            rows = []
            for text in texts(batch):
                words = words_of(text)
                places, chained = scan_words(auto, words, share)
                starts = [at for k, at in places if k < len(BASE)]
                spans = {(names[k], at, at + len(auto.phrases[k][1]), 1.0) for k, at in places}
                spans |= {(auto.long[k][0], a, b, part) for k, a, b, part in chained if part >= share}
                rows.append((
                    len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({names[k] for k, _ in places if k < len(BASE)})),
                    ",".join(sorted({s[0] for s in spans})), 1.0 if places else max((s[3] for s in chained), default=0.0),
                    [dict(zip(("label", "start", "stop", "share"), s)) for s in sorted(spans, key=lambda s: (s[1], s[2], s[0], -s[3]))],
                ))
            kinds = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())])))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
