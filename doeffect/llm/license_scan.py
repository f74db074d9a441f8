"""License scans with a generalised suffix automaton.

The words of all license templates make one automaton.  The words of a file
stream through it and give matching statistics (the longest piece of any
template that ends at each word); maximal matches of at least ``LEAST``
words are chained per template into covered spans.  A template is present
where a chain covers ``COVERED`` of it, unless another such chain accounts for
more of the same words: licenses share whole paragraphs (MIT-0 lies in MIT,
most of one GNU license in another), and only the one that explains a place
best is reported there.

The templates are short notices and the whole texts of licenses in
``licenses/``, a file a license, whose label is the family of its name.

A match of ``LEAST`` words consists of runs of ``LEAST`` words that occur in
templates, so only unbroken sequences of such runs go through the automaton;
the rest of the text is passed over by vectorised look-ups.  Nothing is
shuffled.

NULL text is empty: no words, no labels, score 0.  Ties between chains go to
the earlier one; of two templates that account for as many words of a place
the one covered to the larger share is present, both if that is equal too.
Repeated rows are scanned like any other.  An empty template is never found.
"""

from __future__ import annotations

from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import ALNUM, hash_words, mix, spans, utf8, blocks, word_hashes, worker_cache, LOWER

LEAST = 5  # words of a match
GAP = 40  # words between matches of one chain
COVERED = 0.6  # of a template

# Phrases of the base labels, notices of public licenses, and families of the texts in ``licenses/``.
PHRASES = {
    "mit": "mit license",
    "apache": "apache license",
    "gpl": "general public license",
}
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
]
FAMILIES = ["apache", "artistic", "bsd", "cc0", "epl", "gfdl", "gpl", "lgpl", "mpl"]


def whole_texts() -> list[tuple[str, str]]:
    """Label and text of the licenses in ``licenses/``."""
    out = []
    for file in sorted((resources.files(__package__) / "licenses").iterdir(), key=lambda f: f.name):
        name = file.name.removesuffix(".txt")
        family = name.split("-")[0]
        out.append((family if family in FAMILIES else name, file.read_text()))
    return out


TEMPLATES = NOTICES + whole_texts()

FOUND = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "matches array<struct<label:string,start:long,stop:long,covered:double,present:boolean>>"
)


def words(text: str) -> list[str]:
    """The words of a short text (templates), as the scan sees them."""
    codes = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = spans(codes, np.array([0, len(codes)]), ALNUM)
    raw = codes.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts, ends)]


class SuffixAutomaton:
    """All substrings of several word sequences, with where they end.

    ``ends[state]`` maps each template that holds the state's strings to the
    position just after one occurrence of them.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for which, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._add(last, word)
                self.ends[last].setdefault(which, at + 1)
        # What ends in a state also ends in its suffixes.
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.ends[self.link[state]]
            for which, at in self.ends[state].items():
                up[which] = min(up.get(which, at), at)

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, state: int, word: int, to: int) -> int:
        """A copy of ``to`` for the strings one longer than ``state``'s."""
        copy = self._new(self.length[state] + 1, dict(self.next[to]), self.link[to])
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = copy
            state = self.link[state]
        self.link[to] = copy
        return copy

    def _add(self, last: int, word: int) -> int:
        if (to := self.next[last].get(word)) is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        made = self._new(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = made
            state = self.link[state]
        if state >= 0:
            to = self.next[state][word]
            self.link[made] = to if self.length[to] == self.length[state] + 1 else self._split(state, word, to)
        return made

    def statistics(self, sequence) -> list[tuple[int, int]]:
        """(length, state) of the longest match that ends at each word."""
        out, state, length = [], 0, 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if (to := self.next[state].get(word)) is not None:
                state, length = to, length + 1
            out.append((length, state))
        return out


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        split = [(label, words(text)) for label, text in templates]
        self.labels = [label for label, _ in split]
        self.sizes = [len(w) for _, w in split]
        spoken = [(label, words(p)) for label, p in phrases.items()]
        vocabulary = sorted({w for _, ws in split + spoken for w in ws})
        hashes = hash_words(vocabulary)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = (order + 1).astype(np.int32)
        # Most words fail this look-up by their low bits.
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.phrases = [(label, [number[w] for w in ws]) for label, ws in spoken]
        self.automaton = SuffixAutomaton([[number[w] for w in ws] for _, ws in split])
        self.least = min([LEAST, *filter(None, self.sizes)])
        whole = [np.array([number[w] for w in ws], np.int32) for _, ws in split]
        grams = [self.grams(ids, np.arange(len(ids) - self.least + 1)) for ids in whole]
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.shorter: dict[int, dict[int, tuple[int, int]]] = {}  # by state; see held()

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int32)
        at = np.flatnonzero(self.filter[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(at):
            k = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
            out[at] = np.where(self.hashes[k] == hashes[at], self.ids[k], 0)
        return out

    def grams(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A hash of the ``least`` words from each of the given places on."""
        out = np.zeros(len(at), np.uint64)
        for k in range(self.least):
            out = mix(out + ids[at + k].astype(np.uint64))
        return out

    def runs(self, ids: np.ndarray, docs: np.ndarray):
        """Runs (a, b) within a document in which all ``least`` neighbouring words stand so in a template."""
        last = self.least - 1
        if len(ids) <= last:
            return []
        at = np.flatnonzero((ids[: len(ids) - last] > 0) & (ids[last:] > 0) & (docs[: len(ids) - last] == docs[last:]))
        for k in range(1, last):
            at = at[ids[at + k] > 0]
        gram = self.grams(ids, at)
        some = self.maybe[(gram >> np.uint64(44)).astype(np.int64)]
        at = at[some][np.isin(gram[some], self.known)]
        if not len(at):
            return []
        cut = np.flatnonzero((np.diff(at) > 1) | (docs[at[1:]] != docs[at[:-1]])) + 1
        return list(zip(at[np.r_[0, cut]].tolist(), (at[np.r_[cut - 1, len(at) - 1]] + self.least).tolist()))

    def held(self, length: int, state: int) -> dict[int, tuple[int, int]]:
        """Template: (length, template end) of its own longest match that ends
        where the longest of all has this length and state."""
        if state not in self.shorter:
            found: dict[int, tuple[int, int]] = {}
            up = self.automaton.link[state]
            while up > 0 and self.automaton.length[up] >= self.least:
                size = self.automaton.length[up]
                for which, stop in self.automaton.ends[up].items():
                    if which not in self.automaton.ends[state] and size >= min(LEAST, self.sizes[which]):
                        found.setdefault(which, (size, stop))
                up = self.automaton.link[up]
            self.shorter[state] = found
        out = {which: (length, stop) for which, stop in self.automaton.ends[state].items() if length >= min(LEAST, self.sizes[which])}
        return out | self.shorter[state]

    def matches(self, ids: list[int], base: int) -> list[tuple[int, int, int, int]]:
        """(template, document start, document end, template end) of each template's
        maximal matches in a run whose first word is word ``base`` of its document."""
        out, held = [], {}
        for i, (length, state) in enumerate([*self.automaton.statistics(ids), (0, 0)]):
            now = self.held(length, state) if length >= self.least else {}
            for which, (size, stop) in held.items():
                if which not in now or now[which][0] != size + 1:
                    out.append((which, base + i - size, base + i, stop))
            held = now
        return out

    def chained(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, start, end, covered words) of the best chain of each place of each template."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for which, start, stop, end in matches:
            by.setdefault(which, []).append((start, stop, end))
        out = []
        for which, found in by.items():
            found.sort()
            longest = max(stop - start for start, stop, _ in found)
            best: list[tuple[int, int]] = []  # words covered by the best chain up to here, its start
            for i, (start, stop, end) in enumerate(found):
                take = (stop - start, start)
                for j in range(i - 1, -1, -1):
                    if start - found[j][0] > GAP + longest:
                        break
                    lap = max(0, found[j][1] - start, found[j][2] - (end - (stop - start)))
                    if start - found[j][1] <= GAP and end > found[j][2] and lap < stop - start:
                        gain = best[j][0] + stop - start - lap
                        if gain > take[0]:
                            take = (gain, best[j][1])
                best.append(take)
            top: dict[int, tuple[int, int]] = {}
            for (covered, start), (_, stop, _) in zip(best, found):
                if covered > top.get(start, (0, 0))[0]:
                    top[start] = (covered, stop)
            out += [(which, start, stop, covered) for start, (covered, stop) in sorted(top.items())]
        return out

    def share(self, which: int, covered: int) -> float:
        return min(1.0, covered / self.sizes[which])

    def chains(self, matches: list[tuple[int, int, int, int]]):
        """(label, start, end, covered share) of the best chain of each place of each template."""
        return [(self.labels[which], start, stop, self.share(which, n)) for which, start, stop, n in self.chained(matches)]

    def present(self, chains: list[tuple[int, int, int, int]], covered: float) -> set[int]:
        """Places in the list of the chains that cover enough of their template, but for those half
        of whose words or more lie in such a chain that accounts for more."""
        good = sorted((i for i, c in enumerate(chains) if self.share(c[0], c[3]) >= covered), key=lambda i: chains[i][1:3])
        worth = {i: (chains[i][3], self.share(chains[i][0], chains[i][3])) for i in good}
        out, near = set(good), []
        for i in good:
            _, start, stop, _ = chains[i]
            near = [j for j in near if chains[j][2] > start]
            for j in near:
                common = min(stop, chains[j][2]) - start
                less, more = (i, j) if worth[i] < worth[j] else (j, i)
                if worth[less] < worth[more] and 2 * common >= chains[less][2] - chains[less][1]:
                    out.discard(less)
            near.append(i)
        return out

    def judged(self, matches: list[tuple[int, int, int, int]], covered: float) -> list[dict]:
        """The chains with their labels; of chains with one label and place the best covered."""
        chains = self.chained(matches)
        present = self.present(chains, covered)
        out: dict[tuple[str, int, int], tuple[float, bool]] = {}
        for i, (which, start, stop, n) in enumerate(chains):
            key = (self.labels[which], start, stop)
            share, own = out.get(key, (0.0, False))
            out[key] = (max(share, self.share(which, n)), own or i in present)
        return [dict(zip(("label", "start", "stop", "covered", "present"), key + value)) for key, value in out.items()]


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    id_col: str = "doc_id",
    text_col: str = "text",
    covered: float = COVERED,
) -> DataFrame:
    """Per row: counts of the phrases, and the template spans (``matches``)."""
    match_type = pa.list_(
        pa.struct(
            [("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("covered", pa.float64()), ("present", pa.bool_())]
        )
    )

    def run(batches):
        cache = worker_cache()
        key = ("licenses", tuple(templates), tuple(phrases.items()))
        if key not in cache:
            cache[key] = Scanner(templates, phrases)
        scanner = cache[key]
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in blocks(off):
                codes = LOWER[data[off[i] : off[j]]]
                starts, ends, docs_of = spans(codes, off[i : j + 1] - off[i], ALNUM)
                n = j - i
                bounds = np.searchsorted(docs_of, np.arange(n + 1))
                ids = scanner.word_ids(word_hashes(codes, starts, ends))
                count = np.zeros(n, np.int64)
                first = np.full(n, np.iinfo(np.int64).max)
                last = np.full(n, -1, np.int64)
                base: list[set] = [set() for _ in range(n)]
                for label, phrase in scanner.phrases:
                    m = len(ids) - len(phrase) + 1
                    if m <= 0:
                        continue
                    hit = docs_of[:m] == docs_of[len(phrase) - 1 :]
                    for k, word in enumerate(phrase):
                        hit &= ids[k : k + m] == word
                    at = np.flatnonzero(hit)
                    of = docs_of[at]
                    np.add.at(count, of, 1)
                    np.minimum.at(first, of, at - bounds[of])
                    np.maximum.at(last, of, at - bounds[of])
                    for d in set(of.tolist()):
                        base[d].add(label)
                found: dict[int, list] = {}
                for a, b in scanner.runs(ids, docs_of):
                    d = int(docs_of[a])
                    found.setdefault(d, []).extend(scanner.matches(ids[a:b].tolist(), a - int(bounds[d])))
                matches = [scanner.judged(found[d], covered) if d in found else [] for d in range(n)]
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(count),
                        pa.array(first, pa.int64(), mask=none),
                        pa.array(last, pa.int64(), mask=none),
                        pa.array([sorted(b) for b in base], pa.list_(pa.string())),
                        pa.array(matches, match_type),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "matches"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, FOUND)


def digest(scanned: DataFrame) -> DataFrame:
    """Labels (those of the phrases and of the templates that are present) and score."""
    own = F.transform(F.filter("matches", lambda m: m["present"]), lambda m: m["label"])
    return scanned.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.sort_array("base_labels"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base_labels", own)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["covered"])), F.lit(0.0)).alias("score"),
    )
