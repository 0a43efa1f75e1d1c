"""Licence texts in documents, by a generalised suffix automaton of licence tokens.

The automaton knows every run of words of every template. A text streams through it and gets its matching statistics:
for each word the longest run ending there that some template has. Matches of `least` words or more are chained for each
template, forward in the text and in the template, over gaps of up to `gap` words, at every place where the template has
the run; a chain that covers `share` of a template labels the text, once for each stretch of the text that does. The phrases are templates too: a phrase stands wherever the automaton's match ends with the
whole of it, which the suffix links tell.

Two words that never stand side by side in a template end a match, so a table of hashed word pairs finds the stretches
that the automaton needs to see; in other text no match is longer than one word.

Words are lower-cased runs of ASCII letters, digits and anything outside ASCII. Null texts are empty and have no words.
Repeated rows are scanned row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.columns import ALNUM, Words, ngrams, text_slices
from ledgerloom.llm.decontaminate import Sieve
from ledgerloom.llm.pii import Intervals
from ledgerloom.shipping import ship

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# The wording of public licences and notices.
TEMPLATES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is-disclaimer": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorsement": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-reference": "licensed under the apache license version 2 0",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "gpl-reference": "under the terms of the gnu general public license",
    "lgpl-reference": "under the terms of the gnu lesser general public license",
    "mit-reference": "released under the mit license",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}


class Automaton:
    """A suffix automaton of several token sequences. ends[s][t] are the places where a run of state s ends in sequence t,
    in order."""

    def __init__(self, sequences: list[list[str]]):
        self.size, self.link, self.next = [0], [-1], [{}]
        ends: list[dict[int, set[int]]] = [{}]
        for t, tokens in enumerate(sequences):
            last = 0
            for e, c in enumerate(tokens):
                last = self._extend(last, c, ends)
                ends[last].setdefault(t, set()).add(e)
        for s in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):  # what ends with a run ends with its suffixes
            up = ends[self.link[s]]
            for t, places in ends[s].items():
                up.setdefault(t, set()).update(places)
        self.ends = [{t: sorted(places) for t, places in x.items()} for x in ends]

    def _state(self, size: int, link: int, step: dict, ends: list) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(step)
        ends.append({})
        return len(self.size) - 1

    def _split(self, p: int, c: str, q: int, ends: list) -> int:
        """The state of exactly the runs of p with c, apart from longer ones."""
        if self.size[p] + 1 == self.size[q]:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]), ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: str, ends: list) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c], ends)
        new, p = self._state(self.size[last] + 1, 0, {}, ends), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = self._split(p, c, self.next[p][c], ends) if p >= 0 else 0
        return new

    def follow(self, tokens: list[str]) -> list[tuple[int, int]]:
        """Matching statistics: (state, length) after each token."""
        out, state, n = [], 0, 0
        for c in tokens:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.size[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            else:
                state, n = 0, 0
            out.append((state, n))
        return out


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str], least: int = 3, gap: int = 12, share: float = 0.6):
        self.labels, self.least, self.gap, self.share = list(templates), least, gap, share
        self.phrases = [(label, text.split()) for text, label in phrases.items()]
        self.tokens = [text.split() for text in templates.values()]
        self.automaton = a = Automaton([*self.tokens, *(p for _, p in self.phrases)])
        pairs = {tuple(s[k : k + 2]) for s in [*self.tokens, *(p for _, p in self.phrases)] for k in range(len(s) - 1)}
        w = Words(pa.array([" ".join(p) for p in sorted(pairs)]), ALNUM)
        self.pairs = Sieve(ngrams(w.hashes(), w.first, 2)[0])
        # a state's phrases and whole templates: those whose own state lies on its chain of suffix links
        self.wholes = [*(p for _, p in self.phrases), *self.tokens]
        own: dict[int, list[int]] = {}
        for k, p in enumerate(self.wholes):
            own.setdefault(a.follow(p)[-1][0], []).append(k)
        self.ending: dict[int, list[int]] = {}
        for s in range(1, len(a.size)):
            up, found = s, []
            while up > 0:
                found += own.get(up, [])
                up = a.link[up]
            if found:
                self.ending[s] = found

    def stretch(self, tokens: list[str], first: int, places: list, whole: list, matches: list) -> None:
        """Adds the phrases' places (label, first word), those of whole templates (template, first word, last word), which
        may lie within longer matches of others, and the longest matches (first word, last word, state)."""
        stats = self.automaton.follow(tokens)
        for k, (state, n) in enumerate(stats):
            for p in self.ending.get(state, ()):
                size = len(self.wholes[p])
                if n >= size and p < len(self.phrases):
                    places.append((self.phrases[p][0], first + k - size + 1))
                elif n >= size:
                    whole.append((p - len(self.phrases), first + k - size + 1, first + k))
            if n >= self.least and (k + 1 == len(stats) or stats[k + 1][1] <= n):
                matches.append((first + k - n + 1, first + k, state))

    def chained(self, matches: list) -> dict[int, list[tuple[int, int, int, int]]]:
        """For each template, for each match and place of it, the best chain that ends there: (last word, place in the
        template, words covered, first word). Matches are in the order of their last words."""
        best: dict[int, list[tuple[int, int, int, int]]] = {}
        for a, b, state in matches:
            n = b - a + 1
            for t, places in self.automaton.ends[state].items():
                if t >= len(self.tokens):
                    continue
                before, new = best.setdefault(t, []), []
                for e in places:
                    begin, score, start = e - n + 1, n, a
                    for pb, pe, covered, pstart in reversed(before):  # all ends that are near enough, the latest first
                        if a - pb - 1 > self.gap:
                            break
                        if pe < e and begin - pe - 1 <= self.gap:
                            fresh = min(a - 1 - pb, begin - 1 - pe, 0) + n
                            if fresh > 0 and covered + fresh > score:
                                score, start = covered + fresh, pstart
                    new.append((b, e, score, start))
                before += new
        return best

    def chains(self, matches: list, whole: list) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share covered): for each template its whole places and, from the best down, the
        chains that cover enough, none of which overlaps one before it."""
        taken: dict[int, Intervals] = {}
        out = []
        for t, a, b in whole:
            if taken.setdefault(t, Intervals([])).add(a, b + 1):
                out.append((self.labels[t], a, b, 1.0))
        for t, ends in self.chained(matches).items():
            enough = [x for x in ends if x[2] >= self.share * len(self.tokens[t])]
            for b, _, score, start in sorted(enough, key=lambda x: (-x[2], x[0])):
                if taken.setdefault(t, Intervals([])).add(start, b + 1):
                    out.append((self.labels[t], start, b, min(1.0, score / len(self.tokens[t]))))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, least: int = 3, gap: int = 12, share: float = 0.6) -> DataFrame:
    """doc_id, n_words, places (phrase label, first word) and spans (template label, first and last word, share covered)."""
    ship(docs.sparkSession)
    scanner = Scanner(templates or TEMPLATES, phrases or PHRASES, least, gap, share)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for part in text_slices(batches):
            w = Words(part.column("text"), ALNUM)
            grams, at = ngrams(w.hashes(), w.first, 2)
            hit = at[s.pairs.find(grams)[0]]
            places: list[list] = [[] for _ in range(w.n)]
            matches: list[list] = [[] for _ in range(w.n)]
            wholes: list[list] = [[] for _ in range(w.n)]
            if len(hit):
                owner = np.searchsorted(w.first, hit, "right") - 1
                cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(owner) > 0)) + 1
                for a, b, d in zip(hit[np.concatenate([[0], cut])].tolist(), hit[np.concatenate([cut - 1, [len(hit) - 1]])].tolist(), owner[np.concatenate([[0], cut])].tolist(), strict=True):
                    tokens = [w.data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(w.starts[a : b + 2].tolist(), w.ends[a : b + 2].tolist(), strict=True)]
                    s.stretch(tokens, a - int(w.first[d]), places[d], wholes[d], matches[d])
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array([[{"label": x, "word": k} for x, k in p] for p in places], place), pa.array([[dict(zip(("label", "first", "last", "share"), c, strict=True)) for c in (s.chains(m, x) if m or x else [])] for m, x in zip(matches, wholes, strict=True)], span)],
                names=["doc_id", "n_words", "places", "spans"],
            )

    schema = "doc_id long, n_words long, places array<struct<label:string,word:long>>, spans array<struct<label:string,first:long,last:long,share:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    The score is the largest share of a template that is covered, 0.5 at least where a phrase stands."""
    base, more = F.transform("places", lambda p: p["label"]), F.transform("spans", lambda s: s["label"])
    listed = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    at = F.transform("places", lambda p: p["word"])
    return scan(docs).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, more)).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
