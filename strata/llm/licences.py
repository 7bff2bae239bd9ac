"""Licence scan: matching statistics over a generalised suffix automaton of licence words, chained into covered spans.

The automaton accepts every run of words that occurs in a template or base phrase. A text streams through it word by
word; at each word the state and length give the longest run ending there that occurs in some template. Base phrases
are read off the same walk: each state lists the phrases that end there. Long maximal runs are kept and, for each template,
chained in text order with rising template positions and bounded gaps; a run that a template has at several places may stand
for each of them. A chain that covers enough of its template (a short one must be whole) is a covered span. Of spans that lie
one over another, the one with most words covered gives its label: versions of a licence share most of their words.

Words: runs of ASCII digits, letters and non-ASCII characters after lower-casing A-Z.

Defined cases: a null text is empty: no words, no labels, score 0; an empty table gives no rows; repeated rows give equal
rows; the walk is linear in the text.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_texts

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening words or notices of well-known licences, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Further texts by label: whole short licences, headings of long ones, notices.
NOTICES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "apache-2": ("apache license version 2 0 january 2004",),
    "gpl-1": ("gnu general public license version 1 february 1989",),
    "gpl-2": ("gnu general public license version 2 june 1991", "this work is licensed under the gnu general public license version 2"),
    "gpl-3": ("gnu general public license version 3 29 june 2007", "this work is licensed under the gnu general public license version 3"),
    "lgpl-2": ("gnu library general public license version 2 june 1991",),
    "lgpl-2.1": ("gnu lesser general public license version 2 1 february 1999",),
    "lgpl-3": ("gnu lesser general public license version 3 29 june 2007",),
    "agpl-3": ("gnu affero general public license version 3 19 november 2007",),
    "gfdl-1.2": ("gnu free documentation license version 1 2 november 2002",),
    "gfdl-1.3": ("gnu free documentation license version 1 3 3 november 2008",),
    "mpl-1.1": (
        "mozilla public license version 1 1 1 definitions",
        "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "mpl-2": ("mozilla public license version 2 0 1 definitions",),
    "artistic": ("the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package",),
    "cc0-1": ("creative commons legal code cc0 1 0 universal",),
}
MIN_RUN = 4
MAX_GAP = 12
COVERED = 0.6
#: Templates of fewer words must be covered whole.
SHORT = 20
_KEEP = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_automaton = None


class SuffixAutomaton:
    """Generalised over several word sequences; for each state also its places in each sequence and the phrases ending there."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[tuple[str, int], list[int]]] = [{}]
        self.phrases: list[list[tuple[str, int]]] = [[]]

    def _state(self, length: int, follow: dict[bytes, int]) -> int:
        self.next.append(follow)
        self.link.append(0)
        self.length.append(length)
        self.places.append({})
        return len(self.next) - 1

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is None:
            made = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = made
                p = self.link[p]
            if p < 0:
                self.link[made] = 0
                return made
        else:
            p, made = last, None
        q = self.next[p][word]
        if self.length[q] != self.length[p] + 1:
            twin = self._state(self.length[p] + 1, dict(self.next[q]))
            self.link[twin], self.link[q] = self.link[q], twin
            while p >= 0 and self.next[p].get(word) == q:
                self.next[p][word] = twin
                p = self.link[p]
            q = twin
        if made is None:
            return q
        self.link[made] = q
        return made

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def finish(self, templates: dict[tuple[str, int], list[bytes]], phrases: dict[str, list[bytes]]) -> SuffixAutomaton:
        """End positions of each state's run in each template; phrases that end at each state."""
        for name, words in templates.items():
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                v = state
                while v > 0:
                    self.places[v].setdefault(name, []).append(i)
                    v = self.link[v]
        ends = {}
        for label, words in phrases.items():
            state = 0
            for w in words:
                state = self.next[state][w]
            ends.setdefault(state, []).append((label, len(words)))
        self.phrases = []
        for v in range(len(self.next)):
            own, u = [], v
            while u > 0:
                own += ends.get(u, [])
                u = self.link[u]
            self.phrases.append(own)
        self.words = frozenset(w for follow in self.next for w in follow)
        return self


def split_words(text: str) -> list[bytes]:
    return text.encode().translate(_KEEP).split()


def licence_automaton() -> SuffixAutomaton:
    global _automaton
    if _automaton is None:
        texts = {**{(k, 0): t for k, t in TEMPLATES.items()}, **{(k, i): t for k, own in NOTICES.items() for i, t in enumerate(own, 1)}}
        templates = {name: split_words(t) for name, t in texts.items()}
        phrases = {k: split_words(p) for p, k in PHRASES.items()}
        a = SuffixAutomaton()
        for words in (*templates.values(), *phrases.values()):
            a.add(words)
        _automaton = (a.finish(templates, phrases), {k: len(w) for k, w in templates.items()})
    return _automaton


def walk(words: list[bytes]):
    """(places, runs): base phrases as (start, label), and maximal runs of MIN_RUN words or more as (start, length, state)."""
    a, _ = licence_automaton()
    follow, link, length, phrases, known = a.next, a.link, a.length, a.phrases, a.words
    places, runs = [], []
    state = n = 0
    last = -2
    for i in [i for i, w in enumerate(words) if w in known]:
        w = words[i]
        if i != last + 1:
            if n >= MIN_RUN:
                runs.append((last + 1 - n, n, state))
            state = n = 0
        last = i
        if w not in follow[state]:
            if n >= MIN_RUN:
                runs.append((i - n, n, state))
            while state and w not in follow[state]:
                state = link[state]
            n = length[state]
        state = follow[state].get(w, 0)
        n = n + 1 if state else 0
        for label, size in phrases[state]:
            if n >= size:
                places.append((i - size + 1, label))
    if n >= MIN_RUN:
        runs.append((last + 1 - n, n, state))
    return places, runs


def chain(runs) -> list[tuple[str, int, int, float]]:
    """label, first word, end word, share of the template covered, of the chains that cover enough and that no better one overlaps."""
    a, sizes = licence_automaton()
    found = []
    for name in {name for _, _, state in runs for name in a.places[state]}:
        size = sizes[name]
        best: list[tuple[int, int, int, int]] = []  # words covered, first word, end word, template end
        for start, n, state in runs:
            made = []
            for end in a.places[state].get(name, ()):
                covered, first = n, start
                for c, f, e, t in best:
                    if e <= start <= e + MAX_GAP and t < end - n + 1 <= t + 1 + MAX_GAP and c + n > covered:
                        covered, first = c + n, f
                made.append((covered, first, start + n, end))
                if covered >= (COVERED if size >= SHORT else 1.0) * size:
                    found.append((covered, first, start + n, name[0], min(1.0, covered / size)))
            best = [b for b in best if b[2] + MAX_GAP >= start] + made
    # Those kept so far don't overlap, so in their order only two can be in the way of another.
    firsts: list[int] = []
    kept: list[tuple[str, int, int, float]] = []
    for covered, first, end, label, share in sorted(found, key=lambda f: (-f[0], *f[1:])):
        at = bisect_right(firsts, first)
        if (not at or kept[at - 1][2] <= first) and (at == len(kept) or firsts[at] >= end):
            firsts.insert(at, first)
            kept.insert(at, (label, first, end, share))
    return kept


def licence_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base array<string> of label:word, covered array<string> of label:first:end:share."""

    def row(text: str):
        words = split_words(text)
        places, runs = walk(words)
        return len(words), [f"{label}:{at}" for at, label in places], [f"{k}:{a}:{b}:{s:.4f}" for k, a, b, s in chain(runs)]

    return map_texts(docs, row, "n_words long, base array<string>, covered array<string>")


def op4_licences_automaton(spark, sf_dir):
    found = licence_spans(documents(spark, sf_dir))
    label = lambda s: F.substring_index(s, ":", 1)
    at = F.transform("base", lambda s: F.substring_index(s, ":", -1).cast("long"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, label))), ",")
    share = F.array_max(F.transform("covered", lambda s: F.substring_index(s, ":", -1).cast("double")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined("base").alias("base_labels"),
        joined(F.concat("base", "covered")).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
        F.array_join("covered", ",").alias("covered_spans"),
    )
