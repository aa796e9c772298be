"""License scan by templates whose markup is compiled to token automata.

A template is a licence's wording with two kinds of markup:

* ``[[ ... ]]``       an optional region (it may hold markup itself);
* ``{{a b|c|}}``      a replaceable region: one of the listed wordings (an empty one included);
* ``{{*m-n}}``        a replaceable region of any m to n words (a name, a year, an organisation).

Everything else is mandatory and must stand in the text word by word; case, punctuation and white
space do not count, since texts and templates are compared as words.  Every template becomes one
automaton over words; its states are made deterministic while they are met, and kept.  A template
must start with three words that no region of any words can replace: those beginnings, as hashes
of three words, are looked up at all positions of a text at once, and the automata run from there
only.  From one start the longest accepted wording counts.  A run is never longer than its
template, so a text of n words takes at most n times the longest template.

Phrases (the base) are templates without markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineup.llm.common import byte_slices
from lineup.llm.words import ALNUM_LOWER, Words

#: Words of a beginning.
ENTRY = 3

#: Phrases of the base and their labels (fixed values).
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

_BSD_DISCLAIMER = """
this software is provided by {{*1-12}} as is and any express or implied warranties including but not limited to
the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall
{{*1-12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not
limited to procurement of substitute goods or services loss of use data or profits or business interruption
however caused and on any theory of liability whether in contract strict liability or tort including negligence
or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage
"""
_BSD_CONDITIONS = """
redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of
conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice
this list of conditions and the following disclaimer in the documentation and or other materials provided with the
distribution
"""
_GNU_NOTICE = """
is free software you can redistribute it and or modify it under the terms of the gnu {{kind}}general public
{{license|licence}} as published by the free software foundation either version {{number}} of the license or [[at your
option]] any later version
"""

#: Wordings of public licences and notices (fixed values); several may share a label.
TEMPLATES = [
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and
        associated documentation files the software to deal in the software without restriction including without
        limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
        software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice [[including the next paragraph]] shall be included in
        all copies or substantial portions of the software the software is provided as is without warranty of any kind
        express or implied including but not limited to the warranties of merchantability fitness for a particular
        purpose and noninfringement in no event shall {{*1-12}} be liable for any claim damages or other liability
        whether in an action of contract tort or otherwise arising from out of or in connection with the software or
        the use or other dealings in the software"""),
    ("mit", "{{released|licensed|licenced|distributed|available}} under the [[terms of the]] mit {{license|licence}}"),
    ("isc", """permission to use copy modify and {{and or |or |}}distribute this software for any purpose with or without
        fee is hereby granted provided that the above copyright notice and this permission notice appear in all
        copies the software is provided as is and {{*1-12}} disclaims all warranties with regard to this software
        including all implied warranties of merchantability and fitness in no event shall {{*1-12}} be liable for any
        special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data
        or profits whether in an action of contract negligence or other tortious action arising out of or in
        connection with the use or performance of this software"""),
    ("bsd-2", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("bsd-3", _BSD_CONDITIONS + """[[3]] neither the name of {{*1-12}} nor the names of its contributors may be used
        to endorse or promote products derived from this software without specific prior written permission"""
     + _BSD_DISCLAIMER),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors
        be held liable for any damages arising from the use of this software permission is granted to anyone to use
        this software for any purpose including commercial applications and to alter it and redistribute it freely
        subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must
        not claim that you wrote the original software if you use this software in a product an acknowledgment in
        the product documentation would be appreciated but is not required [[2]] altered source versions must be
        plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may
        not be removed or altered from any source distribution"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy
        modify publish use compile sell or distribute this software either in source code form or as a compiled
        binary for any purpose commercial or non commercial and by any means"""),
    ("apache-2", """licensed under the apache license version 2 0 [[the license]] [[you may not use this file except
        in compliance with the license [[you may obtain a copy of the license at {{*1-12}} unless required by
        applicable law or agreed to in writing software distributed under the license is distributed on an as is
        basis without warranties or conditions of any kind either express or implied see the license for the
        specific language governing permissions and limitations under the license]]]]"""),
    ("gpl-2", "{{*program}} " + _GNU_NOTICE.replace("{{kind}}", "").replace("{{number}}", "2")),
    ("gpl-3", "{{*program}} " + _GNU_NOTICE.replace("{{kind}}", "").replace("{{number}}", "3")),
    ("lgpl-2.1", "{{*program}} " + _GNU_NOTICE.replace("{{kind}}", "lesser ").replace("{{number}}", "2 1")),
    ("lgpl-3", "{{*program}} " + _GNU_NOTICE.replace("{{kind}}", "lesser ").replace("{{number}}", "3")),
    ("agpl-3", "{{*program}} " + _GNU_NOTICE.replace("{{kind}}", "affero ").replace("{{number}}", "3")),
    ("gpl-2", "gnu general public {{license|licence}} version 2 [[0]]"),
    ("gpl-3", "gnu general public {{license|licence}} version 3 [[0]]"),
    ("lgpl-2.1", "gnu lesser general public {{license|licence}} version 2 1"),
    ("lgpl-3", "gnu lesser general public {{license|licence}} version 3 [[0]]"),
    ("agpl-3", "gnu affero general public {{license|licence}} version 3 [[0]]"),
    ("mpl-2", """this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the
        mpl was not distributed with this file you can obtain one at {{*1-8}}]]"""),
    ("mpl-2", "mozilla public license {{version|v}} 2 0"),
    ("epl-2", "eclipse public license {{version|v}} 2 0"),
    ("boost-1", "boost software license version 1 0"),
    ("cc0-1", "cc0 1 0 universal [[public domain dedication]]"),
    ("cc-by-nc", "licensed under [[a]] cc by nc {{2|2 0|2 5|3|3 0|4|4 0}}"),
    ("cc-by-nc", "creative commons attribution {{noncommercial|non commercial}} {{1|2|3|4}} 0 [[international]]"),
    ("cc-by", "creative commons attribution {{1|2|3|4}} 0 [[international|unported]]"),
    ("cc-by-sa", "creative commons attribution {{sharealike|share alike}} {{1|2|3|4}} 0 [[international]]"),
]
#: How a notice may name the work it is about.
_PROGRAM = "{{this program|this software|this library|this file|this work}}"
TEMPLATES = [(label, text.replace("{{*program}}", _PROGRAM)) for label, text in TEMPLATES]


def _split(text: str) -> list[bytes]:
    return text.encode().translate(ALNUM_LOWER).split()


class Automaton:
    """Token automaton of one template: ``step`` by word, ``accepts`` by state.

    Inside, states of a nondeterministic automaton are numbers with edges by word, an edge for any word
    and empty edges; a state of the automaton is a set of those, numbered when first met."""

    def __init__(self, template: str):
        self._word: list[dict[bytes, set[int]]] = []
        self._any: list[set[int]] = []
        self._empty: list[set[int]] = []
        self.alphabet: set[bytes] = set()
        end = self._compile(template, self._new())
        self._final = end
        self._numbers: dict[frozenset[int], int] = {}
        self._sets: list[frozenset[int]] = []
        self.accepts: list[bool] = []
        self._next: dict[tuple[int, bytes | None], int] = {}
        self.start = self._number(frozenset([0]))

    def _new(self) -> int:
        self._word.append({})
        self._any.append(set())
        self._empty.append(set())
        return len(self._word) - 1

    def _add(self, state: int, words: list[bytes]) -> int:
        for w in words:
            after = self._new()
            self._word[state].setdefault(w, set()).add(after)
            self.alphabet.add(w)
            state = after
        return state

    def _compile(self, template: str, state: int) -> int:
        opened: list[int] = []
        for mark, region, words in re.findall(r"(\[\[|\]\])|\{\{(.*?)\}\}|((?:(?!\[\[|\]\]|\{\{).)+)", template, re.S):
            if mark == "[[":
                opened.append(state)
            elif mark == "]]":
                if not opened:
                    raise ValueError("an optional region ends that never began")
                after = self._new()
                self._empty[opened.pop()].add(after)
                self._empty[state].add(after)
                state = after
            elif words:
                state = self._add(state, _split(words))
            elif region.startswith("*"):
                least, most = map(int, region[1:].split("-"))
                after = self._new()
                for i in range(most + 1):
                    if i >= least:
                        self._empty[state].add(after)
                    if i < most:
                        following = self._new()
                        self._any[state].add(following)
                        state = following
                state = after
            else:
                after = self._new()
                for wording in region.split("|"):
                    self._empty[self._add(state, _split(wording))].add(after)
                state = after
        if opened:
            raise ValueError("an optional region never ends")
        return state

    def _number(self, states: Iterable[int]) -> int:
        found, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in found:
                found.add(s)
                todo.extend(self._empty[s])
        key = frozenset(found)
        if key not in self._numbers:
            self._numbers[key] = len(self._sets)
            self._sets.append(key)
            self.accepts.append(self._final in key)
        return self._numbers[key]

    def step(self, state: int, word: bytes) -> int:
        """The state after ``word``; a state that leads nowhere is empty (``dead``)."""
        word = word if word in self.alphabet else None
        if (state, word) not in self._next:
            after: set[int] = set()
            for s in self._sets[state]:
                after |= self._any[s]
                after |= self._word[s].get(word, set())
            self._next[state, word] = self._number(after)
        return self._next[state, word]

    def dead(self, state: int) -> bool:
        return not self._sets[state]

    def beginnings(self, n: int) -> set[tuple[bytes, ...]]:
        """All ``n``-word beginnings of accepted texts; an error where any word may stand among them."""
        out: set[tuple[bytes, ...]] = set()
        todo: list[tuple[int, tuple[bytes, ...]]] = [(self.start, ())]
        while todo:
            state, words = todo.pop()
            if len(words) == n:
                out.add(words)
                continue
            if self.accepts[state] or any(self._any[s] for s in self._sets[state]):
                raise ValueError(f"a template must begin with {n} given words")
            for w in set().union(*(self._word[s] for s in self._sets[state])):
                todo.append((self.step(state, w), (*words, w)))
        return out

    def longest(self, words: Iterator[bytes]) -> int:
        """Words of the longest accepted beginning of ``words`` (0: none)."""
        state, best = self.start, 0
        for i, word in enumerate(words, 1):
            state = self.step(state, word)
            if self.accepts[state]:
                best = i
            if self.dead(state):
                break
        return best


@dataclass
class Found:
    label: str
    base: bool
    start: int
    end: int


class Scanner:
    """All templates, entered through a table of the hashes of their beginnings."""

    def __init__(self, base: list[tuple[str, str]], templates: list[tuple[str, str]]):
        self.automata = [(label, True, Automaton(t)) for label, t in base] + [
            (label, False, Automaton(t)) for label, t in templates]
        self.entries: dict[int, list[int]] = {}
        for i, (_, _, automaton) in enumerate(self.automata):
            for words in sorted(automaton.beginnings(ENTRY)):
                h = int(Words([b" ".join(words)], ALNUM_LOWER).windows(ENTRY)[0])
                self.entries.setdefault(h, []).append(i)
        self._low = np.zeros(1 << 16, bool)
        self._low[[h & 0xFFFF for h in self.entries]] = True

    def scan(self, words: Words) -> list[list[Found]]:
        """For each text the accepted wordings, by start."""
        out: list[list[Found]] = [[] for _ in words.count]
        if not len(words):
            return out
        hashes = words.windows(ENTRY)
        maybe = np.flatnonzero(self._low[hashes & np.uint64(0xFFFF)] & words.whole(ENTRY))
        for at in maybe.tolist():
            for i in self.entries.get(int(hashes[at]), ()):
                label, base, automaton = self.automata[i]
                d = int(np.searchsorted(words.first, at, side="right")) - 1
                stop = int(words.first[d + 1])
                # the automaton compares the words themselves: equal hashes alone accept nothing
                n = automaton.longest(words.data[words.start[j]:words.end[j]] for j in range(at, stop))
                if n:
                    out[d].append(Found(label, base, at - int(words.first[d]), at - int(words.first[d]) + n))
        return out


def scan_licenses(docs: DataFrame, base: list[tuple[str, str]] | None = None,
                  templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_words, spans, covered``; ``spans`` lists every
    accepted wording (``label, base, start, end``: words from 0, end exclusive) by start, ``covered``
    counts the words inside any of them.

    Defined cases.  A NULL or empty text has no words and no spans; texts of any length are read whole;
    rows are scanned each by itself, so repeated rows, equal or NULL doc_ids keep their own results; an
    empty table gives an empty result; other columns are not read.
    """
    base = BASE if base is None else base
    templates = TEMPLATES if templates is None else templates
    Scanner(base, templates)  # a broken template is an error here, not in a task
    span = "struct<label: string, base: boolean, start: long, end: long>"

    def scan(batches: Iterable[pa.RecordBatch]):
        scanner = Scanner(base, templates)
        kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))
        for rows, texts in byte_slices(batches):
            words = Words(texts, ALNUM_LOWER)
            spans, covered = [], []
            for found in scanner.scan(words):
                found.sort(key=lambda f: (f.start, f.end, f.label, not f.base))
                total, reach = 0, 0
                for f in found:
                    total += max(0, f.end - max(f.start, reach))
                    reach = max(reach, f.end)
                spans.append([f.__dict__ for f in found])
                covered.append(total)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(words.count, pa.int64()), pa.array(spans, kind), pa.array(covered, pa.int64())],
                ["doc_id", "n_words", "spans", "covered"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
                       ).mapInArrow(scan, f"doc_id long, n_words long, spans array<{span}>, covered long")


def label_text(spans: Column) -> Column:
    """The distinct labels of ``spans``, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
