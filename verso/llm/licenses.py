"""License scans by template-markup matching.

A template is license wording with markup: ``[[...]]`` may be absent and
``{{a..b}}`` stands for ``a`` to ``b`` words of the author's own. It is
compiled into an automaton over tokens that accepts a text only if all
mandatory wording stands there, word for word. Short phrases are labels of
their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.llm.common import table

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Wording of public licenses and notices, by label.
TEMPLATES = {
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and
        associated documentation files {{0..4}} to deal in the software without restriction including without limitation
        the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to
        permit persons to whom the software is furnished to do so subject to the following conditions the above
        copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or
        substantial portions of the software""",
    "isc-text": """permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is
        hereby granted provided that the above copyright notice and this permission notice appear in all copies""",
    "bsd-2-clause": """redistribution and use in source and binary forms with or without modification are permitted provided
        that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice
        this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other materials
        provided with the distribution""",
    "bsd-3-clause": """redistribution and use in source and binary forms with or without modification are permitted provided
        that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice
        this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other materials
        provided with the distribution [[3]] neither the name of {{1..12}} nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission""",
    "apache-2.0-notice": """licensed under the apache license version 2 0 the license you may not use this file except in
        compliance with the license""",
    "gpl-notice": """this program is free software you can redistribute it and or modify it under the terms of the gnu
        general public license as published by the free software foundation [[either]] version {{1..3}} of the license
        [[or at your option any later version]]""",
    "lgpl-notice": """under the terms of the gnu lesser general public license as published by the free software
        foundation""",
    "agpl-notice": """under the terms of the gnu affero general public license as published by the free software
        foundation""",
    "gpl-disclaimer": """this program is distributed in the hope that it will be useful but without any warranty without even the
        implied warranty of merchantability or fitness for a particular purpose see the gnu [[affero]] [[lesser]] general
        public license for more details""",
    "apache-2.0-disclaimer": """unless required by applicable law or agreed to in writing software distributed under the
        license is distributed on an as is basis without warranties or conditions of any kind either express or implied
        see the license for the specific language governing permissions and limitations under the license""",
    "mit-disclaimer": """the software is provided as is without warranty of any kind express or implied including but not
        limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event
        shall the {{1..8}} be liable for any claim damages or other liability whether in an action of contract tort or
        otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "bsd-disclaimer": """this software is provided by {{1..12}} as is and any express or implied warranties including but not
        limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed""",
    "mpl-2.0-notice": """this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of
        the mpl was not distributed with this file you can obtain one at]]""",
    "unlicense": """this is free and unencumbered software released into the public domain [[anyone is free to copy modify
        publish use compile sell or distribute this software either in source code form or as a compiled binary for any
        purpose commercial or non commercial and by any means]]""",
    "bsl-1.0": """permission is hereby granted free of charge to any person or organization obtaining a copy of the software
        and accompanying documentation covered by this license the software to use reproduce display distribute execute
        and transmit the software and to prepare derivative works of the software and to permit third parties to whom the
        software is furnished to do so""",
    "zlib-text": """this software is provided as is without any express or implied warranty in no event will the {{1..4}} be
        held liable for any damages arising from the use of this software permission is granted to anyone to use this
        software for any purpose including commercial applications and to alter it and redistribute it freely""",
    "cc-notice": """creative commons attribution [[noncommercial]] [[sharealike]] [[noderivatives]] {{0..2}} [[international]]
        [[public]] license""",
    "spdx-tag": "spdx license identifier {{1..1}}",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache-2.0": "spdx license identifier apache 2 0",
    "spdx-gpl": "spdx license identifier gpl [[2]] [[3]] [[0]] [[only]] [[or later]]",
    "spdx-bsd": "spdx license identifier bsd {{1..1}} clause",
    "spdx-mpl-2.0": "spdx license identifier mpl 2 0",
    "mit-notice": "under the [[terms of the]] mit license",
    "apache-notice": "under the [[terms of the]] apache license [[version]] [[2]] [[0]]",
    "gpl-short-notice": "under the [[terms of the]] [[gnu]] general public license [[version]] [[2]] [[3]]",
}

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER_TO_LOWER = {i: i + 32 for i in range(65, 91)}
_WORD = re.compile(WORD_PATTERN)


def words_of(text: str) -> list[str]:
    """Words of a text whose A-Z are lower-cased."""
    return _WORD.findall(text.translate(UPPER_TO_LOWER))


@dataclass(frozen=True)
class Automaton:
    """States are positions in ``steps``; a step is (word, next) or (None, next) for any word, ``skips`` are moves without a word."""

    label: str
    opening: tuple[str, ...]
    anchor: str
    steps: tuple[tuple[str | None, int], ...]
    skips: tuple[tuple[int, ...], ...]

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def match(self, words: list[str], at: int) -> int:
        """The end of the longest accepted run from ``at``, or -1."""
        final, best = len(self.steps), -1
        states = self.closure({0})
        while states:
            if final in states:
                best = at
            if at >= len(words):
                break
            word = words[at]
            states = self.closure({self.steps[s][1] for s in states if s < final and self.steps[s][0] in (None, word)})
            at += 1
        return best


def compile_template(label: str, markup: str) -> Automaton:
    """A template to its automaton. It must open with mandatory wording."""
    steps: list[tuple[str | None, int]] = []
    skips: dict[int, set[int]] = {}
    opening: list[str] = []
    plain = True
    for piece in re.findall(r"\[\[.*?\]\]|\{\{.*?\}\}|[^\[\]{}]+", markup, flags=re.S):
        begin = len(steps)
        if piece.startswith("{{"):
            least, most = map(int, re.fullmatch(r"\{\{(\d+)\.\.(\d+)\}\}", piece).groups())
            for i in range(most):
                steps.append((None, len(steps) + 1))
                if i >= least:
                    skips.setdefault(begin + i, set()).add(begin + most)
            plain = False
        else:
            optional = piece.startswith("[[")
            for w in words_of(piece):
                steps.append((w, len(steps) + 1))
                if plain and not optional:
                    opening.append(w)
            if optional:
                skips.setdefault(begin, set()).add(len(steps))
            plain = plain and not optional
    if not opening:
        raise ValueError(f"template {label} must open with mandatory wording")
    return Automaton(label, tuple(opening[:3]), max(opening[:3], key=len), tuple(steps), tuple(tuple(skips.get(i, ())) for i in range(len(steps) + 1)))


def scan(words: list[str], automata: list[Automaton]) -> tuple[list[tuple[int, int]], set[str], list[tuple[int, int]], set[str]]:
    """Phrase places and labels, template places and labels of a text.

    A template that is accepted inside a longer accepted one, as the opening
    of a longer license, counts as part of that.
    """
    at: dict[str, list[int]] = {}
    wanted = {p.split()[0] for p, _ in PHRASES} | {a.opening[0] for a in automata}
    for i, w in enumerate(words):
        if w in wanted:
            at.setdefault(w, []).append(i)
    base, labels = [], set()
    for phrase, label in PHRASES:
        parts = phrase.split()
        for i in at.get(parts[0], ()):
            if words[i : i + len(parts)] == parts:
                base.append((i, i + len(parts)))
                labels.add(label)
    accepted = []
    for a in automata:
        for i in at.get(a.opening[0], ()):
            if tuple(words[i : i + len(a.opening)]) == a.opening and (end := a.match(words, i)) >= 0:
                accepted.append((i, -end, a.label))
    more, found, reach, begin = [], set(), -1, -1
    for i, end, label in sorted(accepted):  # in order of the start, the longest first
        if -end > reach or (i, -end) == (begin, reach):
            more.append((i, -end))
            found.add(label)
            begin, reach = i, max(reach, -end)
    return base, labels, more, found


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row a document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is the share of the words that stand in a phrase or an accepted
    template. Null and empty texts have no words and score 0; repeated rows
    are scanned alike; a very long text is scanned as a whole, in time linear
    in its words. Only texts that have one of the words which every phrase or
    template needs go to Python; counting words stays in the engine.
    """
    automata = [compile_template(k, v) for k, v in (TEMPLATES if templates is None else templates).items()]
    needed = {max(p.split(), key=len) for p, _ in PHRASES} | {a.anchor for a in automata}
    either = "|".join("".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else re.escape(c) for c in w) for w in sorted(needed))
    text = F.coalesce(F.col("text"), F.lit(""))
    count = F.size(F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))).cast("long")
    row = docs.select("doc_id", count.alias("n_words"), F.when(text.rlike(either), text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                words = words_of(text) if text is not None else []  # null: no word that any of them needs
                base, labels, more, found = scan(words, automata)
                covered: set[int] = set()
                for a, b in base + more:
                    covered.update(range(a, b))
                starts = [a for a, _ in base]
                out.append((len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found)), len(covered) / len(words) if words else 0.0))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [c.split()[0] for c in schema.split(", ")])

    return row.mapInArrow(look, schema)


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """Phrases and templates of every document; null, empty, repeated and long texts and empty tables as in ``scan_licenses``."""
    return scan_licenses(table(spark, sf_dir, "documents"))
