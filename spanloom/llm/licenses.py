"""License scans by template-markup matching.

A template is a license text with markup: optional regions, replaceable regions
of a bounded number of words, and alternatives. It is compiled into an automaton
over words; a text is accepted from some word on when all mandatory words match
exactly, in order, with nothing else between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases with the label each stands for.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The wording of public licenses. [[...]] is optional, {a|b} one of
# several wordings, <<n>> up to n words that may be replaced.
TEMPLATES = {
    "mit-notice": """{released|licensed|distributed|available} under the [[terms of the]] mit license""",
    "apache-2.0-notice": """licensed under the apache license [[version]] 2 0""",
    "gpl-notice": """licensed under the [[terms of the]] gnu [[{lesser|affero}]] general public license
        [[as published by the free software foundation]] [[{version|v}]] <<1>> [[or later]]""",
    "gpl-header": """redistribute it and or modify it under the terms of the gnu general public license as published by
        the free software foundation [[either]] [[version <<2>> [[of the license]]]] [[or at your option any later version]]""",
    "lgpl-header": """redistribute it and or modify it under the terms of the gnu {lesser|library} general public license as published by
        the free software foundation [[either]] [[version <<2>> [[of the license]]]] [[or at your option any later version]]""",
    "agpl-header": """redistribute it and or modify it under the terms of the gnu affero general public license as published by
        the free software foundation [[either]] [[version <<2>> [[of the license]]]] [[or at your option any later version]]""",
    "cc-notice": """licensed under [[a|the]] {cc|creative commons} {by|attribution} [[{nc|noncommercial}]]
        [[{sa|sharealike|nd|noderivatives}]] [[<<1>> 0]] [[international]] [[license]]""",
    "mit": """[[the mit license [[mit]]]] [[copyright <<12>>]] [[all rights reserved]] permission is hereby granted free of
        charge to any person obtaining a copy of this software and associated documentation files the software to deal in
        the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished
        to do so subject to the following conditions the above copyright notice and this permission notice
        [[including the next paragraph]] shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the
        {authors or copyright holders|<<8>>} be liable for any claim damages or other liability whether in an action of
        contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in
        the software""",
    "isc": """[[isc license]] [[copyright <<12>>]] permission to use copy modify and or distribute this software for any
        purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice
        appear in all copies the software is provided as is and {the author|<<6>>} disclaims all warranties with regard
        to this software including all implied warranties of merchantability and fitness in no event shall
        {the author|<<6>>} be liable for any special direct indirect or consequential damages or any damages whatsoever
        resulting from loss of use data or profits whether in an action of contract negligence or other tortious action
        arising out of or in connection with the use or performance of this software""",
    "bsd-3-clause": """[[copyright <<12>>]] [[all rights reserved]] redistribution and use in source and binary forms with
        or without modification are permitted provided that the following conditions are met [[1]] redistributions of
        source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]]
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the
        following disclaimer in the documentation and or other materials provided with the distribution [[3]] neither the
        name of <<10>> nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission this software is provided by <<10>> as is and any express or
        implied warranties including but not limited to the implied warranties of merchantability and fitness for a
        particular purpose are disclaimed in no event shall <<12>> be liable for any direct indirect
        incidental special exemplary or consequential damages including but not limited to procurement of substitute goods
        or services loss of use data or profits or business interruption however caused and on any theory of liability
        whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use
        of this software even if advised of the possibility of such damage""",
    "bsd-2-clause": """[[copyright <<12>>]] [[all rights reserved]] redistribution and use in source and binary forms with
        or without modification are permitted provided that the following conditions are met [[1]] redistributions of
        source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]]
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the
        following disclaimer in the documentation and or other materials provided with the distribution this software is
        provided by <<10>> as is and any express or implied warranties including but not limited to the implied warranties
        of merchantability and fitness for a particular purpose are disclaimed in no event shall <<12>> be liable for any direct indirect
        incidental special exemplary or consequential damages including but not limited to procurement of substitute goods
        or services loss of use data or profits or business interruption however caused and on any theory of liability
        whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use
        of this software even if advised of the possibility of such damage""",
    "mpl-2.0-header": """this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the
        mpl was not distributed with this file you can obtain one at [[https]] [[http]] [[www]] mozilla org mpl 2 0]]""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify
        publish use compile sell or distribute this software either in source code form or as a compiled binary for any
        purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or
        authors of this software dedicate any and all copyright interest in the software to the public domain we make this
        dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this
        dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
        under copyright law the software is provided as is without warranty of any kind express or implied including but
        not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event
        shall the authors be liable for any claim damages or other liability whether in an action of contract tort or
        otherwise arising from out of or in connection with the software or the use or other dealings in the software
        [[for more information please refer to [[https]] [[http]] [[www]] unlicense org]]""",
    "apache-2.0-header": """licensed under the apache license version 2 0 the license you may not use this file except in
        compliance with the license you may obtain a copy of the license at [[https]] [[http]] www apache org licenses
        license 2 0 [[unless required by applicable law or agreed to in writing software distributed under the license is
        distributed on an as is basis without warranties or conditions of any kind either express or implied see the
        license for the specific language governing permissions and limitations under the license]]""",
}

# Label that an accepted template adds.
LABELS = {
    "mit-notice": "mit", "apache-2.0-notice": "apache-2.0", "gpl-notice": "gnu-gpl", "cc-notice": "creative-commons",
    "mit": "mit", "isc": "isc", "bsd-3-clause": "bsd-3-clause", "gpl-header": "gnu-gpl",
    "lgpl-header": "gnu-lgpl", "agpl-header": "gnu-agpl", "bsd-2-clause": "bsd-2-clause", "mpl-2.0-header": "mpl-2.0",
    "unlicense": "unlicense", "apache-2.0-header": "apache-2.0",
}

_MARKS = re.compile(r"\[\[|\]\]|<<\d+>>|[{}|]|[^\s\[\]{}|<>]+")


@dataclass(frozen=True)
class Automaton:
    """States with their words (`step[s][word]` -> next states) and free moves on any word (`skip[s]`)."""

    label: str
    start: frozenset[int]
    step: tuple[dict[bytes, frozenset[int]], ...]
    skip: tuple[frozenset[int], ...]
    final: int

    def first_words(self) -> set[bytes]:
        return {w for s in self.start for w in self.step[s]}

    def longest(self, found: Sequence[bytes], at: int) -> int:
        """Where the longest accepted run of words that starts at `at` ends; -1 without one."""
        live, end, i = self.start, -1, at
        while live and i < len(found):
            word, step, skip = found[i], self.step, self.skip
            live = frozenset(t for s in live for t in (step[s].get(word, frozenset()) | skip[s]))
            i += 1
            if self.final in live:
                end = i
        return end


class _Builder:
    """States and free moves of one template while it is read."""

    def __init__(self) -> None:
        self.words: list[dict[bytes, set[int]]] = []
        self.any: list[set[int]] = []
        self.free: list[set[int]] = []

    def state(self) -> int:
        self.words.append({})
        self.any.append(set())
        self.free.append(set())
        return len(self.words) - 1

    def choices(self, marks: list[str], at: int, begin: int, stop: str) -> tuple[int, int]:
        """Wordings parted by `|` from state `begin` on, up to `stop`; their common end and the next mark."""
        end = self.state()
        while True:
            now = begin
            while at < len(marks) and marks[at] not in (stop, "|"):
                now, at = self.element(marks, at, now)
            self.free[now].add(end)
            at += 1
            if at > len(marks) or marks[at - 1] == stop:
                return end, at

    def element(self, marks: list[str], at: int, now: int) -> tuple[int, int]:
        mark = marks[at]
        if mark == "[[":
            end, at = self.choices(marks, at + 1, now, "]]")
            self.free[now].add(end)
            return end, at
        if mark == "{":
            return self.choices(marks, at + 1, now, "}")
        if mark.startswith("<<"):
            end = self.state()
            self.free[now].add(end)
            for _ in range(int(mark[2:-2])):
                later = self.state()
                self.any[now].add(later)
                self.free[later].add(end)
                now = later
            return end, at + 1
        later = self.state()
        self.words[now].setdefault(mark.encode(), set()).add(later)
        return later, at + 1


def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template, its free moves already followed."""
    built = _Builder()
    begin = built.state()
    final, _ = built.choices(_MARKS.findall(template.lower()), 0, begin, "")

    def reach(states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in built.free[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return frozenset(seen)

    step = tuple({w: reach(t) for w, t in words.items()} for words in built.words)
    return Automaton(label, reach({begin}), step, tuple(reach(t) if t else frozenset() for t in built.any), final)


@dataclass(frozen=True)
class Findings:
    n_words: int
    places: list[tuple[int, int, str]]
    accepted: list[tuple[int, int, str]]


class Scanner:
    """All phrases and templates, looked up by the words they can start with."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str], labels: dict[str, str]) -> None:
        self.phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in phrases.items():
            parts = phrase.encode().split()
            self.phrases.setdefault(parts[0], []).append((parts, label))
        self.automata: dict[bytes, list[Automaton]] = {}
        for name, template in templates.items():
            automaton = compiled(labels[name], template)
            for word in automaton.first_words():
                self.automata.setdefault(word, []).append(automaton)
        self.starts = {*self.phrases, *self.automata}

    def scan(self, text: bytes) -> Findings:
        found = WORD.findall(text.lower())
        places, accepted = [], []
        for i in [i for i, w in enumerate(found) if w in self.starts]:
            for parts, label in self.phrases.get(found[i], ()):
                if found[i : i + len(parts)] == parts:
                    places.append((i, i + len(parts), label))
            for automaton in self.automata.get(found[i], ()):
                end = automaton.longest(found, i)
                if end >= 0:
                    accepted.append((i, end, automaton.label))
        return Findings(len(found), places, accepted)


SCAN_TYPE = (
    "doc_id long, n_words long, places array<struct<first:long,last:long,label:string>>, "
    "accepted array<struct<first:long,last:long,label:string>>"
)


def scanned(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES,
    labels: dict[str, str] = LABELS,
) -> DataFrame:
    """Where the whole text of each document holds phrases and accepted templates (words from 0, ends exclusive).

    A-Z is lower-cased; words are runs of digits, letters and non-ASCII
    characters. Null text counts as empty. One row per row of `docs`, other
    columns left out. Every start is tried, so places may overlap.
    """
    kind = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates, labels)
        for batch in batches:
            found = [scanner.scan((t.as_py() or "").encode()) for t in batch.column("text")]
            listed = lambda rows: [[{"first": a, "last": b, "label": c} for a, b, c in r] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([f.n_words for f in found], pa.int64()),
                    pa.array(listed(f.places for f in found), pa.list_(kind)),
                    pa.array(listed(f.accepted for f in found), pa.list_(kind)),
                ],
                names=["doc_id", "n_words", "places", "accepted"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, SCAN_TYPE)


def labelled(found: DataFrame) -> DataFrame:
    """Per document: how many places of phrases, their first and last word, labels, and the share of words under a match."""
    def listed(*columns: str):
        names = F.array_union(*[F.transform(c, lambda x: x["label"]) for c in columns]) if len(columns) > 1 else (
            F.array_distinct(F.transform(columns[0], lambda x: x["label"]))
        )
        return F.array_join(F.array_sort(names), ",")

    spans = F.sort_array(F.concat("places", "accepted"))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), x["last"] - F.greatest(x["first"], s["end"]))).alias("n"),
            F.greatest(s["end"], x["last"]).alias("end"),
        ),
        lambda s: s["n"],
    )
    starts = F.transform("places", lambda x: x["first"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed("places").alias("base_labels"), listed("places", "accepted").alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"),
    )
