"""Licence scans: marked-up templates compiled to token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.llm.common import small_batches

#: Phrases that are searched word by word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates by label. ``<<beginOptional>>``..``<<endOptional>>`` may be missing; in
#: ``<<var;name="..";match="..";words="a..b">>`` a to b words that match stand instead.
TEMPLATES = {
    "notice:apache-2.0": '<<beginOptional>>this <<var;name="what";match=".+";words="1..3">> is<<endOptional>> licensed under the '
    'apache license <<beginOptional>>version<<endOptional>> 2 0',
    "notice:cc-by": '<<beginOptional>>this work is<<endOptional>> <<var;name="how";match="licensed|released|available";words="1..1">> under '
    '<<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by <<var;name="version";match="[0-9]+";words="1..2">>',
    "notice:cc-by-nc": '<<beginOptional>>this work is<<endOptional>> <<var;name="how";match="licensed|released|available";words="1..1">> under '
    '<<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by nc <<var;name="version";match="[0-9]+";words="1..2">>',
    "notice:gpl": '<<var;name="what";match=".+";words="0..2">> is <<beginOptional>>free software and is<<endOptional>> licensed under the '
    'gnu <<beginOptional>>lesser<<endOptional>> general public license version <<var;name="version";match="[23]";words="1..1">> '
    '<<beginOptional>>or <<beginOptional>>at your option any<<endOptional>> later<<endOptional>>',
    "notice:mit": '<<var;name="how";match="released|licensed|distributed";words="1..1">> under the mit license',
    "header:agpl": 'you can redistribute it and or modify it under the terms of <<beginOptional>>version '
    '<<var;name="version";match="[0-9]+";words="1..2">> of<<endOptional>> the gnu affero general public license as '
    'published by the free software foundation',
    "header:apache-2.0": 'licensed under the apache license version 2 0 the license you may not use '
    '<<var;name="what";match="this|these";words="1..1">> <<var;name="files";match="files?";words="1..1">> except in '
    'compliance with the license',
    "header:gpl": 'you can redistribute it and or modify it under the terms of <<beginOptional>>version '
    '<<var;name="version";match="[0-9]+";words="1..2">> of<<endOptional>> the gnu general public license as '
    'published by the free software foundation',
    "header:lgpl": 'you can redistribute it and or modify it under the terms of <<beginOptional>>version '
    '<<var;name="version";match="[0-9]+";words="1..2">> of<<endOptional>> the gnu '
    '<<var;name="kind";match="lesser|library";words="1..1">> general public license as published by the free '
    'software foundation',
    "header:mpl-2.0": 'this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not '
    'distributed with this file you can obtain one at',
    "notice:cc0": 'to the extent possible under law <<var;name="who";match=".+";words="1..12">> has waived all copyright and '
    'related or <<var;name="spelling";match="neighbou?ring";words="1..1">> rights',
    "notice:creative-commons-by": 'creative commons attribution <<var;name="version";match="[0-9]+";words="1..2">> '
    '<<beginOptional>>international<<endOptional>> license',
    "notice:creative-commons-by-sa": 'creative commons attribution <<var;name="spelling";match="share|sharealike";words="1..1">> '
    '<<beginOptional>>alike<<endOptional>> <<var;name="version";match="[0-9]+";words="1..2">> '
    '<<beginOptional>>international<<endOptional>> license',
    "text:bsd-2": 'redistribution and use in source and binary forms with or without modification are permitted provided that the '
    'following conditions are met <<var;name="number";match="[0-9]+";words="0..1">> redistributions of source code '
    'must retain the above copyright notice this list of conditions and the following disclaimer '
    '<<var;name="number";match="[0-9]+";words="0..1">> redistributions in binary form must reproduce the above '
    'copyright notice this list of conditions and the following disclaimer in the documentation and or other '
    'materials provided with the distribution',
    "text:bsd-3": 'redistribution and use in source and binary forms with or without modification are permitted provided that the '
    'following conditions are met <<var;name="number";match="[0-9]+";words="0..1">> redistributions of source code '
    'must retain the above copyright notice this list of conditions and the following disclaimer '
    '<<var;name="number";match="[0-9]+";words="0..1">> redistributions in binary form must reproduce the above '
    'copyright notice this list of conditions and the following disclaimer in the documentation and or other '
    'materials provided with the distribution <<var;name="number";match="[0-9]+";words="0..1">> neither the name of '
    '<<var;name="holder";match=".+";words="1..12">> nor the names of '
    '<<var;name="whose";match="its|any";words="1..1">> contributors may be used to endorse or promote products '
    'derived from this software without specific prior written permission',
    "text:isc": 'permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose '
    'with or without fee is hereby granted provided that the above copyright notice and this permission notice '
    'appear in all copies',
    "text:mit": 'permission is hereby granted <<beginOptional>>free of charge<<endOptional>> to any person obtaining a copy of '
    'this software and associated documentation files the software to deal in the software without restriction '
    'including without limitation the rights to use copy modify merge publish distribute sublicense and or sell '
    'copies of the software and to permit persons to whom the software is furnished to do so subject to the '
    'following conditions the above copyright notice and this permission notice <<beginOptional>>including the next '
    'paragraph<<endOptional>> shall be included in all copies or substantial portions of the software',
}

#: ASCII letters, digits and all other letters make words; A-Z are lower-cased before.
_PARTS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARK = re.compile(r"<<(.*?)>>|([^<\s]+)")
_FIELD = re.compile(r'(\w+)="([^"]*)"')

SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of a whole text."""
    return (text or "").encode().lower().translate(_PARTS).split()


@dataclass
class Automaton:
    """A nondeterministic automaton over words.

    ``steps[state]`` holds (test, next state): a word that must be equal, or a
    compiled pattern it must match whole. ``skips[state]`` holds states reached
    without a word. ``wording`` is the longest run of words that every accepted
    text holds in a row.
    """

    steps: list[list[tuple[bytes | re.Pattern, int]]] = field(default_factory=lambda: [[]])
    skips: list[set[int]] = field(default_factory=lambda: [set()])
    end: int = 0
    wording: bytes = b""

    def _state(self) -> int:
        self.steps.append([])
        self.skips.append(set())
        return len(self.steps) - 1

    def reach(self, states: set[int]) -> set[int]:
        """``states`` and all that need no further word."""
        found, todo = set(states), list(states)
        while todo:
            more = self.skips[todo.pop()] - found
            found |= more
            todo += more
        return found

    def accepts(self, words: list[bytes]) -> bool:
        """Whether the template matches somewhere in ``words``."""
        start, states = self.reach({0}), set()
        if self.end in start:
            return True
        for word in words:
            states = self.reach({
                after for state in states | start for test, after in self.steps[state]
                if (test == word if isinstance(test, bytes) else test.fullmatch(word))
            })
            if self.end in states:
                return True
        return False


def compile_template(markup: str) -> Automaton:
    """Compile marked-up wording; optional regions nest, replaceable ones take a range of words."""
    made = Automaton()
    now, opened, run, longest = 0, [], [], []

    def ended() -> None:
        nonlocal longest
        longest = max(longest, run[:], key=lambda r: len(b" ".join(r)))
        run.clear()

    for mark, literal in _MARK.findall(markup):
        if literal:
            for word in words_of(literal):
                after = made._state()
                made.steps[now].append((word, after))
                now = after
                if not opened:
                    run.append(word)
            continue
        ended()
        if mark == "beginOptional":
            opened.append(now)
        elif mark == "endOptional":
            made.skips[opened.pop()].add(now)
        elif mark.startswith("var;"):
            fields = dict(_FIELD.findall(mark))
            least, most = map(int, fields.get("words", "1..1").split(".."))
            test, before = re.compile(fields["match"].encode()), []
            for n in range(most):
                if n >= least:
                    before.append(now)
                after = made._state()
                made.steps[now].append((test, after))
                now = after
            for state in before:
                made.skips[state].add(now)
        else:
            raise ValueError(f"unknown mark {mark!r}")
    if opened:
        raise ValueError("an optional region is not closed")
    ended()
    made.end, made.wording = now, b" ".join(longest)
    return made


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Indexes of the words at which ``phrase`` stands in space-joined words with a space at both ends."""
    found, word, last = [], 0, 0
    at = joined.find(b" " + phrase + b" ")
    while at >= 0:
        word += joined.count(b" ", last, at)
        last = at
        found.append(word)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return found


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Licence phrases and notices of every whole text of ``docs`` (doc_id, text).

    ``phrases`` map wording to labels and are found wherever their words stand in a
    row; ``templates`` map labels to markup, and a label is given when the automaton
    accepts a stretch of the text, that is when all mandatory wording matches
    exactly. score is 1 with an accepted notice, 0.5 with phrases alone, else 0. A
    null or empty text has no words, no labels (empty strings) and null places.
    Repeated rows and null ids are scanned like any other; other columns are
    ignored. One pass, no shuffle; an automaton runs only over texts that hold its
    longest mandatory wording.
    """
    small_batches(docs.sparkSession)
    sought = {b" ".join(words_of(p)): label for p, label in (PHRASES if phrases is None else phrases).items()}
    compiled = {label: compile_template(m) for label, m in (TEMPLATES if templates is None else templates).items()}

    def one(text: str | None) -> tuple:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        places = {p: found for p in sought if (found := phrase_places(joined, p))}
        base = {sought[p] for p in places}
        starts = [n for found in places.values() for n in found]
        notices = {
            label for label, a in compiled.items() if (b" " + a.wording + b" " in joined or not a.wording) and a.accepts(words)
        }
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | notices)), 1.0 if notices else 0.5 if base else 0.0,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = [c.split()[0] for c in SCANNED.split(", ")]
        for batch in batches:
            columns = list(zip(*[one(t.as_py()) for t in batch.column(1)], strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCANNED)
