"""License notices by template markup compiled into token automata.

In a template, ``[...]`` is an optional region and ``{n}`` a replaceable one of
at most n words; all other words are mandatory and must match exactly, in
order, with nothing between. A text is accepted where an automaton reaches its
end. Plain phrases give base labels; templates add finer ones.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, key_type, map_batches, rows_of

# Phrases of the base labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label -> templates, in words (a-z, 0-9).
TEMPLATES = {
    "gpl-3.0": (
        "licensed under [the terms of] the gnu general public license [gpl] version 3 [0] [or [at your option] [any] later [version]]",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the"
        " free software foundation either version 3 of the license or at your option any later version",
    ),
    "gpl-2.0": (
        "licensed under [the terms of] the gnu general public license [gpl] version 2 [0] [or [at your option] [any] later [version]]",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the"
        " free software foundation either version 2 of the license or at your option any later version",
    ),
    "lgpl-2.0": (
        "you can redistribute it and or modify it under the terms of the gnu library general public license as published by the"
        " free software foundation either version 2 of the license or at your option any later version",
    ),
    "lgpl-2.1": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the"
        " free software foundation either version 2 1 of the license or at your option any later version",
    ),
    "lgpl-3.0": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the"
        " free software foundation either version 3 of the license or at your option any later version",
    ),
    "agpl-3.0": (
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the"
        " free software foundation either version 3 of the license or at your option any later version",
    ),
    "apache-2.0": (
        "licensed under the apache license version 2 0 [the license]",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    ),
    "mit-notice": (
        "released under the [terms of the] mit license",
        "licensed under the [terms of the] mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
    ),
    "cc-by-4.0": ("licensed under [a] [the] [creative commons {3}] cc by 4 0 [international] [license]",),
    "cc-by-sa-4.0": ("licensed under [a] [the] cc by sa 4 0 [international] [license]",),
    "cc-by-nc-4.0": ("licensed under [a] [the] cc by nc 4 0 [international] [license]",),
    "cc-by-nd-4.0": ("licensed under [a] [the] cc by nd 4 0 [international] [license]",),
    "bsd-2-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met [1] redistributions of source code must retain the above copyright notice this list of"
        " conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice"
        " this list of conditions and the following disclaimer in the documentation and or other materials provided with the"
        " distribution this software is provided by",
    ),
    "bsd-4-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met {80} all advertising materials mentioning features or use of this software must display"
        " the following acknowledgement",
    ),
    "bsd-3-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met {120} neither the name of {12} nor the names of its contributors",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license [version] 2 0"),
}

_WORDS = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_WORDS).split()


class Automaton:
    """A template's states; ``steps[s]`` maps a word to states, ``any_[s]`` are the states after any word."""

    def __init__(self, template: str):
        self.steps: list[dict[bytes, set[int]]] = [{}]
        self.any_: list[set[int]] = [set()]
        self.free: list[set[int]] = [set()]
        marks, opened, at, self.n_words, self.least = re.findall(r"\[|\]|\{\d+\}|\w+", template), [], 0, 0, 0
        for mark in marks:
            if mark == "[":
                opened.append(at)
            elif mark == "]":
                self.free[opened.pop()].add(at)
            elif mark[0] == "{":
                start = at
                for _ in range(int(mark[1:-1])):
                    at = self._state()
                    self.any_[at - 1].add(at)
                for s in range(start, at):
                    self.free[s].add(at)
            else:
                at = self._state()
                self.steps[at - 1].setdefault(mark.encode(), set()).add(at)
                self.n_words += 1
                self.least += not opened
        self.end = at
        self.first = {w for s in self._open({0}) for w in self.steps[s]}
        if any(self.any_[s] for s in self._open({0})):
            raise ValueError("a template starts with a mandatory or optional word")

    def _state(self) -> int:
        for table, empty in ((self.steps, dict), (self.any_, set), (self.free, set)):
            table.append(empty())
        return len(self.steps) - 1

    def _open(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return seen

    def accepts(self, words: list[bytes], start: int) -> int:
        """Words from ``start`` that the longest accepted text takes; 0 if none."""
        states, taken = self._open({0}), 0
        for n, word in enumerate(words[start:], 1):
            after = {t for s in states for t in (self.steps[s].get(word, set()) | self.any_[s])}
            if not after:
                break
            states = self._open(after)
            if self.end in states:
                taken = n
        return taken


AUTOMATA = [(label, Automaton(t)) for label, templates in TEMPLATES.items() for t in templates]
_FIRST: dict[bytes, list[tuple[str, Automaton]]] = {}
for _label, _automaton in AUTOMATA:
    for _word in _automaton.first:
        _FIRST.setdefault(_word, []).append((_label, _automaton))
#: A template's words stand together in a text or it cannot match.
_PRESENT = (b"license", b"permission", b"redistribut", b"cc by")


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word index, label) of every phrase."""
    line, places = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES.items():
        mark, at = b" " + phrase.encode() + b" ", -1
        while (at := line.find(mark, at + 1)) >= 0:
            places.append((line.count(b" ", 0, at), label))
    return sorted(places)


def template_matches(words: list[bytes]) -> list[tuple[int, int, str, float]]:
    """(first word, words, label, share of the template's words) of every accepted place."""
    found = []
    for i, word in enumerate(words):
        for label, automaton in _FIRST.get(word, ()):
            if taken := automaton.accepts(words, i):
                found.append((i, taken, label, min(1.0, taken / automaton.n_words)))
    return found


def find_licenses(shipments: DataFrame) -> DataFrame:
    """License phrases and templates in every shipment's text.

    Returns one row per input row: ``shipment_id``, ``n_words``, ``places``
    (array of (word, label) of the phrases), ``matches`` (array of (word,
    n_words, label, share) of the templates), ``score``: 0 without a phrase, 0.5
    with one, and more by the share of a template's words that was met. A null
    or empty text has no words. The project's records hold no licenses; any
    free text will do.
    """

    def find(batch: pa.RecordBatch) -> dict:
        n_words, places, matches, scores = [], [], [], []
        for text in as_bytes(rows_of(batch, "delivery_hub")):
            words = words_of(text)
            line = b" ".join(words)
            some = any(p in line for p in _PRESENT)
            own = base_places(words) if some else []
            fits = template_matches(words) if some else []
            n_words.append(len(words))
            places.append([{"word": i, "label": x} for i, x in own])
            matches.append([{"word": i, "n_words": n, "label": x, "share": s} for i, n, x, s in fits])
            scores.append(max([0.5 * bool(own), *(0.5 + 0.5 * m[3] for m in fits)]))
        place = pa.struct([("word", pa.int64()), ("label", pa.string())])
        match = pa.struct([("word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("share", pa.float64())])
        return {
            "shipment_id": rows_of(batch, "shipment_id"), "n_words": pa.array(n_words, pa.int64()),
            "places": pa.array(places, pa.list_(place)), "matches": pa.array(matches, pa.list_(match)),
            "score": pa.array(scores, pa.float64()),
        }

    return map_batches(
        shipments.select("shipment_id", "delivery_hub"), find,
        f"shipment_id {key_type(shipments)}, n_words long, places array<struct<word: long, label: string>>, "
        "matches array<struct<word: long, n_words: long, label: string, share: double>>, score double",
    )
