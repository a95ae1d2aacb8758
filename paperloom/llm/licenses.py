"""License scans by template-markup matching.

A template is license wording with markup: ``<<optional>>...<<end>>`` marks words
that may be missing, ``<<any:N>>`` a replaceable region of up to N words, and
``<<one:a|b>>`` a choice of single words.  It is compiled into a token automaton;
a text is accepted when the automaton's mandatory wording occurs in it word for
word, anywhere.  Beside the templates, fixed phrases give base labels.

Words are compared after lower-casing A-Z; they are runs of digits, a-z and
characters beyond ASCII.  The automata run only from places where their rarest
fixed run of words occurs, so that a text without them costs one substring search
per template.  Everything is local to a text: one scan, no shuffle.

Defined results: a null text counts as empty and has no words, places or labels.
Repeated rows are scanned each; an empty table gives an empty result.  Columns
other than those asked for with ``keep`` are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm._shared import small_batches
from paperloom.llm._words import ALNUM, LOWER, slices, strings

#: Phrase and the label that each of its places gives.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of well-known public licenses and of the usual one-line notices.
TEMPLATES = {
    "mit-notice": "<<one:released|licensed|distributed|available|provided>> under <<optional>>the terms of<<end>> <<optional>>the<<end>> mit license",
    "apache-2.0-notice": "licensed under the apache license <<optional>>version<<end>> 2 0",
    "gpl-notice": "<<one:released|licensed|distributed|available|redistribute>> <<any:12>> gnu <<optional>><<one:lesser|library|affero>><<end>> general public license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
    " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
    " subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software"
    " <<optional>>the software is provided as is without warranty of any kind express or implied<<end>>",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-2-clause-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>>1<<end>> redistributions of source code must retain the above"
    " copyright notice this list of conditions and the following disclaimer <<optional>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the"
    " documentation and or other materials provided with the distribution <<any:60>> this software is provided by <<any:12>> as is",
    "apache-2.0-text": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<any:12>>"
    " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <<one:2|3>> of the license or at your option any later version",
}


@dataclass(frozen=True)
class Automaton:
    """``steps[i]`` are the (words or None for any, next state) moves of state i; the last state accepts."""

    label: str
    steps: tuple[tuple[tuple[frozenset | None, int], ...], ...]
    anchor: bytes
    before: int  # words that may come before the anchor, at most

    @property
    def accept(self) -> int:
        return len(self.steps)


def compile_template(label: str, text: str) -> Automaton:
    pieces = re.findall(r"<<optional>>|<<end>>|<<any:\d+>>|<<one:[^>]*>>|[^\s<>]+", text)
    states: list[list[tuple[frozenset | None, int]]] = []
    skips: list[tuple[int, int]] = []  # empty moves
    opened: list[int] = []
    fixed: list[tuple[list[str], int]] = [([], 0)]  # runs of mandatory words, with the words that may precede them
    for piece in pieces:
        if piece == "<<optional>>":
            opened.append(len(states))
            fixed.append(([], len(states)))
        elif piece == "<<end>>":
            skips.append((opened.pop(), len(states)))
            fixed.append(([], len(states)))
        elif m := re.fullmatch(r"<<any:(\d+)>>", piece):
            end = len(states) + int(m[1])
            for at in range(len(states), end):
                states.append([(None, at + 1)])
                skips.append((at, end))
            fixed.append(([], len(states)))
        elif m := re.fullmatch(r"<<one:([^>]*)>>", piece):
            states.append([(frozenset(x.encode() for x in m[1].split("|")), len(states) + 1)])
            fixed.append(([], len(states)))
        else:
            states.append([(frozenset([piece.encode()]), len(states) + 1)])
            if not opened:
                fixed[-1][0].append(piece)
    n = len(states)
    reach = {i: {i} for i in range(n + 1)}
    for _ in range(n + 1):
        if not any([reach[a].update(x) or True for a, b in skips if not (x := reach[b]) <= reach[a]]):
            break
    steps = []
    for i in range(n):
        moves = {(words, after) for at in reach[i] if at < n for words, to in states[at] for after in [to]}
        steps.append(tuple(sorted(moves, key=lambda m: (m[1], m[0] is None))))
    final = {i for i in range(n + 1) if n in reach[i]}
    # a move into a state from which the end can be reached by empty moves accepts, too
    steps = [tuple(sorted({*moves, *((w, n) for w, to in moves if to in final)}, key=lambda m: (m[1], m[0] is None))) for moves in steps]
    words, before = max(fixed, key=lambda x: len(" ".join(x[0])))
    return Automaton(label, tuple(steps), " ".join(words).encode(), before)


def accepts(automaton: Automaton, words: list[bytes], anchors: list[int]) -> bool:
    """Whether the wording occurs in a text that has the automaton's anchor at the word places ``anchors``."""
    tried: set[int] = set()
    for anchor in anchors:
        for begin in range(max(0, anchor - automaton.before), anchor + 1):
            if begin in tried:
                continue
            tried.add(begin)
            states, at = {0}, begin
            while states and at < len(words):
                word = words[at]
                states = {to for s in states if s < automaton.accept for allowed, to in automaton.steps[s] if allowed is None or word in allowed}
                if automaton.accept in states:
                    return True
                at += 1
    return False


_TABLE = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 0x20 for b in range(256))


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word places of a phrase in space-joined words (with a space at both ends)."""
    found, needle, at, words, seen = [], b" " + phrase + b" ", 0, 0, 0
    while (at := joined.find(needle, at)) >= 0:
        words += joined.count(b" ", seen, at)
        seen = at
        found.append(words)
        at += 1
    return found


def scan(texts: list[str | None], phrases: dict[str, str], automata: list[Automaton]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates")}
    known = {k.encode(): v for k, v in phrases.items()}
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
        joined = b" ".join([b"", *words, b""])
        base: list[int] = []
        labels: set[str] = set()
        for phrase, label in known.items():
            if found := places(joined, phrase):
                base += found
                labels.add(label)
        matched = [a.label for a in automata if (at := places(joined, a.anchor)) and accepts(a, words, at)]
        both = sorted(labels.union(matched))
        out["n_words"].append(len(words))
        out["n_base"].append(len(base))
        out["first_word"].append(min(base, default=None))
        out["last_word"].append(max(base, default=None))
        out["base_labels"].append(",".join(sorted(labels)))
        out["labels"].append(",".join(both))
        out["score"].append(1.0 if matched else 0.5 if labels else 0.0)
        out["templates"].append(len(matched))
    return out


def license_scan(df: DataFrame, keep: list[str], text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """The ``keep`` columns of every row with its word count, base places, labels and score.

    The score is 1 if a template accepts the text, 0.5 if only a base phrase
    occurs, else 0.
    """
    small_batches(df.sparkSession)
    automata = [compile_template(k, v) for k, v in templates.items()]
    kinds = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double", "templates": "long"}
    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                found = scan(strings(part, "__text"), phrases, automata)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(found[k], arrow[t]) for k, t in kinds.items())], names=[*keep, *kinds])

    rows = df.select(*keep, F.col(text).alias("__text"))
    schema = rows.select(*keep).schema
    for name, kind in kinds.items():
        schema = schema.add(name, kind)
    return rows.mapInArrow(scanned, schema)
