"""License scans by conditional compression.

Cues that speak of licensing are found by a native pattern; a candidate block has so many words on both
sides of a cue as the longest template, across lines. A template is confirmed by its exact wording:
its words must stand in a stretch of the block in order, with at most ``max_changes`` changes, none of
them in the words that tell one license from another; every template is looked for. The sentences and lines around the stretch are compressed alone and again with the template as zstandard raw
dictionary; of templates whose stretches overlap the one that saves most bytes counts.

A stretch that is denied in its sentence ("not released under ...") is no notice; a version of the GNU
family that "or later" follows has the identifier with that ending.

Defined cases: null text is empty, and a document without candidate blocks has no license. Every
notice in a stretch of its own counts, whatever the length of its line; texts of any length are taken
whole. Of templates that save as much as each other the one with fewer differences, then the first by
name, wins. Rows are judged one by one, so repeated rows and null or repeated ids count each. Only the
id and the text are looked at, so names of other columns can't clash. An empty table has no rows.
"""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.llm.common import small_batches, text_of

#: SPDX identifiers and the names that notices call licenses by.
NAMES = (
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "CC0 1.0"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("Unlicense", "Unlicense"),
    ("Zlib", "zlib License"),
)
#: The customary ways to grant one by its name; a Creative Commons name takes an article.
GRANTS = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.")
#: Notices in the customary wordings of public licenses.
WORDINGS = (
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)


def _granted() -> list[tuple[str, str]]:
    """A notice for each name and way to grant it, and SPDX lines."""
    out = [(spdx, grant.format(name).replace("the CC", "CC").replace("the Creative", "a Creative")) for spdx, name in NAMES for grant in GRANTS]
    return out + [(spdx, f"SPDX-License-Identifier: {spdx}") for spdx in dict.fromkeys(spdx for spdx, _ in NAMES)]


TEMPLATES = (*WORDINGS, *_granted())
#: Words that tell licenses apart, besides all words with a digit or a capital inside.
TELLING = frozenset("affero apache boost eclipse general lesser mit mozilla noncommercial noderivatives nc nd sa by isc bsd cc cc0 zlib unlicense library attribution sharealike not never no except unencumbered licensed released distributed".split())
#: A notice that follows one of these, or another word after it, in its sentence grants nothing.
DENIALS = frozenset("not never neither nor cannot isn wasn aren weren".split())
#: What follows a version where later ones are granted, too.
LATER = tuple(x.split() for x in ("or later", "or any later version", "or newer", "or at your option any later version"))
#: Words of a cue may stand in different lines.
CUE = r"(?i)licen[cs]|copyright|redistribut|permission[^a-z0-9]+(?:to|is)|public[^a-z0-9]+domain|unencumbered|creative[^a-z0-9]+commons|implied[^a-z0-9]+warrant|under[^a-z0-9]+cc[^a-z]"
_WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")
_CUE = re.compile(CUE, re.ASCII)
_SENTENCE = re.compile(r"[.!?:][ \t\n\x0b\f\r]+")


def plain(text: str) -> bytes:
    """Text as it is compressed: without case and spacing."""
    return " ".join(text.lower().split()).encode()


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@dataclass(frozen=True)
class Match:
    license: str
    saved: float  # share of the block's compressed size that the template saves
    changes: int


#: Above any number of changes, for those that aren't allowed; costs and starts share a number, costs in its upper half.
_NEVER, _COST = 1000, 1 << 32


def telling(word: str) -> bool:
    return word in TELLING or any(map(str.isdigit, word))


class Scanner:
    def __init__(self, templates=TEMPLATES, level: int = 3, max_changes: float = 0.1):
        self.max_changes = max_changes
        make = lambda d=None: zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.alone = make()
        self.templates = [(name, words(text), make(zstandard.ZstdCompressionDict(plain(text), dict_type=zstandard.DICT_TYPE_RAWCONTENT))) for name, text in templates]
        self.empty = len(self.alone.compress(b""))
        self.longest = max(len(t) + self.allowed(t) for _, t, _ in self.templates)

    def allowed(self, template: list[str]) -> int:
        return int(self.max_changes * len(template))

    def stretches(self, template: list[str], block: list[str]) -> list[tuple[int, int, int]]:
        """(changes, start, end) of the stretches of ``block`` that at most the allowed changes make into the template.

        A word is replaced, left out or put in at the price of a change; telling words never are. Of
        stretches that overlap the one with fewest changes counts.
        """
        have, least = set(block), self.allowed(template)
        missing = [w for w in template if w not in have]
        if len(missing) > least or any(map(telling, missing)):
            return []
        n = len(block)
        price = np.array([_NEVER if telling(w) else 1 for w in block], np.int64)
        put_in = np.concatenate([[0], np.cumsum(price)]) * _COST
        at = np.array(block, object)
        row = n - np.arange(n + 1, dtype=np.int64)  # ends with the same costs keep the latest start
        for w in template:
            own = _NEVER if telling(w) else 1
            now = row + own * _COST
            now[1:] = np.minimum(now[1:], row[:-1] + np.where(at == w, 0, np.maximum(price, own)) * _COST)
            row = put_in + np.minimum.accumulate(now - put_in)
        found = sorted((int(row[e]) // _COST, n - int(row[e]) % _COST, int(e)) for e in np.flatnonzero(row < (least + 1) * _COST))
        return apart(found, lambda x: x[1:])

    def saved(self, data: bytes, k: int) -> tuple[int, float]:
        """Bytes, and share of the compressed size, that a template saves."""
        whole = len(self.alone.compress(data)) - self.empty
        less = whole - (len(self.templates[k][2].compress(data)) - self.empty)
        return less, less / max(1, whole)

    def blocks(self, text: str, spans: list[tuple[int, int]], cues: list[int]) -> list[tuple[int, int]]:
        """(first, end) of the runs of words that are near enough to a cue for the longest template, across lines."""
        out: list[tuple[int, int]] = []
        for at in cues:
            word = bisect.bisect_right(spans, (at, len(text))) - 1  # the one that the cue begins in
            first, end = max(0, word - self.longest), min(len(spans), word + self.longest + 1)
            if out and first <= out[-1][1]:
                first = out.pop()[0]
            out.append((first, end))
        return out

    def matches(self, text: str) -> tuple[int, list[Match]]:
        """(sentences and lines with a cue, all notices of ``text``, each in a stretch of its own).

        What a template saves is told by the sentences and lines that its stretch lies in, and says
        which of overlapping stretches counts.
        """
        cues = [m.start() for m in _CUE.finditer(text)]
        if not cues:
            return 0, []
        spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        split, ends = [text[a:b].lower() for a, b in spans], cuts(text)
        place = lambda at: int(np.searchsorted(ends, at, side="right"))
        found = []
        for begin, stop in self.blocks(text, spans, cues):
            for k, (name, template, _) in enumerate(self.templates):
                for changes, start, end in self.stretches(template, split[begin:stop]):
                    start, end = start + begin, end + begin
                    if self.denied(split, start, first_word(spans, ends[place(spans[start][0]) - 1])):
                        continue
                    block = text[ends[place(spans[start][0]) - 1] : ends[place(spans[end - 1][0])]]
                    less, share = self.saved(plain(block), k)
                    found.append((-less, changes, name, start, end, share))
        notices = [Match(self.ending(name, split, end), share, changes) for _, changes, name, _, end, share in apart(sorted(found), lambda x: x[3:5])]
        return len({place(at) for at in cues}), notices

    def denied(self, split: list[str], start: int, sentence: int) -> bool:
        """One of the two words before ``start``, in its sentence, denies what follows."""
        return not DENIALS.isdisjoint(split[max(sentence, start - 2) : start])

    def ending(self, name: str, split: list[str], end: int) -> str:
        later = "GPL-" in name and not name.endswith("-or-later") and any(split[end : end + len(w)] == w for w in LATER)
        return f"{name}-or-later" if later else name

    def scan(self, block: str) -> Match | None:
        """The notice that saves most."""
        return max(self.matches(block)[1], key=lambda m: m.saved, default=None)


def apart(found: list[tuple], span) -> list[tuple]:
    """Those of ``found``, best first, that don't overlap a better one."""
    out, taken = [], bytearray(max((span(x)[1] for x in found), default=0))
    for x in found:
        a, b = span(x)
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            out.append(x)
    return out


def first_word(spans: list[tuple[int, int]], at: int) -> int:
    """The number of the first word that begins at ``at`` or later."""
    return bisect.bisect_left(spans, (at, -1))


def cuts(text: str) -> np.ndarray:
    """Where the lines and sentences of ``text`` begin, and its end."""
    sentences = (m.end() for m in _SENTENCE.finditer(text) if m.end() < len(text) and unicodedata.category(text[m.end()]) == "Lu")
    return np.array(sorted({0, len(text), *sentences, *(m.end() for m in re.finditer("\n", text))}))


@functools.lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_blocks, n_confirmed, licenses, best_saved, changes), one row per row of ``df``.

    ``n_blocks`` are the sentences and lines with a cue, ``licenses`` the confirmed ones, sorted and joined
    by commas (empty: none); ``changes`` is the sum of word changes over confirmed notices. The pattern runs
    in the JVM, so that Python sees the texts with a cue only.
    """

    @F.pandas_udf("n_blocks long, n_confirmed long, licenses string, best_saved double, changes long")
    def run(column: pd.Series) -> pd.DataFrame:
        tool, out = scanner(), []
        for found in column:
            n, hits = tool.matches(found or "")
            out.append((n, len(hits), ",".join(sorted({h.license for h in hits})), max((h.saved for h in hits), default=0.0), sum(h.changes for h in hits)))
        return pd.DataFrame(out, columns=["n_blocks", "n_confirmed", "licenses", "best_saved", "changes"])

    body = text_of(text)
    cued = df.select(F.col(id_col).alias("id"), F.when(body.rlike(CUE), body).alias("body"))
    return small_batches(cued.select("id", run("body").alias("found")).select(F.col("id").alias(id_col), "found.*"))
