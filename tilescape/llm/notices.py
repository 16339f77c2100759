"""Licence notices in texts, found by min-hash bands over overlapping windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .shingle_forest import WORDS, _functions, window_hashes

BANDS = 64
#: Windows in the smallest block; blocks double from level to level.
FIRST_BLOCK = 2
#: A notice may be longer in a text than its template by this factor.
SLACK = 1.25
#: Words looked at together (a longer text is looked at alone).
AT_ONCE = 1 << 20
TABLE_BITS = 16

#: Fixed texts of common notices.
NOTICES = {
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "ODbL-1.0": ["This data is made available under the Open Database License", "Map data from OpenStreetMap is available under the Open Database License"],
}


def _words(text: str) -> Column:
    """Hashes of the runs of letters and digits, in lower case."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def level(n: int) -> int:
    """The level whose blocks are as long as a notice of n windows can be; two adjacent blocks then hold it whole."""
    at = 0
    while FIRST_BLOCK << at < int(np.ceil(SLACK * n)):
        at += 1
    return at


def collision_chance(n: int, containment: float, bands: int = BANDS) -> float:
    """Least chance that a notice of n windows, contained to the given share, meets its template in some band."""
    window = 2 * (FIRST_BLOCK << level(n))
    similarity = containment * n / (n + window - containment * n)
    return 1 - (1 - similarity) ** bands


def _hashed(h: np.ndarray, band: int) -> np.ndarray:
    flip, odd = _functions(BANDS)
    v = (h ^ flip[band]) * odd[band]
    v ^= v >> np.uint64(32)
    return ((v * odd[band]) >> np.uint64(32)).astype(np.uint32)


class _Templates:
    """Templates by level, with a table per band that says which smallest hashes occur at all."""

    def __init__(self, rows: list[tuple[str, np.ndarray]]):
        self.names = [name for name, _ in rows]
        self.sets = [np.unique(window_hashes(w)) for _, w in rows]
        self.levels: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            self.levels.setdefault(level(len(s)), []).append(t)
        self.least = {(j, b): np.unique([_hashed(self.sets[t], b).min() for t in ts]) for j, ts in self.levels.items() for b in range(BANDS)}
        self.table = {}
        for key, least in self.least.items():
            self.table[key] = np.zeros(1 << TABLE_BITS, bool)
            self.table[key][least >> np.uint32(32 - TABLE_BITS)] = True

    def windows(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """Level -> numbers of its windows (two adjacent blocks) that meet a template of that level in a band."""
        top = max(self.levels)
        size = FIRST_BLOCK << top
        padded = np.full(-(-len(h) // size) * size + size, np.uint32(2**32 - 1))
        hits = {j: np.zeros(len(padded) // (FIRST_BLOCK << j) - 1, bool) for j in self.levels}
        for b in range(BANDS):
            padded[:len(h)] = _hashed(h, b)
            least = padded.reshape(-1, FIRST_BLOCK).min(axis=1)
            for j in range(top + 1):
                if j in self.levels:
                    both = np.minimum(least[:-1], least[1:])
                    maybe = np.flatnonzero(self.table[j, b][both >> np.uint32(32 - TABLE_BITS)])
                    hits[j][maybe[np.isin(both[maybe], self.least[j, b])]] = True
                if j < top:
                    least = np.minimum(least[0::2], least[1::2])
        return {j: np.flatnonzero(x) for j, x in hits.items()}

    def matches(self, h: np.ndarray, first: int, last: int, t: int, containment: float) -> list[tuple[int, int, float]]:
        """(first, last window, containment) of template t in windows first..last: best regions that do not overlap."""
        wanted = self.sets[t]
        at = np.searchsorted(wanted, h[first:last + 1])
        at[at == len(wanted)] = 0
        where = np.flatnonzero(wanted[at] == h[first:last + 1])
        need, reach = containment * len(wanted) - 1e-9, int(np.ceil(SLACK * len(wanted)))
        found = []
        for i, a in enumerate(where):
            inside = where[i:np.searchsorted(where, a + reach)]
            share = len(np.unique(at[inside]))
            if share >= need:
                found.append((-share, int(a), int(inside[-1])))
        out: list[tuple[int, int, float]] = []
        for share, a, b in sorted(found):
            if all(b < x or a > y for x, y, _ in out):
                out.append((a, b, -share / len(wanted)))
        return [(first + a, first + b, s) for a, b, s in sorted(out)]


def _scan(rows: list[tuple[str, np.ndarray]], containment: float):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = _Templates(rows)
        for batch in batches:
            words, keys, i = batch["words"].tolist(), batch["extract_id"].tolist(), 0
            while i < len(words):
                j, size = i, 0
                while j < len(words) and (j == i or size + len(words[j]) <= AT_ONCE):
                    size += len(words[j])
                    j += 1
                out = [(keys[i + d], *m) for d, m in _found(words[i:j], templates, containment)]
                frame = pd.DataFrame(out, columns=["extract_id", "notice", "first_word", "last_word", "containment"])
                yield frame.astype({"extract_id": "Int64"})
                i = j
    return scan


def _found(texts: list, templates: _Templates, containment: float) -> list[tuple]:
    hashes = [window_hashes(w) if len(w) >= WORDS else np.zeros(0, np.uint64) for w in texts]
    begin = np.cumsum([0, *map(len, hashes)])
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    if not len(h):
        return []
    out = []
    for j, hits in templates.windows(h).items():
        block = FIRST_BLOCK << j
        spans: dict[int, list[list[int]]] = {}
        for w in hits.tolist():
            first, last = w * block, min((w + 2) * block, len(h)) - 1
            d = int(np.searchsorted(begin, first, "right")) - 1
            while d < len(texts) and begin[d] <= last:  # a window may reach into the next texts
                if begin[d] < begin[d + 1]:
                    a, b = max(int(begin[d]), first - 2 * block), min(int(begin[d + 1]) - 1, last + 2 * block)
                    mine = spans.setdefault(d, [])
                    if mine and a <= mine[-1][1] + 1:
                        mine[-1][1] = max(b, mine[-1][1])
                    elif a <= b:
                        mine.append([a, b])
                d += 1
        for d, mine in spans.items():
            for t in templates.levels[j]:
                for a, b in mine:
                    for x, y, share in templates.matches(h, a, b, t, containment):
                        out.append((d, (templates.names[t], x - int(begin[d]), y - int(begin[d]) + WORDS - 1, share)))
    return sorted(out)


def find_notices(extracts: DataFrame, templates: DataFrame, containment: float = 0.8) -> DataFrame:
    """(extract_id, notice, first_word, last_word, containment) of the notices in `extracts` (extract_id, text).

    Map extracts carry licence notices of their sources (data licences, map attributions);
    `templates` (notice, text) has their wordings, a bounded list that every task holds. A
    notice is found where a region of the text, at most 1.25 times as long as the template,
    holds at least `containment` of the template's distinct 5-word windows. Words are runs of
    letters and digits in lower case, numbered from 0. Of overlapping regions of one template
    the fullest counts, then the first.

    Method: at each level the text is cut in overlapping windows (two adjacent blocks, a block
    as long as the longest notice of that level), so each notice lies whole in some window.
    Window and template meet if they share the smallest hash in one of BANDS bands;
    `collision_chance` (at least 0.9999 for 0.8, checked here) follows from the sizes alone.
    What meets is verified on the windows themselves, within whole texts.

    Templates under five words are refused. Texts that are null, empty or under five words
    have no notices. Rows with null or repeated ids are looked at like any other. Other
    columns are ignored; empty tables give no rows.
    """
    listed = [(r["notice"], np.asarray(r["words"], np.int64)) for r in templates.select("notice", _words("text").alias("words")).collect()]
    if any(len(w) < WORDS for _, w in listed):
        raise ValueError("templates need five words")
    for _, w in listed:
        if collision_chance(len(np.unique(window_hashes(w))), containment) < 0.9999:
            raise ValueError("containment is too low for the bands")
    schema = "extract_id long, notice string, first_word long, last_word long, containment double"
    if not listed:
        return extracts.sparkSession.createDataFrame([], schema)
    hashed = extracts.select(F.col("extract_id").cast("long").alias("extract_id"), _words("text").alias("words"))
    return hashed.mapInPandas(_scan(listed, containment), schema)
