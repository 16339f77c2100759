"""Periodic runs of words, found in a Re-Pair grammar of each text."""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
Run = tuple[int, int, int]  # start, end, period


def pair_grammar(ids: Sequence[int], terminals: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Re-Pair: (rules, sequence). Rule t makes symbol `terminals` + t of two earlier symbols.

    The most frequent pair (the smallest among equals) gets a new symbol at all its places,
    until no pair occurs twice without overlap. Places are kept per pair and checked when
    the pair's turn comes, so counts that went down in between are corrected then.
    """
    n, symbol = len(ids), list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, pair in enumerate(zip(symbol, symbol[1:])):
        places[pair].append(i)
    heap = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        a, b = pair
        there = [i for i in sorted(set(places.get(pair, ()))) if symbol[i] == a and after[i] < n and symbol[after[i]] == b]
        live, end = [], -1
        for i in there:  # without overlap
            if i != end:
                live.append(i)
                end = after[i]
        if len(live) < -count:
            places[pair] = there
            if len(live) > 1:
                heapq.heappush(heap, (-len(live), pair))
            continue
        del places[pair]
        made, touched = terminals + len(rules), set()
        rules.append(pair)
        for i in live:
            j, left = after[i], before[i]
            right = after[j]
            symbol[i], symbol[j], after[i] = made, -1, right
            if left >= 0:
                places[symbol[left], made].append(left)
                touched.add((symbol[left], made))
            if right < n:
                before[right] = i
                places[made, symbol[right]].append(i)
                touched.add((made, symbol[right]))
        for pair in touched:
            if len(places[pair]) > 1:
                heapq.heappush(heap, (-len(places[pair]), pair))
    return rules, [s for s in symbol if s >= 0]


def repeated_windows(ids: Sequence[int], size: int) -> dict[int, np.ndarray]:
    """Start of each window of `size` words that occurs again in the text -> starts of all its occurrences, ascending."""
    n = len(ids) - size + 1
    if n < 2:
        return {}
    rank = names = np.asarray(ids, dtype=np.int64)
    width = 1
    while width < size:  # names of windows of twice the width, or of two that overlap
        step = min(width, size - width)
        head, tail = names[:len(names) - step], names[step:]
        _, names = np.unique(head * (len(rank) + 1) + tail, return_inverse=True)
        width += step
    count = np.bincount(names)
    if count.max() < 2:
        return {}
    order = np.argsort(names, kind="stable")
    groups = np.split(order, np.cumsum(count)[:-1])
    return {int(i): g for g in groups if len(g) > 1 for i in g}


def _crossing(ids: Sequence[int], low: int, cut: int, high: int, windows: dict[int, np.ndarray], size: int, least: int, times: int) -> list[Run]:
    """Runs inside [low, high) that cross `cut`, each with its smallest period, as far as they go in [low, high).

    A run of `least` words and `times` periods holds the window that ends one word behind the
    cut or the one that starts one word before it, and any window of it again a period away.
    So the distances to the window's other places are all periods that come into question.
    """
    most, found = (high - low) // times, []
    for s in dict.fromkeys((cut - 1, cut - size + 1)):
        if s < low or s + size > high or s not in windows:
            continue
        at = windows[s]
        near = at[bisect_left(at, max(low, s - most)):bisect_left(at, min(high - size, s + most) + 1)]
        for t in near[np.argsort(np.abs(near - s), kind="stable")].tolist():
            q = abs(t - s)
            if q == 0 or any(q % p == 0 and i <= min(s, t) and max(s, t) + size <= e for i, e, p in found):
                continue
            x = min(s, t)
            y = x + size
            while y + q < high and ids[y] == ids[y + q]:
                y += 1
            while x > low and ids[x - 1] == ids[x - 1 + q]:
                x -= 1
            y += q
            if y - x >= max(least, times * q) and x < cut < y and not any(i <= x and y <= e and p <= q for i, e, p in found):
                found.append((x, y, q))
    return found


def find_runs(words: Sequence[str], least: int = 24, times: int = 3) -> list[Run]:
    """(start, length, period) of every maximal run of at least `least` words and `times` (3 or more) periods, by start, then period.

    Word ids are compressed by Re-Pair and the remaining sequence is paired up to one root,
    so every run crosses the boundary of the two halves of some symbol. Each symbol's
    boundary is searched once, at one of its places in the text; the runs found there hold at
    every place that the symbol derives, and pieces of one run that meet are merged by period.
    A run of one period can only be a part of one of the same period, and the smallest
    symbol that holds a run whole reports it whole, so the merged runs are the maximal ones.

    A text without a repeated window of a third of `least` words cannot hold a run: no grammar is built.
    """
    if times < 3 or least < 4:
        raise ValueError("runs of fewer than three periods or four words are not found this way")
    size = (least + 2) // 3
    number: dict[str, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    windows = repeated_windows(ids, size)
    if not windows:
        return []
    terminals = len(number)
    rules, row = pair_grammar(ids, terminals)
    while len(row) > 1:
        paired = []
        for a, b in zip(row[::2], row[1::2]):
            paired.append(terminals + len(rules))
            rules.append((a, b))
        row = paired + row[len(row) & ~1:]
    length = [1] * terminals
    for a, b in rules:
        length.append(length[a] + length[b])
    place = [0] * len(length)
    for t in range(len(rules) - 1, -1, -1):  # one place of each symbol in the text
        a, b = rules[t]
        place[a], place[b] = place[terminals + t], place[terminals + t] + length[a]
    own: list[list[Run]] = []
    holds = [False] * len(length)
    for t, (a, b) in enumerate(rules):
        low = place[terminals + t]
        runs = _crossing(ids, low, low + length[a], low + length[terminals + t], windows, size, least, times) if length[terminals + t] >= least else []
        own.append([(x - low, y - low, q) for x, y, q in runs])
        holds[terminals + t] = bool(runs) or holds[a] or holds[b]
    pieces: set[Run] = set()
    open_symbols = [(row[0], 0)]
    while open_symbols:
        s, at = open_symbols.pop()
        if not holds[s]:
            continue
        a, b = rules[s - terminals]
        pieces.update((q, at + x, at + y) for x, y, q in own[s - terminals])
        open_symbols += [(a, at), (b, at + length[a])]
    merged: list[list[int]] = []
    for q, x, y in sorted(pieces):
        if merged and merged[-1][0] == q and x <= merged[-1][2] - q:
            merged[-1][2] = max(merged[-1][2], y)
        else:
            merged.append([q, x, y])
    return sorted((x, y - x, q) for q, x, y in merged)


def collapse(text: str, least: int = 24, times: int = 3) -> tuple[int, list[Run], str]:
    """(words, runs, the words that are in no run's repeats, joined by a space)."""
    words = _WORD.findall(text)
    runs = find_runs(words, least, times)
    if not runs:
        return len(words), runs, " ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    inside = np.cumsum(edge)[:-1] > 0
    return len(words), runs, " ".join(w for w, drop in zip(words, inside.tolist()) if not drop)


def collapse_runs(extracts: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """(extract_id, n_words, runs, text) per row of `extracts` (extract_id, text).

    The texts meant are those of map elements (`sources.element_texts`), which editors and
    imports fill with repeated phrases. `runs` is an array of (start, length, period) in
    words, by start, then period; `text` has the words that no run repeats (each run keeps
    its first period), joined by one space. Null and empty texts have no words, no runs and
    an empty text. Texts are taken whole, each by itself: nothing is shuffled, repeated rows
    give repeated results, other columns are ignored, an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    @F.pandas_udf("n bigint, starts array<bigint>, lengths array<bigint>, periods array<bigint>, text string")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            n, runs, kept = collapse(t, least, times)
            starts, lengths, periods = (list(c) for c in zip(*runs)) if runs else ([], [], [])
            rows.append((n, starts, lengths, periods, kept))
        return pd.DataFrame(rows, columns=["n", "starts", "lengths", "periods", "text"]).astype({"n": "int64"})

    runs = F.transform(F.arrays_zip("_f.starts", "_f.lengths", "_f.periods"), lambda r: F.struct(r["starts"].alias("start"), r["lengths"].alias("length"), r["periods"].alias("period")))
    return extracts.select("extract_id", found(text).alias("_f")).select("extract_id", F.col("_f.n").alias("n_words"), runs.alias("runs"), F.col("_f.text").alias("text"))
