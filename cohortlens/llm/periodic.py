"""Periodic runs of words in a text, found on a grammar of it.

Re-Pair turns the word ids of a text into a grammar: the most frequent pair of neighbouring
symbols becomes a rule until no pair occurs twice. A run lies across the boundary of the two
halves of some symbol, the smallest that holds it whole. So the runs across the boundary of each
rule are computed once, in one of its places, and put at all places of the rule; the start
rule is cut in halves in the same way, where its text can hold a run at all. A run that
reaches the edge of a symbol may be a part of one that goes on outside; merging the intervals of
each period leaves the whole ones.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A run has so many words and so many periods at least.
MIN_WORDS, MIN_PERIODS = 6, 4
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"

Rule = tuple[int, int, list[int]]
Run = tuple[int, int, int]


def word_ids(words: list[bytes]) -> list[int]:
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def _repeated_pairs(ids: list[int]) -> list[tuple[tuple[int, int], list[int]]]:
    """Pairs of neighbouring ids that occur twice or more, with their places, in text order."""
    at = np.asarray(ids, np.int64)
    keys = at[:-1] * (int(at.max()) + 1) + at[1:]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(starts, append=len(keys))
    found = []
    for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        places = order[start : start + size].tolist()
        found.append(((ids[places[0]], ids[places[0] + 1]), places))
    return sorted(found, key=lambda pair: pair[1][0])


def re_pair(ids: list[int]) -> tuple[list[int], list[Rule]]:
    """The places where the symbols of the start rule begin, and the rules long enough for a run.

    A rule is (length of its left half, length, places of all its occurrences in the derivation).
    Pairs of equal frequency are taken in the order they came up, which keeps the grammar flat.
    """
    if len(ids) < 2:
        return list(range(len(ids))), []
    symbol, before = list(ids), list(range(-1, len(ids) - 1))
    width = [1] * (max(ids) + 1)
    places = dict(_repeated_pairs(ids))
    queue = [(-len(at), turn, pair) for turn, (pair, at) in enumerate(places.items())]
    heapify(queue)
    turn, end, rules = len(queue), len(ids), []
    while queue:
        count, _, pair = queue[0]
        left, right = pair
        wide, reach = width[left], width[left] + width[right]
        live, free = [], 0
        for at in places[pair]:
            if at >= free and symbol[at] == left and at + wide < end and symbol[at + wide] == right:
                live.append(at)
                free = at + reach
        if len(live) < 2:
            heappop(queue)
            del places[pair]
            continue
        if len(live) < -count:
            heapreplace(queue, (-len(live), turn, pair))
            turn += 1
            if queue[0][2] != pair:
                continue
        heappop(queue)
        del places[pair]
        made = len(width)
        width.append(reach)
        for at in live:
            symbol[at], symbol[at + wide] = made, -1
            if at + reach < end:
                before[at + reach] = at
        if reach >= MIN_WORDS:
            rules.append((wide, reach, live))
        fresh = defaultdict(list)
        for at in live:
            if before[at] >= 0:
                fresh[symbol[before[at]], made].append(before[at])
            if at + reach < end and symbol[at + reach] != made:
                fresh[made, symbol[at + reach]].append(at)
        for pair, at in fresh.items():
            if len(at) > 1:
                places[pair] = at
                heappush(queue, (-len(at), turn, pair))
                turn += 1
    return [at for at, s in enumerate(symbol) if s >= 0], rules


def regions(words: np.ndarray) -> list[tuple[int, int]]:
    """Parts of the text outside of which no run can lie.

    Behind its first period every word of a run has the same word a period before it or nearer,
    and a run goes on for three periods at least. So words whose next equal word before is
    farther than a third of the stretch of such words around them are ruled out, again and
    again, until nothing changes.
    """
    size = len(words)
    if size < MIN_WORDS:
        return []
    order = np.argsort(words, kind="stable")
    same = np.flatnonzero(words[order[1:]] == words[order[:-1]])
    back = np.full(size, size, np.int64)
    back[order[same + 1]] = order[same + 1] - order[same]
    near = back * MIN_PERIODS <= size
    while near.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(np.int8), [0]])))
        starts, stops = edges[::2], edges[1::2]
        lengths = stops - starts
        around = np.zeros(size, np.int64)
        around[near] = np.repeat(lengths, lengths)
        kept = near & (back * (MIN_PERIODS - 1) <= around) & (around >= MIN_WORDS - 1)
        if kept.sum() == near.sum():
            merged: list[tuple[int, int]] = []
            for start, stop in zip(np.maximum(starts - lengths // (MIN_PERIODS - 1), 0).tolist(), stops.tolist()):
                while merged and start <= merged[-1][1]:
                    start = min(start, merged.pop()[0])
                merged.append((start, stop))
            return merged
        near = kept
    return []


def _same_until(words: np.ndarray, at: int, stop: int, period: int, step: int) -> int:
    """First place from ``at`` on, in direction ``step``, whose word differs from that a period later."""
    size = 32
    while at != stop:
        part = min(size, abs(stop - at))
        low = at if step > 0 else at - part + 1
        differ = (words[low : low + part] != words[low + period : low + period + part])[::step]
        first = int(differ.argmax())
        if differ[first]:
            return at + step * first
        at, size = at + step * part, size * 2
    return stop


def crossing(words: np.ndarray, start: int, cut: int, end: int) -> list[Run]:
    """Runs (start, end, period) of ``words[start:end]``, as far as they reach in it, across ``cut``.

    One side of the boundary holds two periods of a run, so a period is the distance of the
    word at the boundary to an equal one on that side, and the same holds for the next word.
    A period is passed over where a smaller one found before covers so much of the place that
    both cannot be smallest periods (two periods that overlap by their sum have a common part).
    """
    most = (end - start) // MIN_PERIODS
    ahead = np.flatnonzero(words[cut + 1 : min(end, cut + 1 + most)] == words[cut]) + 1
    behind = np.flatnonzero(words[max(start, cut - 1 - most) : cut - 1][::-1] == words[cut - 1]) + 1
    ahead = ahead[(ahead == 1) | (words[np.minimum(cut + 1, end - 1)] == words[np.minimum(cut + 1 + ahead, end - 1)])]
    behind = behind[(behind == 1) | (words[max(cut - 2, start)] == words[np.maximum(cut - 2 - behind, start)])]
    sides = sorted([(int(q), 0) for q in ahead] + [(int(q), 1) for q in behind])
    seen: list[Run] = []
    found: list[Run] = []
    for period, side in sides:
        low, high = (cut, cut + period) if side == 0 else (cut - period, cut)
        shift = (0, 1) if side == 0 else (-1, 0)
        if any(
            i <= low + shift[0] * q and high + shift[1] * q <= j for i, j, q in seen if q <= period
        ):
            continue
        anchor = cut if side == 0 else cut - 1 - period
        if anchor < start or anchor + period >= end:
            continue
        first = _same_until(words, anchor, start - 1, period, -1) + 1
        last = _same_until(words, anchor, end - period, period, 1) + period
        length = last - first
        if length < 2 * period:
            continue
        if any(q < period and min(j, last) - max(i, first) >= q + period for i, j, q in seen):
            continue
        seen.append((first, last, period))
        if length >= max(MIN_WORDS, MIN_PERIODS * period) and first < cut < last:
            found.append((first, last, period))
    return found


def find_runs(ids: list[int]) -> list[Run]:
    """All runs (start, length, period) of a sequence of ids, by start, then period."""
    starts, rules = re_pair(ids)
    words = np.asarray(ids, np.int64)
    spots = regions(words)
    if not spots:
        return []
    inside = np.zeros(len(ids) + 1, np.int64)
    for low, high in spots:
        inside[low + 1 : high + 1] = 1
    inside = np.cumsum(inside).tolist()
    parts: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for wide, reach, places in rules:
        at = places[0]
        if inside[at + reach] - inside[at] >= MIN_WORDS:
            for first, last, period in crossing(words, at, at + wide, at + reach):
                parts[period].update((p + first - at, p + last - at) for p in places)
    for low, high in spots:
        halves = [(bisect_right(starts, low) - 1, bisect_left(starts, high))]
        while halves:
            one, two = halves.pop()
            end = starts[two] if two < len(starts) else len(ids)
            if two - one > 1 and end - starts[one] >= MIN_WORDS:
                middle = (one + two) // 2
                for first, last, period in crossing(words, starts[one], starts[middle], end):
                    parts[period].add((first, last))
                halves += [(one, middle), (middle, two)]
    runs = []
    for period, intervals in parts.items():
        ordered = sorted(intervals)
        low, high = ordered[0]
        for first, last in ordered[1:]:
            if first <= high - period:
                high = max(high, last)
            else:
                runs.append((low, high - low, period))
                low, high = first, last
        runs.append((low, high - low, period))
    return sorted(runs, key=lambda run: (run[0], run[2]))


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run contains behind its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    dropped = (np.cumsum(change[:-1]) > 0).tolist()
    return b" ".join(w for w, gone in zip(words, dropped) if not gone)


def _found(texts: pa.Array) -> pa.Array:
    counts, found, sizes, left = [], [], [], []
    for text in texts.to_pylist():
        words = text.encode().split() if text else []
        runs = find_runs(word_ids(words))
        counts.append(len(words))
        found += runs
        sizes.append(len(runs))
        left.append(collapse(words, runs).decode())
    columns = [pa.array([run[k] for run in found], pa.int64()) for k in range(3)]
    rows = pa.StructArray.from_arrays(columns, ["start", "length", "period"])
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
    arrays = [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, rows), pa.array(left, pa.string())]
    return pa.StructArray.from_arrays(arrays, ["n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, ``n_words``, ``runs`` and ``collapsed``.

    Words lie between ASCII white space. A run is a stretch of words with smallest period q
    (words q apart are the same), of ``max(6, 4 q)`` words at least, that no neighbouring word
    extends; ``runs`` has ``start`` (number of the first word, from 0), ``length`` and ``period``
    by start, then period. ``collapsed`` is the text without the words that a run contains
    behind its first period, joined by one space. Null and empty texts have no words and no
    runs, and collapse to an empty text. Every row is handled by itself, however often it
    repeats and however long its text; columns of these names in ``docs`` are replaced.
    """
    docs = docs.drop("n_words", "runs", "collapsed")
    runs = F.arrow_udf(_found, f"n_words long, runs {RUNS}, collapsed string")
    found = docs.withColumn("_found", runs(F.col(text_col)))
    return found.select(*docs.columns, "_found.n_words", "_found.runs", "_found.collapsed")
