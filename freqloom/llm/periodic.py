"""Runs of repeated word sequences: Re-Pair grammars, runs at each nonterminal's boundary, translated to all its places.

The word numbers of many documents share one grammar. Re-Pair goes in rounds: every pair that occurs again and is more frequent
than the pairs it overlaps becomes a nonterminal everywhere; what remains of a document is paired up to a single symbol. A run
of four periods that crosses the boundary of a nonterminal has two periods on one of its sides, so its period is the distance
from the words at the boundary to their next place on that side. These are looked up once for each nonterminal, extended as
far as the nonterminal goes, and carried to all places where it stands. Each run of a text crosses the boundary of the smallest
nonterminal that holds it, so that the union of overlapping intervals of one period gives the runs.

Words that can't lie in a run leave before: in a run, each three neighbouring words occur three times or more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from freqloom.llm.common import mix, row_blocks, runs, seeds, texts_of, utf8, window_hash, words

#: A run has so many periods and words at least.
PERIODS, LEAST = 4, 6
#: Candidate periods looked at in one step.
CHUNK = 1 << 20
#: Two primes and a base below them for each, for fingerprints of word sequences.
PRIMES = ((2147483647, 1294687231), (2147483629, 987654323))


class Runs(NamedTuple):
    """Runs [start, end) of a sequence with their periods, by start, then period."""

    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


class Rules(NamedTuple):
    """Nonterminals by one place [low, high) where each stands and the boundary of its halves, and all (rule, place)."""

    low: np.ndarray
    middle: np.ndarray
    high: np.ndarray
    rule: np.ndarray
    place: np.ndarray


def grammar(w: np.ndarray, part: np.ndarray) -> Rules:
    """Re-Pair in rounds over sequences of numbers side by side; ``part`` tells them apart (equal neighbours)."""
    symbol, own = w.astype(np.int64), part
    at, size = np.arange(len(w)), np.ones(len(w), np.int64)
    symbols, n_rules = int(w.max(initial=0)) + 1, 0
    found: list[list[np.ndarray]] = [[], [], [], [], []]
    again = True
    while True:
        inside = own[1:] == own[:-1]
        if not inside.any():
            break
        taken = np.zeros(0, np.int64)
        if again:
            key = symbol[:-1] * symbols + symbol[1:]
            pair = np.flatnonzero(inside)
            kinds, kind, count = np.unique(key[pair], return_inverse=True, return_counts=True)
            rank = np.empty(len(kinds), np.int64)
            rank[np.lexsort((mix(kinds.astype(np.uint64)), count))] = np.arange(1, len(kinds) + 1)
            weight = np.zeros(len(key), np.int64)
            weight[pair] = np.where(count > 1, rank, 0)[kind]
            # Equal neighbours are pairs of one repeated symbol: every second of them is taken.
            edge = runs([weight])
            first, value = edge[:-1], weight[edge[:-1]]
            around = np.concatenate(([0], value, [0]))
            top = (value > around[:-2]) & (value > around[2:])
            offset = np.arange(len(weight)) - np.repeat(first, np.diff(edge))
            taken = np.flatnonzero(np.repeat(top, np.diff(edge)) & (offset % 2 == 0))
            again = len(taken) > 0
        if again:
            _, one, rule = np.unique(key[taken], return_index=True, return_inverse=True)
            one = taken[one]
        else:
            edge = runs([own])
            offset = np.arange(len(own)) - np.repeat(edge[:-1], np.diff(edge))
            one = taken = np.flatnonzero(inside & (offset[:-1] % 2 == 0))
            rule = np.arange(len(taken))
        for column, values in zip(found, (at[one], at[one + 1], at[one + 1] + size[one + 1], rule + n_rules, at[taken]), strict=True):
            column.append(values)
        n_rules += len(one)
        symbol[taken] = symbols + rule
        symbols += len(one)
        size[taken] += size[taken + 1]
        keep = np.ones(len(symbol), bool)
        keep[taken + 1] = False
        symbol, own, at, size = symbol[keep], own[keep], at[keep], size[keep]
    return Rules(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found))


class Sequence:
    """A sequence of numbers whose parts are compared by fingerprints modulo two primes."""

    def __init__(self, w: np.ndarray):
        self.sums = []
        for prime, base in PRIMES:
            power = np.ones(1, np.int64)
            while len(power) <= len(w):
                power = np.concatenate((power, power * pow(base, len(power), prime) % prime))
            code = (mix(w.astype(np.uint64) * np.uint64(2) + np.uint64(prime)) % np.uint64(prime)).astype(np.int64)
            total = np.zeros(len(w) + 1, np.int64)
            np.cumsum(code * power[: len(w)] % prime, out=total[1:])
            self.sums.append((prime, power, total % prime))

    def same(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` numbers from x on and from y on are the same; x < y."""
        out = np.ones(len(x), bool)
        for prime, power, total in self.sums:
            out &= (total[x + n] - total[x]) % prime * power[y - x] % prime == (total[y + n] - total[y]) % prime
        return out

    def common(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
        """How many numbers from x and y on (or before them) are the same, at most ``limit``."""
        low, high = np.zeros(len(x), np.int64), limit.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            n = (low[open_] + high[open_] + 1) // 2
            step = n if back else 0
            same = self.same(x[open_] - step, y[open_] - step, n)
            low[open_[same]] = n[same]
            high[open_[~same]] = n[~same] - 1


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows listed ``count`` times each: the row, and the number of the copy."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def boundary_runs(w: np.ndarray, part: np.ndarray, rules: Rules) -> tuple[np.ndarray, Runs]:
    """For each nonterminal the intervals with enough periods that reach its boundary: rule and interval at its first place."""
    n = len(w)
    sequence = Sequence(w)
    pair = w[:-1].astype(np.int64) * (int(w.max(initial=0)) + 1) + w[1:]
    pair[part[1:] != part[:-1]] = -1
    _, pair = np.unique(pair, return_inverse=True)
    key = np.sort(pair * np.int64(n + 1) + np.arange(n - 1))
    wide = np.flatnonzero(rules.high - rules.low >= LEAST)
    found: list[list[np.ndarray]] = [[], [], [], []]
    for right in (True, False):
        side = rules.high - rules.middle if right else rules.middle - rules.low
        own = wide[side[wide] >= 3]
        low, middle, high = rules.low[own], rules.middle[own], rules.high[own]
        if right:
            base = pair[middle] * np.int64(n + 1)
            first, last = np.searchsorted(key, base + middle, "right"), np.searchsorted(key, base + middle + (high - middle) // 2, "right")
        else:
            base = pair[middle - 2] * np.int64(n + 1)
            first, last = np.searchsorted(key, base + middle - 2 - (middle - low) // 2, "left"), np.searchsorted(key, base + middle - 2, "left")
        count = last - first
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(count), np.arange(CHUNK, max(CHUNK, int(count.sum())), CHUNK)), [0, len(own)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            row, copy = _spread(count[a:b])
            row += a
            place = key[first[row] + copy] - base[row]
            c, lo, hi = middle[row], low[row], high[row]
            if right:
                q = place - c
                held = sequence.same(c, c + q, q)
                row, c, lo, hi, q = (x[held] for x in (row, c, lo, hi, q))
                start = c - sequence.common(c, c + q, c - lo, back=True)
                end = c + q + sequence.common(c, c + q, hi - c - q)
            else:
                q = c - 2 - place
                held = sequence.same(c - 2 * q, c - q, q)
                row, c, lo, hi, q = (x[held] for x in (row, c, lo, hi, q))
                start = c - q - sequence.common(c - q, c, c - q - lo, back=True)
                end = c + sequence.common(c - q, c, hi - c)
            held = end - start >= np.maximum(LEAST, PERIODS * q)
            for column, values in zip(found, (own[row], start, end, q), strict=True):
                column.append(values[held])
    rule, start, end, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    # Multiples of a period give the same interval.
    order = np.lexsort((q, end, start, rule))
    one = order[runs([rule[order], start[order], end[order]])[:-1]]
    return rule[one], Runs(start[one], end[one], q[one])


def merged(found: Runs) -> Runs:
    """The union of intervals of one period that overlap by a period or more."""
    order = np.lexsort((found.start, found.period))
    start, end, q = (x[order] for x in found)
    if not len(start):
        return found
    group = np.cumsum(np.append(0, q[1:] != q[:-1])) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + group)
    new = np.append(True, (start + q + group)[1:] > reach[:-1])
    at = np.flatnonzero(new)
    start, q, end = start[at], q[at], np.maximum.reduceat(end, at)
    order = np.lexsort((q, start))
    return Runs(start[order], end[order], q[order])


def sequence_runs(w: np.ndarray, part: np.ndarray) -> Runs:
    """All runs of sequences side by side: LEAST words and PERIODS smallest periods or more, not extendable inside a part."""
    if len(w) < LEAST:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none)
    rules = grammar(w, part)
    rule, found = boundary_runs(w, part, rules)
    order = np.argsort(rules.rule, kind="stable")
    first = np.searchsorted(rules.rule[order], np.arange(len(rules.low) + 1))
    row, copy = _spread(first[rule + 1] - first[rule])
    shift = rules.place[order[first[rule[row]] + copy]] - rules.low[rule[row]]
    return merged(Runs(found.start[row] + shift, found.end[row] + shift, found.period[row]))


_SALT = seeds(1, 31)[0]


def repeated_stretches(h: np.ndarray, by_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 word of the stretches that can hold runs: each three neighbours occur three times in the stretch.

    A run lies in one stretch: its three-word sequences each recur one period on, and it has four periods.
    """
    if len(h) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    three = window_hash(h, 3)
    row = np.repeat(np.arange(len(by_row) - 1), np.diff(by_row))
    slot = (mix(three + row[: len(three)].astype(np.uint64) * _SALT) & np.uint64((1 << int(len(h) * 16).bit_length()) - 1)).astype(np.int64)
    at = np.flatnonzero((row[2:] == row[: len(three)]) & (np.bincount(slot)[slot] >= 3))
    own = row[at]
    while len(at):
        edge = runs([own, at - np.arange(len(at))])
        size = np.diff(edge)
        stretch = np.repeat(np.arange(len(size)), size)
        _, kind, count = np.unique(mix(three[at] + stretch.astype(np.uint64) * _SALT), return_inverse=True, return_counts=True)
        keep = (count[kind] >= 3) & (size[stretch] >= 4)
        if keep.all():
            return at[edge[:-1]], at[edge[1:] - 1] + 3
        at, own = at[keep], own[keep]
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def row_runs(h: np.ndarray, by_row: np.ndarray) -> tuple[np.ndarray, Runs]:
    """Row, and run by word number of the row, of all runs; by row, start and period."""
    first, last = repeated_stretches(h, by_row)
    part, copy = _spread(last - first)
    at = first[part] + copy
    _, w = np.unique(h[at], return_inverse=True)
    found = sequence_runs(w, part)
    start = at[found.start] if len(at) else found.start
    row = np.searchsorted(by_row, start, "right") - 1
    start = start - by_row[row]
    order = np.lexsort((found.period, start, row))
    return row[order], Runs(start[order], (start + found.end - found.start)[order], found.period[order])


def _collapsed(data: np.ndarray, offsets: np.ndarray, s: np.ndarray, e: np.ndarray, by_row: np.ndarray, row: np.ndarray, found: Runs) -> pa.Array:
    """The words that stay, joined by one space: all but those behind a run's first period."""
    base = int(offsets[0])
    step = np.zeros(len(s) + 1, np.int64)
    np.add.at(step, by_row[row] + found.start + found.period, 1)
    np.add.at(step, by_row[row] + found.end, -1)
    kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    own = np.searchsorted(by_row, kept, "right") - 1
    # A word takes the blank after it along, but for the last of a row.
    more = np.append(own[1:] == own[:-1], False)[: len(kept)]
    block = data[base : int(offsets[-1])].copy()
    low, high = s[kept] - base, e[kept] - base
    block[high[more]] = 32
    mark = np.zeros(len(block) + 1, np.int8)
    mark[low] += 1
    high = high + more
    np.subtract.at(mark, high, 1)
    out = block[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    length = np.zeros(len(offsets), np.int64)
    np.add.at(length, own + 1, high - low)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.cumsum(length)), pa.py_buffer(out)]).cast(pa.string())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` of the whole text, numbered from 0 and told apart by 64-bit hashes. A run is a
    stretch with smallest period q, of ``max(6, 4q)`` words or more, that no neighbouring word extends. ``collapsed`` has the
    words that no run holds behind its first period, joined by one space. Each run is listed, also where runs overlap.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``; rows that repeat give repeated results, a
    null id stays null, an empty table gives none. Documents are taken in parts of a megabyte, a longer text by itself:
    memory goes with the longest text. Other columns are not read, so their names can't clash. No shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for i, j in row_blocks(offsets):
                h, s, e, by_row = words(data, offsets[i : j + 1])
                row, found = row_runs(h, by_row)
                listed = pa.StructArray.from_arrays([pa.array(found.start), pa.array(found.end - found.start), pa.array(found.period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)), listed)
                out = [batch["doc_id"].slice(i, j - i), pa.array(np.diff(by_row)), lists, _collapsed(data, offsets[i : j + 1], s, e, by_row, row, found)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "runs", "collapsed"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
