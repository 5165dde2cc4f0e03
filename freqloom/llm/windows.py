"""Windows of a text that hold a shingle of a reference set: the common part of the scans against reference texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freqloom.llm.common import SMALL_STEP, row_blocks, utf8, window_hash, words

WIDTH = 5
#: Reference texts are broadcast in slices of about so many bytes and rows; more of them mean more passes, not larger slices.
SLICE_BYTES, SLICE_ROWS = 32 << 20, 20_000


@dataclass(frozen=True)
class Reference:
    """Reference texts of one slice by their shingle streams."""

    keys: list  # ids as given
    streams: list[np.ndarray]  # shingles of each text in order
    gram: np.ndarray  # words in a shingle: WIDTH, or all words of a shorter text
    members: dict[int, np.ndarray]  # sorted distinct shingles by gram
    maps: dict[int, np.ndarray]  # bit maps over them by gram


#: Bytes of which comment marks consist: a word of these alone begins or ends a line of source code.
MARKS = b"#/*;%!<>-\"'"
_NO_MARK = np.ones(256, np.int64)
_NO_MARK[list(MARKS)] = 0


def without_marks(data: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray, by_row: np.ndarray) -> tuple[np.ndarray, ...]:
    """The words that do not consist of comment marks alone, in the form in which they are given."""
    if not len(h):
        return h, s, e, by_row
    base = int(s[0])
    other = np.concatenate(([0], np.cumsum(_NO_MARK[data[base : int(e[-1])]])))
    keep = other[e - base] > other[s - base]
    return h[keep], s[keep], e[keep], np.concatenate(([0], np.cumsum(keep)))[by_row]


def build_reference(keys: list, texts: list[str], marks: bool = True) -> Reference:
    import pyarrow as pa

    data, offsets = utf8(pa.array(texts, pa.string()))
    found = words(data, offsets, lower=True)
    h, _, _, by_row = found if marks else without_marks(data, *found)
    own, streams, gram = [], [], []
    for i, key in enumerate(keys):
        w = h[by_row[i] : by_row[i + 1]]
        if len(w):
            g = min(WIDTH, len(w))
            own.append(key)
            gram.append(g)
            streams.append(window_hash(w, g))
    gram = np.array(gram, np.int64)
    members, maps = {}, {}
    for g in sorted(set(gram.tolist())):
        members[g] = np.unique(np.concatenate([s for s, k in zip(streams, gram, strict=True) if k == g]))
        size = 1 << max(16, int(len(members[g]) * 16).bit_length())
        maps[g] = np.zeros(size, bool)
        maps[g][(members[g] & np.uint64(size - 1)).astype(np.int64)] = True
    return Reference(own, streams, gram, members, maps)


def references(items: DataFrame, key_col: str, text_col: str, most: int | None = None, marks: bool = True) -> Iterator[Reference]:
    """Slices of bounded size, of about ``most`` rows (SLICE_ROWS); null and empty texts hold no words and match nothing.

    Without ``marks`` words of comment marks alone are left out.
    """
    rows = items.select(items[key_col].alias("key"), items[text_col].cast("string").alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    slices = max(1, -(-size // SLICE_BYTES), -(-n // (most or SLICE_ROWS)))
    for k in range(slices):
        part = rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(slices)) == k) if slices > 1 else rows
        got = sorted(part.collect(), key=lambda r: (r["key"] is None, r["key"] or 0, r["text"] or ""))
        yield build_reference([r["key"] for r in got], [r["text"] or "" for r in got], marks)


def hit_rows(column, reference: Reference, marks: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]]:
    """Row number, word hashes, byte starts and ends of the words, and for each gram the places of reference shingles.

    Rows without such a place are skipped: none of their windows shares a shingle with a reference text. Without ``marks``
    words of comment marks alone are left out.
    """
    data, offsets = utf8(column)
    for i, j in row_blocks(offsets, SMALL_STEP):
        h, s, e, by_row = words(data, offsets[i : j + 1], lower=True)
        if not marks:
            h, s, e, by_row = without_marks(data, h, s, e, by_row)
        found: dict[int, dict[int, np.ndarray]] = {}
        for g, members in reference.members.items():
            stream, bits = window_hash(h, g), reference.maps[g]
            at = np.flatnonzero(bits[(stream & np.uint64(len(bits) - 1)).astype(np.int64)])
            if len(at):
                near = np.minimum(np.searchsorted(members, stream[at]), len(members) - 1)
                at = at[members[near] == stream[at]]
            if not len(at):
                continue
            row = np.searchsorted(by_row, at, "right") - 1
            inside = at + g <= by_row[row + 1]
            at, row = at[inside], row[inside]
            for r in np.unique(row):
                found.setdefault(int(r), {})[g] = at[row == r] - by_row[r]
        for r in sorted(found):
            a, b = by_row[r], by_row[r + 1]
            base = offsets[i + r]
            yield i + r, h[a:b], s[a:b] - base, e[a:b] - base, found[r]


def starts_near(hits: np.ndarray, width: int, count: int) -> np.ndarray:
    """Starts of the windows of ``width`` among ``count`` shingles that hold a hit."""
    mark = np.zeros(count + 1, np.int32)
    np.add.at(mark, np.maximum(hits - width + 1, 0), 1)
    np.add.at(mark, hits + 1, -1)
    starts = np.flatnonzero(np.cumsum(mark[:count]) > 0)
    return starts[starts + width <= count]


