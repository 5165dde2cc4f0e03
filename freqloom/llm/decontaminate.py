"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming blocks, exact verification.

A window has two fingerprints of 64 bits, each bit the majority over the window's shingles under another hash. Equal sizes and
a similarity of 0.75 put two fingerprints 11 bits apart on average; a pair is a candidate if either is within 19. Each is
within 19 with a probability of about 0.996 at that similarity, so both miss about one such pair in 60,000, and none of higher
similarity in practice. The index has 5 blocks of 13 or 12 bits for each fingerprint: within 19 bits some block has 3 errors
at most. Each item is entered under all values within 3 bits of its block's, as sorted postings; a window looks up its blocks'
values and meets 4 % of the items in each. Weighted shingles then decide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freqloom.llm.common import mix, received, seeds, sent, texts_of, window_hash
from freqloom.llm.windows import Reference, hit_rows, references, starts_near

RADIUS, PRINTS = 19, 2
#: Bits of a block; errors that one of them must not exceed.
BLOCKS = (13, 13, 13, 13, 12)
ERRORS = RADIUS // len(BLOCKS)
#: Windows fingerprinted at once; benchmark items of one pass, whose index takes 25 KB each.
STRIP, SLICE_ITEMS = 2048, 4000
_OFFSETS = np.concatenate(([0], np.cumsum(BLOCKS)[:-1])).astype(np.uint64)
_PRINT_SALT = seeds(PRINTS, 91)


def errors_within(bits: int, errors: int) -> np.ndarray:
    """All values of ``bits`` bits with at most ``errors`` ones."""
    values = np.arange(1 << bits, dtype=np.uint64)
    return values[np.bitwise_count(values) <= errors]


def fingerprints(stream: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash prints (windows x PRINTS) of the windows of ``width`` shingles at ``starts`` (ascending)."""
    low = int(starts[0])
    own, at = stream[low : int(starts[-1]) + width], starts - low
    out = np.empty((len(starts), PRINTS), np.uint64)
    for k in range(PRINTS):
        bits = np.unpackbits((mix(own ^ _PRINT_SALT[k]) if k else own).view(np.uint8).reshape(-1, 8), axis=1)
        total = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=total[1:])
        out[:, k] = np.packbits(2 * (total[at + width] - total[at]) > width, axis=1).view(np.uint64)[:, 0]
    return out


_PRINT = np.repeat(np.arange(PRINTS), len(BLOCKS))
_SHIFT = np.tile(_OFFSETS, PRINTS)
_MASK = np.tile((np.uint64(1) << np.array(BLOCKS, np.uint64)) - np.uint64(1), PRINTS)
_TAG = np.arange(len(_PRINT), dtype=np.uint64) << np.uint64(16)


def block_keys(prints: np.ndarray) -> np.ndarray:
    """The values of all blocks of all prints (windows x blocks), each with the block's number above its bits."""
    return (((prints[:, _PRINT] >> _SHIFT) & _MASK) | _TAG).astype(np.uint32)


class HammingIndex:
    """Items of one size in postings by block and value: each item under all values within ERRORS bits of its own."""

    def __init__(self, items: np.ndarray, prints: np.ndarray):
        self.items, self.prints = items, prints
        own = block_keys(prints)
        near = [own[:, b, None] ^ errors_within(n, ERRORS).astype(np.uint32)[None, :] for b, n in enumerate(BLOCKS * PRINTS)]
        keys = np.concatenate([x.ravel() for x in near])
        places = np.concatenate([np.repeat(np.arange(len(x), dtype=np.int32), x.shape[1]) for x in near])
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], places[order]

    def met(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, block, place in items) of the pairs that meet in a block."""
        own = block_keys(prints).ravel()
        first = np.searchsorted(self.keys, own, "left")
        count = np.searchsorted(self.keys, own, "right") - first
        at = np.repeat(np.arange(len(own)), count)
        w, block = np.divmod(at, len(_PRINT))
        return w, block, self.places[np.arange(len(at)) + np.repeat(first - np.cumsum(count) + count, count)]

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in items) of all pairs within RADIUS in either print."""
        w, block, place = self.met(prints)
        k = _PRINT[block]
        near = np.bitwise_count(prints[w, k] ^ self.prints[place, k]) <= RADIUS
        if not near.any():
            return w[:0], place[:0]
        return np.divmod(np.unique(w[near] * len(self.items) + place[near]), len(self.items))


def build_index(reference: Reference) -> dict[tuple[int, int], HammingIndex]:
    """By words in a shingle and number of shingles."""
    groups: dict[tuple[int, int], list[int]] = {}
    for i, s in enumerate(reference.streams):
        groups.setdefault((int(reference.gram[i]), len(s)), []).append(i)
    return {
        (g, n): HammingIndex(np.array(own), np.concatenate([fingerprints(reference.streams[i], np.zeros(1, np.int64), n) for i in own]))
        for (g, n), own in groups.items()
    }


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Shared shingles over all shingles, each weighted by how often it occurs."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def matches(h: np.ndarray, hits: dict[int, np.ndarray], reference: Reference, index: dict, least: float) -> dict[int, tuple[float, int, int]]:
    """For each item found in a text: best similarity, first word and number of words of the best, leftmost window."""
    best: dict[int, tuple[float, int, int]] = {}
    bags: dict[int, Counter] = {}
    streams = {g: window_hash(h, g) for g in hits}
    for (g, width), known in index.items():
        if g not in hits:
            continue
        stream = streams[g]
        wide = min(width, len(stream))  # a shorter text is one window
        if wide < least * width:
            continue
        starts = starts_near(hits[g], wide, len(stream))
        for p in range(0, len(starts), STRIP):
            own = starts[p : p + STRIP]
            for q in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                for w, k in zip(*known.within(fingerprints(stream, q, wide)), strict=True):
                    start, item = int(q[w]), int(known.items[k])
                    if item not in bags:
                        bags[item] = Counter(reference.streams[item].tolist())
                    sim = weighted_similarity(Counter(stream[start : start + wide].tolist()), bags[item])
                    if sim >= least and (item not in best or sim > best[item][0]):
                        best[item] = (sim, start, wide + g - 1)
    return best


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.75) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, similarity, start_byte, end_byte of the window.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lowered, shingles have five of them (an item of fewer words is one
    shingle). A window has as many words as the item; a shorter document is one window. Shingles weigh as often as they
    occur: the sum of smaller counts over the sum of larger ones is at least ``least``. Windows without any shingle of the
    benchmark have similarity 0 and are not fingerprinted. Of windows of one text that are equally similar to an item, the
    leftmost is given. Null and empty texts, on either side, match nothing. Repeated rows give repeated results; empty tables
    give none. A very long text is read in parts of a megabyte and fingerprinted in strips. Other columns are not read, so
    their names can't clash. The index is made by each task from the items, of which one pass takes SLICE_ITEMS at most.
    """
    texts = texts_of(docs, id_col, text_col)
    schema = "doc_id long, place int, similarity double, start_byte long, end_byte long"
    kind = items.schema[item_col].dataType
    found = []
    for reference in references(items, item_col, item_text_col, SLICE_ITEMS):
        shared = sent(docs, reference)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            reference = received(shared)
            index = build_index(reference)
            for batch in batches:
                ids, rows = batch["doc_id"], []
                for i, h, s, e, hits in hit_rows(batch["text"], reference):
                    for item, (sim, start, n) in sorted(matches(h, hits, reference, index, least).items()):
                        rows.append((ids[i].as_py(), item, sim, int(s[start]), int(e[start + n - 1])))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                types = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "place", "similarity", "start_byte", "end_byte"])

        keys = F.array(*[F.lit(k).cast(kind) for k in reference.keys]) if len(reference.keys) <= 1000 else None
        part = texts.mapInArrow(run, schema)
        if keys is not None and reference.keys:
            part = part.withColumn("item_id", F.element_at(keys, F.col("place") + 1))
        else:
            names = docs.sparkSession.createDataFrame(list(enumerate(reference.keys)), f"place int, item_id {kind.simpleString()}")
            part = part.join(F.broadcast(names), "place", "left")
        found.append(part.select("doc_id", "item_id", "similarity", "start_byte", "end_byte"))
    return reduce(DataFrame.unionAll, found)


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, and all rows without id; columns stay in their order."""
    gone = leaks(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
