"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A window has as many shingles as the template. A template with containment 0.75 in it has a Jaccard similarity of at least
0.6, so one of 20 bands of two rows agrees with probability 1 - (1 - 0.36)^20 > 0.9998; its neighbours overlap it and add to
that.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freqloom.llm.common import mix, received, seeds, sent, texts_of, window_hash
from freqloom.llm.license_templates import PARAGRAPHS, short_notices
from freqloom.llm.windows import Reference, hit_rows, references

BANDS, ROWS = 20, 2
STRIP = 4096
_FLIP = seeds(BANDS * ROWS, 41)
_TIMES = seeds(BANDS * ROWS, 43) | np.uint64(1)
_BAND = seeds(BANDS, 47)

# Wordings by which texts state a license, or that licenses consist of.
_NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}
TEMPLATES = {**_NOTICES, **PARAGRAPHS, **{k: v for k, v in short_notices().items() if v not in _NOTICES.values()}}


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    pairs = [x for kv in (templates or TEMPLATES).items() for x in kv]
    return spark.range(1).select(F.explode(F.create_map(*map(F.lit, pairs))).alias("template_id", "text"))


def band_keys(stream: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Band hashes (windows x bands) of the windows of ``width`` shingles at ``starts`` (ascending, one run)."""
    part = stream[int(starts[0]) : int(starts[-1]) + width]
    least = mix((part[:, None] ^ _FLIP) * _TIMES)
    span = 1
    while span < width:  # least[i] covers span shingles from i on
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    pairs = least.reshape(len(least), BANDS, ROWS)
    return mix(reduce(lambda x, r: mix(x) + pairs[:, :, r], range(ROWS), np.broadcast_to(_BAND, (len(least), BANDS)).copy()))


def build_bands(reference: Reference) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Sorted band hashes and their templates, the templates' sorted shingles and the least number of distinct ones in a
    template, by words in a shingle and number of shingles."""
    groups: dict[tuple[int, int], list[int]] = {}
    for i, s in enumerate(reference.streams):
        groups.setdefault((int(reference.gram[i]), len(s)), []).append(i)
    out = {}
    for (g, n), own in groups.items():
        keys = np.concatenate([band_keys(reference.streams[i], np.zeros(1, np.int64), n)[0] for i in own])
        owner = np.repeat(own, BANDS)
        order = np.argsort(keys, kind="stable")
        sets = [np.unique(reference.streams[i]) for i in own]
        out[g, n] = keys[order], owner[order], np.unique(np.concatenate(sets)), min(map(len, sets))
    return out


def retrieved(keys: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> set[tuple[int, int]]:
    """(window, template) pairs that share a band."""
    flat = keys.ravel()
    low, high = np.searchsorted(known[0], flat, "left"), np.searchsorted(known[0], flat, "right")
    at = np.flatnonzero(high > low)
    return {(int(i) // BANDS, int(known[1][k])) for i in at for k in range(low[i], high[i])}


def starts_with(stream: np.ndarray, hits: np.ndarray, width: int, members: np.ndarray, need: int) -> np.ndarray:
    """Starts of the windows of ``width`` shingles that hold at least ``need`` places of ``members``."""
    near = np.minimum(np.searchsorted(members, stream[hits]), len(members) - 1)
    own = hits[members[near] == stream[hits]]
    if len(own) < need:
        return own[:0]
    # A window with enough places begins at most width - 1 before the last of some ``need`` that follow each other.
    first, last = own[: len(own) - need + 1], own[need - 1 :]
    low, high = np.maximum(last - width + 1, 0), np.minimum(first, len(stream) - width)
    mark = np.zeros(len(stream) + 2, np.int32)
    some = low <= high
    np.add.at(mark, low[some], 1)
    np.add.at(mark, high[some] + 1, -1)
    return np.flatnonzero(np.cumsum(mark) > 0)


def found_in(h: np.ndarray, hits: dict[int, np.ndarray], reference: Reference, bands: dict, least: float) -> dict[int, tuple[float, int, int]]:
    """For each template found: best containment, first word and number of words of its leftmost best window."""
    best: dict[int, tuple[float, int, int]] = {}
    sets: dict[int, set] = {}
    streams = {g: window_hash(h, g) for g in hits}
    for (g, width), (*known, members, size) in bands.items():
        if g not in hits:
            continue
        stream = streams[g]
        wide = min(width, len(stream))
        # With fewer places no template of this width can reach the least share.
        starts = starts_with(stream, hits[g], wide, members, max(1, int(np.ceil(least * size - 1e-9))))
        for p in range(0, len(starts), STRIP):
            own = starts[p : p + STRIP]
            for q in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                for w, t in sorted(retrieved(band_keys(stream, q, wide), known)):
                    if t not in sets:
                        sets[t] = set(reference.streams[t].tolist())
                    start = int(q[w])
                    share = len(sets[t].intersection(stream[start : start + wide].tolist())) / len(sets[t])
                    if share >= least and (t not in best or share > best[t][0]):
                        best[t] = (share, start, wide + g - 1)
    return best


def license_notices(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", template_col: str = "template_id", template_text_col: str = "text", least: float = 0.75) -> DataFrame:
    """One row per document and template found in it: doc_id, template_id, containment, start_byte, end_byte of the window.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lowered, but those of comment marks alone (``windows.MARKS``), on both
    sides, so that a header is found whose lines begin with such a mark. Shingles have five words (a template of fewer is one
    shingle). Containment is the share of a template's distinct shingles in the window, at least ``least``. Windows without
    any shingle of a template have containment 0 and get no signature. Of windows of one text that hold as much of a template,
    the leftmost is given. Null and empty texts, on either side, match nothing. Repeated rows give repeated results; empty
    tables give none. A very long text is read in parts of a megabyte and signed in strips. Other columns are not read, so
    their names can't clash.
    """
    texts = texts_of(docs, id_col, text_col)
    found = []
    for reference in references(templates.withColumn(template_col, F.col(template_col).cast("string")), template_col, template_text_col, marks=False):
        shared = sent(docs, (reference, build_bands(reference)))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            reference, bands = received(shared)
            for batch in batches:
                ids, rows = batch["doc_id"], []
                for i, h, s, e, hits in hit_rows(batch["text"], reference, marks=False):
                    for t, (share, start, n) in sorted(found_in(h, hits, reference, bands, least).items()):
                        rows.append((ids[i].as_py(), reference.keys[t], share, int(s[start]), int(e[start + n - 1])))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "template_id", "containment", "start_byte", "end_byte"])

        found.append(texts.mapInArrow(run, "doc_id long, template_id string, containment double, start_byte long, end_byte long"))
    return reduce(DataFrame.unionAll, found)
