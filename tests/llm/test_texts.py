"""Suffix dedup, windows against references, and the classifier, against brute force."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import ODD, shingle_list, word_list
from pyspark.sql import functions as F

from freqloom.llm import decontaminate, license_scan, quality, suffix_dedup

SF = "/root/testdata/sf0.001"


def brute_repeats(pairs, n):
    texts = [(i, (t or "").encode()) for i, t in pairs]
    seen = collections.Counter(b[s : s + n] for _, b in texts for s in range(len(b) - n + 1))
    out = collections.Counter()
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if seen[b[s : s + n]] > 1:
                gone[s : s + n] = b"\1" * n
        kept = bytes(c for c, f in zip(b, gone) if not f)
        out[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return out


def digests(rows):
    return collections.Counter(tuple(r) for r in rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())


def test_repeats_of_documents(documents):
    assert digests(suffix_dedup.without_repeats(documents)) == brute_repeats([(r.doc_id, r.text) for r in documents.collect()], 200)


@pytest.mark.parametrize("rows", [60_000, 40])
def test_repeats_of_odd_rows(make, monkeypatch, rows):
    """Also with many small runs and parts: periodic texts, overlaps, exact lengths, and copies with edits nearby."""
    monkeypatch.setattr(suffix_dedup, "RUN_ROWS", rows)
    monkeypatch.setattr(suffix_dedup, "PART_ROWS", rows)
    rnd = random.Random(2)
    passage = "".join(rnd.choice("abcdé ") for _ in range(260))
    pairs = [p for p in ODD if p[0] != 8] + [(30, "ab" * 150), (31, "z" * 199), (32, "z" * 200), (33, "y" * 201)]
    for k in range(30):
        cut = rnd.randrange(0, 60)
        pairs.append((40 + k, "".join(rnd.choice("xyz") for _ in range(rnd.randrange(300))) + passage[cut : cut + rnd.choice((150, 198, 199, 200, 201, 230))] + rnd.choice("QRST") * rnd.randrange(9)))
    pairs += [(None, passage), (90, passage), (90, passage)]
    assert digests(suffix_dedup.without_repeats(make(pairs))) == brute_repeats(pairs, 200)


def test_repeats_of_a_small_length(make):
    rnd = random.Random(4)
    pairs = [(k, "".join(rnd.choice("ab") for _ in range(rnd.randrange(40)))) for k in range(60)]
    assert digests(suffix_dedup.without_repeats(make(pairs), length=9, gram=4)) == brute_repeats(pairs, 9)
    assert suffix_dedup.without_repeats(make([])).count() == 0


def test_merge_of_front_coded_runs():
    rnd = random.Random(6)
    for count in (1, 2, 5, 8):
        runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(12))) for _ in range(rnd.randrange(30))) for _ in range(count)]
        coded = [suffix_dedup.front_code(r) for r in runs]
        assert [suffix_dedup.front_decode(*c) for c in coded] == runs
        order, shared = suffix_dedup.merge_runs([(r, c[0]) for r, c in zip(runs, coded)])
        merged = [runs[a][b] for a, b in order]
        assert merged == sorted(x for r in runs for x in r) and len(set(order)) == len(order)
        assert shared[1:] == [suffix_dedup.common_prefix(x, y, 0) for x, y in zip(merged, merged[1:])]


def brute_leaks(pairs, items, least=0.75):
    out = {}
    for i, t in pairs:
        w = word_list(t)
        for k, u in items:
            v = word_list(u)
            if not v:
                continue
            g = min(5, len(v))
            sh = [tuple(w[j : j + g]) for j in range(len(w) - g + 1)]
            want = collections.Counter(shingle_list(v))
            m = sum(want.values())
            n = min(m, len(sh))
            best = max((sum((collections.Counter(sh[a : a + n]) & want).values()) for a in range(len(sh) - n + 1)), default=0)
            if n and best / (m + n - best) >= least:
                out.setdefault((i, k), []).append(best / (m + n - best))
    return {key: sorted(v) for key, v in out.items()}


def found(rows, key, value):
    out = {}
    for r in rows.collect():
        out.setdefault((r.doc_id, r[key]), []).append(r[value])
    return {k: sorted(v) for k, v in out.items()}


def same(got, want):
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_leaks_of_documents(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = found(decontaminate.leaks(documents, items), "item_id", "similarity")
    want = brute_leaks([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    same(got, want)


@pytest.mark.parametrize("slice_rows", [20_000, 7])
def test_leaks_with_edits_and_odd_rows(spark, make, monkeypatch, slice_rows):
    monkeypatch.setattr(decontaminate, "SLICE_ITEMS", slice_rows)
    rnd = random.Random(9)
    items = [(k, " ".join(f"t{rnd.randrange(900)}" for _ in range(rnd.choice((2, 5, 12, 30, 60))))) for k in range(25)]
    items += [(50, None), (51, ""), (None, "an item that has no number at all"), (3, items[4][1]), (60, "la " * 20)]
    pairs = [p for p in ODD if p[0] != 8]
    for k in range(120):
        words = rnd.choice(items[:25])[1].split()
        for _ in range(rnd.choice((0, 0, 1, 2, 3))):
            words[rnd.randrange(len(words))] = "edit"
        pairs.append((100 + k, " ".join([f"u{rnd.randrange(99)}" for _ in range(rnd.randrange(30))] + words + ["end"] * rnd.randrange(4))))
    pairs += [(400, "La la  LA " * 9), (401, "AN item that\nhas no number at all")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("place", F.lit("x")).withColumn("key", F.lit(1))
    got = found(decontaminate.leaks(make(pairs), table), "item_id", "similarity")
    want = brute_leaks(pairs, items)
    same(got, want)
    kept = {r.doc_id for r in decontaminate.keep_clean(make(pairs), table).select("doc_id").collect()}
    assert kept == {i for i, _ in pairs} - {i for i, _ in want}
    assert decontaminate.leaks(make([]), table).count() == 0
    assert decontaminate.leaks(make(pairs), table.limit(0)).count() == 0


def flipped(prints, rng, most):
    """Copies of random rows with up to ``most`` bits changed in each print."""
    out = prints[rng.integers(0, len(prints), 500)].copy()
    for row in out:
        for k in range(out.shape[1]):
            for bit in rng.choice(64, rng.integers(0, most), replace=False):
                row[k] ^= np.uint64(1) << np.uint64(bit)
    return out


def test_hamming_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 1 << 64, (60, decontaminate.PRINTS), dtype=np.uint64)
    probes = flipped(items, rng, 30)
    index = decontaminate.HammingIndex(np.arange(60), items)
    got = set(zip(*map(np.ndarray.tolist, index.within(probes))))
    distance = np.bitwise_count(probes[:, None] ^ items[None]).min(axis=2)
    assert got == {(int(w), int(k)) for w, k in zip(*np.nonzero(distance <= decontaminate.RADIUS))}


def test_hamming_index_leaves_most_pairs_out():
    """Of pairs that have nothing to do with each other a block lets through what its bits say, all of them a fifth a print."""
    rng = np.random.default_rng(4)
    items, probes = (rng.integers(0, 1 << 64, (n, decontaminate.PRINTS), dtype=np.uint64) for n in (300, 2000))
    index = decontaminate.HammingIndex(np.arange(300), items)
    w, block, place = index.met(probes)
    met = [(w * 300 + place)[block == b] for b in range(decontaminate.PRINTS * len(decontaminate.BLOCKS))]
    assert all(0.03 < len(pairs) / 600_000 < 0.08 for pairs in met)
    for k in range(decontaminate.PRINTS):
        assert 0.15 < len(np.unique(np.concatenate(met[len(decontaminate.BLOCKS) * k :][: len(decontaminate.BLOCKS)]))) / 600_000 < 0.25
    assert len(index.within(probes)[0]) < 0.003 * 600_000


@pytest.mark.parametrize("width", [9, 24, 60])
def test_prints_of_similar_windows_are_near(width):
    """Pairs at the least similarity or just above it: hardly one of 4,000 is beyond the radius in both prints."""
    rng = np.random.default_rng(width)
    both = math.ceil(1.5 * width / 1.75)
    assert both / (2 * width - both) >= 0.75
    near = []
    for _ in range(4000):
        stream = rng.integers(0, 1 << 64, 2 * width - both, dtype=np.uint64)
        x, y = (decontaminate.fingerprints(np.ascontiguousarray(s), np.zeros(1, np.int64), width) for s in (stream[:width], stream[len(stream) - width :]))
        near.append(np.bitwise_count(x ^ y).min() <= decontaminate.RADIUS)
    assert np.mean(near) > 0.999


@pytest.mark.parametrize("parts", [1, 6])
def test_grams_that_occur_often(spark, make, monkeypatch, parts):
    """A passage in many contexts is split by distance over several parts, by narrower ranges the more often it occurs."""
    monkeypatch.setattr(suffix_dedup, "SPLITS", ((3, 20), (12, 5), (40, 1)))
    monkeypatch.setattr(suffix_dedup, "PART_ROWS", 40)
    monkeypatch.setattr(suffix_dedup, "RUN_ROWS", 50)
    rnd = random.Random(parts)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passages = [word(n) for n in (180, 199, 200, 201, 260, 600)]
    pairs = []
    for k, passage in enumerate(passages):
        for _ in range((6, 15, 60, 20, 45, 50)[k]):
            pairs.append((len(pairs), word(rnd.choice((0, 3, 90, 170))) + passage + word(rnd.choice((0, 5, 150)))))
    # The same bytes before or behind: strings that reach out of the passage.
    for tail in range(30):
        pairs.append((len(pairs), word(rnd.choice((0, 40))) + passages[0] + "same behind it" * 2 + word(9)))
        pairs.append((len(pairs), "and the same before " + passages[1][: 150 + tail] + word(70)))
    pairs += [(500, passages[4]), (500, passages[4]), (None, passages[2]), (501, passages[5] * 3)]
    assert digests(suffix_dedup.without_repeats(make(pairs).repartition(parts))) == brute_repeats(pairs, 200)


def test_ranges_cover_all_distances():
    for count in (1, *(least for least, _ in suffix_dedup.SPLITS), 10**9):
        ranges = suffix_dedup.ranges_of(count, 160)
        assert [d for a, b in ranges for d in range(a, b + 1)] == list(range(161))
    assert suffix_dedup.ranges_of(suffix_dedup.SPLITS[0][0] - 1, 160) == [(0, 160)] and len(suffix_dedup.ranges_of(10**9, 160)) == 161


def unmarked(text):
    return [x for x in word_list(text) if not re.fullmatch("[#/*;%!<>\"'-]+", x)]


def brute_notices(pairs, templates, least=0.75):
    out = {}
    for i, t in pairs:
        w = unmarked(t)
        for k, u in templates:
            v = unmarked(u)
            if not v:
                continue
            g = min(5, len(v))
            sh, want = [tuple(w[j : j + g]) for j in range(len(w) - g + 1)], shingle_list(v)
            n = min(len(want), len(sh))
            best = max((len(set(want) & set(sh[a : a + n])) / len(set(want)) for a in range(len(sh) - n + 1)), default=0)
            if best >= least:
                out.setdefault((i, k), []).append(best)
    return {key: sorted(v) for key, v in out.items()}


def test_license_notices(spark, make):
    rnd = random.Random(8)
    templates = [*license_scan.TEMPLATES.items(), ("none", None), ("blank", " "), ("two", "Licence: X"), (None, "a template without any name given")]
    pairs = [p for p in ODD if p[0] != 8]
    for k in range(150):
        words = (rnd.choice([t for _, t in templates if t and t.strip()])).split()
        if rnd.random() < 0.4:
            words[rnd.randrange(len(words))] = "edit"
        pairs.append((100 + k, " ".join(["pre"] * rnd.randrange(5) + words + ["post"] * rnd.randrange(5))))
    table = spark.createDataFrame(templates, "template_id string, text string")
    got = found(license_scan.license_notices(make(pairs), table), "template_id", "containment")
    want = brute_notices(pairs, templates)
    same(got, want)
    assert license_scan.license_notices(make([]), table).count() == 0
    assert license_scan.license_notices(make(pairs), table.limit(0)).count() == 0


def test_license_notices_of_documents(spark, documents):
    got = found(license_scan.license_notices(documents, license_scan.template_table(spark)), "template_id", "containment")
    same(got, brute_notices([(r.doc_id, r.text) for r in documents.collect()], license_scan.TEMPLATES.items()))


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, quality.fit_quality(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.98
    assert sum(r.predicted for r in held if r.quality == 1) >= 0.97 * len(good)


@pytest.mark.parametrize("n", [10, 1000, 8000])
def test_passes_do_not_depend_on_the_sample(n):
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(64, 5, replace=False)).astype(np.int32), np.full(5, 0.4, np.float32)) for _ in range(n)]
    labels = np.array([float(at[0] < 8) for at, _ in rows])
    own, fixed = quality.ftrl(rows, labels, bits=6), quality.ftrl(rows, labels, bits=6, epochs=quality.EPOCHS)
    assert own.bias == fixed.bias and (own.weights == fixed.weights).all()


def test_training_holds_no_second_copy_of_the_sample():
    rnd = np.random.default_rng(4)
    rows = [(np.sort(rnd.choice(1 << 10, 500, False)).astype(np.int32), rnd.random(500).astype(np.float32)) for _ in range(1000)]
    labels = np.arange(1000) % 2
    batches = [pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x, _ in part], pa.binary()), pa.array([x.tobytes() for _, x in part], pa.binary())], ["at", "value"]) for part in (rows[:300], rows[300:])]
    order = rnd.permutation(1000)
    tracemalloc.start()
    try:
        own = quality.ftrl(rows, labels, bits=10, epochs=2)
        assert tracemalloc.get_traced_memory()[1] < 1 << 20, "the rows themselves are 4 MB"
        mixed = quality.ftrl(quality.SparseRows(batches, order), labels[order], bits=10, epochs=2)
        assert tracemalloc.get_traced_memory()[1] < 1 << 20
    finally:
        tracemalloc.stop()
    want = quality.ftrl([rows[i] for i in order], labels[order], bits=10, epochs=2)
    assert (mixed.weights == want.weights).all() and mixed.bias == want.bias and (own.weights != want.weights).any()


def plain_ftrl(rows, labels, size, epochs, alpha=1.0, beta=1.0, l1=1e-4, l2=1e-4):
    """The update rule in plain Python, one number at a time; the last coordinate is the bias."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            own = [*row, (size, 1.0)]
            w = {i: weight(i) for i, _ in own}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in own)))))
            for i, v in own:
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return [weight(i) for i in range(size + 1)]


def test_quality_against_plain_training(spark):
    """The registered model and its scores against training one number at a time on the same hashed features."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    order = sorted(marks, key=lambda i: (zlib.crc32(str(i).encode()), i))

    def features(ids):
        found = quality.sparse_rows(pa.RecordBatch.from_arrays([pa.array([texts[i] for i in ids], pa.string())], ["text"]))
        return [list(zip(at.tolist(), v.tolist(), strict=True)) for at, v in found]

    want = plain_ftrl(features(order), [marks[i] for i in order], 1 << quality.BITS, quality.EPOCHS)
    model = quality.fit_quality(docs, labels)
    assert np.abs(model.weights - np.array(want[:-1])).max() < 1e-6 and abs(model.bias - want[-1]) < 1e-6
    ids = sorted(texts)
    scores = {i: 1 / (1 + math.exp(-sum(want[at] * v for at, v in row) - want[-1])) for i, row in zip(ids, features(ids), strict=True)}
    assert all(abs(r.score - scores[r.doc_id]) < 1e-5 for r in quality.score(docs, model).collect())


def test_quality_of_odd_rows(spark, make):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(1, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    pairs = [p for p in ODD] + [(k, "good words here" if k % 2 else "### bad ###") for k in range(11, 40)]
    model = quality.fit_quality(make(pairs), labels)
    rows = quality.score(make(pairs), model).collect()
    assert len(rows) == len(pairs) and all(0 < r.score < 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[13] > by[12] and by[1] == by[2] == by[3]
    kept = quality.keep_good(make(pairs), model)
    assert kept.columns == make(pairs).columns
    assert collections.Counter(r.doc_id for r in kept.select("doc_id").collect()) == collections.Counter(r.doc_id for r in rows if r.predicted)
    blank = quality.fit_quality(make(pairs), labels.limit(0))
    assert {r.score for r in quality.score(make(pairs), blank).collect()} == {0.5}
    assert quality.score(make([]), model).count() == 0


def test_registered_templates_find_common_wordings(spark, make):
    """Headers, paragraphs with edits and short notices as they stand in other texts."""
    texts = {
        1: ("Apache-2.0-notice", 'Copyright 2020 X. Licensed under the Apache License, Version 2.0 (the "License");'),
        2: ("MIT-notice", "Code is Released under the MIT License and free"),
        3: ("GPL-3.0-header", "Tool 1.0. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
        4: ("Apache-2.0-copyright", "2. Grant of Copyright License. Subject to the terms of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
        5: ("BSD-3-Clause-names", "* Neither the name of Acme Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
        6: ("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
        7: ("ISC-permission", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
        8: ("CC-BY-SA-4.0-notice", "Photos are licensed under a Creative Commons Attribution-ShareAlike 4.0 International License unless said"),
        9: ("AGPL-3.0-notice", "It is covered under the GNU Affero General Public License v3.0 or later"),
        10: ("LGPL-2.1-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or later."),
    }
    rows = license_scan.license_notices(make([*[(i, t) for i, (_, t) in texts.items()], (99, "A story about the license to fish under the old bridge.")]), license_scan.template_table(spark)).collect()
    got = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r.template_id)
    assert {i: want for i, (want, _) in texts.items() if not any(t.startswith(want) for t in got[i])} == {}
    assert 99 not in got
    assert not any(t.startswith(("LGPL-3.0-notice", "AGPL-3.0-notice")) for t in got[10])
    assert not any(t.startswith("GPL-2.0-notice") for t in got[3])


def test_headers_behind_comment_marks(spark, make):
    """Marks at the lines' beginnings and ends are no words; the span given holds the header."""
    lines = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    wrapped = [("# ", "", ""), ("// ", "", ""), (" * ", "/**\n", "\n */"), (";; ", "", ""), ("% ", "", ""), ("-- ", "", ""), ("! ", "", ""), ("  ", "<!--\n", "\n-->"), ("", '"""\n', '\n"""')]
    texts = {k: f"#!/bin/x\n{top}" + "\n".join(mark + x for x in lines) + f"{end}\nx = 1\n" for k, (mark, top, end) in enumerate(wrapped)}
    found_in = {}
    for r in license_scan.license_notices(make(list(texts.items())), license_scan.template_table(spark)).collect():
        if r.template_id == "GPL-3.0-header":
            found_in[r.doc_id] = texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode()
    assert found_in.keys() == texts.keys()
    assert all("redistribute it" in t and "of the License" in t for t in found_in.values())


def test_long_templates_stand_edits():
    """A word in the middle may change in 24 words or more, as it breaks at most five shingles."""
    for text in license_scan.TEMPLATES.values():
        words = word_list(text)
        assert len(words) >= 5 and "'" not in text
        if len(words) >= 24:
            edit = shingle_list([*words[: len(words) // 2], "edit", *words[len(words) // 2 + 1 :]])
            assert len(set(shingle_list(words)) & set(edit)) >= 0.75 * len(set(shingle_list(words)))
