"""Near and exact duplicates against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import ODD, shingle_list, word_list
from pyspark.sql import functions as F

from freqloom.llm import exact_dedup, near_dedup


def brute_components(pairs):
    sets = collections.defaultdict(set)
    for i, t in pairs:
        if i is not None:
            s = frozenset(shingle_list(word_list(t)))
            if s:
                sets[i].add(s)
    up = {i: i for i, _ in pairs if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = collections.defaultdict(set)
    for i, own in sets.items():
        for s in own:
            for x in s:
                holders[x].add(i)
    close = {(i, j) for ids in holders.values() for i in ids for j in ids if i < j}
    for i, j in close:
        if any(100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j]):
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    out = collections.Counter()
    for i, t in pairs:
        n = len(set(shingle_list(word_list(t))))
        c = None if i is None else root(i) if n else i
        out[i, n, c, i is None or c == i] += 1
    return out


def edited(rnd, words, share):
    words = list(words)
    for _ in range(max(1, int(len(words) * share))):
        words[rnd.randrange(len(words))] = rnd.choice("pqrstuv") * 3
    return " ".join(words)


def test_near_duplicates_of_documents(documents):
    got = collections.Counter(tuple(r) for r in near_dedup.near_duplicates(documents).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in documents.collect()])


def test_near_duplicates_of_edits_and_odd_rows(make):
    rnd = random.Random(5)
    bases = [[f"{rnd.choice('abcdefg')}{rnd.randrange(5000)}" for _ in range(rnd.choice((4, 5, 8, 30, 200)))] for _ in range(40)]
    pairs = list(ODD)
    for k in range(300):
        pairs.append((100 + k, edited(rnd, rnd.choice(bases), rnd.choice((0.004, 0.02, 0.05, 0.1)))))
    got = near_dedup.near_duplicates(make(pairs)).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_components(pairs)


def test_near_duplicates_in_many_blocks(make, monkeypatch):
    """Small blocks: a group of copies around a base is compared over many pairs of blocks, and buckets are chained."""
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 500)
    rnd = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    pairs = [(k, edited(rnd, base, 0.02)) for k in range(80)] + [(200, " ".join(base))]
    got = near_dedup.near_duplicates(make(pairs)).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_components(pairs)


def test_large_groups_that_fall_into_parts(make, monkeypatch):
    """Candidates by loose signatures, half of whom are no links: parts within and across blocks are told apart."""
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 700)
    rnd = random.Random(8)
    pairs = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(60)]
        for variant in range(5):
            # Variants of a family share two thirds; their copies are near.
            own = base[:44] + [f"f{family}v{variant}w{i}" for i in range(16)]
            pairs += [(1000 * family + 100 * variant + k, edited(rnd, own, 0.01)) for k in range(9)]
    got = near_dedup.near_duplicates(make(pairs)).collect()
    want = brute_components(pairs)
    assert collections.Counter(tuple(r) for r in got) == want and 4 <= len({c for _, _, c, _ in want}) < 100


def test_empty_tables(make):
    assert near_dedup.near_duplicates(make([])).count() == 0
    assert near_dedup.keep_one(make([])).count() == 0
    assert exact_dedup.exact_duplicates(make([])).count() == 0
    assert exact_dedup.keep_first(make([])).count() == 0


def test_keep_one(make):
    text = " ".join(f"w{i}" for i in range(100))
    rows = near_dedup.keep_one(make([(3, text), (2, text + " more"), (7, "other words that stand alone here"), (None, text)]))
    assert sorted((r.doc_id is not None, r.doc_id) for r in rows.select("doc_id").collect()) == [(False, None), (True, 2), (True, 7)]
    assert "grp" in rows.columns


def test_index_finds_all_signatures_within_the_guaranteed_distance():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (400, near_dedup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.SYMBOLS, near_dedup.GUARANTEED, replace=False)] ^= 1
    assert (near_dedup.chunk_keys(a) == near_dedup.chunk_keys(b)).any(axis=1).all()


@pytest.mark.parametrize("cuts", [[], [3], [3, 6], [1, 8], [1, 2, 3, 4, 5, 6, 7, 8, 9]])
@pytest.mark.parametrize("block", [4, 4096])
def test_candidates_of_a_split_run(monkeypatch, cuts, block):
    """Rows 1 and 8 are close and the first row is far from both: blocks or batches between them don't part them."""
    if block > 10 and not cuts:
        cuts = [5]
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", block)
    rng = np.random.default_rng(2)
    low = rng.integers(0, 256, (10, near_dedup.SYMBOLS)).astype(np.uint8)
    low[8] = low[1]
    low[8, :5] ^= 1
    keys = np.full(12, 7)
    keys[[0, 11]] = 3, 9
    ids, low = np.arange(12) - 1, np.concatenate([low[:1], low, low[:1]])
    batches = [
        pa.RecordBatch.from_arrays([pa.array(keys[i:j]), pa.array(ids[i:j]), near_dedup._fixed(low[i:j])], ["key", "doc_id", "low"])
        for i, j in zip([0, *(c + 1 for c in cuts)], [*(c + 1 for c in cuts), 12])
    ]
    up = {int(i): int(i) for i in ids}
    for out in near_dedup._candidates(batches):
        for x, y in zip(out["a"].to_pylist(), out["b"].to_pylist()):
            up = {k: up[y] if v == up[x] else v for k, v in up.items()}
    assert up[1] == up[8]
    assert up[-1] == -1 and up[10] == 10


def test_confirmed_forest_matches_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(300) < 0.93], rng.integers(0, 1 << 60, 9).astype(np.uint64)))) for _ in range(60)]
    links = near_dedup.confirmed(sets, np.zeros(60, np.int64), 75)
    assert all(100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j])) for i, j in links)

    def parts(pairs):
        up = list(range(60))
        for i, j in pairs:
            x, y = up[i], up[j]
            up = [min(x, y) if u in (x, y) else u for u in up]
        return up

    every = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    assert parts(links) == parts(every)


def brute_exact(pairs):
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in pairs]
    out = collections.Counter()
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        out[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


PAIRS = [*ODD, (20, "a  b\n"), (21, "a b "), (22, "a b"), (23, " a b"), (None, "only without number"), (None, "only without  number")]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(make, weak):
    """With a one-digit hash all groups collide, and bytes still tell them apart."""
    options = {"content_hash": lambda c: F.substring(F.md5(c), 1, 1)} if weak else {}
    got = exact_dedup.exact_duplicates(make(PAIRS), **options)
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_exact(PAIRS)


def test_keep_first(make):
    rows = exact_dedup.keep_first(make(PAIRS))
    want = collections.Counter()
    for (i, _, _, kept, digest), n in brute_exact(PAIRS).items():
        if kept:
            want[i, digest] += n
    # An id that stands for several texts goes with any of them that goes.
    gone = {i for (i, _, _, kept, _) in brute_exact(PAIRS) if not kept and i is not None}
    got = collections.Counter((r.doc_id, hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", r.text or "").encode()).hexdigest()) for r in rows.select("doc_id", "text").collect())
    assert got == collections.Counter({k: n for k, n in want.items() if k[0] not in gone})
