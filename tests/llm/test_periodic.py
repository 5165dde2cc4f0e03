"""Runs of repeated words against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from llm_helpers import ODD

from freqloom.llm import periodic
from freqloom.llm.common import mix
from freqloom.llm.queries import planted


def brute(w):
    """Runs by comparing the sequence with itself at every distance."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((i, j - i, q) for (i, j), q in found.items())


def collapse(w, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_sequence(rnd):
    kinds = rnd.randint(1, 4)
    s = [rnd.randrange(kinds) for _ in range(rnd.randint(0, 60))]
    if rnd.random() < 0.6:
        s = ([rnd.randrange(kinds) for _ in range(rnd.randint(1, 7))] * 40)[: rnd.randint(0, 60)]
        for _ in range(rnd.randint(0, 3)):
            if s:
                s[rnd.randrange(len(s))] = rnd.randrange(kinds)
        s += (s[: rnd.randint(0, 9)] + [rnd.randrange(kinds) for _ in range(rnd.randint(1, 3))] * rnd.randint(0, 6)) * rnd.randint(1, 5)
    return s


@pytest.mark.parametrize("seed,chunk", [(1, 1 << 20), (2, 5)])
def test_sequences(monkeypatch, seed, chunk):
    """Sequences that share a grammar; and the filter before it loses no run."""
    monkeypatch.setattr(periodic, "CHUNK", chunk)
    rnd = random.Random(seed)
    for _ in range(500):
        parts = [random_sequence(rnd) for _ in range(rnd.randint(1, 4))]
        at = np.concatenate(([0], np.cumsum([len(s) for s in parts])))
        w = np.array(sum(parts, []), np.int64)
        want = [(k, *r) for k, s in enumerate(parts) for r in brute(s)]
        got = periodic.sequence_runs(w, np.repeat(np.arange(len(parts)), np.diff(at)))
        own = np.searchsorted(at, got.start, "right") - 1
        assert sorted(zip(own, got.start - at[own], got.end - got.start, got.period)) == want
        row, got = periodic.row_runs(mix(w.astype(np.uint64) + np.uint64(5)), at)
        assert list(zip(row, got.start, got.end - got.start, got.period)) == want


def test_words_of_long_sequences():
    """Powers of one word, of two, of many, and a Fibonacci word, which has no fourth power."""
    n = 100_000
    for w, want in (([0] * n, [(0, n, 1)]), ([0, 1] * (n // 2), [(0, n, 2)]), ([i % 977 for i in range(n)], [(0, n, 977)])):
        got = periodic.sequence_runs(np.array(w), np.zeros(n, np.int64))
        assert list(zip(got.start, got.end, got.period)) == want
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    assert not len(periodic.sequence_runs(np.array(b), np.zeros(len(b), np.int64)).start)


def test_grammar_gives_the_sequences_back():
    rnd = random.Random(4)
    parts = [random_sequence(rnd) for _ in range(40)]
    w, part = np.array(sum(parts, []), np.int64), np.repeat(np.arange(40), [len(s) for s in parts])
    rules = periodic.grammar(w, part)
    assert len(rules.rule) == sum(max(0, len(s) - 1) for s in parts)  # one place for each inner node
    assert len(rules.low) < len(rules.rule)
    size = rules.high - rules.low
    for rule, place in zip(rules.rule.tolist(), rules.place.tolist()):
        assert (w[place : place + size[rule]] == w[rules.low[rule] : rules.high[rule]]).all()
        assert rules.low[rule] < rules.middle[rule] < rules.high[rule] and part[place] == part[place + size[rule] - 1]


def texts(seed):
    rnd = random.Random(seed)
    pairs = [*ODD, (20, "a a a a a"), (21, "a a a a a a"), (22, " a a  a\ta\na a"), (23, "x a b a b a b a b y"), (24, "A a A a A a A a"), (25, "é ü é ü é ü é ü")]
    return pairs + [(100 + i, " ".join(f"w{x}" for x in random_sequence(rnd))) for i in range(200)]


def expected(pairs):
    out = collections.Counter()
    for i, t in pairs:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        found = brute(w) if len(w) < 10_000 else [(0, len(w), 977)]
        out[i, len(w), tuple(found), collapse(w, found)] += 1
    return out


def test_documents(spark, make):
    for parts in (1, 5):
        got = periodic.periodic_runs(make(texts(parts)).repartition(parts)).collect()
        assert collections.Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in got) == expected(texts(parts))
    assert periodic.periodic_runs(make([])).count() == 0


def test_names_may_differ(spark, make):
    docs = make([(1, "a b a b a b a b")]).withColumnRenamed("doc_id", "runs").withColumnRenamed("text", "collapsed")
    got = periodic.periodic_runs(docs, "runs", "collapsed").collect()
    assert [(r.doc_id, r.collapsed) for r in got] == [(1, "a b")]


def test_planted_periods(spark, make):
    import zlib

    pairs = [(i, " ".join(f"w{j}" for j in range(i % 50))) for i in range(300)] + [(None, "one two"), (301, None), (302, "")]
    for r in planted(make(pairs)).collect():
        w, h = (dict(pairs)[r.doc_id] or "").split(), zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and w:
            a = (h // 10) % len(w)
            p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
            assert r.text.split() == w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
        else:
            assert r.text == dict(pairs)[r.doc_id]
