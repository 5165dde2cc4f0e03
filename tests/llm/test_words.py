"""Words and shingles of whole batches against plain Python."""

import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
from llm_helpers import shingle_list, word_list

from freqloom.llm import hidden_markov
from freqloom.llm.common import STEP, connected, row_blocks, sent, shingles, sorted_groups, utf8, words


def test_words_and_shingles():
    rnd = random.Random(1)
    texts = [None, "", "a", "a b", " a  b\tc d\n", "A b C d E f", "é à b c d e f"]
    texts += [" ".join(rnd.choice("abC") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts.append("x y " * (STEP // 1))
    data, offsets = utf8(pa.array(texts))
    h, s, e, by_row = words(data, offsets, lower=True)
    want = [word_list(t) for t in texts]
    assert [len(w) for w in want] == list(np.diff(by_row))
    flat = [x for w in want[:-1] for x in w]
    assert [bytes(data[a:b]).decode().lower() for a, b in zip(s[: len(flat)], e[: len(flat)])] == flat
    seen = {}
    assert all(seen.setdefault(x, y) == y for x, y in zip(flat, h)) and len(set(seen.values())) == len(seen)
    got, at = shingles(h, by_row)
    seen = {}
    for i, w in enumerate(want[:-1]):
        own = got[at[i] : at[i + 1]]
        assert len(own) == len(shingle_list(w))
        assert all(seen.setdefault(x, y) == y for x, y in zip(shingle_list(w), own))
    assert len(set(seen.values())) == len(seen)


def test_row_blocks_cover_all_rows():
    offsets = np.array([0, 0, 5, 5, 105, 107, 400])
    assert [j for _, j in row_blocks(offsets, 100)][-1] == 6
    assert all(offsets[j] - offsets[i] <= 100 or j == i + 1 for i, j in row_blocks(offsets, 100))


def test_sorted_groups_are_not_split():
    keys = np.sort(np.random.default_rng(0).integers(0, 40, 500))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[p : p + 7])], ["k"]) for p in range(0, 500, 7)]
    out = [b["k"].to_numpy() for b in sorted_groups(batches, ["k"])]
    assert np.array_equal(np.concatenate(out), keys)
    assert all(x[-1] != y[0] for x, y in zip(out, out[1:]))


def test_connected(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4100)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {tuple(r) for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, root(x)) for x in up}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sent_values_need_no_package(spark, tmp_path):
    model = hidden_markov.Model(np.ones(1), np.ones((1, 1)), np.ones((3, 1)))
    (tmp_path / "value").write_bytes(sent(spark.range(1), model).value)
    said = "import pickle, sys; m = pickle.load(open(sys.argv[1], 'rb')); print(m.emit.shape, 'freqloom' in sys.modules)"
    path = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", said, str(tmp_path / "value")], cwd=tmp_path, env=path, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["(3,", "1)", "False"]
