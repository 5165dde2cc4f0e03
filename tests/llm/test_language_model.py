"""The hidden Markov model against plain Python: counts, training, forward likelihoods, and whole scores."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import ODD, word_list
from pyspark.sql import functions as F

from freqloom.llm import hidden_markov as hm
from freqloom.llm.common import utf8, words

SMALL = dict(states=3, classes=17, rounds=3)


def random_model(rng, states, classes):
    start, step, emit = rng.random(states), rng.random((states, states)), rng.random((classes, states))
    return hm.Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def paths(model, ids):
    """Probability and states of every path."""
    for z in itertools.product(range(len(model.start)), repeat=len(ids)):
        p = model.start[z[0]] * model.emit[ids[0], z[0]]
        for i in range(1, len(ids)):
            p *= model.step[z[i - 1], z[i]] * model.emit[ids[i], z[i]]
        yield p, z


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_forward_and_counts_by_all_paths(limit):
    rng = np.random.default_rng(2)
    model = random_model(rng, 3, 5)
    texts = [rng.integers(0, 5, n).tolist() for n in (1, 6, 2, 4, 4, 1, 5)]
    strip = hm.Strip(np.array(sum(texts, []), np.uint16), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    start, step, emit, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), []
    for ids in texts:
        every = list(paths(model, ids))
        total = sum(p for p, _ in every)
        logs.append(math.log10(total))
        for p, z in every:
            start[z[0]] += p / total
            for i, k in enumerate(z):
                emit[ids[i], k] += p / total
                if i:
                    step[z[i - 1], k] += p / total
    got = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    strip.expected_counts(model, *got, limit=limit)
    assert all(np.allclose(x, y, atol=1e-12) for x, y in zip(got, (start, step, emit)))
    assert np.allclose(strip.log10_likelihood(model, limit), logs, atol=1e-12)


def plain_forward(model, ids):
    a, total = model.start * model.emit[ids[0]], 0.0
    for i, x in enumerate(ids):
        if i:
            a = (a @ model.step) * model.emit[x]
        total += math.log10(a.sum())
        a = a / a.sum()
    return total


def plain_counts(model, ids):
    """Expected starts, steps and emissions by unscaled forward and backward values."""
    n, states = len(ids), len(model.start)
    f, b = np.zeros((n, states)), np.ones((n, states))
    f[0] = model.start * model.emit[ids[0]]
    for i in range(1, n):
        f[i] = (f[i - 1] @ model.step) * model.emit[ids[i]]
    for i in range(n - 2, -1, -1):
        b[i] = model.step @ (model.emit[ids[i + 1]] * b[i + 1])
    total = f[-1].sum()
    step = sum((np.outer(f[i], model.emit[ids[i + 1]] * b[i + 1]) * model.step for i in range(n - 1)), np.zeros((states, states)))
    return f[0] * b[0] / total, step / total, f * b / total


def token_class(word, classes):
    data, offsets = utf8(pa.array([word]))
    return int(hm.classes_of(words(data, offsets, lower=True)[0], classes)[0])


def plain_scores(pairs, learnt, states, classes, rounds):
    """Everything again with dictionaries and one text at a time; only the first model is taken from the module."""
    tokens = [word_list(t) for _, t in pairs]
    count = collections.Counter(w for t, own in zip(tokens, learnt) if own for w in t)
    ends = sum(learnt)
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    box = {w: token_class(w, classes) for t in tokens for w in t}
    class_tokens, class_words = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    class_tokens[0], class_words[0] = ends, ends > 0
    for w, c in count.items():
        class_tokens[box[w]] += c
        class_words[box[w]] += 1
    vocab = hm.Vocabulary(None, n, v, ends, class_tokens, class_words, None, None, 1)
    model, share = hm.first_model(vocab, states), class_tokens + class_words + 1.0
    share = share / share.sum()
    ids = [[*(box[w] for w in t), 0] for t in tokens]
    for _ in range(rounds):
        start, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
        for x, own in zip(ids, learnt):
            if own:
                s, p, g = plain_counts(model, x)
                start, step = start + s, step + p
                for i, k in enumerate(x):
                    emit[k] += g[i]
        start, step, emit = start + 1, step + 1, emit + hm.PRIOR * share[:, None]
        model = hm.Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    out = []
    for (i, _), own, t, x in zip(pairs, learnt, tokens, ids):
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t) + math.log10((ends + 1) / (n + v + 1))
        score = plain_forward(model, x) + sum(math.log10((count[w] + 1) / (class_tokens[box[w]] + class_words[box[w]] + 1)) for w in t)
        out.append((i, not own, len(t) + 1, sum(w in count for w in t) + (ends > 0), n, base, score))
    return out


def learn(column="doc_id"):
    return F.crc32(F.col(column).cast("string")) % 7 != 2


def is_learnt(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 != 2


def same(got, want, digits=1e-5):
    got, want = (sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5])) for x in (got, want))
    assert [tuple(r)[:5] for r in got] == [tuple(r)[:5] for r in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) <= 1e-9 * max(1, abs(w[5])) and abs(g[6] - w[6]) <= digits * max(1, abs(w[6]))


def case(n=120):
    rnd = random.Random(7)
    pairs = [(i, t if len(t or "") < 10_000 else t[:300]) for i, t in ODD]
    for i in range(100, 100 + n):
        vocabulary = [f"{'ab'[i % 2]}{int(rnd.paretovariate(0.7)) % 60}" for _ in range(rnd.randint(0, 25))]
        pairs.append((i, " ".join(vocabulary)))
    return pairs + [(900, "Mixed CASE words"), (901, "mixed case WORDS"), (902, "words met nowhere else")]


@pytest.mark.parametrize("heavy,parts", [(hm.HEAVY, 1), (30, 4), (1, 3)])
def test_scores(spark, make, heavy, parts):
    """All words broadcast, some, and hardly any."""
    docs = make(case()).repartition(parts)
    got = hm.language_scores(docs, learn(), heavy=heavy, **SMALL)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert [t for _, t in got.dtypes] == ["bigint", "boolean", "bigint", "bigint", "bigint", "double", "double"]
    same(got.collect(), plain_scores(case(), [is_learnt(i) for i, _ in case()], **SMALL))


def test_parts_of_a_task_and_of_time(spark, make, monkeypatch):
    monkeypatch.setattr(hm, "HELD_WORDS", 20)
    rows = hm.prepared(make(case()), learn())
    vocab = hm.vocabulary(rows, 17, 30)
    texts = hm.encoded(rows, vocab)
    model = hm.baum_welch(texts.where("not held_out"), vocab, hm.first_model(vocab, 3), 3, gather=100, strip=7)
    got = hm.scored(texts, vocab, model, gather=100, strip=7).collect()
    same(got, plain_scores(case(), [is_learnt(i) for i, _ in case()], **SMALL))


def test_very_long_text(spark, make):
    pairs = [(8, dict(ODD)[8]), (1, "one two"), (2, "w1 w2 w3")]
    got = {r.doc_id: r for r in hm.language_scores(make(pairs), F.lit(True), **SMALL).collect()}
    assert got[8].n_tokens == 300_001 and got[8].n_known == 300_001 and math.isfinite(got[8].score)


def test_nothing_to_learn_from(spark, make):
    pairs = [(1, "one two"), (2, None)]
    got = hm.language_scores(make(pairs), F.lit(False), **SMALL).collect()
    same(got, plain_scores(pairs, [False, False], **SMALL))
    assert hm.language_scores(make([]), F.lit(True), **SMALL).count() == 0


def test_columns_with_the_same_names(spark, make):
    docs = make([(1, "one two"), (2, "two")])
    for name in ("row", "held_out", "n", "known", "logs", "ids", "tail", "tail_n", "more", "gain"):
        docs = docs.withColumn(name, F.lit("x"))
    same(hm.language_scores(docs, learn(), **SMALL).collect(), plain_scores([(1, "one two"), (2, "two")], [is_learnt(1), is_learnt(2)], **SMALL))


def test_shares_sum_to_one():
    """All texts of up to seven tokens, and what has not ended by then."""
    rng = np.random.default_rng(5)
    model = random_model(rng, 2, 3)  # class 0 is the end
    total = 0.0
    for n in range(7):
        for ids in itertools.product((1, 2), repeat=n):
            total += sum(p for p, _ in paths(model, [*ids, 0]))
    alive = model.start * (1 - model.emit[0])
    for _ in range(6):
        alive = (alive @ model.step) * (1 - model.emit[0])
    assert abs(total + alive.sum() - 1) < 1e-12


def test_better_than_single_words_on_held_out_texts(spark):
    rows = hm.language_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), learn()).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    gain = (sum(r.score for r in held) - sum(r.base_score for r in held)) / sum(r.n_tokens for r in held)
    assert gain > 0.1 and sum(r.score > r.base_score for r in held) > 0.8 * len(held)
