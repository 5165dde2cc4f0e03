"""Ranked lexical search against brute force."""

import math
import random
import re

import numpy as np
import pytest
from llm_helpers import ODD

from freqloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def term_list(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def counts(words):
    out = {}
    for w in words:
        out[w] = out.get(w, 0) + 1
    return out


def brute(pairs, items, k=20):
    bags = [(i, counts(term_list(t))) for i, t in pairs]
    held = [b for _, b in bags if b]
    n_docs, n_terms = len(held), sum(sum(b.values()) for b in held)
    df = {}
    for b in held:
        for w in b:
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 75 + (25 * sum(b.values()) * n_docs) // n_terms if b else 0
            score = 0
            for w, times in counts(term_list(text)).items():
                if w in b:
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def rows(df):
    assert df.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def case(seed, n=400):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(150)] + ["É", "ß2", "Ab", "aB"]
    text = lambda m: " ".join(rnd.choice(vocabulary[: rnd.choice([5, 40, 154])]) for _ in range(m))
    docs = [*ODD, *((100 + i, text(rnd.randint(0, 60))) for i in range(n))]
    docs += [(1000 + i, "the same text, w7 w9") for i in range(60)]
    items = [(i, text(rnd.randint(1, 12))) for i in range(15)] + [(50, None), (51, ""), (52, "-- ,"), (None, "w7 w9"), (3, "w7 one"), (53, "nowhere2"), (54, "W7 w7 w7, É")]
    return docs, items


@pytest.mark.parametrize("block,part", [(16_384, 1), (7, 3)])
def test_ranks(spark, make, monkeypatch, block, part):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    docs, items = case(block)
    table = spark.createDataFrame(items, "item_id int, text string")
    for k in (1, 20):
        assert rows(lexical.ranked(make(docs).repartition(part), table, k)) == brute(docs, items, k)


def test_more_queries_than_a_slice(spark, make, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE_ROWS", 6)
    docs, items = case(5, 100)
    assert rows(lexical.ranked(make(docs), spark.createDataFrame(items, "item_id int, text string"))) == brute(docs, items)


def test_empty_tables(spark, make):
    table = spark.createDataFrame([(1, "one two")], "item_id int, text string")
    assert rows(lexical.ranked(make([]), table)) == []
    assert rows(lexical.ranked(make(ODD), table.limit(0))) == []
    assert rows(lexical.ranked(make([(1, None), (2, "..")]), table)) == []


def test_names_may_differ(spark, make):
    docs = make([(1, "one two"), (2, "two")]).withColumnRenamed("doc_id", "place").withColumnRenamed("text", "rank")
    table = spark.createDataFrame([("q", "two", 5)], "name string, body string, item_id int")
    got = lexical.ranked(docs, table, id_col="place", text_col="rank", item_col="name", item_text_col="body").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in got] == [("q", 1, 2), ("q", 2, 1)]


def test_accumulators_are_limited():
    """Few documents of a frequent term get an accumulator once rare terms have filled the ranks, and no score changes."""
    rng = np.random.default_rng(3)
    n = 5000
    row = np.concatenate([rng.choice(n, 40, replace=False), rng.choice(n, 60, replace=False), np.arange(n)])
    term = np.repeat([0, 1, 2], [40, 60, n])
    corpus = lexical.Corpus(n, 50 * n, np.array([40, 60, n]), np.array([4800, 4400, 1]))
    block = lexical.Block.build(np.arange(n), np.zeros(n, bool), np.full(n, 50), row, term, np.ones(len(row), np.int64), corpus)
    terms, repeats = np.arange(3), np.array([1, 2, 1])
    scores = lexical.accumulate(block, terms, repeats, corpus.df, 20)
    whole = np.zeros(n, np.int64)
    np.add.at(whole, block.row, block.gain * repeats[np.repeat(np.arange(3), np.diff(block.start))])
    assert 20 <= np.count_nonzero(scores) <= 100 < np.count_nonzero(whole)
    held = scores > 0
    assert (scores[held] == whole[held]).all() and lexical.kth(scores, 20) == lexical.kth(whole, 20)
    assert not lexical.accumulate(block, terms, repeats, corpus.df, 20, floor=int(whole.max()) * 9).any()
