"""Ranked lexical search: term-at-a-time with limited accumulators over blocks of documents.

Every task indexes the documents it reads block by block. For each query the terms are taken rarest first, and each adds its
contributions to the documents' accumulators. Once the terms still to come can't lift a document without an accumulator to the
k-th best partial score (or to the k-th best score of the task's earlier blocks), no accumulators are created any more;
those there are updated to the end, so that their scores are exact. The best k of all tasks are merged in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freqloom.llm.common import received, row_blocks, sent, texts_of, utf8, words

#: Queries are broadcast in slices of at most so many bytes of text and rows; more of them mean more passes.
SLICE_BYTES, SLICE_ROWS = 16 << 20, 20_000
#: Documents and postings of one block.
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 1 << 22
#: Groups in which a query's candidates are merged first.
MERGE_GROUPS = 64
#: A term is a maximal run of bytes that are a digit, a letter or not ASCII; all others are blanks here.
_AS_WORDS = np.full(256, 32, np.uint8)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _AS_WORDS[_low : _high + 1] = np.arange(_low, _high + 1)
_BLANK = np.frombuffer(b" ", np.uint8)


@dataclass(frozen=True)
class Queries:
    """Queries of one slice as numbers into the sorted distinct hashes of their terms."""

    keys: list  # ids as given
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    known: np.ndarray
    bits: np.ndarray  # bit map over the hashes


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, terms with repeats, and weight and document count of each query term."""

    n_docs: int
    n_terms: int
    df: np.ndarray
    weight: np.ndarray


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of the given rows, A-Z lowered, and term offsets by row."""
    base = int(offsets[0])
    plain = _AS_WORDS[data[base : int(offsets[-1])]] if len(data) else _BLANK[:0]
    h, _, _, by_row = words(plain, offsets - base, lower=True)
    return h, by_row


def query_slices(items: DataFrame, key_col: str, text_col: str) -> Iterator[Queries]:
    """Slices of bounded size; queries without a term are left out."""
    rows = items.select(items[key_col].alias("key"), items[text_col].cast("string").alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    slices = max(1, -(-size // SLICE_BYTES), -(-n // SLICE_ROWS))
    for k in range(slices):
        part = rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(slices)) == k) if slices > 1 else rows
        got = part.collect()
        data, offsets = utf8(pa.array([r["text"] for r in got], pa.string()))
        h, by_row = term_hashes(data, offsets)
        own = [np.unique(h[by_row[i] : by_row[i + 1]], return_counts=True) for i in range(len(got))]
        held = [i for i, (t, _) in enumerate(own) if len(t)]
        known = np.unique(h)
        bits = np.zeros(1 << max(16, int(len(known) * 16).bit_length()), bool)
        bits[(known & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        yield Queries([got[i]["key"] for i in held], [np.searchsorted(known, own[i][0]) for i in held], [own[i][1] for i in held], known, bits)


def postings(column, queries: Queries) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For a range of rows: their terms with repeats, and (row, term, count) of the query terms they hold."""
    data, offsets = utf8(column)
    for i, j in row_blocks(offsets):
        h, by_row = term_hashes(data, offsets[i : j + 1])
        at = np.flatnonzero(queries.bits[(h & np.uint64(len(queries.bits) - 1)).astype(np.int64)])
        near = np.searchsorted(queries.known, h[at])
        near[near == len(queries.known)] = 0
        same = queries.known[near] == h[at] if len(queries.known) else np.zeros(0, bool)
        at, near = at[same], near[same]
        row = np.searchsorted(by_row, at, "right") - 1
        key, count = np.unique(row * len(queries.known) + near, return_counts=True)
        row, term = np.divmod(key, max(1, len(queries.known)))
        yield i, j, np.diff(by_row), row, term, count


def corpus_of(texts: DataFrame, queries: Queries) -> Corpus:
    """Counts over all documents: each task sends one row per query term it has seen and two for the totals."""
    size = len(queries.known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            for _, _, n, _, term, _ in postings(batch["text"], queries):
                total[:size] += np.bincount(term, minlength=size)
                total[size:] += (np.count_nonzero(n), int(n.sum()))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    total = np.zeros(size + 2, np.int64)
    for r in texts.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r["at"]] = r["n"]
    n_docs, n_terms = int(total[size]), int(total[size + 1])
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in total[:size]]
    return Corpus(n_docs, n_terms, total[:size], np.array(weight, np.int64))


@dataclass
class Block:
    """An index of some documents: contributions of each term's documents, term by term."""

    ids: np.ndarray
    missing: np.ndarray  # documents without id
    row: np.ndarray
    gain: np.ndarray
    start: np.ndarray  # postings of a term begin here
    most: np.ndarray  # largest gain of a term

    @classmethod
    def build(cls, ids, missing, n, row, term, count, corpus: Corpus) -> Block:
        order = np.argsort(term, kind="stable")
        row, term, count = row[order], term[order], count[order].astype(np.int64)
        m = 100 - 25 + (25 * n.astype(np.int64) * corpus.n_docs) // max(1, corpus.n_terms)
        gain = corpus.weight[term] * ((1_000_000_000 * count) // (1000 * count + 12 * m[row]))
        start = np.searchsorted(term, np.arange(len(corpus.df) + 1))
        most = np.zeros(len(corpus.df), np.int64)
        held = np.flatnonzero(np.diff(start))
        if len(held):
            most[held] = np.maximum.reduceat(gain, start[held])
        return cls(ids, missing, row, gain, start, most)


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest of the positive scores, 0 if there are fewer."""
    held = scores[scores > 0]
    return int(np.partition(held, len(held) - k)[len(held) - k]) if len(held) >= k else 0


def accumulate(block: Block, terms: np.ndarray, repeats: np.ndarray, df: np.ndarray, k: int, floor: int = 0) -> np.ndarray:
    """Exact scores of all documents that can be among the best ``k``; 0 for those without accumulator.

    ``floor`` is the k-th best score of documents seen before.
    """
    order = np.lexsort((terms, df[terms]))
    terms, repeats = terms[order], repeats[order]
    rest = np.append(np.cumsum((block.most[terms] * repeats)[::-1])[::-1], 0)
    scores = np.zeros(len(block.ids), np.int64)
    growing = not rest[0] < floor
    if not growing:
        return scores
    for j, (t, times) in enumerate(zip(terms, repeats, strict=True)):
        a, b = block.start[t], block.start[t + 1]
        if a == b:
            continue
        row, gain = block.row[a:b], block.gain[a:b] * times
        if not growing:
            old = scores[row] > 0
            row, gain = row[old], gain[old]
        scores[row] += gain
        if growing and rest[j + 1] < max(floor, int(scores.max())):
            growing = not rest[j + 1] < max(floor, kth(scores, k))
    return scores


class Best:
    """The best ``k`` (score, id) of one query so far, equal scores by ascending id, rows without id last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, scores: np.ndarray, block: Block) -> None:
        at = np.flatnonzero(scores >= max(1, self.floor, kth(scores, self.k)))
        if not len(at):
            return
        score, ids, missing = (np.concatenate(x) for x in ((self.score, scores[at]), (self.ids, block.ids[at]), (self.missing, block.missing[at])))
        order = np.lexsort((ids, missing, -score))[: self.k]
        self.score, self.ids, self.missing = score[order], ids[order], missing[order]


def blocks_of(batches: Iterable[pa.RecordBatch], queries: Queries, corpus: Corpus) -> Iterator[Block]:
    """The documents of a task in blocks of bounded size (or of one batch's part of up to a megabyte of text)."""
    parts, docs, size = [], 0, 0

    def block():
        ids, missing, n, row, term, count = (np.concatenate([p[x] for p in parts]) for x in range(6))
        return Block.build(ids, missing, n, row, term, count, corpus)

    for batch in batches:
        missing = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
        ids = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
        for i, j, n, row, term, count in postings(batch["text"], queries):
            parts.append((ids[i:j], missing[i:j], n, row + docs, term, count))
            docs, size = docs + j - i, size + len(row)
            if docs >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                yield block()
                parts, docs, size = [], 0, 0
    if parts:
        yield block()


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score.

    Terms are the maximal runs of digits, ASCII letters and non-ASCII characters of whole texts, A-Z lowered, told apart by
    64-bit hashes. N documents have a term, L are their terms with repeats; a term in df documents weighs
    ``floor(1000 * ln((2N + 2) / (2df + 1)))``, and adds ``weight * (10^9 tf div (1000 tf + 12 m))`` for each of its repeats in
    the item, with ``m = 75 + 25 n N div L`` for a document of n terms. Only scores above 0 are listed, equal scores by
    ascending id, rows without id last.

    Null and empty texts, on either side, have no terms: such a document counts nowhere, such an item has no rows. Each row
    is a document of its own, also where ids or texts repeat; each row of ``items`` is an item. A very long text is read in
    parts of a megabyte. Other columns are not read, so their names can't clash. Empty tables give no rows.

    Both passes read the texts where they lie. Shuffled are a row per task and query term for the counts, and ``k`` rows
    per task and item for the ranks, merged in groups of tasks first.
    """
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col)
    kind = items.schema[item_col].dataType
    found = []
    for queries in query_slices(items, item_col, item_text_col):
        corpus = corpus_of(texts, queries)
        shared = sent(docs, (queries, corpus))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries, corpus = received(shared)
            best = [Best(k) for _ in queries.keys]
            for block in blocks_of(batches, queries, corpus):
                for own, terms, repeats in zip(best, queries.terms, queries.repeats, strict=True):
                    own.add(accumulate(block, terms, repeats, corpus.df, k, own.floor), block)
            for place, own in enumerate(best):
                ids = pa.array(own.ids, pa.int64(), mask=own.missing)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), place, np.int32)), ids, pa.array(own.score)], ["place", "doc_id", "score"])

        parts = texts.mapInArrow(run, "place int, doc_id long, score long").withColumn("part", F.spark_partition_id() % MERGE_GROUPS)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        near = parts.withColumn("rank", F.row_number().over(Window.partitionBy("place", "part").orderBy(*order))).where(F.col("rank") <= k)
        last = near.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(queries.keys)), f"place int, item_id {kind.simpleString()}")
        found.append(last.join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionAll, found)
