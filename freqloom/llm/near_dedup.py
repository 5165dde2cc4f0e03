"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature is 32 symbols of 16 bits. It is split into 8 chunks of 4 symbols, and each chunk is entered under its 4 keys
with one symbol left out. Two signatures that differ in at most 15 symbols have, by pigeonhole, a chunk with at most one
error, so they meet under a key: every pair within that distance is found. Pairs further apart that meet are kept up to 19.
At a Jaccard similarity of 0.75 the distance is 8 on average, and a pair is missed with probability below 4e-5.

No pairs are written out. Documents with the same shingle set form a class with one representative. In a bucket, close
signatures are joined to groups of candidates (a forest, not all pairs); the groups' whole shingle sets are then compared in
blocks, skipping what is already connected, and confirmed links again leave as a forest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freqloom.llm.common import SMALL_STEP, connected, mix, row_blocks, seeds, shingles, sorted_groups, runs, texts_of, utf8, words
from freqloom.session import cut_lineage

SYMBOLS, CHUNK = 32, 4
#: Distance up to which all pairs are found, and up to which pairs that meet are looked at.
GUARANTEED, LOOSE = 2 * (SYMBOLS // CHUNK) - 1, 19
#: Signatures compared with each other at once, and shingles in a block of whole sets. Larger groups take more blocks.
BUCKET_BLOCK, SET_BLOCK = 4096, 1 << 20
_FLIP = seeds(SYMBOLS, 31)
_TIMES = seeds(SYMBOLS, 37) | np.uint64(1)
FEATURES = "doc_id long, n_shingles long, h1 long, h2 long, signature binary"
SETS = "doc_id long, n_shingles long, shingles binary"


def signature(distinct: np.ndarray) -> np.ndarray:
    """32 MinHash symbols of 16 bits; the shingle set must not be empty."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for p in range(0, len(distinct), 1 << 12):
        part = (distinct[p : p + (1 << 12), None] ^ _FLIP) * _TIMES
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0))
    return mix(least).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """All keys of each signature (rows x 32): each chunk with each of its symbols left out."""
    s = signatures.astype(np.int64).reshape(len(signatures), -1, CHUNK)
    out = []
    for c in range(s.shape[1]):
        for gone in range(CHUNK):
            key = np.full(len(s), c * CHUNK + gone, np.int64)
            for j in range(CHUNK):
                if j != gone:
                    key = (key << 16) | s[:, c, j]
            out.append(key)
    return np.stack(out, axis=1)


def distinct_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingles of each row."""
    data, offsets = utf8(batch["text"])
    for i, j in row_blocks(offsets, SMALL_STEP):
        h, _, _, by_row = words(data, offsets[i : j + 1], lower=True)
        s, at = shingles(h, by_row, width)
        for r in range(j - i):
            yield i + r, np.unique(s[at[r] : at[r + 1]])


def _features(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, sig = [], [], [], []
            for _, s in distinct_sets(batch, width):
                n.append(len(s))
                h1.append(int(mix(s).sum().astype(np.int64)) if len(s) else 0)
                h2.append(int(mix(s ^ _FLIP[0]).sum().astype(np.int64)) if len(s) else 0)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "signature"])

    return run


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        keys, ids = chunk_keys(sig), batch["doc_id"].to_numpy(zero_copy_only=False)
        low = (sig & 0xFF).astype(np.uint8)
        for k in range(keys.shape[1]):
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, k]), pa.array(ids), _fixed(low)], ["key", "doc_id", "low"])


def _fixed(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def close_groups(low: np.ndarray, limit: int = LOOSE) -> np.ndarray:
    """For each row, the first row that it is connected with by steps of at most ``limit`` differing symbols."""
    n = len(low)
    root = np.full(n, -1, np.int64)
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first] = first
        todo = [first]
        left = np.flatnonzero(root < 0)
        while todo and len(left):
            near = (low[left] != low[todo.pop()]).sum(axis=1) <= limit
            found = left[near]
            root[found] = first
            todo.extend(found)
            left = left[~near]
    return root


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links from rows sorted by key. Of a long run, blocks are searched one by one and all their groups chained.

    Chaining takes no look at the signatures: it only makes the group of candidates larger. ``open_roots`` are the first rows
    of the groups of a batch's last run, which are chained once the next batch shows that the run goes on.
    """
    key, chain, open_roots = None, None, None
    for batch in batches:
        ks = batch["key"].to_numpy(zero_copy_only=False)
        ids = batch["doc_id"].to_numpy(zero_copy_only=False)
        at = runs([ks])
        size = np.diff(at)
        low = None
        a, b = [], []
        for r in np.flatnonzero(size > 1):
            if low is None:
                low = np.frombuffer(b"".join(batch["low"].to_pylist()), np.uint8).reshape(-1, SYMBOLS)
            for p in range(at[r], at[r + 1], BUCKET_BLOCK):
                q = min(p + BUCKET_BLOCK, at[r + 1])
                root = close_groups(low[p:q])
                far = np.flatnonzero(root != np.arange(q - p))
                a.append(ids[p:q][far])
                b.append(ids[p:q][root[far]])
                roots = ids[p:q][root == np.arange(q - p)]
                if size[r] > BUCKET_BLOCK:
                    a.append(roots)
                    b.append(np.full(len(roots), ids[at[r]]))
        if len(ks):
            if key == ks[0]:  # the run goes on from the batch before
                firsts = np.concatenate([open_roots, ids[: at[1]]])
                a.append(firsts)
                b.append(np.full(len(firsts), chain))
                open_roots = open_roots[:0]
            if key != ks[-1]:
                key, chain = ks[-1], ids[at[-2]]
                # Of a run of several blocks all groups are chained already.
                open_roots = ids[at[-2] :][:0] if size[-1] > BUCKET_BLOCK else roots if size[-1] > 1 else ids[at[-2] :]
        if a:
            edges = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], ["a", "b"])


def _sets(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in distinct_sets(batch, width):
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one["grp"], one["pair"], one["side"], one["doc_id"], pa.array([s.tobytes()], pa.binary())], ["grp", "pair", "side", "doc_id", "shingles"])

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def confirmed(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of the links with 100 * |A & B| >= percent * |A | B|, between rows of different sides or all if there is one.

    Each row is compared with all rows of other components at once, largest sets' neighbours first; a row whose component
    already holds all others is skipped.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    sig = np.stack([signature(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    everything = np.concatenate(sets)
    values, code = np.unique(everything, return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(size)))
    marked = np.zeros(len(values), bool)
    comp = np.arange(n)
    two = side.min() != side.max()
    # A row close to many others connects them early.
    sample = sig[:: max(1, n // 64)]
    order = np.argsort(np.array([(sig[i] != sample).sum() for i in range(n)]), kind="stable")
    done = np.zeros(n, bool)
    out = []
    for i in order:
        done[i] = True
        other = ~done & (comp != comp[i])
        if two:
            other &= side != side[i]
        at = np.flatnonzero(other)
        at = at[(100 * size[at] >= percent * size[i]) & (percent * size[at] <= 100 * size[i])]
        if len(at):
            at = at[(sig[at] != sig[i]).sum(axis=1) <= LOOSE]
        if not len(at):
            continue
        marked[code[starts[i] : starts[i + 1]]] = True
        if len(at) <= 8:
            both = np.array([marked[code[starts[j] : starts[j + 1]]].sum() for j in at])
        else:
            both = np.bincount(owner[marked[code]], minlength=n)[at]
        marked[code[starts[i] : starts[i + 1]]] = False
        for j in at[100 * both >= percent * (size[i] + size[at] - both)]:
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
                out.append((int(i), int(j)))
    return out


def _confirm(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sorted_groups(batches, ["grp", "pair"]):
            at = runs([batch["grp"].to_numpy(zero_copy_only=False), batch["pair"].to_numpy(zero_copy_only=False)])
            ids, side = batch["doc_id"].to_numpy(zero_copy_only=False), batch["side"].to_numpy(zero_copy_only=False)
            a, b = [], []
            for p, q in zip(at[:-1], at[1:], strict=True):
                sets = [np.frombuffer(x, np.uint64) for x in batch["shingles"].slice(p, q - p).to_pylist()]
                for i, j in confirmed(sets, side[p:q], percent):
                    a.append(ids[p + i])
                    b.append(ids[p + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _compared(texts: DataFrame, dealt: DataFrame, width: int, percent: int) -> DataFrame:
    """Forests of links among the documents that share (grp, pair) in ``dealt(doc_id, grp, pair, side)``."""
    sets = texts.join(dealt.select("doc_id", "grp").distinct(), "doc_id").join(dealt, ["doc_id", "grp"]).select("doc_id", "text", "grp", "pair", "side")
    sent = sets.mapInArrow(_sets(width), "grp long, pair long, side long, doc_id long, shingles binary").repartition("grp", "pair").sortWithinPartitions("grp", "pair")
    return sent.mapInArrow(_confirm(percent), "a long, b long")


def _links(texts: DataFrame, placed: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that connect each group of candidates as all its links do, from ``placed(doc_id, grp, m, mine, n_shingles)``.

    Groups are compared in blocks of bounded size, each document in its own block first. Most groups of several blocks hold
    copies that are connected within each block, and one document of each of these parts, compared with the others' in one
    block, connects them: work and bytes go with the size of the group. Only groups that are still in parts then take each
    pair of blocks once.
    """
    near = _compared(texts, placed.selectExpr("doc_id", "grp", "mine AS pair", "0L AS side"), width, percent)
    if placed.where("m > 1").isEmpty():
        return near
    large, near = placed.where("m > 1"), cut_lineage(near)

    def parts(links: DataFrame) -> DataFrame:
        roots = connected(links.join(large.select("doc_id"), links["a"] == F.col("doc_id"), "left_semi"))
        return large.join(roots, large["doc_id"] == roots["node"], "left").select("doc_id", "grp", F.coalesce("root", "doc_id").alias("top"))

    tops = parts(near).selectExpr("grp", "top AS doc_id").distinct().join(large.select("doc_id", "n_shingles"), "doc_id")
    few = tops.groupBy("grp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size")).where(f"n > 1 AND n <= {BUCKET_BLOCK} AND size <= {SET_BLOCK}")
    across = cut_lineage(_compared(texts, tops.join(few.select("grp"), "grp").selectExpr("doc_id", "grp", "-1L AS pair", "0L AS side"), width, percent))
    split = parts(near.unionAll(across)).groupBy("grp").agg(F.count_distinct("top").alias("n")).where("n > 1").select("grp")
    pairs = "transform(filter(sequence(0, m - 1), x -> x <> mine), x -> least(x, mine) * m + greatest(x, mine))"
    rest = cut_lineage(large.join(split, "grp")).selectExpr("doc_id", "grp", "mine AS side", f"explode({pairs}) AS pair")
    return near.unionAll(across).unionAll(_compared(texts, rest, width, percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links), kept (doc_id = component_id).

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lowered; a set holds the distinct shingles of ``width`` words, or the
    whole sequence if it is shorter. Documents are linked with 100 * |A & B| >= percent * |A | B|, confirmed on whole sets.
    Null and empty texts have an empty set and link with nothing. Rows that repeat an id count as linked with each other. A
    row without id is kept and has no component. Of a component's documents the one of smallest id stays. A very long text is
    hashed in parts of a megabyte; its set is held whole where it is compared. An empty table gives an empty result. Other
    columns are not looked at, so their names can't clash.
    """
    texts = texts_of(docs, id_col, text_col)
    features = cut_lineage(texts.mapInArrow(_features(width), FEATURES))
    named = features.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = cut_lineage(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")))

    keys = classes.select("doc_id", "signature").mapInArrow(_keys, "key long, doc_id long, low binary")
    bucket = keys.repartition("key").sortWithinPartitions("key", "doc_id")
    groups = connected(bucket.mapInArrow(_candidates, "a long, b long"))

    members = groups.withColumnRenamed("root", "grp").join(classes.selectExpr("doc_id AS node", "n_shingles"), "node")
    blocks = members.groupBy("grp").agg(F.expr(f"cast(ceil(greatest(sum(n_shingles) / {SET_BLOCK}, count(*) / {BUCKET_BLOCK})) AS int)").alias("m"))
    placed = cut_lineage(members.join(blocks, "grp").select(F.col("node").alias("doc_id"), "grp", "m", F.expr("pmod(xxhash64(node), m)").alias("mine"), "n_shingles"))
    links = connected(_links(texts, placed, width, percent))

    # One id may stand for several sets; then they share the smallest component.
    roots = classes.join(links, classes["doc_id"] == links["node"], "left").select("h1", "h2", F.coalesce("root", "doc_id").alias("component_id"))
    found = features.join(roots, ["h1", "h2"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, and all rows without id; columns stay in their order."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
