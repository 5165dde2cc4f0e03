"""Helpers of the training-data operators: whole texts of an Arrow batch as hashed words and shingles, runs, components."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freqloom.session import cut_lineage

WHITE = b" \t\n\x0b\f\r"
#: Bytes of text hashed in one step, so that a task's arrays stay small whatever a text's length.
STEP = 1 << 20
#: The same where a worker that keeps tokenizers or models would else keep the freed memory of larger arrays beside them.
SMALL_STEP = 1 << 18
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the published splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(salt))


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_CODE = seeds(256, 11)
_CODE[_IS_WHITE] = 0
_LOWER_CODE = _CODE.copy()
_LOWER_CODE[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, STEP + 4096)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            column = np.full(size, base, np.uint64)
            column[0] = 1
            _powers[name] = np.multiply.accumulate(column)
    return _powers["up"][:n], _powers["down"][:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty. The bytes of row i are data[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary()) if pa.types.is_string(column.type) else column.fill_null(b"").cast(pa.large_binary())
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def row_blocks(offsets: np.ndarray, limit: int = STEP) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _hash_words(block: np.ndarray, breaks: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each maximal run of bytes that are not white space; words also end at ``breaks``."""
    n = len(block)
    white = np.ones(n + 2, bool)
    white[1:-1] = _IS_WHITE[block]
    cut = np.zeros(n + 1, bool)
    cut[breaks] = True
    inside = ~white[1:-1]
    starts = np.flatnonzero(inside & (white[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside & (white[2:] | cut[1:])) + 1
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(code[block] * up[:n], out=prefix[1:])
    hashes = (prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return mix(hashes), starts, ends


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the given rows: hashes, byte starts and ends, and word offsets by row.

    A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. A very long row is taken in steps that end at white space.
    """
    code = _LOWER_CODE if lower else _CODE
    base, end = int(offsets[0]), int(offsets[-1])
    found = []
    p = base
    while p < end:
        q = end
        if end - p > 2 * STEP:
            q = p + STEP
            while q < end:
                near = np.flatnonzero(_IS_WHITE[data[q : q + STEP]])
                q = min(end, q + (int(near[0]) if len(near) else STEP))
                if len(near):
                    break
        lo, hi = np.searchsorted(offsets, [p, q])
        breaks = offsets[lo:hi] - p
        h, s, e = _hash_words(data[p:q], breaks[(breaks >= 0) & (breaks <= q - p)], code)
        found.append((h, s + p, e + p))
        p = q
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    h, s, e = (np.concatenate(x) if len(found) > 1 else x[0] for x in zip(*found, strict=True))
    return h, s, e, np.searchsorted(s, offsets)


_SLOT = seeds(64, 23) | np.uint64(1)


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each ``width`` consecutive words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for j in range(width):
        total += (h[j : j + n] ^ _SLOT[j]) * _SLOT[j]
    return mix(total)


def shingles(h: np.ndarray, by_row: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``width`` words by row, repeats included; a row of fewer words has its whole sequence as the only one."""
    count = np.diff(by_row)
    size = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(offsets[-1], np.uint64)
    wide = window_hash(h, width)
    long_rows = count >= width
    if long_rows.any():
        first = np.repeat(by_row[:-1][long_rows] - offsets[:-1][long_rows], size[long_rows])
        target = np.flatnonzero(np.repeat(long_rows, size))
        out[target] = wide[target + first]
    for i in np.flatnonzero((count > 0) & ~long_rows):
        out[offsets[i]] = window_hash(h[by_row[i] : by_row[i + 1]], int(count[i]))[0]
    return out, offsets


def runs(keys: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal neighbours, with the end appended."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of a partition sorted by ``keys``, cut anew so that no group of equal keys is split.

    A group's rows must fit in memory: callers bound their groups first.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[-1][k][-1] == batch[k][0] for k in keys):
            at = runs([batch[k].to_numpy(zero_copy_only=False) for k in keys])[1]
            held.append(batch.slice(0, at))
            batch = batch.slice(at)
            if not batch.num_rows:
                continue
        if held:
            yield one_batch(held)
        at = runs([batch[k].to_numpy(zero_copy_only=False) for k in keys])[-2]
        if at:
            yield batch.slice(0, at)
        held = [batch.slice(at)]
    if held:
        yield one_batch(held)


def one_batch(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text alone, under fixed names, so that other columns of ``docs`` can't clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def _sent_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Large-star: larger neighbours of a node are linked with its smallest neighbour or itself. Rows sorted by (u, v)."""
    node, least = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        u, v = (batch[c].to_numpy(zero_copy_only=False) for c in "uv")
        at = runs([u])
        m = np.minimum(u[at[:-1]], v[at[:-1]])
        if node == u[0]:
            m[0] = least
        node, least = u[-1], m[-1]
        keep = v > u
        keep[1:] &= (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(np.repeat(m, np.diff(at))[keep])], ["a", "b"])


def _sent_down(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small-star: a node and its smaller neighbours are linked with the smallest. Rows u > v sorted by (u, v)."""
    node, least = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        u, v = (batch[c].to_numpy(zero_copy_only=False) for c in "uv")
        at = runs([u])
        m = v[at[:-1]].copy()
        new = np.ones(len(m), bool)
        if node == u[0]:
            m[0], new[0] = least, False
        node, least = u[-1], m[-1]
        low = np.repeat(m, np.diff(at))
        keep = v > low
        keep[1:] &= (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        a, b = np.concatenate([u[at[:-1]][new], v[keep]]), np.concatenate([m[new], low[keep]])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (node, root), root the smallest node reachable.

    ``edges`` has columns a and b. Alternating large-star and small-star steps, each one shuffle by node whose sorted rows
    are streamed, so that a hot node takes no memory; edge tables are checkpointed between rounds.
    """
    now = cut_lineage(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    mark = None
    for _ in range(rounds):
        both = now.selectExpr("inline(array(struct(a AS u, b AS v), struct(b AS u, a AS v)))")
        wide = both.repartition("u").sortWithinPartitions("u", "v").mapInArrow(_sent_up, "a long, b long")
        near = wide.selectExpr("a AS u", "b AS v").repartition("u").sortWithinPartitions("u", "v").mapInArrow(_sent_down, "a long, b long")
        now = cut_lineage(near)
        last, mark = mark, _mark(now)
        if mark == last:
            return now.selectExpr("a AS node", "b AS root").union(now.selectExpr("b", "b")).distinct()
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table: one row."""
    return tuple(edges.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(a, b) AS decimal(38, 0))"))).first())


def sent(df: DataFrame, value) -> Broadcast:
    """Broadcast a value with the classes of this package that it uses, for workers without the package."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast):
    return pickle.loads(shared.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_columns(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added while ``df`` has it."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
