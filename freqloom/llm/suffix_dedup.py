"""Removal of repeated byte strings by a distributed merge sort of sampled suffixes.

Sampling: of the 40-byte grams in each 200-byte string, the one with the smallest hash (leftmost of equals) is its anchor.
Equal strings have their anchor at the same place, so suffixes at anchors whose gram occurs again are enough.

Merge sort: a task sorts its suffixes (200 bytes from the anchor on) and front-codes them: for each, the prefix shared with
the one before and the rest. Runs are exchanged by the gram's hash. A loser tree merges them; it keeps for each run the
prefix it shares with the last suffix put out, so known prefixes are never compared again, and it yields the common prefix
of neighbours. With that and the order of the bytes to the left, the strings around an anchor that occur again are read off
for each distance of a string's start from its anchor.

A task forwards one suffix of each distinct context; the others, being repeated, are settled where they are.

A gram that occurs very often is split by the distance of a string's start from its anchor: all strings whose distance lies
in a range share the bytes that each of them covers, so contexts go to the part of those bytes, once for each range, cut to
what the range can see. The more often a gram occurs, the narrower its ranges, down to single distances, where a part's
contexts are all the same and each task sends one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freqloom.llm.common import STEP, mix, powers, row_blocks, runs, seeds, sorted_groups, utf8
from freqloom.session import cut_lineage

LENGTH, GRAM = 200, 40
#: Contexts sorted at once in a task, and contexts a merged part should have.
RUN_ROWS, PART_ROWS = 60_000, 100_000
#: A gram with so many anchors is split by distance, in ranges of so many; the last width is one distance.
SPLITS = ((100_000, 20), (1_000_000, 5), (20_000_000, 1))
_BYTE = seeds(256, 53)
ANCHORS = "key long, times int, id0 long, h long, pos int"
RUNS = "part int, near int, far int, shared binary, size binary, tails binary, left_size binary, lefts binary, id0 binary, h binary, pos binary, done binary, spans binary"
SPANS = "id0 long, h long, start int, stop int"


def gram_hashes(block: np.ndarray, gram: int) -> np.ndarray:
    n = len(block)
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[block] * up[:n], out=prefix[1:])
    return mix((prefix[gram:] - prefix[: n + 1 - gram]) * down[: n + 1 - gram])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, position in the row, gram hash) of all anchors, in pieces. A long row is taken in overlapping steps."""
    low = np.uint64((1 << 22) - 1)
    for i, j in row_blocks(offsets):
        for p in range(int(offsets[i]), max(int(offsets[i]) + 1, int(offsets[j]) - length + 1), STEP):
            q = min(int(offsets[j]), p + STEP + length - 1)
            if q - p < length:
                continue
            grams = gram_hashes(data[p:q], gram)
            least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
            width, span = length - gram + 1, 1
            while span < width:
                step = min(span, width - span)
                least = np.minimum(least[:-step], least[step:])
                span += step
            starts = np.arange(p, p + len(least))
            row = np.searchsorted(offsets, starts, "right") - 1
            at = np.unique(least[starts + length <= offsets[row + 1]] & low).astype(np.int64)
            row = np.searchsorted(offsets, at + p, "right") - 1
            yield row, at + p - offsets[row], grams[at]


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            ids, hs = batch["id0"].to_numpy(zero_copy_only=False), batch["h"].to_numpy(zero_copy_only=False)
            found = list(anchors(data, offsets, length, gram))
            if not found:
                continue
            row, pos, key = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(key, kind="stable")
            row, pos, key = row[order], pos[order], key[order].view(np.int64)
            at = runs([key])
            size = np.diff(at)
            times = np.zeros(len(key), np.int32)
            times[at[:-1]] = size
            # Repeated here: only the first goes to the others of its gram, with their number; the rest, with 0, is dealt out
            # by a spread key.
            sent = np.where(times == 0, mix(key.view(np.uint64) + pos.astype(np.uint64) * np.uint64(3) + row.astype(np.uint64)).view(np.int64), key)
            yield pa.RecordBatch.from_arrays([pa.array(sent), pa.array(times), pa.array(ids[row]), pa.array(hs[row]), pa.array(pos.astype(np.int32))], ["key", "times", "id0", "h", "pos"])

    return run


def _repeated(batches: Iterable[pa.RecordBatch], often: int) -> Iterator[pa.RecordBatch]:
    """Rows that are known to repeat, or whose key another row has; rows come sorted by key.

    A gram met ``often`` gives a row besides, at its end: the gram as id0, its number of anchors as h, and place -1.
    """
    last, waiting, count = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, times = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "times"))
        keep = times != 1
        same = key[1:] == key[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        at = runs([key])
        total = np.add.reduceat(times.astype(np.int64), at[:-1])
        if last is not None and last == key[0]:
            keep[0] = True
            total[0] += count
            if waiting is not None:
                yield waiting
        elif last is not None and count >= often:
            yield _hot_grams([last], [count])
        waiting = None
        last, count = key[-1], int(total[-1])
        if not keep[-1]:
            waiting = batch.slice(batch.num_rows - 1).select(["id0", "h", "pos"])
        hot = np.flatnonzero(total[:-1] >= often)
        if len(hot):
            yield _hot_grams(key[at[hot]], total[hot])
        yield batch.filter(pa.array(keep)).select(["id0", "h", "pos"])
    if last is not None and count >= often:
        yield _hot_grams([last], [count])


def _hot_grams(keys, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array([-1] * len(keys), pa.int32())], ["id0", "h", "pos"])


def ranges_of(count: int, reach: int) -> list[tuple[int, int]]:
    """Ranges of distances (both ends included) into which the strings around a gram with ``count`` anchors are split."""
    width = reach + 1
    for least, narrower in SPLITS:
        if count >= least:
            width = min(width, narrower)
    return [(d, min(d + width - 1, reach)) for d in range(0, reach + 1, width)]


def _bytes_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def packed(raw: bytes) -> bytes:
    """Size and zstd frame: joined texts shrink more in it than in the shuffle's own codec."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b""


def common_prefix(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(x), len(y))
    a, b = x[known:n], y[known:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared prefix lengths, sizes and joined rests of sorted strings of at most 255 bytes."""
    shared = bytearray(len(strings))
    before = b""
    tails = []
    for i, s in enumerate(strings):
        shared[i] = n = common_prefix(before, s, 0)
        tails.append(s[n:])
        before = s
    return bytes(shared), bytes(map(len, strings)), b"".join(tails)


def front_decode(shared: bytes, size: bytes, tails: bytes) -> list[bytes]:
    out, before, p = [], b"", 0
    for n, m in zip(shared, size, strict=True):
        before = before[:n] + tails[p : p + m - n]
        p += m - n
        out.append(before)
    return out


def merge_runs(runs_: list[tuple[list[bytes], bytes]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs, given as strings and their shared prefixes, with a loser tree.

    Returns (run, place) in order and the common prefix of each string with the one before. A run's head is known by the
    prefix it shares with the last string put out: the longer one is the smaller string, and only at equal lengths bytes
    beyond it are compared.
    """
    k = 1
    while k < len(runs_):
        k *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs_] + [None] * (k - len(runs_))
    place, lcp = [0] * k, [0] * k
    losers = [0] * k

    def smaller(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser's prefix becomes the one it shares with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        la, lb = lcp[a], lcp[b]
        if la > lb:
            return a, b
        if lb > la:
            return b, a
        n = common_prefix(x, y, la)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            lcp[b] = n
            return a, b
        lcp[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, losers[node] = smaller(build(2 * node), build(2 * node + 1))
        return win

    order, shared = [], []
    win = build(1)
    while heads[win] is not None:
        order.append((win, place[win]))
        shared.append(lcp[win])
        strings, own = runs_[win]
        place[win] += 1
        if place[win] < len(strings):
            heads[win], lcp[win] = strings[place[win]], own[place[win]]
        else:
            heads[win] = None
        node = (win + k) // 2
        while node:
            win, losers[node] = smaller(win, losers[node])
            node //= 2
    return order, shared


def grams_at(data: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the grams at the given places, as :func:`gram_hashes` has them."""
    up, _ = powers(gram)
    return mix((_BYTE[data[at[:, None] + np.arange(gram)]] * up).sum(axis=1, dtype=np.uint64))


def _sorted_runs(length: int, gram: int, parts: int, hot: Broadcast):
    reach = length - gram

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, first = 0, int(mix(np.array([TaskContext.get().partitionId()], np.uint64))[0] % np.uint64(parts))
        keys, counts = hot.value
        whole = [(0, reach)]
        held: dict[tuple[tuple[int, int], bytes, bytes], list] = {}
        spans: list[tuple[int, int, int, int]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            by_part: dict[tuple[int, tuple[int, int]], list] = {}
            for (span, right, left), (row, done) in held.items():
                near, far = span
                core = bytes(span) + right[: length - far] + left[:near]
                part = int.from_bytes(hashlib.blake2b(core, digest_size=8).digest()) % parts
                by_part.setdefault((part, span), []).append((right, left, *row, done))
            own = np.array(spans, np.int64).reshape(-1, 4).tobytes()
            # What is settled here only passes through, so any part will do; tasks begin at different ones.
            target = ((first + number) % parts, whole[0])
            if spans:
                by_part.setdefault(target, [])
            number += 1
            rows = []
            for (part, span), got in by_part.items():
                got.sort()
                right, left, ids, hs, pos, done = zip(*got, strict=True) if got else [()] * 6
                shared, size, tails = front_code(list(right))
                rows.append((part, *span, shared, size, packed(tails), bytes(map(len, left)), packed(b"".join(left)), np.array(ids, np.int64).tobytes(), np.array(hs, np.int64).tobytes(), np.array(pos, np.int32).tobytes(), bytes(done), own if (part, span) == target else b""))
            held.clear()
            spans.clear()
            columns = list(map(list, zip(*rows, strict=True)))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), *map(_bytes_column, columns[3:])], [c.split()[0] for c in RUNS.split(", ")])

        for batch in batches:
            data, offsets = utf8(batch["text"])
            at = batch["at"]
            for r in range(batch.num_rows):
                block = data[offsets[r] : offsets[r + 1]]
                text, places = block.tobytes(), at[r].values.to_numpy()
                me = (batch["id0"][r].as_py(), batch["h"][r].as_py())
                split = [whole] * len(places)
                if len(keys):
                    grams = grams_at(block, places, gram)
                    found = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                    for i in np.flatnonzero(keys[found] == grams):
                        split[i] = ranges_of(int(counts[found[i]]), reach)
                for p, spans_of in zip(places.tolist(), split, strict=True):
                    right, left = text[p : p + length], text[max(0, p - reach) : p][::-1]
                    for span in spans_of:
                        near, far = span
                        # A string at a distance in this range must fit on both sides.
                        fits = max(near, length - len(right)) <= min(far, len(left))
                        if not fits and span is not whole[0]:
                            continue
                        x, y = right[: length - near], left[:far]
                        seen = held.get((span, x, y))
                        if seen is None:
                            held[span, x, y] = [(*me, p), False]
                            if len(held) + len(spans) >= RUN_ROWS:
                                yield flush()
                        elif fits:
                            spans.append((*me, p - len(y), p + len(x)))
                            if not seen[1]:
                                seen[1] = True
                                a, b, q = seen[0]
                                spans.append((a, b, q - len(y), q + len(x)))
        if held or spans:
            yield flush()

    return run


def repeated_reach(shared: np.ndarray, lefts: list[bytes], length: int, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest distance of a repeated string's start from each anchor, from ``near`` to ``far``; largest -1 if
    there is none.

    ``shared`` is the common prefix of each suffix with the one before, ``lefts`` the reversed bytes before each anchor. At
    distance d two anchors have the same string if their suffixes share length - d bytes and their left sides d bytes.
    """
    n = len(lefts)
    order = sorted(range(n), key=lefts.__getitem__)
    left_shared = np.zeros(n, np.int64)
    for i in range(1, n):
        left_shared[i] = common_prefix(lefts[order[i - 1]], lefts[order[i]], 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    least, most = np.full(n, length, np.int64), np.full(n, -1, np.int64)
    size = np.array([len(x) for x in lefts])
    for d in range(near, far + 1):
        right = np.cumsum(shared < length - d)
        left = np.cumsum(left_shared < d)[rank] if d else np.zeros(n, np.int64)
        key = right * np.int64(n + 1) + left
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        again = np.zeros(n, bool)
        again[by[1:][same]] = True
        again[by[:-1][same]] = True
        again &= size >= d
        least[again & (least > d)] = d
        most[again] = d
    return least, most


def _merged(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sorted_groups(batches, ["part", "near", "far"]):
            at = runs([batch[c].to_numpy(zero_copy_only=False) for c in ("part", "near", "far")])
            for p, q in zip(at[:-1], at[1:], strict=True):
                rows = batch.slice(p, q - p).to_pydict()
                low, high = rows["near"][0], rows["far"][0]
                inputs, lefts, where = [], [], []
                for i in range(q - p):
                    inputs.append((front_decode(rows["shared"][i], rows["size"][i], unpacked(rows["tails"][i])), rows["shared"][i]))
                    sizes, cut, joined = rows["left_size"][i], 0, unpacked(rows["lefts"][i])
                    own = []
                    for m in sizes:
                        own.append(joined[cut : cut + m])
                        cut += m
                    lefts.append(own)
                    where.append(tuple(np.frombuffer(rows[c][i], t) for c, t in (("id0", np.int64), ("h", np.int64), ("pos", np.int32), ("done", np.uint8))))
                settled = np.frombuffer(b"".join(rows["spans"]), np.int64).reshape(-1, 4)
                if len(settled):
                    yield _spans(settled[:, 0], settled[:, 1], settled[:, 2], settled[:, 3])
                order, shared = merge_runs(inputs)
                if not order:
                    continue
                shared = np.array(shared, np.int64)
                # Suffixes that share too little with both neighbours have no partner.
                near = shared >= length - high
                partner = near | np.append(near[1:], False)
                kept = np.flatnonzero(partner)
                if not len(kept):
                    continue
                shared = np.where(near[kept], shared[kept], 0)
                least, most = repeated_reach(shared, [lefts[order[i][0]][order[i][1]] for i in kept], length, low, high)
                base = np.concatenate(([0], np.cumsum([len(w[0]) for w in where])))
                flat = np.array([base[order[i][0]] + order[i][1] for i in kept])
                ids, hs, pos, done = (np.concatenate([w[c] for w in where])[flat] for c in range(4))
                use = (most >= 0) & (done == 0)
                yield _spans(ids[use], hs[use], pos[use] - most[use], pos[use] + length - least[use])

    return run


def _spans(ids, hs, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).astype(t)) for x, t in ((ids, np.int64), (hs, np.int64), (start, np.int32), (stop, np.int32))], ["id0", "h", "start", "stop"])


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch["text"])
        out = []
        for r, spans in enumerate(batch["spans"]):
            text = data[offsets[r] : offsets[r + 1]].tobytes()
            kept, at, removed, count = [], 0, 0, 0
            if spans.is_valid:
                cells = spans.values
                pairs = sorted(zip(cells.field("start").to_pylist(), cells.field("stop").to_pylist(), strict=True))
                for start, stop in pairs:
                    if count and start <= at:
                        if stop > at:
                            removed += stop - at
                            at = stop
                    else:
                        kept.append(text[at:start])
                        removed += stop - start
                        at = stop
                        count += 1
            kept.append(text[at:])
            out.append((batch["doc_id"][r].as_py(), len(text), removed, count, b"".join(kept)))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 4 else pa.int64()) for k, c in enumerate(columns)], names)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): the rows with keys id0 and h, and byte spans by these keys that hold each repeated byte."""
    if not 0 < gram < length < 256:
        raise ValueError("lengths must satisfy 0 < gram < length < 256")
    id_, text = docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(0)).alias("id0"), F.xxhash64(text, id_.isNull()).alias("h"), text.alias("text"))
    found = rows.select("id0", "h", "text").mapInArrow(_anchor_rows(length, gram), ANCHORS)
    again = found.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_repeated, often=SPLITS[0][0]), "id0 long, h long, pos int")
    places = cut_lineage(again.groupBy("id0", "h", F.expr("pos < 0").alias("hot")).agg(F.collect_set("pos").alias("at")))
    # At most one gram for each SPLITS[0][0] anchors.
    often = {r["id0"]: r["h"] for r in places.where("hot").select("id0", "h").collect()}
    keys = np.array(sorted(often), np.int64)
    order = np.argsort(keys.view(np.uint64))
    hot = docs.sparkSession.sparkContext.broadcast((keys[order].view(np.uint64), np.array([often[k] for k in keys[order].tolist()], np.int64)))
    places = places.where("not hot").drop("hot")
    total = places.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    parts = max(1, -(-total // PART_ROWS))
    # With the same columns as in the last join, so that the texts are dealt out once for both.
    held = rows.join(places, ["id0", "h"])
    sent = held.mapInArrow(_sorted_runs(length, gram, parts, hot), RUNS)
    spans = sent.repartition(parts, "part").sortWithinPartitions("part", "near", "far").mapInArrow(_merged(length), SPANS)
    return rows, spans


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes).

    Each byte covered by a string of ``length`` bytes that also starts anywhere else in the table's texts, same text
    included, is removed; strings are judged on the input and never cross texts. Null counts as empty; texts shorter than
    ``length`` stay whole. Repeated rows are copies of each other and lose all that is long enough. A very long text is searched
    in overlapping steps of a megabyte and cut whole. An empty table gives an empty result. Other columns are not read, so
    their names can't clash. ``kept`` is binary, as a cut may fall inside a character.
    """
    rows, spans = repeated_spans(docs, id_col, text_col, length, gram)
    by_row = spans.groupBy("id0", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = rows.join(by_row, ["id0", "h"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
