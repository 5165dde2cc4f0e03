"""Cost-balanced packing of tokenised documents into sequences of a fixed token budget."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from freqloom.llm.common import texts_of
from freqloom.llm.tokens import encoded_rows, tokenizer_path

END_ID = 1
#: Tokens packed with each other. A larger number leaves fewer padded ends; a task holds about this many ids at a time.
GROUP = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(lengths: list[int], budget: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of the given lengths.

    Documents in descending length go to the sequence of lowest cost that has room; a piece of n tokens costs
    linear * n + quadratic * n * n. What fits nowhere is cut: the roomiest sequence takes what it can. All sequences but the
    last are filled.
    """
    total = sum(lengths)
    count = -(-total // budget)
    room = np.full(count, budget, np.int64)
    if count:
        room[-1] = total - budget * (count - 1)
    used, cost = np.zeros(count, np.int64), np.zeros(count)
    out = []
    for d in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[d]
        while left:
            fits = np.where(room >= left, cost, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:
                s = int(room.argmax())
            n = min(left, int(room[s]))
            out.append((d, start, n, s, int(used[s])))
            used[s] += n
            room[s] -= n
            cost[s] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


def _packer(path: str, budget: int, group: int, end_id: int, added: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        docs: list[tuple[int | None, bytes]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal first
            rows = []
            pieces = pack([len(b) // 4 for _, b in docs], budget)
            for d, start, n, s, offset in pieces:
                doc_id, raw = docs[d]
                rows.append((doc_id, start, n, zlib.crc32(memoryview(raw)[4 * start : 4 * (start + n)]), len(raw) // 4, first + s, offset))
            first += 1 + max(p[3] for p in pieces)
            columns = list(zip(*rows, strict=True))
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            numbers = batch["doc_id"].to_pylist()
            for i, ids, at in encoded_rows(batch, path, end_id, added):
                for r in range(len(at) - 1):
                    docs.append((numbers[i + r], ids[at[r] : at[r + 1]].tobytes()))
                    held += int(at[r + 1] - at[r])
                    if held >= group:
                        yield flush()
                        docs, held = [], 0
        if docs:
            yield flush()

    return run


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, budget: int = 2048, group: int = GROUP, end_id: int = END_ID, added: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; each id lies in one piece, and a sequence's pieces follow each other from offset
    0. Groups of about ``group`` tokens are packed where they are read, without a shuffle: only the last sequence of a group
    is not full. Null and empty texts are ``end_id`` alone. Repeated rows and null ids are packed like others. An empty
    table gives an empty result. Sequence numbers depend on the table's partitions. With ``added``, as by the library's
    default, the string of an added token in a text becomes its id; else it is ordinary text. Documents of equal length are
    packed in the order read. A very long text is encoded in pieces between sure boundaries, and its ids are cut over as many
    sequences as they need. Other columns are not read, so their names can't clash.
    """
    path = tokenizer or tokenizer_path()
    return texts_of(docs, id_col, text_col).mapInArrow(_packer(path, budget, group, end_id, added), PIECES)
