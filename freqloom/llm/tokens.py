"""Token ids of whole texts by a public byte-level tokenizer of the tokenizers library, with a memo of pieces."""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from freqloom.llm.common import SMALL_STEP, mix, powers, row_blocks, runs, seeds, utf8

TOKENIZER = "byte_bpe_50k.json"
#: Pieces remembered in a worker (about 40 bytes each) before those go that were not met again since they came.
MEMO = 400_000
_BYTE = seeds(256, 61)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


_LETTER = _set((65, 90), (97, 122))
_PRINT = _set((33, 126))
_MARK = _PRINT & ~_LETTER & ~_set((48, 57))
_LEAD = _set((0xC3, 0xDF))  # first bytes of two-byte characters, none of them white space
_TAIL = _set((0x80, 0xBF))
_SIGN = _set((0x97, 0x97), (0xB7, 0xB7))  # after C3: the two signs among its letters


def _byte_chars() -> dict[int, str]:
    """Byte-level vocabularies write bytes as characters: printable ones as themselves, the others as 256, 257, ... in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_CHARS = _byte_chars()


def piece_starts(block: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places where byte-level pre-tokenization surely begins a new token, and the ``rows``.

    These are a space or line feed alone between two characters that are not white space, the character after such a line
    feed, and the changes between letters and ASCII marks (not after an apostrophe). What lies between two of them is
    encoded the same way alone, as no other rule looks at its neighbours.
    """
    n = len(block)
    b = np.zeros(n + 3, np.uint8)
    b[2 : n + 2] = block
    before2, before, here, after = b[:n], b[1 : n + 1], b[2 : n + 2], b[3 : n + 3]
    two = _LEAD[before2] & _TAIL[before]
    ends = _PRINT[before] | two  # the character before is surely not white space
    begins = _PRINT | _LEAD
    gap = ((here == 32) | (here == 10)) & ends & begins[after]
    gap[rows[rows < n]] = False
    start = gap.copy()
    start[1:] |= gap[:-1] & (here[:-1] == 10)
    letter_before = _LETTER[before] | ((before2 == 0xC3) & _TAIL[before] & ~_SIGN[before])
    letter_here = _LETTER[here] | ((here == 0xC3) & ~_SIGN[after])
    start |= letter_before & _MARK[here]
    start |= _MARK[before] & (before != 39) & letter_here
    start[rows[rows < n]] = True
    return np.flatnonzero(start)


class PieceEncoder:
    """Encodes texts to ids. Texts are cut into pieces; each distinct piece, known by a 64-bit hash, is encoded once by the
    library, all new ones of a block in one call.

    With ``added``, as by the library's default, the string of an added token in a text is that token, and a text that holds
    one is cut around it; else a special token's string is ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = not added
        tokens = list(self.tokenizer.get_added_tokens_decoder().values()) if added else []
        self.added = sorted((t.content.encode() for t in tokens if t.content), key=len, reverse=True)
        #: Tokens that look at what is around them: rows that hold one are encoded as a whole.
        self.wide = any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tokens)
        self.line = self.whole("\n")[0]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def _forget(self) -> None:
        """Keeps the pieces that were met in more than one block since the last time, or none if these are most."""
        kept = np.flatnonzero(self.again)
        if 2 * len(kept) > MEMO:
            self._clear()
            return
        size = self.size[kept]
        start = np.concatenate(([0], np.cumsum(size)))
        self.pool = self.pool[np.repeat(self.start[kept] - start[:-1], size) + np.arange(start[-1])]
        self.keys, self.start, self.size = self.keys[kept], start[:-1], size
        self.again = np.zeros(len(kept), bool)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows data[offsets[i]:offsets[i + 1]], and their offsets by row."""
        block, rows = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        n = len(block)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = piece_starts(block, rows)
        if self.added:
            starts = self._cut_added(block, rows, starts)
        ends = np.append(starts[1:], n)
        up, down = powers(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[block] * up[:n], out=prefix[1:])
        h = mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        order = np.argsort(h)
        at = runs([h[order]])
        distinct, first = h[order[at[:-1]]], order[at[:-1]]
        self._learn(distinct, starts[first], ends[first], block)
        place = np.searchsorted(self.keys, distinct)
        code = np.empty(len(h), np.int64)
        code[order] = np.repeat(place, np.diff(at))
        size = self.size[code]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(self.start[code] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, rows)]

    def _cut_added(self, block: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The starts, with each added token's string a piece of its own (or its row, if the tokens look around)."""
        raw, pattern = block.tobytes(), re.compile(b"|".join(map(re.escape, self.added)))
        if not pattern.search(raw):
            return starts
        cuts = []
        for p, q in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):  # no string goes over the end of a row
            found = [(m.start(), m.end()) for m in pattern.finditer(raw, p, q)]
            cuts += [(p, q)] if found and self.wide else found
        first, last = np.array(cuts, np.int64).reshape(-1, 2).T
        inside = np.zeros(len(block) + 1, np.int64)
        np.add.at(inside, first + 1, 1)
        np.add.at(inside, last, -1)
        kept = starts[np.cumsum(inside)[starts] == 0]
        return np.unique(np.concatenate([kept, first, last[last < len(block)]]))

    def _learn(self, distinct: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: np.ndarray) -> None:
        if len(self.keys) > MEMO:
            self._forget()
        near = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[near] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        self.again[near[known]] = True
        new = np.flatnonzero(~known)
        if not len(new):
            return
        starts, ends = starts[new], ends[new]
        raw = block.tobytes()
        # A line feed between two pieces is a token of its own if they hold none and neither begin nor end in white space.
        head = block[np.minimum(starts + ((block[starts] == 32) & (ends - starts > 1)), len(block) - 1)]
        tail = block[ends - 1]
        closed = _PRINT[tail] | ((ends - starts > 1) & _LEAD[block[ends - 2]] & _TAIL[tail])
        lines = np.concatenate(([0], np.cumsum(block == 10)))
        plain = (_PRINT[head] | _LEAD[head]) & closed & (lines[ends] == lines[starts])
        if self.added and self.wide:
            holds = re.compile(b"|".join(map(re.escape, self.added))).search
            plain &= np.array([holds(raw, a, b) is None for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], bool)
        pools, size = [self.pool], np.zeros(len(new), np.int64)
        # Letters alone, after a space or not, are one token for pre-tokenization: the model's merges are all that is left.
        latin = np.append((block[:-1] == 0xC3) & _TAIL[block[1:]] & ~_SIGN[block[1:]], False)
        letter = _LETTER[block] | latin
        letter[1:] |= latin[:-1]
        letters = np.concatenate(([0], np.cumsum(letter)))
        single = plain & (letters[ends] - letters[starts] == ends - starts - (block[starts] == 32)) & (ends - starts > (block[starts] == 32))
        own = np.flatnonzero(single)
        if len(own):
            text = b"\n".join([raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            tokenize = self.tokenizer.model.tokenize
            found = [[t.id for t in tokenize(w)] for w in text.decode("latin-1").translate(BYTE_CHARS).split(BYTE_CHARS[10])]
            size[own] = [len(x) for x in found]
            pools.append(np.array([i for x in found for i in x], np.uint32))
        some = np.flatnonzero(plain & ~single)
        for p in range(0, len(some), 100_000):
            own = some[p : p + 100_000]
            text = b"\n".join([raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            ids = self.whole(text.decode())
            cut = np.flatnonzero(ids == self.line)
            if len(cut) + 1 != len(own):
                plain[own] = False
                continue
            size[own] = np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1
            pools.append(np.delete(ids, cut))
        known = np.concatenate([np.flatnonzero(single), np.flatnonzero(plain & ~single)])
        for k in np.flatnonzero(~plain):
            ids = self.whole(raw[starts[k] : ends[k]].decode())
            size[k] = len(ids)
            pools.append(ids)
        filled = np.concatenate([known, np.flatnonzero(~plain)])
        start = np.empty(len(new), np.int64)
        start[filled] = len(self.pool) + np.concatenate(([0], np.cumsum(size[filled])[:-1]))
        self.pool = np.concatenate(pools)
        keys = np.concatenate([self.keys, distinct[new]])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.start = np.concatenate([self.start, start])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])[order]


def encoder(path: str, added: bool = False) -> PieceEncoder:
    """The worker process's encoder, kept between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders"))
    if not hasattr(kept, "by_path"):
        kept.by_path = {}
    if (path, added) not in kept.by_path:
        kept.by_path[path, added] = PieceEncoder(path, added)
    return kept.by_path[path, added]


def encoded_rows(batch: pa.RecordBatch, path: str, end_id: int, added: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, offsets by row) of the batch's texts in pieces, each text with ``end_id`` at its end."""
    encode = encoder(path, added).encode
    data, offsets = utf8(batch["text"])
    for i, j in row_blocks(offsets, 2 * SMALL_STEP):
        ids, at = encode(data, offsets[i : j + 1])
        ids = np.insert(ids, at[1:], end_id).astype("<u4", copy=False)
        yield i, ids, at + np.arange(len(at))
