"""Hidden Markov language model: Baum-Welch counts of all partitions train latent states, scaled forward gives exact scores.

A state emits a class of words, a class emits its words by their counts, whatever the state:

    P(text) = sum over states of  start * product of (step * P(class | state))  *  product of P(word | class)

Classes are hashes of words into a fixed number of boxes, so the model's tables have one size for any corpus and are broadcast,
while each word keeps its own count. The first factor is the forward recursion over classes. The second needs the count of
each word: words with at least one token in HEAVY are at most HEAVY, and are broadcast; the others are joined, and no key of
that join has more than that share of the tokens. Texts are read twice: for the counts, and to be encoded as class numbers.
Each round of training reads the encoded table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freqloom.llm.common import fresh_columns, mix, received, row_blocks, runs, seeds, sent, utf8, words
from freqloom.session import ensure_checkpoint_dir

STATES, CLASSES, ROUNDS = 8, 1 << 16, 8
#: Words with at least one in so many of the learnt tokens are broadcast: they are at most so many.
HEAVY = 1 << 20
#: Distinct words held by a counting task, tokens gathered by a training task, tokens of one step of it.
HELD_WORDS, GATHER, STRIP = 1 << 21, 1 << 25, 1 << 19
#: Expected counts are summed as whole multiples of 1 / UNIT, which gives one result in any order.
UNIT = 1 << 16
#: The end of a text is a token in a class of its own.
END = np.uint64(seeds(1, 71)[0])
#: Weight of the classes' overall shares in each state's emissions.
PRIOR = 2000.0


def classes_of(h: np.ndarray, classes: int) -> np.ndarray:
    return (h % np.uint64(classes - 1)).astype(np.int64) + 1


def _folder(df: DataFrame) -> str:
    ensure_checkpoint_dir(df.sparkSession)
    return f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/language-model-{uuid.uuid4().hex}"


def prepared(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number of its own), doc_id, held_out, text; a condition that is null counts as learnt from."""
    (flag,) = fresh_columns(docs, "held_out")
    rows = docs.withColumn(flag, ~F.coalesce(learn, F.lit(True)))
    return rows.select(F.monotonically_increasing_id().alias("row"), rows[id_col].cast("long").alias("doc_id"), F.col(flag).alias("held_out"), rows[text_col].cast("string").alias("text"))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def merge():
        h, c = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        order = np.argsort(h)
        at = runs([h[order]])[:-1]
        return h[order][at], np.add.reduceat(c[order], at) if len(at) else c

    def out(h, c):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    for batch in batches:
        data, offsets = utf8(batch["text"])
        for i, j in row_blocks(offsets):
            h, _, _, _ = words(data, offsets[i : j + 1], lower=True)
            u, c = np.unique(h, return_counts=True)
            held.append((np.append(u, END), np.append(c, j - i)))
            size += len(held[-1][0])
            if size > 2 * HELD_WORDS:
                held = [merge()]
                size = len(held[0][0])
                if size > HELD_WORDS:
                    yield out(*held[0])
                    held, size = [], 0
    if held:
        yield out(*merge())


@dataclass(frozen=True)
class Vocabulary:
    """Counts of the learnt tokens: all words as a table, and what has a bounded size as arrays."""

    table: DataFrame  # h (hash of a word), c (its count)
    n_tokens: int
    n_words: int  # distinct tokens, the end among them
    n_texts: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    heavy: np.ndarray  # ascending hashes
    heavy_count: np.ndarray
    least: int  # a count from which on a word is heavy


def vocabulary(rows: DataFrame, classes: int = CLASSES, heavy: int = HEAVY) -> Vocabulary:
    """Counts over all texts that are learnt from: a task sends each of its words once, and the sums are written as a table."""
    path = f"{_folder(rows)}/words"
    rows.where("not held_out").select("text").mapInArrow(_counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).write.parquet(path)
    table = rows.sparkSession.read.schema("h long, c long").parquet(path)
    box = F.when(F.col("h") == int(END.view(np.int64)), 0).otherwise(_class_column("h", classes))
    sums = table.groupBy(box.alias("class")).agg(F.sum("c").alias("tokens"), F.count("*").alias("words")).toArrow()
    tokens, kinds = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    at = sums["class"].to_numpy()
    tokens[at], kinds[at] = sums["tokens"].to_numpy(), sums["words"].to_numpy()
    n = int(tokens.sum())
    least = max(1, -(-n // heavy))
    top = table.where((F.col("c") >= least) & (F.col("h") != int(END.view(np.int64)))).toArrow()
    h = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return Vocabulary(table, n, int(kinds.sum()), int(tokens[0]), tokens, kinds, h[order], top["c"].to_numpy()[order], least)


def _class_column(name: str, classes: int) -> Column:
    """classes_of in SQL: the remainder of the hash as an unsigned number."""
    signed = F.pmod(F.col(name), F.lit(classes - 1))
    return (F.pmod(signed + F.when(F.col(name) < 0, (1 << 64) % (classes - 1)).otherwise(0), F.lit(classes - 1)) + 1).cast("int")


ENCODED = "row long, doc_id long, held_out boolean, n long, known long, logs double, ids binary, tail array<long>, tail_n array<int>"


def _encode(batches: Iterable[pa.RecordBatch], shared, classes: int) -> Iterator[pa.RecordBatch]:
    heavy, count, end_known, end_log = received(shared)
    logs_of = np.log10(count + 1.0)
    for batch in batches:
        data, offsets = utf8(batch["text"])
        for i, j in row_blocks(offsets):
            h, _, _, by_row = words(data, offsets[i : j + 1], lower=True)
            n_rows, n = j - i, np.diff(by_row)
            row = np.repeat(np.arange(n_rows), n)
            at = by_row + np.arange(n_rows + 1)
            ids = np.zeros(at[-1], np.uint16)
            ids[np.arange(len(h)) + row] = classes_of(h, classes)
            kinds, kind = np.unique(h, return_inverse=True)
            place = np.searchsorted(heavy, kinds)
            place[place == len(heavy)] = 0
            met = heavy[place] == kinds if len(heavy) else np.zeros(len(kinds), bool)
            hit = met[kind]
            logs = np.bincount(row[hit], weights=logs_of[place[kind[hit]]], minlength=n_rows) + end_log
            known = np.bincount(row[hit], minlength=n_rows) + end_known
            # Words to look up in the table, each once a row.
            key, times = np.unique(row[~hit] * len(kinds) + kind[~hit], return_counts=True)
            own, kind = np.divmod(key, max(1, len(kinds)))
            starts = pa.array(np.searchsorted(own, np.arange(n_rows + 1)).astype(np.int32))
            flat = ids.tobytes()
            out = [batch[c].slice(i, n_rows) for c in ("row", "doc_id", "held_out")]
            out += [pa.array(n + 1), pa.array(known), pa.array(logs), pa.array([flat[2 * a : 2 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())]
            out += [pa.ListArray.from_arrays(starts, pa.array(kinds[kind].view(np.int64))), pa.ListArray.from_arrays(starts, pa.array(times.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in ENCODED.split(", ")])


def encoded(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """All texts as class numbers of 16 bits, with what the broadcast words give; written once and read again.

    ``logs`` sums log10(count + 1) over the end and the heavy words, ``known`` counts them if learnt; ``tail`` are the others.
    """
    known = int(vocab.n_texts > 0)
    shared = sent(rows, (vocab.heavy, vocab.heavy_count, known, float(np.log10(vocab.n_texts + 1.0))))
    path = f"{_folder(rows)}/encoded"
    rows.mapInArrow(partial(_encode, shared=shared, classes=len(vocab.class_tokens)), ENCODED).write.parquet(path)
    return rows.sparkSession.read.schema(ENCODED).parquet(path)


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # (states)
    step: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states): P(class | state)


def first_model(vocab: Vocabulary, states: int = STATES, salt: int = 5) -> Model:
    """States that tend to stay, and emit the classes' shares times fixed numbers by hash that tell the states apart."""
    share = class_shares(vocab)
    code = mix(np.arange(len(share) * states, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
    emit = share[:, None] * (0.05 + (code >> np.uint64(11)) / float(1 << 53)).reshape(len(share), states) ** 2
    step = np.full((states, states), 0.2 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    if states > 1:
        np.fill_diagonal(step, 0.8)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(axis=0))


def class_shares(vocab: Vocabulary) -> np.ndarray:
    share = vocab.class_tokens + vocab.class_words + 1.0
    return share / share.sum()


class Strip:
    """Texts of class numbers, longest first, laid out by time: all first numbers, then all second ones, and so on."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        self.alive = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # texts longer than t
        self.at = np.concatenate(([0], np.cumsum(self.alive)))
        text = np.repeat(np.arange(len(size)), size)
        time = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
        place = self.at[time] + text
        self.ids = np.empty(len(text), np.int64)
        self.ids[place] = ids[offsets[self.order][text] + time]

    def blocks(self, limit: int) -> list[tuple[int, int]]:
        """Ranges of time with at most ``limit`` numbers each, or one time."""
        out, t = [], 0
        while t < len(self.alive):
            u = max(t + 1, int(np.searchsorted(self.at, self.at[t] + limit, "right")) - 1)
            out.append((t, min(u, len(self.alive))))
            t = out[-1][1]
        return out

    def forward(self, block: tuple[int, int], before: np.ndarray | None, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions, scaled forward values and scales of a range of time; ``before`` are the values of the time before."""
        t0, t1 = block
        emit = model.emit[self.ids[self.at[t0] : self.at[t1]]]
        alpha, scale, ones = np.empty_like(emit), np.empty(len(emit), emit.dtype), np.ones(emit.shape[1], emit.dtype)
        a = before
        for t in range(t0, t1):
            n, p = self.alive[t], self.at[t] - self.at[t0]
            own = alpha[p : p + n]
            if a is None:
                np.multiply(emit[p : p + n], model.start, out=own)
            else:
                np.matmul(a[:n], model.step, out=own)
                own *= emit[p : p + n]
            s = own @ ones
            own /= s[:, None]
            scale[p : p + n] = s
            a = own
        return emit, alpha, scale

    def log10_likelihood(self, model: Model, limit: int = STRIP) -> np.ndarray:
        """Of each text, in the order given."""
        total, a = np.zeros(int(self.alive[0])), None
        for t0, t1 in self.blocks(limit):
            _, alpha, scale = self.forward((t0, t1), a, model)
            alive = self.alive[t0:t1]
            text = np.arange(len(scale)) - np.repeat(np.cumsum(alive) - alive, alive)
            total += np.bincount(text, weights=np.log10(scale), minlength=len(total))
            a = alpha[len(alpha) - alive[-1] :]
        out = np.empty(len(total))
        out[self.order] = total
        return out

    def expected_counts(self, model: Model, start: np.ndarray, step: np.ndarray, emit: np.ndarray, limit: int = STRIP) -> None:
        """Adds the texts' expected starts, steps and emissions. Forward values are kept for one range of time only."""
        blocks, entry = self.blocks(limit), [None]
        for block in blocks[:-1]:
            _, alpha, _ = self.forward(block, entry[-1], model)
            entry.append(alpha[len(alpha) - self.alive[block[1] - 1] :].copy())
        turned = np.ascontiguousarray(model.step.T)
        after = np.zeros((0, len(start)), model.emit.dtype)  # emission times backward value of the next time, by its scale
        pairs = np.zeros_like(step)
        for block, before in zip(blocks[::-1], entry[::-1], strict=True):
            shares, alpha, scale = self.forward(block, before, model)
            shares /= scale[:, None]
            back = np.ones_like(alpha)
            for t in range(block[1] - 1, block[0] - 1, -1):
                n, p = self.alive[t], self.at[t] - self.at[block[0]]
                if len(after):
                    np.matmul(after, turned, out=back[p : p + len(after)])
                after = shares[p : p + n]
                after *= back[p : p + n]
            # Each number but a text's first stands behind that of the time before, as many places off as there were texts.
            alive, first = self.alive[block[0] : block[1]], int(self.alive[block[0]])
            if before is not None:
                pairs += before[:first].T @ shares[:first]
            pairs += alpha[np.arange(first, len(alpha)) - np.repeat(alive[:-1], alive[1:])].T @ shares[first:]
            after = after.copy()
            alpha *= back
            ids = self.ids[self.at[block[0]] : self.at[block[1]]]
            for k in range(len(start)):
                emit[:, k] += np.bincount(ids, weights=alpha[:, k], minlength=len(emit))
            if block[0] == 0:
                start += alpha[:first].sum(axis=0)
        step += pairs * model.step


def strips(batches: Iterable[pa.RecordBatch], gather: int, strip: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray], list[Strip]]]:
    """The batches read together, and their texts by falling length in strips, each with the texts' numbers among them."""

    def made(held):
        flat, sizes = [], []
        for batch in held:
            data, at = utf8(batch["ids"])
            flat.append(data[at[0] : at[-1]])
            sizes.append(np.diff(at) // 2)
        ids, size = np.concatenate(flat).view(np.uint16), np.concatenate(sizes)
        at = np.concatenate(([0], np.cumsum(size)))
        order = np.argsort(-size, kind="stable")
        total = np.cumsum(size[order])
        places, out, i = [], [], 0
        while i < len(order):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + strip, "right")))
            own = order[i:j]
            row, copy = np.repeat(own, size[own]), np.arange(int(size[own].sum()))
            copy = copy - np.repeat(np.cumsum(size[own]) - size[own], size[own])
            places.append(own)
            out.append(Strip(ids[at[row] + copy], np.concatenate(([0], np.cumsum(size[own])))))
            i = j
        return held, places, out

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch["ids"].nbytes // 2
        if size >= gather:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def _expected(batches: Iterable[pa.RecordBatch], shared, gather: int, strip: int) -> Iterator[pa.RecordBatch]:
    model = received(shared)
    single = Model(*(x.astype(np.float32) for x in (model.start, model.step, model.emit)))
    states = len(model.start)
    start, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape)
    for _, _, found in strips(batches, gather, strip):
        for own in found:
            own.expected_counts(single, start, step, emit, strip)
    counts = np.rint(np.concatenate((start[None], step, emit)) * UNIT).astype(np.int64)
    at = np.flatnonzero(counts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(counts[at, k]) for k in range(states))], ["at", *(f"s{k}" for k in range(states))])


def baum_welch(texts: DataFrame, vocab: Vocabulary, model: Model, rounds: int = ROUNDS, gather: int = GATHER, strip: int = STRIP) -> Model:
    """``rounds`` of expectation over all ``texts`` (encoded) and maximisation of the summed counts.

    A task sends a row for each class it has met; their sums, one row per class, come back to the driver. Expected counts are
    taken in single precision, which is half the work; scores are not.
    """
    states, share = len(model.start), class_shares(vocab)
    names = [f"s{k}" for k in range(states)]
    for _ in range(rounds):
        shared = sent(texts, model)
        sums = texts.select("ids").mapInArrow(partial(_expected, shared=shared, gather=gather, strip=strip), f"at int, {', '.join(f'{c} long' for c in names)}")
        got = sums.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        counts = np.zeros((1 + states + len(share), states))
        counts[got["at"].to_numpy()] = np.stack([got[c].to_numpy() for c in names], axis=1) / UNIT
        start, step, emit = counts[0] + 1, counts[1 : 1 + states] + 1, counts[1 + states :] + PRIOR * share[:, None]
        model = Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def _scored(batches: Iterable[pa.RecordBatch], shared, gather: int, strip: int) -> Iterator[pa.RecordBatch]:
    model, within = received(shared)
    for held, places, found in strips(batches, gather, strip):
        likelihood = np.empty(sum(b.num_rows for b in held))
        for own, texts in zip(places, found, strict=True):
            size = texts.alive
            text = np.arange(len(texts.ids)) - np.repeat(np.cumsum(size) - size, size)
            share = np.empty(len(own))
            share[texts.order] = np.bincount(text, weights=within[texts.ids], minlength=len(own))
            likelihood[own] = texts.log10_likelihood(model, strip) + share
        at = 0
        for b in held:
            yield pa.RecordBatch.from_arrays([*(b[c] for c in SCORED), pa.array(likelihood[at : at + b.num_rows])], [*SCORED, "part"])
            at += b.num_rows


SCORED = ("row", "doc_id", "held_out", "n", "known", "logs")


def scored(texts: DataFrame, vocab: Vocabulary, model: Model, gather: int = GATHER, strip: int = STRIP) -> DataFrame:
    """Exact scores of encoded texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The part of a class's words: log10(count + 1) - log10(class's tokens + class's words + 1); the first term is ``logs`` and
    what the join of the rarer words adds to it. The end has its class to itself.
    """
    within = -np.log10(vocab.class_tokens + vocab.class_words + 1.0)
    within[0] = -np.log10(vocab.n_texts + 1.0)
    shared = sent(texts, (model, within))
    own = texts.select(*SCORED, "ids").mapInArrow(partial(_scored, shared=shared, gather=gather, strip=strip), "row long, doc_id long, held_out boolean, n long, known long, logs double, part double")
    rare = vocab.table.where(F.col("c") < vocab.least)
    tail = texts.where("size(tail) > 0").selectExpr("row", "inline(arrays_zip(tail, tail_n))").withColumnRenamed("tail", "h")
    more = tail.join(rare, "h").groupBy("row").agg(F.sum("tail_n").alias("more"), F.sum(F.expr("tail_n * log10(c + 1D)")).alias("gain"))
    base = float(np.log10(vocab.n_tokens + vocab.n_words + 1.0))
    return own.join(more, "row", "left").selectExpr(
        "doc_id", "held_out", "n as n_tokens", "known + coalesce(more, 0L) as n_known", f"{vocab.n_tokens}L as train_tokens",
        f"logs + coalesce(gain, 0D) - n * {base!r}D as base_score", "part + logs + coalesce(gain, 0D) as score",
    )


def language_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS, heavy: int = HEAVY) -> DataFrame:
    """Train on the rows of ``docs`` where ``learn`` holds, score all: one row per row of ``docs``.

    Columns: doc_id, held_out (not learnt from), n_tokens, n_known (tokens met in training), train_tokens, base_score
    (log10 of add-one unigram shares, one more for unknown tokens), score (log10 probability of the text under the model).
    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, told apart by 64-bit hashes, and one end.

    Null, empty and blank texts are the end alone. Where ``learn`` is null a row is learnt from. Rows that repeat count and
    are scored as often; a null id stays null. A very long text goes through training in ranges of time, with the forward
    values of one range in memory. Without rows to learn from all tokens are unknown; an empty table gives none. Other
    columns are not read but by ``learn``, so their names can't clash. ``classes`` is at most 65,536. Training is the same
    for any order of tasks; a table dealt out otherwise changes sums in their last digits.
    """
    rows = prepared(docs, learn, id_col, text_col)
    vocab = vocabulary(rows, classes, heavy)
    texts = encoded(rows, vocab)
    model = baum_welch(texts.where("not held_out"), vocab, first_model(vocab, states), rounds)
    return scored(texts, vocab, model)
