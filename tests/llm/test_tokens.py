"""Token files, packing, shards and chats."""

import collections
import random
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm_helpers import ODD
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compare import compare

from freqloom.llm.common import utf8
from freqloom.llm import chats, packing, queries, sharding, token_files, tokens

STRANGE = ["a  b", " lead", "x \n y", "trail ", "it's a  b <|endoftext|> c", "", "one", "　 q w", "we 're  ok\n\n go", "a ᠎ b", "\x1c x", "ﬀ ½ ², x_y 12ab", "tab\t \tx", "日本 語 テ"]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    tokenizer.encode_special_tokens = True
    return lambda text, end: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_pieces_encode_as_whole_texts(plain):
    rnd = random.Random(1)
    texts = STRANGE + ["".join(rnd.choice(["a", "é", " ", " ", "\n", "'s", "'", "1", "!", "　", "×", "ж", "日", "\xa0", "word", "Word ", ".\n"]) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    data, offsets = utf8(pa.array(texts))
    ids, at = tokens.encoder(tokens.tokenizer_path()).encode(data, offsets)
    for k, text in enumerate(texts):
        assert list(ids[at[k] : at[k + 1]]) == list(plain(text, 0)[:-1]), text


def test_the_memo_stays_small_whatever_the_corpus(plain):
    """It holds no more for more distinct words, and keeps those that come again."""
    encode = tokens.PieceEncoder(tokens.tokenizer_path())
    for p in range(0, 700_000, 20_000):
        texts = [" ".join(f"q{i}" for i in range(p + k, p + k + 1000)) + " the same words" for k in range(0, 20_000, 1000)]
        ids, at = encode.encode(*utf8(pa.array(texts)))
        assert list(ids[at[7] : at[8]]) == list(plain(texts[7], 0)[:-1])
        assert sum(x.nbytes for x in vars(encode).values() if isinstance(x, np.ndarray)) < 20 << 20


def test_pieces_met_again_outlive_a_full_memo(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 1400)
    encode = tokens.PieceEncoder(tokens.tokenizer_path())
    encode.encode(*utf8(pa.array(["these words come often"])))
    known = set(encode.keys.tolist())
    for p in range(0, 20_000, 500):
        often = ["these words come often"] if p % 1000 == 0 else []
        encode.encode(*utf8(pa.array([*often, " ".join(f"q{i}" for i in range(p, p + 500))])))
        assert known <= set(encode.keys.tolist())
        assert len(encode.keys) <= 1400 + 2 * 502


@pytest.mark.parametrize("wide", [False, True])
def test_added_tokens_as_by_the_library(wide, monkeypatch):
    library = Tokenizer.from_file(tokens.tokenizer_path())
    rnd = random.Random(3)
    texts = STRANGE + ["<|endof", "text|>", "<|endoftext|>", "".join(["<|endoftext|>"] * 3)]
    texts += ["".join(rnd.choice(["a", "é", " ", " ", "\n", "'s", "'", "1", "!", "\xa0", "Word ", "<|endoftext|>", "<|endoftext|>", "<|", "|>"]) for _ in range(rnd.randrange(30))) for _ in range(2000)]
    encode = tokens.PieceEncoder(tokens.tokenizer_path(), added=True)
    monkeypatch.setattr(encode, "wide", wide)
    data, offsets = utf8(pa.array(texts))
    ids, at = encode.encode(data, offsets)
    for k, text in enumerate(texts):
        assert list(ids[at[k] : at[k + 1]]) == library.encode(text, add_special_tokens=False).ids, text


def test_registered_queries_keep_added_tokens(spark, make, monkeypatch):
    library = Tokenizer.from_file(tokens.tokenizer_path())
    text = "one text<|endoftext|>and another"
    monkeypatch.setattr(queries, "table", lambda *_: make([(1, text)]))
    want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
    for name, end in (("op7_token_files", token_files.END_ID), ("op8_packing", packing.END_ID)):
        (row,) = queries.QUERIES[name](spark, "").collect()
        assert row.ids_crc32 == zlib.crc32(np.append(want, end).astype("<u4").tobytes())


def pairs():
    return [*[p for p in ODD if p[0] != 8], *[(100 + k, t) for k, t in enumerate(STRANGE)], (8, "long words in a row " * 4000)]


def test_token_files(spark, make, plain, tmp_path):
    path = str(tmp_path / "ids")
    got = token_files.token_digests(make(pairs()), path).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter((i, len(plain(t, 2)), zlib.crc32(plain(t, 2).tobytes())) for i, t in pairs())
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == list(np.cumsum([0] + [r.n_tokens for r in order])[:-1])
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    some = token_files.read_tokens(spark, path, 4, 7).collect()
    want = collections.Counter((i, plain(t, 2).tobytes()) for i, t in pairs() if i is not None and 4 <= i < 7)
    assert collections.Counter((r.doc_id, np.array(r.ids, "<u4").tobytes()) for r in some) == want
    assert token_files.token_digests(make([]), str(tmp_path / "none")).count() == 0


def test_token_file_format(spark, make, tmp_path, monkeypatch):
    """Delta-packed numbers, dictionary-coded ids, several row groups with page indexes, and reads that skip row groups."""
    monkeypatch.setattr(token_files, "FORMAT", token_files.FORMAT | {"parquet.block.size": str(64 << 10), "parquet.page.size": str(4 << 10), "parquet.block.size.row.check.min": "10", "parquet.page.size.row.check.min": "10"})
    texts = [(i, " ".join(f"word{(i * 7 + j * j) % 5000}" for j in range(60))) for i in range(1500)]
    token_files.write_token_files(make(texts).coalesce(1), str(tmp_path / "ids"))
    groups = 0
    for file in (tmp_path / "ids").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {c.path_in_schema.split(".")[0]: c for c in (meta.row_group(g).column(k) for k in range(meta.num_columns))}
            assert {"doc_id", "part_start", "n_tokens", "ids"} <= columns.keys()
            for name in ("doc_id", "part_start", "n_tokens"):
                assert "DELTA_BINARY_PACKED" in columns[name].encodings and not columns[name].has_dictionary_page
                assert columns[name].statistics.has_min_max
            assert "RLE_DICTIONARY" in columns["ids"].encodings and columns["ids"].has_dictionary_page
            assert all(c.has_column_index and c.has_offset_index and c.compression == "ZSTD" for c in columns.values())
    assert groups >= 5

    def scanned(df):
        rows = df.collect()
        return len(rows), df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    some, every = token_files.read_tokens(spark, str(tmp_path / "ids"), 100, 130), token_files.read_tokens(spark, str(tmp_path / "ids"), 0, 1500)
    assert scanned(every) == (1500, 1500)
    n, read = scanned(some)
    assert n == 30 and read < 1500 / groups * 3


def test_packing(make, plain):
    rows = packing.packed(make(pairs()), budget=64, group=1000).collect()
    sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    short = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 64
        short += at < 64
    total = sum(len(plain(t, 1)) for _, t in pairs())
    assert sum(r.length for r in rows) == total
    assert short <= total // 1000 + 8
    for i, t in pairs():
        if sum(j == i for j, _ in pairs()) > 1:
            continue
        ids, at = plain(t, 1), 0
        for start, n, crc, size in sorted(documents[i]):
            assert start == at and size == len(ids) and crc == zlib.crc32(ids[at : at + n].tobytes())
            at += n
        assert at == len(ids)
    assert packing.packed(make([])).count() == 0


def test_packing_balances_cost():
    lengths = [2000] * 10 + [100] * 200 + [7] * 300
    pieces = packing.pack(lengths, 2048)
    used, cost = collections.Counter(), collections.Counter()
    for _, _, n, s, _ in pieces:
        used[s] += n
        cost[s] += n + n * n / 1024
    assert sum(used.values()) == sum(lengths) and sum(v < 2048 for v in used.values()) <= 1
    assert len({s for d, _, _, s, _ in pieces if d < 10}) == 10


def test_shard_table():
    names = [f"s{i}" for i in range(16)]
    table = sharding.slot_table(names)
    share = collections.Counter(table)
    assert len(table) == sharding.SLOTS and max(share.values()) - min(share.values()) <= 1
    fewer = sharding.slot_table(names[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != 15)
    assert moved < 0.25 * len(table)
    double = collections.Counter(sharding.slot_table(names, weights={"s3": 2}))
    assert 1.8 < double[3] / double[4] < 2.2
    with pytest.raises(ValueError):
        sharding.slot_table(names, 2040)


def test_placed(spark, make, tmp_path):
    docs = make(ODD)
    rows = sharding.placed(docs, ["doc_id"], queries.SHARDS)
    assert rows.columns == [*docs.columns, "slot_", "shard_"]
    got = rows.collect()
    assert len(got) == len(ODD)
    table = sharding.slot_table(queries.SHARDS)
    for r in got:
        slot = sharding.hash60("" if r.doc_id is None else str(r.doc_id)) % sharding.SLOTS
        assert (r["slot_"], r["shard_"]) == (slot, queries.SHARDS[table[slot]])
    sharding.write_shards(docs, str(tmp_path / "shards"), ["doc_id", "text"], queries.SHARDS)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(ODD)
    assert sharding.placed(make([]), ["doc_id"], queries.SHARDS).count() == 0


CHATS = [
    (1, 0, "user", "Hello there\nsecond line"), (1, 1, "assistant", "> hello  there\nI say hi"), (1, 2, "user", "A new thread"),
    (1, 3, "user", ">> Hello there\n> I say hi\nok then"), (1, 4, "user", "> a new thread\n> I say hi\nmixed\n>unknown"),
    (1, 4, "user", "> a new thread\n> I say hi\nmixed\n>unknown"), (1, 300, "bot", "> ok then\nlate"), (1, 301, "bot", "> second LINE"),
    (1, 301, None, None), (None, 1, "user", "lone"), (None, 1, "user", "lone"), (1, None, "user", "> hello there"), (None, None, None, None),
    (2, 0, "user", ""), (2, 1, "user", "> hello there\n"), (3, 5, "u", "x\ny"), (3, 5, "u", "> x"), (3, 6, "u", " > x\n  >> y\nzz"),
    (3, 6, "w", " > x\n  >> y\nzz"), *[(4, 7, "user", f"m{i}") for i in range(200)], (4, 8, "user", "> m5\n> m77\nlong"),
    *[(5, i, "user", f"> n{i - 1}\nn{i}\nsame") for i in range(600)], (6, 1, "user", "word " * 50_000),
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", CHATS)
    return con


def test_chats_match_sql(spark, con):
    rows = spark.createDataFrame([(*r, "x", "y", "z") for r in CHATS], "conv_id long, turn long, role string, text string, tie string, level string, passage string")
    assert compare(spark, con, "chats", lambda s, d: chats.conversations(rows), queries.OP10, "") is None


def test_chat_threads(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    said = {(r.conv_id, r.turn, r.role): r for r in chats.linked_messages(rows).collect()}
    assert said[1, 3, "user"].reply_to == 1 and said[1, 3, "user"].thread_turn == 0 and said[1, 3, "user"].own == "ok then"
    assert said[1, 301, "bot"].reply_to == 0
    assert said[5, 599, "user"].thread_turn == 0 and said[5, 599, "user"].reply_to == 598
    first = [r.chat for r in chats.conversations(rows).where("conv_id = 1 AND thread_part = 0 AND turn_part = 0").collect()]
    assert [c.replace("<|im_end|>\n", "").split("<|im_start|>")[1:] for c in first] == [["user\nHello there\nsecond line", "assistant\nI say hi", "user\nok then", "user\nA new thread", "user\nmixed"]]
    assert chats.conversations(rows.limit(0)).count() == 0
