"""Token ids as Parquet list columns: delta-packed metadata, dictionary-coded ids, small row groups and page indexes."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freqloom.llm.common import texts_of
from freqloom.llm.tokens import encoded_rows, tokenizer_path
from freqloom.session import ensure_checkpoint_dir

END_ID = 2
ROWS = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
#: Version 2 pages pack integers as deltas; ids keep a dictionary, as a vocabulary is small. Page indexes come with each file.
FORMAT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}


def _rows(path: str, end_id: int, added: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        start = 0
        for batch in batches:
            for i, flat, at in encoded_rows(batch, path, end_id, added):
                size = np.diff(at)
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int32)))
                columns = [batch["doc_id"].slice(i, len(size)), pa.array(np.full(len(size), part, np.int32)), pa.array(start + at[:-1]), pa.array(size), ids]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROWS.split(", ")])
                start += int(at[-1])

    return run


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, added: bool = False) -> None:
    """Write ids in ascending id order, one file per range of ids.

    Columns: doc_id, part (number of the range), part_start (ids before the document in its range), n_tokens, ids. Null and
    empty texts are ``end_id`` alone. Null ids come first; rows that share an id are ordered by a hash of their text, so a
    hot id is split over ranges. An empty table gives no rows. With ``added``, as by the library's default, the string of an
    added token in a text becomes its id; else it is ordinary text. A very long text is encoded in pieces between sure
    boundaries and is one row. Other columns are not read, so their names can't clash.
    """
    texts = texts_of(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = texts.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(_rows(tokenizer or tokenizer_path(), end_id, added), ROWS).write.options(**FORMAT).parquet(path)


def part_starts(files: DataFrame) -> DataFrame:
    """Ids before each range: a running sum over one row per file."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"]
        at = ids.offsets.to_numpy()
        flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<i4")).cast("B")
        crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], batch["part_start"], batch["n_tokens"], pa.array(crc, pa.int64())], ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (ids as little-endian u32)."""
    files = spark.read.schema(ROWS).parquet(path)
    rows = files.mapInArrow(_digests, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return rows.join(part_starts(files), "part", "left").selectExpr("doc_id", "before + part_start AS start", "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """Ids of the documents low <= doc_id < high: row groups and pages of other documents are skipped."""
    return spark.read.schema(ROWS).parquet(path).where((F.col("doc_id") >= low) & (F.col("doc_id") < high)).select("doc_id", "n_tokens", "ids")


def token_digests(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the files (by default to a new folder of the session's checkpoint folder) and read them back."""
    spark = docs.sparkSession
    if path is None:
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, **options)
    return read_token_digests(spark, path)
