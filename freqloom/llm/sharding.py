"""Placement of rows on shards by a permutation-filled lookup table of prime size."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freqloom.llm.common import fresh_columns

#: A prime of at least a hundred slots for each of sixteen shards keeps shares within a few per cent.
SLOTS = 2039
MOST_SLOTS = 1 << 20


def hash60(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def slot_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """Shard number of each slot.

    Shard s prefers slots (offset + j * skip) mod slots, j = 0, 1, ...; the shards take turns, each claiming its next free
    slot (``weights``: so many in its turn), until all are taken. As the size is prime, each order visits every slot. When a
    shard is added or removed, few slots of the others change.
    """
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards must be named, each once")
    if not len(shards) <= slots <= MOST_SLOTS or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    at = [hash60(f"{s}/offset") % slots for s in shards]
    skip = [hash60(f"{s}/skip") % (slots - 1) + 1 for s in shards] if slots > 2 else [1] * len(shards)
    table, free = [-1] * slots, slots
    while True:
        for i, s in enumerate(shards):
            for _ in range((weights or {}).get(s, 1)):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                table[at[i]] = i
                free -= 1
                if not free:
                    return table


def slot_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """(slot, shard): as many rows as slots, a parameter."""
    names = [shards[i] for i in slot_table(shards, slots, weights)]
    return spark.range(1).select(F.posexplode(F.from_json(F.lit(_json(names)), "array<string>")).alias("slot", "shard"))


def _json(names: list[str]) -> str:
    import json

    return json.dumps(names)


def slot_of(keys: list[Column], slots: int) -> Column:
    """Slot of a row: the first 60 bits of the MD5 of its keys as text, modulo the table size. A null key counts as empty."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots).cast("int")


def placed(docs: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with two more, ``slot`` and ``shard`` (names in use get an underscore added).

    Rows of equal keys share a shard; a hot key is spread by naming more columns in ``keys``. Null keys count as empty,
    repeated rows stay, an empty table stays empty. One broadcast join with the table, whose size is a parameter.
    """
    slot, shard = fresh_columns(docs, "slot", "shard")
    table = slot_frame(docs.sparkSession, shards, slots, weights).toDF(slot, shard)
    return docs.withColumn(slot, slot_of([docs[k] for k in keys], slots)).join(F.broadcast(table), slot, "left").select(*docs.columns, slot, shard)


def write_shards(docs: DataFrame, path: str, keys: list[str], shards: list[str], files: int = 8, **options) -> None:
    """One folder per shard with about ``files`` files each, rows dealt by all keys, so that no task holds a whole shard."""
    rows = placed(docs, keys, shards, **options)
    shard = rows.columns[-1]
    rows.withColumn("__file", F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(files))).repartition(shard, "__file").drop("__file").write.partitionBy(shard).parquet(path)
