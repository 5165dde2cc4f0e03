"""Conversations by linked quotations: replies follow what they quote, and the quotes go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freqloom.session import cut_lineage

QUOTED = r"^[ \t]*>"
MARKS = r"^([ \t]*>)+"
#: Turns of one part of a conversation, and distinct messages of one turn in one part.
PART_TURNS, PART_TIES = 256, 64
KEY = ["conv_id", "turn", "tie"]


def distinct_messages(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text, copies, tie: repeated rows as one message; ``tie`` orders messages of one turn."""
    return (
        rows.select(rows[conv_col].cast("long").alias("conv_id"), rows[turn_col].cast("long").alias("turn"), rows[role_col].cast("string").alias("role"), rows[text_col].cast("string").alias("text"))
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.count("*").alias("copies"))
        .withColumn("tie", F.md5(F.concat_ws("\x1f", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))))
    )


def _lines(messages: DataFrame) -> DataFrame:
    """Level and normalised body of each line that is not blank; level 0 is a message's own text."""
    line = messages.select(*KEY, F.explode(F.split("text", "\n")).alias("line")).withColumn("marks", F.regexp_extract("line", MARKS, 0))
    body = F.lower(F.trim(F.regexp_replace(F.expr("substring(line, length(marks) + 1)"), r"[ \t\r\x0B\f]+", " ")))
    return line.select(*KEY, F.expr("length(marks) - length(replace(marks, '>', ''))").alias("level"), body.alias("body")).where("body <> ''").select(*KEY, "level", F.xxhash64("body").alias("passage"), F.length("body").alias("size"))


def quotation_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, tie, to_turn, to_tie of each message that quotes an earlier one of its conversation.

    A quoted passage is a line under one or more marks ``>``, hashed to 64 bits without marks, case and repeated white space. It
    stands for the latest earlier message of its conversation whose own text has it. A message replies to the one of least
    level, then of most quoted characters, then the latest. The search is an as-of window over chunks of turns; in
    conversations of several chunks what earlier ones hold is carried along. So no pairs are made, and no hot passage is held
    whole.
    """
    named = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoting = named.where(F.col("text").rlike(r"(?m)" + QUOTED)).select("conv_id").distinct()
    lines = _lines(named.join(quoting, "conv_id", "left_semi"))
    own = lines.where("level = 0").groupBy("conv_id", "passage", "turn").agg(F.max("tie").alias("tie"))
    asked = lines.where("level > 0").groupBy(*KEY, "level", "passage").agg(F.max("size").alias("size"))
    events = (
        own.selectExpr("conv_id", "passage", "turn", "struct(turn, tie) AS mine", "CAST(null AS string) AS tie", "0 AS level", "0 AS size")
        .unionByName(asked.selectExpr("conv_id", "passage", "turn", "CAST(null AS struct<turn: bigint, tie: string>) AS mine", "tie", "level", "size"))
        .withColumn("chunk", F.expr(f"floor(turn / {PART_TURNS})"))
    )
    near = W.partitionBy("conv_id", "passage", "chunk").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    turns = named.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"))
    several = turns.where(f"floor(low / {PART_TURNS}) < floor(high / {PART_TURNS})").select("conv_id")
    chunks = events.join(several, "conv_id", "left_semi").groupBy("conv_id", "passage", "chunk").agg(F.max("mine").alias("mine"))
    before = chunks.select("conv_id", "passage", "chunk", F.max("mine").over(W.partitionBy("conv_id", "passage").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)).alias("far"))
    found = events.withColumn("close", F.max("mine").over(near)).where("level > 0").join(before, ["conv_id", "passage", "chunk"], "left")
    found = found.withColumn("to", F.coalesce("close", "far")).where("to IS NOT NULL")
    votes = found.groupBy(*KEY, "level", "to").agg(F.sum("size").alias("size"))
    best = votes.groupBy(*KEY).agg(F.max(F.struct(-F.col("level"), F.col("size"), F.col("to"))).alias("best"))
    return best.select(*KEY, F.col("best.to.turn").alias("to_turn"), F.col("best.to.tie").alias("to_tie"))


def thread_roots(links: DataFrame) -> DataFrame:
    """For each linked message the first message of its thread, by pointer jumping: a round halves the way that is left, and
    messages whose thread's first message is found take no part in later rounds."""
    now = cut_lineage(links.select(*KEY, "to_turn", "to_tie", F.lit(True).alias("open")))
    while not now.where("open").isEmpty():
        up = now.selectExpr("conv_id", "turn AS to_turn", "tie AS to_tie", "to_turn AS next_turn", "to_tie AS next_tie", "open AS more")
        jumped = now.where("open").drop("open").join(up, ["conv_id", "to_turn", "to_tie"], "left")
        jumped = jumped.select(*KEY, F.coalesce("next_turn", "to_turn").alias("to_turn"), F.coalesce("next_tie", "to_tie").alias("to_tie"), F.coalesce("more", F.lit(False)).alias("open"))
        now = cut_lineage(jumped.unionAll(now.where("NOT open")))
    return now.selectExpr(*KEY, "to_turn AS thread_turn", "to_tie AS thread_tie")


def linked_messages(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct message: conv_id, turn, tie, role, copies, reply_to, thread_turn, thread_tie, own text.

    Sorted by (conv_id, thread_turn, thread_tie, turn, tie), each reply follows the message it quotes. A message that quotes
    nothing of its conversation begins a thread. ``own`` is the text without quoted lines; null and empty texts are empty.
    """
    messages = distinct_messages(rows, conv_col, turn_col, role_col, text_col)
    links = cut_lineage(quotation_links(messages))
    roots = thread_roots(links)
    known = links.join(roots, KEY).select(*KEY, F.col("to_turn").alias("reply_to"), "thread_turn", "thread_tie")
    own = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~x.rlike(QUOTED)), "\n")
    full = messages.withColumn("own", own).join(known, KEY, "left")
    return full.select(*KEY, "role", "copies", "reply_to", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("thread_tie", "tie").alias("thread_tie"), "own")


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Reply-ordered chats: conv_id, thread_part, turn_part, tie_part, n_messages, n_replies, n_rows, chat.

    A conversation is one row up to 256 turns, else one for each block of 256 threads' first turns and 256 turns, in whose
    order replies still follow what they quote; a turn of more than 64 distinct messages is dealt over more rows. So no row
    gathers without bound. Repeated rows count in ``n_rows`` and stand once in ``chat``. A message without conversation or
    turn is a chat of its own (parts null; null, null and the message's hash as keys). Messages of one turn that differ are
    told apart and ordered by a hash. A very long text is one value; its lines are split and hashed like any others, and as a
    passage is one line, a quote that was wrapped anew is not found. An empty table gives no rows. Other columns are not
    read, so their names can't clash.
    """
    messages = linked_messages(rows, conv_col, turn_col, role_col, text_col)
    crowded = messages.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where(F.col("n") > PART_TIES)
    messages = messages.join(crowded, ["conv_id", "turn"], "left")
    lone = F.col("conv_id").isNull() | F.col("turn").isNull()
    dealt = F.pmod(F.conv(F.substring("tie", 1, 8), 16, 10).cast("long"), F.ceil(F.coalesce("n", F.lit(1)) / PART_TIES)).cast("string")
    parts = messages.select(
        "conv_id",
        F.when(~lone, F.floor(F.col("thread_turn") / PART_TURNS)).alias("thread_part"),
        F.when(~lone, F.floor(F.col("turn") / PART_TURNS)).alias("turn_part"),
        F.when(lone, F.concat_ws("/", F.col("tie"), F.col("turn").cast("string"))).otherwise(dealt).alias("tie_part"),
        F.struct("thread_turn", "thread_tie", "turn", "tie", F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.col("own"), F.lit("<|im_end|>\n")).alias("said")).alias("m"),
        F.col("reply_to").isNotNull().cast("long").alias("reply"),
        "copies",
    )
    grouped = parts.groupBy("conv_id", "thread_part", "turn_part", "tie_part").agg(F.array_sort(F.collect_list("m")).alias("ms"), F.sum("reply").alias("n_replies"), F.sum("copies").alias("n_rows"))
    return grouped.select("conv_id", "thread_part", "turn_part", "tie_part", F.size("ms").cast("long").alias("n_messages"), "n_replies", "n_rows", F.array_join(F.transform("ms", lambda x: x["said"]), "").alias("chat"))
