"""The operators' queries over their whole tables, with SQL counterparts where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freqloom.llm import chats, decontaminate, exact_dedup, hidden_markov, lexical, license_scan, near_dedup, packing, periodic, quality, sharding, suffix_dedup, token_files
from freqloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Words with A-Z lowered, each with the white space before it, and the byte where it ends.
WORDS = r"""
word_list AS (
    SELECT {key} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS parts
    FROM {table}
),
words AS (SELECT id, parts, list_transform(parts, lambda x: regexp_extract(x, '[^\x20\x09-\x0D]+')) AS ws FROM word_list)"""

# Shingles of documents with their places and bytes, and windows around those that a reference text has.
WINDOWS = r"""
doc AS (SELECT id AS doc_id, ws, list_transform(parts, lambda x: strlen(x)) AS sizes FROM words),
place AS (
    SELECT doc_id, i, len(ws) - 4 AS n, array_to_string(ws[i:i + 4], ' ') AS x
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM doc WHERE len(ws) >= 5)
),
ref_words AS (SELECT key, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM ref),
ref_place AS (
    SELECT key, len(ws) - 4 AS m, array_to_string(ws[i:i + 4], ' ') AS x
    FROM (SELECT key, ws, unnest(range(1, len(ws) - 3)) AS i FROM ref_words WHERE len(ws) >= 5)
),
ref_count AS (SELECT key, m, x, count(*) AS c FROM ref_place GROUP BY ALL),
hit AS (SELECT doc_id, key, i, least(m, n) AS wide, m, n, p.x, c FROM place p JOIN ref_count r ON r.x = p.x),
start AS (SELECT DISTINCT doc_id, key, m, n, wide, unnest(range(greatest(1, i - wide + 1), least(i, n - wide + 1) + 1)) AS first FROM hit),
share AS (
    SELECT s.doc_id, s.key, s.m, s.wide, s.first, h.x, least(count(*), any_value(h.c)) AS shared
    FROM start s JOIN hit h ON h.doc_id = s.doc_id AND h.key = s.key AND h.i BETWEEN s.first AND s.first + s.wide - 1
    GROUP BY ALL
)"""

LAST = """
SELECT b.doc_id, key AS {key}, value AS {value},
       (list_sum(sizes[1:first]) - strlen(ws[first]))::BIGINT AS start_byte, list_sum(sizes[1:first + wide + 3])::BIGINT AS end_byte
FROM (SELECT * FROM found WHERE value >= 0.75 QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY value DESC, first) = 1) b
JOIN doc USING (doc_id)
"""

OP2 = rf"""
WITH RECURSIVE {WORDS.format(key="doc_id", table="documents")},
sets AS (
    SELECT id AS doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                            WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingles
    FROM words
),
entry AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS x FROM sets),
link AS (
    SELECT a.doc_id AS p, b.doc_id AS q FROM entry a JOIN entry b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
),
reach AS (SELECT doc_id, doc_id AS c FROM sets UNION SELECT l.q, r.c FROM reach r JOIN link l ON l.p = r.doc_id)
SELECT s.doc_id, len(any_value(s.shingles)) AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id
"""


@query("op2_near_dedup", OP2)
def op2_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


OP3 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""


@query("op3_exact_dedup", OP3)
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op7_token_files")
def op7_token_files(spark, sf_dir):
    return token_files.token_digests(table(spark, sf_dir, "documents"), added=True)


@query("op8_packing")
def op8_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), added=True)


@query("op4_quality")
def op4_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit_quality(docs, labels))


OP9 = f"""
WITH {WORDS.format(key="doc_id", table="documents")}, ref AS (SELECT item_id AS key, coalesce(text, '') AS text FROM benchmark), {WINDOWS},
found AS (
    SELECT doc_id, key, wide, first, sum(shared)::DOUBLE / (m + wide - sum(shared)) AS value FROM share GROUP BY doc_id, key, m, wide, first
)
{LAST.format(key="item_id", value="similarity")}
"""


@query("op9_decontamination", OP9)
def op9_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TEMPLATE_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in license_scan.TEMPLATES.items())

# Words of comment marks alone go; the bytes of a word that stays reach back over those before it.
MARKED_WORDS = r"""
all_words AS (SELECT id, unnest(range(len(ws))) AS i, unnest(ws) AS w, unnest(list_transform(parts, lambda x: strlen(x))) AS size FROM words),
placed AS (SELECT id, i, w, sum(size) OVER (PARTITION BY id ORDER BY i) AS stop FROM all_words),
kept_words AS (SELECT id, i, w, stop - coalesce(lag(stop) OVER (PARTITION BY id ORDER BY i), 0) AS size FROM placed WHERE NOT regexp_full_match(w, '[#/*;%!<>"''-]+')),
doc AS (SELECT id AS doc_id, list(w ORDER BY i) AS ws, list(size ORDER BY i) AS sizes FROM kept_words GROUP BY id),"""

OP6 = f"""
WITH {WORDS.format(key="doc_id", table="documents")}, ref AS (SELECT * FROM (VALUES {TEMPLATE_ROWS}) t(key, text)),
{MARKED_WORDS}{WINDOWS[WINDOWS.index("place AS") :].replace("'[^\\x20\\x09-\\x0D]+') AS ws FROM ref)", "'[^\\x20\\x09-\\x0D]+').list_filter(lambda x: NOT regexp_full_match(x, '[#/*;%!<>\"''-]+')) AS ws FROM ref)")},
found AS (
    SELECT doc_id, key, wide, first, count(*)::DOUBLE / (SELECT count(*) FROM ref_count r WHERE r.key = s.key) AS value
    FROM share s GROUP BY doc_id, key, wide, first
)
{LAST.format(key="template_id", value="containment")}
"""


@query("op6_license_scan", OP6)
def op6_license_scan(spark, sf_dir):
    return license_scan.license_notices(table(spark, sf_dir, "documents"), license_scan.template_table(spark))


OP5 = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
string AS (
    SELECT doc_id, s, md5(substr(hx, 2 * s + 1, 400)) AS k
    FROM (SELECT doc_id, hx, unnest(range(0, len(hx) // 2 - 199)) AS s FROM doc WHERE len(hx) >= 400)
),
again AS (SELECT doc_id, s FROM string QUALIFY count(*) OVER (PARTITION BY k) > 1),
fresh AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM again),
span AS (
    SELECT doc_id, min(s) AS start, max(s) + 200 AS stop
    FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM fresh) GROUP BY doc_id, g
),
piece AS (
    SELECT doc_id, start, stop, substr(hx, 2 * before + 1, 2 * (start - before)) AS part
    FROM (SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM span) JOIN doc USING (doc_id)
),
cut AS (SELECT doc_id, count(*) AS n, sum(stop - start)::BIGINT AS removed, max(stop) AS stop, string_agg(part, '' ORDER BY start) AS front FROM piece GROUP BY doc_id)
SELECT d.doc_id, len(hx) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(hx, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM doc d LEFT JOIN cut c USING (doc_id)
"""


@query("op5_suffix_dedup", OP5)
def op5_suffix_dedup(spark, sf_dir):
    cut = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SHARDS = [f"shard-{i:02d}" for i in range(16)]

OP1 = rf"""
WITH RECURSIVE shard AS (
    SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name,
           ('0x' || substr(md5('shard-' || lpad(i::VARCHAR, 2, '0') || '/offset'), 1, 15))::BIGINT % {sharding.SLOTS} AS start,
           ('0x' || substr(md5('shard-' || lpad(i::VARCHAR, 2, '0') || '/skip'), 1, 15))::BIGINT % {sharding.SLOTS - 1} + 1 AS skip
    FROM range(16) r(i)
),
turn AS (
    SELECT 0::BIGINT AS step, [-1 FOR x IN range({sharding.SLOTS})] AS slots
    UNION ALL
    SELECT step + 1, list_transform(slots, lambda x, k: CASE WHEN k = 1 + (start + skip * first) % {sharding.SLOTS} THEN i ELSE x END)
    FROM (
        SELECT t.step, t.slots, s.i, s.start, s.skip,
               list_filter(range({sharding.SLOTS}), lambda j: t.slots[1 + (s.start + s.skip * j) % {sharding.SLOTS}] < 0)[1] AS first
        FROM turn t JOIN shard s ON s.i = t.step % 16
        WHERE t.step < {sharding.SLOTS}
    )
),
filled AS (SELECT unnest(range({sharding.SLOTS})) AS slot, unnest(slots) AS i FROM turn WHERE step = {sharding.SLOTS})
SELECT d.doc_id, d.slot::INTEGER AS slot, s.name AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents) d
JOIN filled f ON f.slot = d.slot JOIN shard s ON s.i = f.i
"""


@query("op1_sharding", OP1)
def op1_sharding(spark, sf_dir):
    return sharding.placed(table(spark, sf_dir, "documents"), ["doc_id"], SHARDS).select("doc_id", "slot", "shard")


OP10 = r"""
WITH RECURSIVE message AS (
    SELECT conv_id, turn, role, text, count(*) AS copies, md5(coalesce(role, '') || chr(31) || coalesce(text, '')) AS tie
    FROM conversations GROUP BY conv_id, turn, role, text
),
line AS (
    SELECT conv_id, turn, tie, length(marks) - length(replace(marks, '>', '')) AS level,
           lower(trim(regexp_replace(substr(line, length(marks) + 1), '[ \t\r\x0B\f]+', ' ', 'g'))) AS body
    FROM (SELECT *, regexp_extract(line, '^([ \t]*>)+', 0) AS marks
          FROM (SELECT conv_id, turn, tie, unnest(string_split(text, chr(10))) AS line FROM message
                WHERE conv_id IN (SELECT conv_id FROM message WHERE regexp_matches(text, '(^|\n)[ \t]*>'))))
),
asked AS (SELECT DISTINCT conv_id, turn, tie, level, body FROM line WHERE level > 0 AND body <> ''),
found AS (
    SELECT a.conv_id, a.turn, a.tie, a.level, a.body, max({'turn': o.turn, 'tie': o.tie}) AS target
    FROM asked a JOIN line o ON o.conv_id = a.conv_id AND o.body = a.body AND o.level = 0 AND o.turn < a.turn
    GROUP BY ALL
),
link AS (
    SELECT conv_id, turn, tie, target.turn AS to_turn, target.tie AS to_tie
    FROM (SELECT conv_id, turn, tie, level, target, sum(length(body)) AS size FROM found GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn, tie ORDER BY level, size DESC, target DESC) = 1
),
walk AS (
    SELECT conv_id, turn, tie, to_turn, to_tie FROM link
    UNION ALL
    SELECT w.conv_id, w.turn, w.tie, l.to_turn, l.to_tie
    FROM walk w JOIN link l ON l.conv_id = w.conv_id AND l.turn = w.to_turn AND l.tie = w.to_tie
),
root AS (SELECT conv_id, turn, tie, min({'turn': to_turn, 'tie': to_tie}) AS first FROM walk GROUP BY ALL),
said AS (
    SELECT m.*, coalesce(r.first.turn, m.turn) AS thread_turn, coalesce(r.first.tie, m.tie) AS thread_tie,
           r.first IS NOT NULL AS reply, count(*) OVER (PARTITION BY m.conv_id, m.turn) AS n,
           m.conv_id IS NULL OR m.turn IS NULL AS lone,
           '<|im_start|>' || coalesce(role, 'unknown') || chr(10)
           || array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10))
           || '<|im_end|>' || chr(10) AS words
    FROM message m LEFT JOIN root r ON r.conv_id = m.conv_id AND r.turn = m.turn AND r.tie = m.tie
)
SELECT conv_id,
       CASE WHEN NOT lone THEN (thread_turn // 256)::BIGINT END AS thread_part,
       CASE WHEN NOT lone THEN (turn // 256)::BIGINT END AS turn_part,
       CASE WHEN lone THEN tie || coalesce('/' || turn::VARCHAR, '')
            ELSE (('0x' || substr(tie, 1, 8))::BIGINT % CASE WHEN n > 64 THEN ceil(n / 64)::BIGINT ELSE 1 END)::VARCHAR END AS tie_part,
       count(*) AS n_messages, sum(reply::INT)::BIGINT AS n_replies, sum(copies)::BIGINT AS n_rows,
       string_agg(words, '' ORDER BY thread_turn, thread_tie, turn, tie) AS chat
FROM said GROUP BY 1, 2, 3, 4
"""


@query("op10_chats", OP10)
def op10_chats(spark, sf_dir):
    return chats.conversations(table(spark, sf_dir, "conversations"))


def quoting(rows: DataFrame) -> DataFrame:
    """The conversations as a mail program keeps them: above its own text a turn has the lines of the turn before under ``>``,
    and every third turn those of the turn before that under ``>>``. The table itself has no quoted line."""
    said = rows.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    before = [said.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("said").alias(f"said{k}")) for k in (1, 2)]
    joined = rows.join(before[0], ["conv_id", "turn"], "left").join(before[1], ["conv_id", "turn"], "left")
    marked = lambda k: f"concat(array_join(transform(split(said{k}, '\\n'), x -> concat('{'>' * k} ', x)), '\\n'), '\\n')"
    return joined.selectExpr("conv_id", "turn", "role", f"if(text is null, null, concat(if(turn % 3 = 0, coalesce({marked(2)}, ''), ''), coalesce({marked(1)}, ''), text)) as text")


QUOTED = r"""
spoken AS (SELECT conv_id, turn, min(text) AS said FROM conversations GROUP BY conv_id, turn),
quoted AS (
    SELECT c.conv_id, c.turn, c.role,
           CASE WHEN c.text IS NOT NULL THEN
               CASE WHEN c.turn % 3 = 0 AND b.said IS NOT NULL THEN array_to_string(list_transform(string_split(b.said, chr(10)), lambda x: '>> ' || x), chr(10)) || chr(10) ELSE '' END
               || CASE WHEN a.said IS NOT NULL THEN array_to_string(list_transform(string_split(a.said, chr(10)), lambda x: '> ' || x), chr(10)) || chr(10) ELSE '' END
               || c.text END AS text
    FROM conversations c LEFT JOIN spoken a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN spoken b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2
),"""


@query("op10_chats_quoted", OP10.replace("WITH RECURSIVE message AS", f"WITH RECURSIVE {QUOTED.strip()} message AS").replace("FROM conversations GROUP BY conv_id, turn, role, text", "FROM quoted GROUP BY conv_id, turn, role, text"))
def op10_chats_quoted(spark, sf_dir):
    return chats.conversations(quoting(table(spark, sf_dir, "conversations")))


OP11 = r"""
WITH term AS (
    SELECT key, id, x, count(*) AS tf
    FROM (
        SELECT key, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x
        FROM (SELECT 0 AS key, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
    ) GROUP BY ALL
),
doc AS (SELECT id AS doc_id, sum(tf) AS n FROM term WHERE key = 0 GROUP BY id),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM doc),
weight AS (SELECT x, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM term, total WHERE key = 0 GROUP BY x, n_docs),
score AS (
    SELECT i.id AS item_id, d.id AS doc_id,
           sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (100 - 25 + (25 * n::BIGINT * n_docs) // n_terms))))::BIGINT AS score
    FROM term i JOIN term d ON d.x = i.x AND d.key = 0 JOIN weight w ON w.x = i.x JOIN doc ON doc.doc_id = d.id, total
    WHERE i.key = 1 GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY rank <= 20
"""


@query("op11_search", OP11)
def op11_search(spark, sf_dir):
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def planted(docs: DataFrame) -> DataFrame:
    """``documents`` with the periods that the query's contract plants into one of ten texts (whole texts of words joined by spaces)."""
    code = docs.withColumn("h_", F.crc32(F.col("doc_id").cast("string")))
    words = "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')"
    marks = "named_struct('ws', ws, 'a', (h_ div 10) % size(ws), 'p', 1 + (size(ws) - (h_ div 10) % size(ws)) div (3 + (h_ div 10) % 8))"
    # One-element arrays bind the words and the marks, so that they are made once a row.
    text = f"""transform(transform(array({words}), ws -> if(size(ws) > 0, {marks}, null)),
        m -> if(m is null, text, array_join(transform(sequence(0L, size(m.ws) - 1L), i -> m.ws[int(if(i < m.a, i, m.a + (i - m.a) % m.p))]), ' ')))[0]"""
    return code.selectExpr("doc_id", f"case when h_ % 10 = 0 and text is not null then {text} else text end as text")


# DuckDB has no crc32: it is taken bit by bit over the digits of an id.
OP12 = r"""
WITH RECURSIVE crc_step AS (
    SELECT id AS x, 0 AS k, id::BIGINT AS v FROM range(256) t(id)
    UNION ALL SELECT x, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM crc_step WHERE k < 8
),
crc AS (
    SELECT doc_id, 0 AS k, 4294967295::BIGINT AS v, doc_id::VARCHAR AS digits FROM documents
    UNION ALL
    SELECT doc_id, c.k + 1, xor(c.v // 256, s.v), digits
    FROM crc c JOIN crc_step s ON s.k = 8 AND s.x = xor(c.v % 256, ascii(substr(digits, c.k + 1, 1))::BIGINT) WHERE c.k < length(digits)
),
mark AS (SELECT doc_id, xor(v, 4294967295) AS h FROM crc WHERE k = length(digits)),
given AS (SELECT doc_id, h, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents JOIN mark USING (doc_id)),
doc AS (
    SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws
    FROM (SELECT *, 1 + (n - a) // (3 + g % 8) AS p
          FROM (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM (SELECT *, h // 10 AS g, len(ws) AS n FROM given)))
),
word AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM doc),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM word x JOIN word y ON y.doc_id = x.doc_id AND y.w = x.w AND y.i > x.i),
stretch AS (
    SELECT doc_id, q, min(i) AS start, max(i) + 1 + q AS stop
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same) GROUP BY doc_id, q, g
),
run AS (SELECT doc_id, start, stop, min(q) AS period FROM stretch WHERE stop - start >= greatest(6, 4 * q) GROUP BY doc_id, start, stop),
best AS (
    SELECT r.doc_id, start, stop - start AS length, period, ((1000 * (stop - start)) // period)::BIGINT AS exponent_milli FROM run r
    QUALIFY row_number() OVER (PARTITION BY r.doc_id ORDER BY (stop - start)::DOUBLE / period DESC, start, period) = 1
),
listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || (stop - start) || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM run GROUP BY doc_id
),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, stop)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, exponent_milli, sha256(coalesce(l.text, '')) AS runs_sha256,
       sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM doc d LEFT JOIN listed l USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


@query("op12_runs", OP12)
def op12_runs(spark, sf_dir):
    found = periodic.periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = "aggregate(slice(runs, 2, greatest(size(runs), 1)), runs[0], (b, r) -> if(r.length * b.period > b.length * r.period, r, b))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return found.selectExpr("doc_id", "bigint(size(runs)) as n_runs", f"if(size(runs) > 0, {best}, null) as best", f"sha2({lines}, 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256").selectExpr(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", "1000 * best.length div best.period as exponent_milli", "runs_sha256", "collapsed_sha256"
    )


@query("op13_language_model")
def op13_language_model(spark, sf_dir):
    return hidden_markov.language_scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
