"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bradley_terry, chat, covertree, filter_audit, html_extract, minhash, mixing, quality_rules, repair, secrets, sp_tokens, toxicity, warc
from .common import table, temporary


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"))
    own = own.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.lit("<|im_end|><|im_start|>assistant ok").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_chats(rows))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bradley_terry.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{temporary(spark, 'warc')}/archives"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(warc.archive_lines(spark, path))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(table(spark, sf_dir, "documents")).drop("passes")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_tokens.encode(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.repair(repair.damage(table(spark, sf_dir, "conversations"))))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_secret_scan": op6_secret_scan,
    "op7_warc": op7_warc,
    "op8_source_mixing": op8_source_mixing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_structure_repair": op11_structure_repair,
    "op12_toxicity": op12_toxicity,
    "op13_filter_audit": op13_filter_audit,
}

#: The same rows from DuckDB.
SQL: dict[str, str] = {
    "op3_chat_formatting": r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op7_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, max(page_id) AS kept FROM p GROUP BY h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(p.h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM p JOIN k ON p.h = k.h""",
    "op8_source_mixing": r"""
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight
    FROM d GROUP BY source
), r AS (
    SELECT *, (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) AS total,
           row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place,
           coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
           sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
    FROM s WHERE source_size > 0
), u AS (
    SELECT arg_min(CAST(total - full_before AS DOUBLE) / weight_left, place) AS unit FROM r
    WHERE CAST(total - full_before AS DOUBLE) / weight_left * weight <= 3 * source_size
), t AS (
    SELECT s.source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(CAST(3 * source_size AS DOUBLE), coalesce(unit, 1e300) * weight) END AS target FROM s, u
), w AS (
    SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) // source_size END AS whole,
           CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) % source_size END AS rest FROM t
), o AS (
    SELECT d.doc_id, size, source_size, target, whole, rest,
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('0:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar
    FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN 2 * (rest - sofar) > size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o""",
    "op10_exact_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op11_structure_repair": r"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS codes FROM range(256) b(i)
), raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS k
    FROM conversations
), faulty AS (
    SELECT conv_id, turn, role, text,
           xor(list_reduce(k, lambda c, b: xor(c >> 8, codes[CAST(xor(c, b) & 255 AS INT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS fault
    FROM raw, crc_table
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM faulty, (VALUES (0), (1)) copies(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)
), ordered AS (
    SELECT *, left(role, 1) AS initial, row_number() OVER w AS n, lag(left(role, 1)) OVER w AS before
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM ordered
), turns AS (
    SELECT *, coalesce(before || initial NOT IN ('su', 'ua', 'au'), false) AS illegal,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM numbered
), counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
           count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
           count(*) FILTER (WHERE illegal) AS illegal
    FROM turns GROUP BY conv_id
), walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS n, {'cost': CAST(0 AS BIGINT), 'code': ''} AS z, {'cost': CAST(1000000000 AS BIGINT), 'code': ''} AS s,
           {'cost': CAST(3 AS BIGINT), 'code': 'I'} AS u, {'cost': CAST(6 AS BIGINT), 'code': 'IJ'} AS a
    FROM counted
    UNION ALL
    SELECT conv_id, n, z, s, least(u, {'cost': z.cost + 3, 'code': z.code || 'I'}, {'cost': s.cost + 3, 'code': s.code || 'I'}, {'cost': a.cost + 3, 'code': a.code || 'I'}),
           least(a, {'cost': u.cost + 3, 'code': u.code || 'J'})
    FROM (
        SELECT t.conv_id, t.n, {'cost': z.cost + 4, 'code': z.code || 'D'} AS z,
               least({'cost': s.cost + 4, 'code': s.code || 'D'}, {'cost': z.cost + more + CASE WHEN initial = 's' THEN 0 ELSE 1000000000 END, 'code': z.code || 'K'}) AS s,
               least({'cost': u.cost + 4, 'code': u.code || 'D'}, {'cost': z.cost + more + other, 'code': z.code || 'K'}, {'cost': s.cost + more + other, 'code': s.code || 'K'},
                     {'cost': a.cost + more + other, 'code': a.code || 'K'}, {'cost': z.cost + more + 3, 'code': z.code || 'R'},
                     {'cost': s.cost + more + 3, 'code': s.code || 'R'}, {'cost': a.cost + more + 3, 'code': a.code || 'R'}) AS u,
               least({'cost': a.cost + 4, 'code': a.code || 'D'}, {'cost': u.cost + more + CASE WHEN initial = 'a' THEN 0 ELSE 1000000000 END, 'code': u.code || 'K'},
                     {'cost': u.cost + more + 3, 'code': u.code || 'S'}) AS a
        FROM walk JOIN (
            SELECT conv_id, n, initial, CASE WHEN initial = 'u' THEN 0 ELSE 1000000000 END AS other,
                   CASE fault WHEN 'truncated' THEN 3 WHEN '' THEN 0 ELSE 1000000000 END AS more
            FROM turns
        ) t ON t.conv_id IS NOT DISTINCT FROM walk.conv_id AND t.n = walk.n + 1
    )
), best AS (
    SELECT c.*, least(z, a) AS best FROM counted c JOIN walk w ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.n
), letters AS (
    SELECT conv_id, unnest([regexp_extract(best.code, '^[IJ]')] || regexp_extract_all(best.code, '[DKRS][IJ]?')) AS letter,
           generate_subscripts([''] || regexp_extract_all(best.code, '[DKRS][IJ]?'), 1) - 1 AS n
    FROM best
), said AS (
    SELECT l.conv_id, string_agg(nullif(concat_ws(chr(10),
               CASE left(letter, 1) WHEN 'K' THEN role || ':' || text WHEN 'R' THEN 'user:' || text WHEN 'S' THEN 'assistant:' || text END,
               CASE right(letter, 1) WHEN 'I' THEN 'user:' WHEN 'J' THEN 'assistant:' END), ''), chr(10) ORDER BY l.n) AS lines
    FROM letters l LEFT JOIN turns t ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND l.n = t.n GROUP BY l.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(translate(best.code, 'JS', 'IR'), '') AS audit,
       sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN said ON o.conv_id IS NOT DISTINCT FROM said.conv_id""",
    "op13_filter_audit": r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), m AS (
    SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
            regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS fails
    FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), orders AS (
    SELECT '' AS o UNION ALL SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) f(x) WHERE NOT contains(o, x)
), p AS (
    SELECT part, o AS filter_order, CAST(step AS INT) AS step, good, toxic, fails[ascii(o[step]) - 64] AS here,
           len(list_filter(range(1, step), lambda k: fails[ascii(o[k]) - 64])) AS earlier, len(list_filter(fails, lambda f: f)) AS failing
    FROM m, orders, range(1, 6) s(step) WHERE length(o) = 5
), g AS (
    SELECT part, filter_order, step, count(*) FILTER (WHERE NOT here AND earlier = 0) AS kept, count(*) FILTER (WHERE here AND earlier = 0) AS removed,
           count(*) FILTER (WHERE here AND earlier > 0) AS redundant, count(*) FILTER (WHERE here AND failing = 1) AS unique_fails,
           count(*) FILTER (WHERE here AND earlier = 0 AND good = 1) AS good_lost, count(*) FILTER (WHERE here AND earlier = 0 AND toxic = 1) AS toxic_lost
    FROM p GROUP BY part, filter_order, step
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM g""",
}
