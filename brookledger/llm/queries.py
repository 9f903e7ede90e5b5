"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, exact_dedup, fingerprints, langid, mixing, near_dedup, packing, quality, resample, secrets, toxicity, warc
from .common import held_out, table


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("_secrets", lambda x: x["layer"] == "")
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, secrets.KINDS), F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("_secrets")).alias("spans"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("_quality")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", held_out("doc_id", quality.FOLDS, quality.HELD_OUT_FOLD).alias("held_out"), s.alias("score"),
        (s >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    s = F.col("_toxic.score")
    return toxicity.score(docs, model).select(
        "doc_id", held_out("doc_id", toxicity.FOLDS, toxicity.HELD_OUT_FOLD).alias("held_out"), s.alias("score"),
        (s >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.col("_toxic.worst_start").alias("worst_start"), F.col("_toxic.worst_end").alias("worst_end"), F.col("_toxic.n_offending").alias("n_offending"),
    )


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(docs, path, public_tokenizers.PATTERN).select("doc_id", "_bpe.*")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_next(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read(made, warc.scan(made), payloads=False).drop("url", "payload")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.decide(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damaged(rows), rows.select("conv_id"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_langid": op1_langid,
    "op2_packing": op2_packing,
    "op3_near_dedup": op3_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_secrets": op5_secrets,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_bpe": op8_bpe,
    "op9_fingerprints": op9_fingerprints,
    "op10_warc": op10_warc,
    "op11_resample": op11_resample,
    "op12_conversations": op12_conversations,
    "op13_mixing": op13_mixing,
}

#: The CRC-32 of ``{}``, a list of bytes; the table ``crc`` has its steps by byte.
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)),
                         lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295)"""
CRC_STEPS = """crc AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
            FROM range(256) t(i))"""

#: Fewest edits: ``b`` has the costs of what is left from row k on in the four states when no insertion comes first.
AFTER = "[3, 3, 4, 3]"
KEPT = "CASE WHEN initial = 's' AND s = 1 THEN 2 WHEN initial = 'u' AND s <> 3 THEN 3 WHEN initial = 'a' AND s = 3 THEN 4 END"
ORACLE_SQL = {
    "op12_conversations": f"""
        WITH RECURSIVE {CRC_STEPS},
        r AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault
            FROM conversations, crc),
        d AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
            FROM r WHERE fault <> 0),
        o AS (
            SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS i,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again
            FROM d),
        f AS (
            SELECT *, role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS two,
                   CASE WHEN bare = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM o),
        ends AS (SELECT conv_id, count(*) AS n FROM f GROUP BY conv_id),
        back AS (
            SELECT conv_id, n + 1 AS k, [0, 1000000, 1000000, 0] AS b FROM ends
            UNION ALL
            SELECT conv_id, k - 1, list_transform([1, 2, 3, 4], lambda s: least(
                       2 + w[s], CASE WHEN fault NOT IN ('blank', 'duplicate') THEN 1 + cut + w[{AFTER}[s]] END, CASE WHEN fault NOT IN ('blank', 'duplicate') THEN cut + w[{KEPT}] END))
            FROM (
                SELECT back.conv_id, k, fault, initial, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cut, list_transform([1, 2, 3, 4], lambda s: least(b[s], 5 + b[{AFTER}[s]])) AS w
                FROM back JOIN f ON back.conv_id IS NOT DISTINCT FROM f.conv_id AND i = k - 1)),
        walk AS (
            SELECT conv_id, 1::BIGINT AS k, 1 AS s, true AS may, '' AS audit, []::VARCHAR[] AS lines FROM ends
            UNION ALL
            SELECT conv_id, CASE WHEN e = 'I' THEN k ELSE k + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN {KEPT} ELSE {AFTER}[s] END, e <> 'I', audit || e,
                   CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                       ELSE list_append(lines, CASE WHEN s = 3 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN text ELSE '' END) END
            FROM (
                SELECT *, CASE WHEN 2 + w[s] = v THEN 'D' WHEN may AND 5 + b[{AFTER}[s]] = v THEN 'I' WHEN fault NOT IN ('blank', 'duplicate') AND cut + w[{KEPT}] = v THEN 'K' WHEN i IS NOT NULL THEN 'R' END AS e
                FROM (
                    SELECT walk.*, now.b, f.i, f.role, f.text, f.initial, f.fault, CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END AS cut,
                           CASE WHEN may THEN least(now.b[s], 5 + now.b[{AFTER}[s]]) ELSE now.b[s] END AS v, list_transform([1, 2, 3, 4], lambda x: least(later.b[x], 5 + later.b[{AFTER}[x]])) AS w
                    FROM walk JOIN back AS now ON walk.conv_id IS NOT DISTINCT FROM now.conv_id AND walk.k = now.k
                    LEFT JOIN back AS later ON walk.conv_id IS NOT DISTINCT FROM later.conv_id AND walk.k + 1 = later.k
                    LEFT JOIN f ON walk.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = walk.k))
            WHERE e IS NOT NULL),
        done AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM walk GROUP BY conv_id),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
            FROM f GROUP BY conv_id),
        costs AS (SELECT conv_id, least(b[1], 5 + b[3]) AS cost FROM back WHERE k = 1)
        SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN costs x ON a.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN done z ON a.conv_id IS NOT DISTINCT FROM z.conv_id""",
    "op11_resample": f"""
        WITH {CRC_STEPS},
        w AS (
            SELECT doc_id, row, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
            FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents UNION ALL SELECT NULL, text, NULL FROM benchmark)),
        b AS (SELECT word, {CRC.format("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM w), crc),
        n AS (SELECT bucket, count(row) AS s, count(*) - count(row) AS t FROM w JOIN b USING (word) GROUP BY bucket),
        g AS (
            SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000))))::BIGINT AS gain
            FROM n, (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM n)),
        d AS (SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM w JOIN b USING (word) JOIN g USING (bucket) WHERE row IS NOT NULL GROUP BY row),
        scored AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM (SELECT doc_id, row_number() OVER () AS row FROM documents) LEFT JOIN d USING (row)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
        r AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(sha, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM r""",
    "op7_exact_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
}
