"""The corpus queries: each applies one operator to its whole table; SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import CHAT_SQL, format_chats, read_back, with_hostile
from .common import table
from .decontaminate import DECONTAMINATE_SQL, decontaminate
from .exact_dedup import exact_dedup
from .license_scan import license_scan
from .line_dedup import LINE_DEDUP_SQL, line_dedup
from .mixing import MIX_SQL, mix
from .near_dedup import near_dedup
from .quality import fit, score
from .sharding import shard_rows
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .vector_codes import encode
from .whitening import whiten


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "host", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source", "copies")


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_bytes")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("evidence")


def op11_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))  # null beyond a long


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings")).drop("label")


def op13_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(format_chats(with_hostile(spark, sf_dir)))


SUBSTRING_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS xx, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT xx, k, array_to_string(w[k + 1 : k + 35], ' ') AS window_text FROM (SELECT xx, w, unnest(range(greatest(len(w) - 34, 0))) AS k FROM d)),
repeated AS (SELECT window_text FROM windows GROUP BY window_text HAVING count(*) > 1),
gone AS (SELECT xx, list(DISTINCT p) AS g FROM (SELECT xx, unnest(range(k, k + 35)) AS p FROM windows SEMI JOIN repeated USING (window_text)) GROUP BY xx),
words AS (SELECT xx, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
lost AS (SELECT xx, unnest(g) AS p FROM gone),
kept AS (SELECT xx, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN lost USING (xx, p) GROUP BY xx)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (xx) LEFT JOIN kept USING (xx)
"""

SUFFIX_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS xx, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT xx, doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM (SELECT xx, doc_id, h, unnest(range(greatest(len(h) // 2 - 49, 0))) AS k FROM d)),
firsts AS (SELECT s, min(doc_id) AS best FROM strings GROUP BY s HAVING count(*) > 1),
hits AS (SELECT xx, k FROM strings JOIN firsts USING (s) WHERE doc_id IS NULL AND best IS NOT NULL OR doc_id > best),
runs AS (
  SELECT xx, min(k) AS a, max(k) + 50 AS z
  FROM (SELECT xx, k, sum(new) OVER (PARTITION BY xx ORDER BY k) AS run
        FROM (SELECT xx, k, CASE WHEN k <= lag(k) OVER (PARTITION BY xx ORDER BY k) + 50 THEN 0 ELSE 1 END AS new FROM hits))
  GROUP BY xx, run),
gaps AS (
  SELECT xx, z AS a, lead(a) OVER (PARTITION BY xx ORDER BY a) AS z FROM runs
  UNION ALL SELECT xx, 0, min(a) FROM runs GROUP BY xx),
summed AS (SELECT xx, sum(z - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM runs GROUP BY xx),
kept AS (SELECT xx, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, len(h) // 2) - a)), '' ORDER BY a) AS h FROM gaps JOIN d USING (xx) GROUP BY xx)
SELECT doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept.h, CASE WHEN n_spans IS NULL THEN d.h ELSE '' END))) AS kept_sha256
FROM d LEFT JOIN summed USING (xx) LEFT JOIN kept USING (xx)
"""

EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS xx, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY doc_id NULLS LAST, xx)
"""


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_license_scan": op2_license_scan,
        "op3_line_dedup": op3_line_dedup,
        "op4_decontaminate": op4_decontaminate,
        "op5_mix_sources": op5_mix_sources,
        "op6_shard": op6_shard,
        "op7_near_dedup": op7_near_dedup,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_quality": op10_quality,
        "op11_whiten_embeddings": op11_whiten_embeddings,
        "op12_vector_codes": op12_vector_codes,
        "op13_format_chats": op13_format_chats,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": SUBSTRING_SQL,
        "op3_line_dedup": LINE_DEDUP_SQL,
        "op4_decontaminate": DECONTAMINATE_SQL,
        "op5_mix_sources": MIX_SQL,
        "op8_suffix_dedup": SUFFIX_SQL,
        "op9_exact_dedup": EXACT_SQL,
        "op13_format_chats": CHAT_SQL,
    }
