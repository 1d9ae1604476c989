"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.common import read_table
from scriptorium.llm import frequency, leaks, normalize, packing, scans, spans

# 1 ------------------------------------------------------------------------------------------


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.variant_tokens(read_table(spark, sf_dir, "token"))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.form_table(read_table(spark, sf_dir, "token"))


# 2 ------------------------------------------------------------------------------------------


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.marked_terms(read_table(spark, sf_dir, "token"), read_table(spark, sf_dir, "kbest"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).where("mark IS NOT NULL").select("field_name", "term", "mark")


def p2_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir)


TERMS_SQL = """
WITH v AS (
  SELECT 'original' AS field_name, original AS term, doc_id FROM token
  UNION ALL SELECT 'gold', gold, doc_id FROM token
  UNION ALL SELECT 'candidate', candidate, doc_id FROM kbest),
c AS (SELECT field_name, term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM v WHERE term IS NOT NULL AND term <> '' GROUP BY ALL),
t AS (SELECT (SELECT count(DISTINCT doc_id) FROM token) AS nt, (SELECT count(DISTINCT doc_id) FROM kbest) AS nk),
m AS (SELECT field_name, term, n, n_docs,
  CASE WHEN n_docs < 3 THEN 'rare' WHEN n_docs * 100 > 30 * (CASE WHEN field_name = 'candidate' THEN nk ELSE nt END) THEN 'common' END AS mark
  FROM c, t)
"""

# 4 ------------------------------------------------------------------------------------------


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noisy_tokens(read_table(spark, sf_dir, "token"), read_table(spark, sf_dir, "dict_words"))


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.paragraphs(read_table(spark, sf_dir, "token"), read_table(spark, sf_dir, "dict_words"))


# 6 ------------------------------------------------------------------------------------------


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pack_plan"))


def p6_unused_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, sf_dir), read_table(spark, sf_dir, "pack_plan"))


# 7 ------------------------------------------------------------------------------------------


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_report(_leaks(spark, sf_dir), read_table(spark, sf_dir, "eval_items"))


# 8 ------------------------------------------------------------------------------------------


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.sharing_pairs(read_table(spark, sf_dir, "documents"))


def p8_shared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(read_table(spark, sf_dir, "documents"))


SPANS_SQL = """
WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 300),
-- pieces of 1,000 places with their margins, so that no position is looked up in a long text
piece AS (SELECT doc_id, p, greatest(p - 150, 1) AS base, substr(text, greatest(p - 150, 1), 1449 + least(p - 1, 150)) AS s FROM (SELECT *, unnest(generate_series(1, n, 1000)) AS p FROM t)),
place AS (SELECT doc_id, p, base, s, unnest(generate_series(p, least(p + 999, base + length(s) - 150))) AS i FROM piece),
hashed AS (SELECT doc_id, p, i, hash(substr(s, i - base + 1, 150)) AS h FROM place),
-- every span of 300 holds a block of 150 that starts at a multiple of 150
block AS (SELECT * FROM hashed WHERE i % 150 = 1),
cand AS (SELECT DISTINCT b.doc_id AS a, b.i AS ai, b.p AS ap, h.doc_id AS c, h.i AS ci, h.p AS cp FROM block b JOIN hashed h ON b.h = h.h AND b.doc_id <> h.doc_id),
ctx AS (SELECT a, c, substr(x.s, greatest(ai - x.base - 149, 1), least(150, ai - x.base)) AS al, substr(x.s, ai - x.base + 1, 300) AS ar,
               substr(y.s, greatest(ci - y.base - 149, 1), least(150, ci - y.base)) AS cl, substr(y.s, ci - y.base + 1, 300) AS cr
        FROM cand JOIN piece x ON x.doc_id = a AND x.p = ap JOIN piece y ON y.doc_id = c AND y.p = cp),
ext AS (SELECT a, c, list_max(list_filter(generate_series(0, least(length(al), length(cl))), lambda k: right(al, k) = right(cl, k))) AS lk,
               list_max(list_filter(generate_series(0, least(length(ar), length(cr))), lambda k: left(ar, k) = left(cr, k))) AS rk FROM (SELECT DISTINCT * FROM ctx))
SELECT DISTINCT least(a, c) AS doc_id_a, greatest(a, c) AS doc_id_b FROM ext WHERE lk + rk >= 300
"""


SHARE_SQL = """
WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
copy AS (SELECT text, min(doc_id) AS rep FROM t WHERE n >= 300 GROUP BY text HAVING count(*) > 1),
held AS (SELECT t.doc_id, n, t.text, rep FROM t LEFT JOIN copy ON copy.text = t.text AND n >= 300),
piece AS (SELECT doc_id, p, substr(text, p, 1299) AS s FROM (SELECT *, unnest(generate_series(1, n, 1000)) AS p FROM held WHERE n >= 300)),
place AS (SELECT doc_id, p, s, unnest(generate_series(p, least(p + 999, p + length(s) - 300))) AS i FROM piece),
hashed AS (SELECT doc_id, i, md5_number_lower(substr(s, i - p + 1, 300)) AS h FROM place),
twice AS (SELECT h FROM hashed GROUP BY h HAVING min(doc_id) < max(doc_id)),
common AS (SELECT doc_id, i, h FROM hashed WHERE h IN (SELECT h FROM twice)),
cover AS (SELECT doc_id, sum(least(300, gap)) AS part FROM (SELECT doc_id, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 300) AS gap FROM common) GROUP BY doc_id),
link AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM (SELECT DISTINCT doc_id, h FROM common) a JOIN (SELECT DISTINCT doc_id, h FROM common) b ON a.h = b.h AND a.doc_id <> b.doc_id
  WHERE a.doc_id IN (SELECT doc_id FROM held WHERE coalesce(rep, doc_id) = doc_id) AND b.doc_id IN (SELECT doc_id FROM held WHERE coalesce(rep, doc_id) = doc_id)),
partner AS (SELECT a AS doc_id, count(*) AS k FROM link GROUP BY a)
SELECT h.doc_id, n::INTEGER AS n_chars, coalesce(c.part, 0)::INTEGER AS shared_chars, coalesce(k, 0) AS n_partners, rep AS copy_of
FROM held h LEFT JOIN cover c ON c.doc_id = h.doc_id LEFT JOIN partner p ON p.doc_id = coalesce(h.rep, h.doc_id)
"""


QUERIES = {
    "p1_found": p1_found,
    "p1_forms": p1_forms,
    "p2_found": p2_found,
    "p2_term_counts": p2_term_counts,
    "p4_found": p4_found,
    "p4_paragraphs": p4_paragraphs,
    "p6_packed": p6_packed,
    "p6_unused_room": p6_unused_room,
    "p7_found": p7_found,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_shared_share": p8_shared_share,
}

SQL = {
    "p2_found": TERMS_SQL + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p2_term_counts": TERMS_SQL + "SELECT * FROM m",
    "p8_found": SPANS_SQL,
    "p8_shared_share": SHARE_SQL,
}
