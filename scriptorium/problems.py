"""Queries of the general problems: orphan references (3) and incremental processing (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.common import read_table
from scriptorium.operators import incremental, references

ORPHANS_SQL = """
WITH parent AS (
  SELECT doc_id, doc_index, min(loaded_at) AS loaded_at FROM token GROUP BY doc_id, doc_index),
held AS (
  SELECT doc_id, min(added_at) AS added_at, bool_or(removed_at IS NOT NULL) AS removed FROM doc_catalog GROUP BY doc_id),
child AS (
  SELECT doc_id, doc_index, k, min(loaded_at) AS loaded_at FROM kbest
  WHERE doc_id IS NOT NULL AND doc_index IS NOT NULL GROUP BY doc_id, doc_index, k),
orphan AS (
  SELECT 'token' AS ref_table, p.doc_id, p.doc_index, 0 AS k, p.loaded_at,
         CASE WHEN h.doc_id IS NULL THEN 'missing' WHEN h.removed THEN 'deleted' WHEN p.loaded_at < h.added_at THEN 'late' END AS reason
  FROM parent p LEFT JOIN held h ON p.doc_id = h.doc_id WHERE p.doc_id IS NOT NULL
  UNION ALL
  SELECT 'kbest', c.doc_id, c.doc_index, c.k, c.loaded_at,
         CASE WHEN p.doc_id IS NULL THEN 'missing' WHEN c.loaded_at < p.loaded_at THEN 'late' END
  FROM child c LEFT JOIN parent p ON c.doc_id = p.doc_id AND c.doc_index = p.doc_index)
"""

CHANGES_SQL = """
WITH mark AS (
  SELECT doc_id, max(read_upto) AS seen FROM sync_log WHERE state = 'ok' GROUP BY doc_id),
ranked AS (
  SELECT t.doc_id, t.doc_index, t.gold, t.last_modified,
         coalesce(t.loaded_at <= m.seen, false) AS was_seen,
         row_number() OVER (PARTITION BY t.doc_id, t.doc_index
                            ORDER BY t.last_modified DESC NULLS LAST, t.loaded_at DESC NULLS LAST, t.gold DESC NULLS LAST) AS now_rank,
         row_number() OVER (PARTITION BY t.doc_id, t.doc_index, coalesce(t.loaded_at <= m.seen, false)
                            ORDER BY t.last_modified DESC NULLS LAST, t.loaded_at DESC NULLS LAST, t.gold DESC NULLS LAST) AS seen_rank
  FROM token t LEFT JOIN mark m ON t.doc_id = m.doc_id),
cur AS (SELECT * FROM ranked WHERE now_rank = 1),
old AS (SELECT * FROM ranked WHERE was_seen AND seen_rank = 1),
changed AS (
  SELECT c.doc_id, c.doc_index, c.gold, c.last_modified, CASE WHEN o.doc_id IS NULL THEN 'new' ELSE 'changed' END AS kind
  FROM cur c LEFT JOIN old o ON c.doc_id = o.doc_id AND c.doc_index = o.doc_index
  WHERE o.doc_id IS NULL OR c.gold IS DISTINCT FROM o.gold OR c.last_modified IS DISTINCT FROM o.last_modified)
"""


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphans(read_table(spark, sf_dir, "token"), read_table(spark, sf_dir, "kbest"), read_table(spark, sf_dir, "doc_catalog"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "doc_id", "doc_index", "k", "reason")


def p3_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphans_by_month(_orphans(spark, sf_dir))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changed_tokens(read_table(spark, sf_dir, "token"), read_table(spark, sf_dir, "sync_log"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("doc_id", "doc_index")


def p5_changes_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).groupBy("kind", F.col("gold").isNotNull().alias("has_gold")).agg(F.count("*").alias("n_tokens"))


QUERIES = {
    "p3_found": p3_found,
    "p3_orphans_by_month": p3_orphans_by_month,
    "p5_found": p5_found,
    "p5_changes_by_kind": p5_changes_by_kind,
}

SQL = {
    "p3_found": ORPHANS_SQL + "SELECT ref_table, doc_id, doc_index, k, reason FROM orphan WHERE reason IS NOT NULL",
    "p3_orphans_by_month": ORPHANS_SQL
    + "SELECT ref_table, strftime(loaded_at, '%Y-%m') AS month, reason, count(*) AS n_orphans FROM orphan WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_found": CHANGES_SQL + "SELECT doc_id, doc_index FROM changed",
    "p5_changes_by_kind": CHANGES_SQL + "SELECT kind, gold IS NOT NULL AS has_gold, count(*) AS n_tokens FROM changed GROUP BY ALL",
}
