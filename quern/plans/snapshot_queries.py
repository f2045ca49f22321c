from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.snapshots import snapshot_changes
from quern.plans.tables import table

QUERIES, SQL = {}, {}


def p3_found(spark, sf_dir):
    return snapshot_changes(table(spark, sf_dir, "doc_snapshots"), "snapshot", "doc_id", "content_hash", "delivered_at",
                            buckets=max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def p3_changes(spark, sf_dir):
    """The changes with what the record was before: hash, version and department of the former snapshot's row."""
    out = snapshot_changes(table(spark, sf_dir, "doc_snapshots"), "snapshot", "doc_id", "content_hash", "delivered_at",
                           buckets=max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), values=["version", "department"], with_old=True)
    old = F.from_json("old_row", "content_hash string, version int, department string")
    return (out.withColumn("o", old).select("snapshot", "doc_id", "change_type", F.col("o.content_hash").alias("old_hash"), F.col("o.version").alias("old_version"), F.col("o.department").alias("old_department")))


QUERIES["p3_found"] = p3_found
QUERIES["p3_changes"] = p3_changes
SQL["p3_found"] = r"""
WITH clean AS (
  SELECT snapshot, doc_id, delivered_at,
         regexp_replace(lower(regexp_replace(content_hash, '^\s+|\s+$', '', 'g')), '^sha-?1[:=]\s*|^0x', '') AS h
  FROM doc_snapshots WHERE doc_id IS NOT NULL AND snapshot IS NOT NULL),
one AS (
  SELECT snapshot, doc_id, h FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot, doc_id ORDER BY delivered_at DESC NULLS LAST, h DESC NULLS LAST) AS rn FROM clean)
  WHERE rn = 1),
bounds AS (SELECT min(snapshot) AS lo, max(snapshot) AS hi FROM one),
j AS (
  SELECT coalesce(n.snapshot, o.snapshot + 1) AS snapshot, coalesce(n.doc_id, o.doc_id) AS doc_id,
         CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed'
              WHEN o.h IS DISTINCT FROM n.h THEN 'changed' END AS change_type
  FROM one o FULL JOIN one n ON n.doc_id = o.doc_id AND n.snapshot = o.snapshot + 1)
SELECT j.snapshot::INTEGER AS snapshot, doc_id, change_type FROM j, bounds
WHERE change_type IS NOT NULL AND j.snapshot > lo AND j.snapshot <= hi
"""
SQL["p3_changes"] = r"""
WITH clean AS (
  SELECT snapshot, doc_id, delivered_at, version, department,
         regexp_replace(lower(regexp_replace(content_hash, '^\s+|\s+$', '', 'g')), '^sha-?1[:=]\s*|^0x', '') AS h
  FROM doc_snapshots WHERE doc_id IS NOT NULL AND snapshot IS NOT NULL),
one AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot, doc_id ORDER BY delivered_at DESC NULLS LAST, h DESC NULLS LAST, version DESC NULLS LAST, department DESC NULLS LAST) AS rn FROM clean)
  WHERE rn = 1),
bounds AS (SELECT min(snapshot) AS lo, max(snapshot) AS hi FROM one),
j AS (
  SELECT coalesce(n.snapshot, o.snapshot + 1) AS snapshot, coalesce(n.doc_id, o.doc_id) AS doc_id, o.h AS old_hash, o.version AS old_version, o.department AS old_department,
         CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed'
              WHEN o.h IS DISTINCT FROM n.h THEN 'changed' END AS change_type
  FROM one o FULL JOIN one n ON n.doc_id = o.doc_id AND n.snapshot = o.snapshot + 1)
SELECT j.snapshot::INTEGER AS snapshot, doc_id, change_type, old_hash, old_version, old_department FROM j, bounds
WHERE change_type IS NOT NULL AND j.snapshot > lo AND j.snapshot <= hi
"""
