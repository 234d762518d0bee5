"""Queries over the change feed, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.operators import changefeed
from spindrift.runtime import table


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return changefeed.repeated_deliveries(table(spark, directory, "delta_ops"), table(spark, directory, "delta_logs"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    keys = changefeed.current_keys(table(spark, directory, "delta_ops"), table(spark, directory, "delta_logs"))
    return keys.select("collection", "vector_id", "sequence")


QUERIES = {"p4_found": p4_found, "p6_found": p6_found}

DELIVERIES = r"""
src AS (SELECT batch_id, min(lower(regexp_replace(source_id, '[^\p{L}\p{N}]+', '', 'g'))) AS source
        FROM delta_logs GROUP BY batch_id),
del AS (
  SELECT delivery_id, coalesce(source, '?') AS source, coalesce(sequence, -1) AS sequence,
         lower(regexp_replace(op_type, '[^A-Za-z]+', '', 'g')) AS op, collection, vector_id,
         CASE WHEN abs(timestamp_ms) < 100000000000 THEN timestamp_ms * 1000
              WHEN abs(timestamp_ms) < 100000000000000 THEN timestamp_ms
              WHEN abs(timestamp_ms) < 100000000000000000 THEN timestamp_ms // 1000
              ELSE timestamp_ms // 1000000 END AS at_ms,
         nullif(trim(lower(regexp_replace(trim(checksum), '^[A-Za-z0-9_-]+[:=]', ''))), '') AS checksum
  FROM delta_ops LEFT JOIN src USING (batch_id))"""

ORACLE = {
    "p4_found": f"""
WITH {DELIVERIES},
one AS (SELECT *, CASE WHEN checksum IS NULL THEN delivery_id
                       ELSE min(delivery_id) OVER (PARTITION BY source, sequence, checksum) END AS m FROM del),
two AS (SELECT *, max(checksum IS NULL) OVER w AS open, min(m) OVER w AS m2 FROM one
        WINDOW w AS (PARTITION BY source, sequence, op, collection, vector_id, at_ms)),
three AS (SELECT *, CASE WHEN open THEN m2 ELSE m END AS m3 FROM two),
four AS (SELECT *, CASE WHEN checksum IS NULL THEN m3
                        ELSE min(m3) OVER (PARTITION BY source, sequence, checksum) END AS m4 FROM three),
five AS (SELECT *, CASE WHEN open THEN min(m4) OVER (PARTITION BY source, sequence, op, collection, vector_id, at_ms)
                        ELSE m4 END AS m5 FROM four)
SELECT delivery_id FROM five WHERE delivery_id <> m5""",
    "p6_found": f"""
WITH {DELIVERIES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY collection, vector_id ORDER BY at_ms DESC, sequence DESC, delivery_id) AS rn
           FROM del WHERE op IN ('upsert', 'delete') AND vector_id IS NOT NULL AND collection IS NOT NULL AND at_ms IS NOT NULL),
drops AS (SELECT collection, max(at_ms) AS dropped FROM del WHERE op = 'dropcollection' GROUP BY collection)
SELECT r.collection, vector_id, sequence FROM ranked r LEFT JOIN drops d ON r.collection = d.collection
WHERE rn = 1 AND op = 'upsert' AND (dropped IS NULL OR at_ms > dropped)""",
}
