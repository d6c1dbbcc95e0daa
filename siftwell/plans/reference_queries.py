"""Queries on references to records that do not exist (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import references as R
from siftwell.runtime import read


def reference_rows(spark: SparkSession, d: str) -> DataFrame:
    """References of relationships (source_id, target_id) and vectors (entity_id), one row each."""
    rel = (
        read(spark, d, "relationships")
        .select(
            F.col("id").alias("row_key"),
            F.col("created_at").alias("at"),
            F.expr("stack(2, 'source_id', source_id, 'target_id', target_id) as (ref_field, key)"),
        )
        .withColumn("ref_table", F.lit("relationships"))
    )
    vec = read(spark, d, "vectors").select(
        F.concat_ws("|", "entity_id", "model_id", F.col("chunk_index").cast("string")).alias("row_key"),
        F.col("created_at").alias("at"),
        F.lit("entity_id").alias("ref_field"),
        F.col("entity_id").alias("key"),
        F.lit("vectors").alias("ref_table"),
    )
    return rel.unionByName(vec)


def found(spark: SparkSession, d: str) -> DataFrame:
    return R.report(
        reference_rows(spark, d),
        read(spark, d, "entities").select(F.col("id").alias("key"), F.col("created_at").alias("at")),
        read(spark, d, "entity_removals").select(F.col("entity_id").alias("key")),
    )


def orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.counts(found(spark, d))


def orphan_keys(spark: SparkSession, d: str) -> DataFrame:
    """Orphan keys with their signed counts; repeated rows of one key count once."""
    refs = reference_rows(spark, d).where(F.col("key").isNotNull()).select("ref_table", "ref_field", "row_key", "key").distinct()
    state = R.accumulate(
        R.deltas(refs, F.col("key"), references=1),
        R.deltas(read(spark, d, "entities").select("id").distinct(), F.col("id"), existence=1),
        R.deltas(read(spark, d, "entity_removals").select("entity_id").distinct(), F.col("entity_id"), removals=1),
    )
    return R.orphans(state).select(F.col("key").alias("entity_key"), F.col("refs").alias("n_references"), "kind")


QUERIES = {"p2_found": found, "p2_orphan_counts": orphan_counts, "p2_orphan_keys": orphan_keys}

_REFS = """
refs AS (
  SELECT 'relationships' AS ref_table, 'source_id' AS ref_field, id AS row_key, source_id AS k, created_at AS seen FROM relationships
  UNION ALL SELECT 'relationships', 'target_id', id, target_id, created_at FROM relationships
  UNION ALL SELECT 'vectors', 'entity_id', concat_ws('|', entity_id, model_id, chunk_index), entity_id, created_at FROM vectors
), known AS (SELECT id AS k, min(created_at) AS born FROM entities GROUP BY 1),
gone AS (SELECT DISTINCT entity_id AS k FROM entity_removals)"""
_FOUND = f"""
WITH {_REFS}
SELECT DISTINCT ref_table, ref_field, row_key,
  CASE WHEN known.k IS NOT NULL THEN 'late' WHEN gone.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind,
  strftime(seen, '%Y-%m') AS period
FROM refs LEFT JOIN known ON refs.k = known.k LEFT JOIN gone ON refs.k = gone.k
WHERE refs.k IS NOT NULL AND (known.k IS NULL OR known.born > seen)"""
SQL = {
    "p2_found": _FOUND,
    "p2_orphan_counts": f"SELECT ref_table, ref_field, kind, period, count(*) AS n_references FROM ({_FOUND}) GROUP BY ALL",
    "p2_orphan_keys": f"""
WITH {_REFS}
SELECT refs.k AS entity_key, count(DISTINCT (ref_table, ref_field, row_key)) AS n_references,
  CASE WHEN any_value(gone.k) IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind
FROM refs LEFT JOIN known ON refs.k = known.k LEFT JOIN gone ON refs.k = gone.k
WHERE refs.k IS NOT NULL AND known.k IS NULL GROUP BY refs.k""",
}
