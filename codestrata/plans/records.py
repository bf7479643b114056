"""Queries over packed fields (problem 4) and nested records (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.packed import split_packed
from codestrata.operators.shred import path_values, pivot_group, shred_rows, shred_struct
from codestrata.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    terms = split_packed(table(spark, folder, "task_metrics", "metric_id", "search_terms"), "metric_id", "search_terms", "values")
    places = split_packed(table(spark, folder, "agent_result", "run_id", "final_text"), "run_id", "final_text", "locations")
    both = terms.withColumn("src", F.lit("task_metrics")).unionByName(places.withColumn("src", F.lit("agent_result")))
    return both.select("src", "rec_id", "pos", "val").distinct()


def p4_malformed(spark: SparkSession, folder: str) -> DataFrame:
    """Values that were read by a fallback, with their flag."""
    terms = split_packed(table(spark, folder, "task_metrics", "metric_id", "search_terms"), "metric_id", "search_terms", "values")
    return terms.where(F.col("flag") != "").select("rec_id", "pos", "val", "flag").distinct()


def _run_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Located entities of runs, from the typed column: a run has one attempt."""
    entities = shred_struct(table(spark, folder, "agent_result", "run_id", "final_locations"), "run_id", "final_locations")["entities[]"]
    return entities.select("rec_id", F.lit(1).cast("long").alias("attempt_pos"), F.col("ord_1").alias("entity_pos"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("file", "symbol")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    shape = {"rows_key": "entities", "list_key": "attempts", "below": "final_locations", "columns": ("file", "symbol"), "inherited": ("file",)}
    runs = _run_entities(spark, folder).withColumn("src", F.lit("agent_result"))
    raw = shred_rows(table(spark, folder, "raw_result", "raw_id", "payload"), "raw_id", "payload", **shape).withColumn("src", F.lit("raw_result"))
    return runs.unionByName(raw).select("src", "rec_id", "attempt_pos", "entity_pos", "file", "symbol").distinct()


def p5_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """The parent table of the attempts in raw_result, pivoted from triples."""
    t = path_values(table(spark, folder, "raw_result", "raw_id", "payload").distinct(), "raw_id", "payload")
    return pivot_group(t, "attempts[]", {"attempt_id": "attempt_id"}).select("rec_id", F.col("ordinal").alias("attempt_pos"), "attempt_id")


QUERIES = {"p4_found": p4_found, "p4_malformed": p4_malformed, "p5_found": p5_found, "p5_attempts": p5_attempts}

SQL = {
    "p5_attempts": """WITH r AS (SELECT DISTINCT raw_id, payload FROM raw_result WHERE payload IS NOT NULL AND json_valid(payload)), a AS (SELECT raw_id, payload, unnest(range(0, CAST(json_array_length(payload, '$.attempts') AS BIGINT))) AS i FROM r WHERE json_type(payload, '$.attempts') = 'ARRAY')
    SELECT raw_id AS rec_id, CAST(i + 1 AS BIGINT) AS attempt_pos, json_extract_string(payload, '$.attempts[' || i || '].attempt_id') AS attempt_id FROM a WHERE json_type(payload, '$.attempts[' || i || ']') = 'OBJECT'""",
}
