"""Parquet tables of one data folder, and the schemas of the record formats the engine reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``; with ``columns`` only these reach the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


TASK = (
    "example_id LONG, namespace STRING, type STRING, project_path STRING, completion_path STRING, "
    "signature_position ARRAY<INT>, body_position ARRAY<INT>, "
    "dependency STRUCT<intra_class: ARRAY<STRING>, intra_file: ARRAY<STRING>, cross_file: ARRAY<STRING>>, "
    "requirement STRUCT<Functionality: STRING, Arguments: STRING>, tests ARRAY<STRING>, indent INT"
)
METHOD = "ID LONG, method_signature STRING, func_file STRING, method_code STRING"
FEATURE = "id STRING, cluster_id STRING, module_desc STRING, desc STRING, method_name STRING, flow STRING, notf STRING"
ENTITY_REPORT = (
    "variables ARRAY<STRUCT<id: LONG, qualifiedName: STRING, category: STRING, location: STRUCT<startLine: INT, "
    "endLine: INT, startColumn: INT, endColumn: INT>, File: STRING, modifiers: MAP<STRING, ARRAY<STRING>>>>, "
    "cells ARRAY<STRUCT<src: LONG, dest: LONG, values: STRUCT<kind: STRING, in_type_context: BOOLEAN, "
    "resolved: ARRAY<LONG>>, location: STRUCT<startLine: INT, startCol: INT>>>"
)
