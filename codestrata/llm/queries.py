"""Queries of problems 1, 2, 3, 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.text import project_key, strip
from codestrata.llm import near_duplicates, sampling, set_join, spans, splits
from codestrata.sources.tables import table


def dependency_sets(spark: SparkSession, folder: str) -> DataFrame:
    lists = [F.coalesce(F.col(f"dependency.{c}"), F.array().cast("array<string>")) for c in ("intra_class", "intra_file", "cross_file")]
    values = F.filter(F.transform(F.concat(*lists), strip), lambda x: x != "")
    return table(spark, folder, "filtered", "example_id", "dependency").select(F.col("example_id").alias("id"), values.alias("tokens"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = set_join.similar_sets(dependency_sets(spark, folder), threshold=0.6, least_values=3)
    return pairs.select(F.col("id_a").alias("example_id_a"), F.col("id_b").alias("example_id_b"))


def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    links = set_join.set_links(dependency_sets(spark, folder), threshold=0.6, least_values=3)
    return links.withColumnRenamed("id", "example_id")


def codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of methods and of located entities; null entities have no place."""
    methods = table(spark, folder, "methods", "id", "method_code").select(F.lit("methods").alias("src"), F.col("id").alias("rec_id"), F.lit(0).cast("long").alias("item_pos"), F.col("method_code").alias("text"))
    entities = F.filter("final_locations.entities", lambda e: e.isNotNull())
    located = table(spark, folder, "agent_result", "run_id", "final_locations").select("run_id", F.posexplode(entities).alias("pos", "e"))
    return methods.unionByName(located.select(F.lit("agent_result").alias("src"), F.col("run_id").alias("rec_id"), (F.col("pos") + 1).cast("long").alias("item_pos"), F.col("e.code").alias("text")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_spans(codes(spark, folder), 150).drop("chars")


def p2_extent(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_extent(spans.shared_spans(codes(spark, folder), 150))


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    path = project_key("project_path")
    kind = F.replace(F.lower(strip("type")), F.lit("\\"), F.lit("/"))
    return table(spark, folder, "filtered", "example_id", "project_path", "type").select(F.col("example_id").alias("id"), F.substring_index(path, "/", 1).alias("domain"), kind.alias("type"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    cells = sampling.report(_cells(spark, folder), table(spark, folder, "sample_targets"))
    return cells.where("shortfall > 0").select("domain", "type")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Quota, drawn rows and shortfall of every cell of the targets."""
    return sampling.report(_cells(spark, folder), table(spark, folder, "sample_targets"))


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    drawn = sampling.sample_to_targets(_cells(spark, folder), table(spark, folder, "sample_targets"))
    return drawn.withColumnRenamed("id", "example_id")


def requirements(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.coalesce("requirement.Functionality", F.lit("")), F.lit(" "), F.coalesce("requirement.Arguments", F.lit("")))
    return table(spark, folder, "filtered", "example_id", "requirement").select(F.col("example_id").alias("id"), text.alias("text"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_duplicates.near_duplicates(requirements(spark, folder), shingle=3, threshold=0.7, least_words=20)
    return groups.withColumnRenamed("id", "example_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_duplicates.near_duplicates(requirements(spark, folder), shingle=3, threshold=0.7, least_words=20)
    return near_duplicates.pairs_in_groups(groups).select(F.col("a").alias("example_id_a"), F.col("b").alias("example_id_b"))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    """All records; a blank package, like a null one, links nothing."""
    package = F.lower(F.substring_index("namespace", ".", 1))
    rows = table(spark, folder, "filtered", "example_id", "namespace", "project_path", "type")
    return rows.select(F.col("example_id").alias("id"), F.lower(strip("type")).alias("label"), project_key("project_path").alias("project"), F.when(package != "", package).alias("package"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    components = splits.link_components(_links(spark, folder).where("project is not null"), ["project", "package"])
    return splits.pairs_kept_together(components).select(F.col("a").alias("project_a"), F.col("b").alias("project_b"))


def p7_split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.grouped_splits(_links(spark, folder), ["project", "package"]).withColumnRenamed("id", "example_id")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How the tasks of each type lie over the splits."""
    rows = _links(spark, folder)
    return splits.label_shares(rows, splits.grouped_splits(rows, ["project", "package"]))


QUERIES = {"p1_found": p1_found, "p1_links": p1_links, "p2_found": p2_found, "p2_extent": p2_extent, "p3_found": p3_found, "p3_sample": p3_sample, "p3_report": p3_report, "p6_found": p6_found, "p6_groups": p6_groups, "p7_found": p7_found, "p7_split": p7_split, "p7_shares": p7_shares}
