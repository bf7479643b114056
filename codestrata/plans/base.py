"""Base relations that the queries share, as DataFrames and as the same CTEs in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.text import no_args, strip
from codestrata.sources.tables import table

SQL_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def sql_strip(x: str) -> str:
    return SQL_STRIP.format(x)


def tasks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Tasks, one row each (repeated rows are equal)."""
    return table(spark, folder, "filtered", "example_id", *columns).distinct()


TASKS = "tasks AS (SELECT DISTINCT ON (example_id) * FROM filtered)"
KINDS = ("intra_class", "intra_file", "cross_file")


def dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """(example_id, namespace, kind, pos, dep): named dependencies of tasks with their place in the list; trimmed,
    without nulls and blanks, repeats kept."""
    t = tasks(spark, folder, "namespace", "dependency")
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"dependency.{k}").alias("items")) for k in KINDS))
    lists = t.select("example_id", "namespace", F.explode(rows).alias("l")).select("example_id", "namespace", "l.kind", F.posexplode("l.items").alias("p", "raw"))
    return lists.select("example_id", "namespace", "kind", (F.col("p") + 1).cast("long").alias("pos"), strip("raw").alias("dep")).where("dep <> ''")


DEPENDENCIES = (
    TASKS
    + ", deps AS (SELECT * FROM (SELECT example_id, namespace, kind, pos, "
    + sql_strip("raw")
    + " AS dep FROM ("
    + " UNION ALL ".join(f"SELECT example_id, namespace, '{k}' AS kind, unnest(range(1, len(dependency.{k}) + 1)) AS pos, unnest(dependency.{k}) AS raw FROM tasks" for k in KINDS)
    + ")) WHERE dep <> '')"
)


def methods(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Methods, one row each; partitioned by id, which later steps by id then find."""
    return table(spark, folder, "methods", "id", *columns).repartition("id").distinct()


METHODS = "meth AS (SELECT DISTINCT ON (id) * FROM methods)"


def method_names(spark: SparkSession, folder: str) -> DataFrame:
    """(id, name, file): methods by their name without arguments."""
    return methods(spark, folder, "method_signature", "func_file").select("id", no_args("method_signature").alias("name"), F.col("func_file").alias("file"))


NAMES = METHODS + ", names AS (SELECT id, " + sql_strip("split_part(method_signature, '(', 1)") + " AS name, func_file AS file FROM meth)"


def code_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """(node, category) of the code graph: methods are Functions, other names Classes where their last segment starts
    with a capital, Modules where nothing names their parent ... see CODE_GRAPH for the rule in SQL."""
    known = method_names(spark, folder).select(F.col("name").alias("node")).distinct().withColumn("f", F.lit(1))
    named = dependencies(spark, folder).select(F.col("dep").alias("node")).unionByName(tasks(spark, folder, "namespace").select(F.col("namespace").alias("node"))).where("node is not null").distinct()
    return named.join(known, "node", "full_outer").select("node", category(F.col("node"), F.col("f")).alias("category")).distinct()


def category(node: Column, function: Column) -> Column:
    last = F.substring_index(node, ".", -1)
    return F.when(function == 1, "Function").when(last.rlike("^[A-Z][A-Za-z0-9]*[a-z]"), "Class").when(last.rlike("^_"), "Unresolved Attribute").when(last.rlike("^[a-z_]+$"), "Variable").otherwise("Unknown")


def code_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, kind, ord): task code uses its dependencies; ``ord`` is the order of first mention."""
    kind = F.when(F.col("kind") == "intra_class", "Contain").when(F.col("kind") == "intra_file", "Call").otherwise("Use")
    d = dependencies(spark, folder).where("namespace is not null")
    return d.select(F.col("namespace").alias("src"), F.col("dep").alias("dst"), kind.alias("kind"), (F.col("example_id") * 1000 + F.col("pos")).alias("ord"))


CODE_GRAPH = (
    DEPENDENCIES
    + ", "
    + NAMES
    + """, nodes AS (SELECT DISTINCT node, CASE WHEN f = 1 THEN 'Function'
        WHEN regexp_matches(last, '^[A-Z][A-Za-z0-9]*[a-z]') THEN 'Class' WHEN regexp_matches(last, '^_') THEN 'Unresolved Attribute'
        WHEN regexp_matches(last, '^[a-z_]+$') THEN 'Variable' ELSE 'Unknown' END AS category
      FROM (SELECT coalesce(a.node, b.node) AS node, b.f, split_part(coalesce(a.node, b.node), '.', -1) AS last
            FROM (SELECT dep AS node FROM deps UNION SELECT namespace FROM tasks WHERE namespace IS NOT NULL) a
            FULL OUTER JOIN (SELECT DISTINCT name AS node, 1 AS f FROM names) b ON a.node = b.node)),
    edges AS (SELECT namespace AS src, dep AS dst, CASE kind WHEN 'intra_class' THEN 'Contain' WHEN 'intra_file' THEN 'Call' ELSE 'Use' END AS kind,
      example_id * 1000 + pos AS ord FROM deps WHERE namespace IS NOT NULL)"""
)
