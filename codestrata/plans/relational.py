"""Filters, dedup and joins over tasks, methods and the code graph."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.functions import text as T
from codestrata.operators import relational as R
from codestrata.plans import base as B
from codestrata.plans.catalog import query
from codestrata.sources.tables import table

N = "CAST({} AS BIGINT)".format


@query(f"WITH {B.TASKS} SELECT example_id, namespace, type FROM tasks WHERE project_path = 'Networking/kovibaba-segment'")
def project_filter(s, d):
    return B.tasks(s, d, "namespace", "type", "project_path").where("project_path = 'Networking/kovibaba-segment'").drop("project_path")


@query(f"WITH {B.TASKS} SELECT example_id, CAST(len(dependency.cross_file) AS BIGINT) AS n FROM tasks WHERE len(dependency.cross_file) > 0")
def nonempty_cross_file(s, d):
    return R.non_empty(B.tasks(s, d, "dependency"), "dependency.cross_file").select("example_id", F.size("dependency.cross_file").cast("long").alias("n"))


@query(
    f"WITH {B.TASKS} SELECT example_id, coalesce(len(dependency.intra_class), 0) + coalesce(len(dependency.intra_file), 0) + coalesce(len(dependency.cross_file), 0) = 0 AS standalone, "
    "CAST(coalesce(len(dependency.intra_class), 0) + coalesce(len(dependency.intra_file), 0) + coalesce(len(dependency.cross_file), 0) AS BIGINT) AS n_deps FROM tasks"
)
def standalone_tasks(s, d):
    n = sum((F.coalesce(F.size(f"dependency.{k}"), F.lit(0)) for k in B.KINDS), F.lit(0))
    return B.tasks(s, d, "dependency").select("example_id", (n == 0).alias("standalone"), n.cast("long").alias("n_deps"))


@query(f"WITH {B.TASKS} SELECT example_id, project_path FROM tasks WHERE lower({B.sql_strip('project_path')}) IN (SELECT lower({B.sql_strip('project_path')}) FROM projects)")
def membership_folded(s, d):
    return R.in_folded(B.tasks(s, d, "project_path"), "project_path", table(s, d, "projects", "project_path"), "project_path")


@query(f"WITH {B.DEPENDENCIES} SELECT example_id, dep, CAST(min(CASE kind WHEN 'intra_class' THEN 0 WHEN 'intra_file' THEN 1000 ELSE 2000 END + pos) AS BIGINT) AS place FROM deps GROUP BY ALL")
def ordered_dedup(s, d):
    place = F.when(F.col("kind") == "intra_class", 0).when(F.col("kind") == "intra_file", 1000).otherwise(2000) + F.col("pos")
    return R.first_wins(B.dependencies(s, d).withColumn("place", place), ["example_id", "dep"], ["place"], ["place"])


@query(
    f"WITH {B.NAMES} SELECT name, CAST(min(id) AS BIGINT) AS first_id, arg_min(file, id) AS first_file, CAST(max(id) AS BIGINT) AS last_id, arg_max(file, id) AS last_file FROM names WHERE name IS NOT NULL AND file IS NOT NULL GROUP BY name"
)
def first_last_wins(s, d):
    n = B.method_names(s, d).where("name is not null and file is not null")
    first = R.first_wins(n, ["name"], ["id"], ["id", "file"]).withColumnsRenamed({"id": "first_id", "file": "first_file"})
    last = R.last_wins(n, ["name"], ["id"], ["id", "file"]).withColumnsRenamed({"id": "last_id", "file": "last_file"})
    return first.join(last, "name")


@query(f"WITH {B.CODE_GRAPH} SELECT src, dst, kind, CAST(min(ord) AS BIGINT) AS ord FROM edges GROUP BY src, dst, kind")
def edge_dedup(s, d):
    return R.first_wins(B.code_edges(s, d), ["src", "dst", "kind"], ["ord"], ["ord"])


@query(f"WITH {B.CODE_GRAPH} SELECT src, dst, arg_min(kind, (ord, kind)) AS first_kind, arg_max(kind, (ord, kind)) AS last_kind FROM edges GROUP BY src, dst")
def edge_collapse(s, d):
    e = B.code_edges(s, d)
    a = R.first_wins(e, ["src", "dst"], ["ord"], ["kind"]).withColumnRenamed("kind", "first_kind")
    return a.join(R.last_wins(e, ["src", "dst"], ["ord"], ["kind"]).withColumnRenamed("kind", "last_kind"), ["src", "dst"])


@query(
    f"""WITH {B.CODE_GRAPH}, v AS (SELECT node FROM nodes WHERE category NOT LIKE 'Un%')
    SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT src, dst, kind FROM edges) WHERE src IN (SELECT node FROM v) AND dst IN (SELECT node FROM v) GROUP BY kind"""
)
def edge_validity(s, d):
    nodes = B.code_nodes(s, d).where(~F.col("category").startswith("Un"))
    return R.valid_edges(B.code_edges(s, d).select("src", "dst", "kind").distinct(), nodes).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    f"""WITH {B.CODE_GRAPH} SELECT category, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (category NOT LIKE 'Un%') AS BIGINT) AS graph_build,
    CAST(count(*) FILTER (NOT (category LIKE 'Unknown%' OR category LIKE 'Ambiguous%' OR (category = 'Unresolved Attribute' AND NOT contains(node, '/')))) AS BIGINT) AS context_stats,
    CAST(count(*) FILTER (category IN ('Variable', 'Module', 'Package') OR (category = 'Unresolved Attribute' AND contains(node, '/'))) AS BIGINT) AS metrics,
    CAST(count(*) FILTER (category NOT LIKE 'Un%' AND category NOT IN ('Package', 'Module')) AS BIGINT) AS path_analysis FROM nodes GROUP BY category"""
)
def entity_categories(s, d):
    """The four entity filters, counted side by side."""
    c, path = F.col("category"), F.col("node").contains("/")
    un = c.startswith("Un")
    return B.code_nodes(s, d).groupBy("category").agg(
        F.count("*").alias("n"),
        F.count_if(~un).alias("graph_build"),
        F.count_if(~(c.startswith("Unknown") | c.startswith("Ambiguous") | ((c == "Unresolved Attribute") & ~path))).alias("context_stats"),
        F.count_if(c.isin("Variable", "Module", "Package") | ((c == "Unresolved Attribute") & path)).alias("metrics"),
        F.count_if(~un & ~c.isin("Package", "Module")).alias("path_analysis"),
    )


@query(
    f"""WITH {B.DEPENDENCIES} SELECT example_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (NOT (dep = namespace OR starts_with(dep, namespace || '.'))) AS BIGINT) AS kept FROM deps WHERE namespace IS NOT NULL GROUP BY example_id"""
)
def exclude_target(s, d):
    return B.dependencies(s, d).where("namespace is not null").groupBy("example_id").agg(F.count("*").alias("n"), F.count_if(R.outside("dep", "namespace")).alias("kept"))


@query(
    f"""WITH {B.TASKS} SELECT example_id, list_filter([regexp_replace(replace({B.sql_strip('project_path')}, '\\', '/'), '^/+|/+$', '', 'g')], lambda x: x <> '')[1] AS project,
    split_part(replace({B.sql_strip('project_path')}, '\\', '/'), '/', 1) AS domain, split_part(completion_path, '/', -1) AS file_name,
    replace(regexp_replace(regexp_replace(replace(completion_path, '\\', '/'), '\\.py$', ''), '(^|/)__init__$', ''), '/', '.') AS module FROM tasks"""
)
def path_columns(s, d):
    p = F.replace(T.strip("project_path"), F.lit("\\"), F.lit("/"))
    bare = F.regexp_replace(p, "^/+|/+$", "")
    return B.tasks(s, d, "project_path", "completion_path").select(
        "example_id", F.nullif(bare, F.lit("")).alias("project"), F.substring_index(p, "/", 1).alias("domain"), T.last_part(F.replace("completion_path", F.lit("."), F.lit("\x00"))).alias("x"), F.substring_index("completion_path", "/", -1).alias("file_name"), T.module_of_path("completion_path").alias("module")
    ).drop("x")


@query(f"""WITH {B.METHODS} SELECT id, CASE WHEN length(method_code) > 300 THEN substring(method_code, 1, 300) || '...' ELSE method_code END AS preview FROM meth""")
def truncate_text(s, d):
    return B.methods(s, d, "method_code").select("id", T.clipped("method_code", 300).alias("preview"))


@query(
    f"""WITH {B.DEPENDENCIES}, {B.NAMES}, one AS (SELECT name, arg_min(file, id) AS file FROM names WHERE file IS NOT NULL GROUP BY name)
    SELECT example_id, kind, pos, coalesce(file, '') AS file FROM deps LEFT JOIN one ON dep = name"""
)
def left_join_default(s, d):
    one = R.first_wins(B.method_names(s, d).where("file is not null"), ["name"], ["id"], ["file"])
    return R.lookup(B.dependencies(s, d), "dep", one, "name", "file", "").select("example_id", "kind", "pos", "file")


@query(
    f"""WITH {B.DEPENDENCIES}, {B.NAMES}, m AS (SELECT id, name, split_part(name, '.', -1) AS short, replace(name, '.__init__', '') AS cls FROM names),
    t1 AS (SELECT name AS k, min(id) AS id FROM m GROUP BY 1), t2 AS (SELECT cls AS k, min(id) AS id FROM m GROUP BY 1), t3 AS (SELECT short AS k, min(id) AS id FROM m GROUP BY 1)
    SELECT example_id, kind, pos, coalesce(t1.id, t2.id, t3.id) AS id, CASE WHEN t1.id IS NOT NULL THEN 'exact' WHEN t2.id IS NOT NULL THEN 'class' WHEN t3.id IS NOT NULL THEN 'short' END AS tier
    FROM deps LEFT JOIN t1 ON dep = t1.k LEFT JOIN t2 ON dep = t2.k LEFT JOIN t3 ON split_part(dep, '.', -1) = t3.k"""
)
def fallback_lookup(s, d):
    m = B.method_names(s, d).drop("file")
    keys = [("exact", F.col("dep")), ("class", F.col("dep")), ("short", T.last_part("dep"))]
    out = R.fallback_lookup(B.dependencies(s, d), keys, m, [F.col("name"), F.replace("name", F.lit(".__init__"), F.lit("")), T.last_part("name")], ["id"], "id")
    return out.select("example_id", "kind", "pos", "id", "tier")


@query(
    f"""WITH {B.DEPENDENCIES}, {B.NAMES}, parts AS (SELECT DISTINCT dep, string_split(dep, '.') AS p FROM deps),
    c AS (SELECT dep, p, greatest(1, coalesce(list_min(list_filter(range(0, len(p)), lambda i: i > 0 AND regexp_matches(p[i + 1], '^[A-Z]'))), len(p) - 1)) AS cut FROM parts),
    k AS (SELECT dep, array_to_string(list_concat(list_concat(p[1:cut], ['__init__']), p[cut + 1:]), '.') AS ctor FROM c)
    SELECT dep, ctor, dep IN (SELECT name FROM names) AS plain, ctor IN (SELECT name FROM names) AS as_constructor FROM k"""
)
def constructor_fallback(s, d):
    names = B.method_names(s, d).where("name is not null").select("name").distinct()
    k = B.dependencies(s, d).select("dep").distinct().withColumn("ctor", T.with_constructor("dep"))
    a = names.select(F.col("name").alias("dep"), F.lit(True).alias("plain"))
    b = names.select(F.col("name").alias("ctor"), F.lit(True).alias("as_constructor"))
    out = k.join(a, "dep", "left").join(b, "ctor", "left")
    return out.select("dep", "ctor", F.coalesce("plain", F.lit(False)).alias("plain"), F.coalesce("as_constructor", F.lit(False)).alias("as_constructor"))


@query(
    f"""WITH {B.TASKS}, a AS (SELECT task_id, run_id, row_number() OVER (PARTITION BY task_id ORDER BY run_id) AS place FROM (SELECT DISTINCT task_id, run_id FROM agent_result)),
    b AS (SELECT task_id, metric_id, row_number() OVER (PARTITION BY task_id ORDER BY metric_id) AS place FROM (SELECT DISTINCT task_id, metric_id FROM task_metrics))
    SELECT a.task_id, a.place, run_id, metric_id FROM a JOIN b ON a.task_id = b.task_id AND a.place = b.place"""
)
def positional_join(s, d):
    """Run i of a task with metric row i of the task."""
    a, b = table(s, d, "agent_result", "task_id", "run_id").distinct(), table(s, d, "task_metrics", "task_id", "metric_id").distinct()
    return R.zip_by_place(a, ["run_id"], b, ["metric_id"], ["task_id"]).select("task_id", F.col("place").cast("long").alias("place"), "run_id", "metric_id")


@query(
    f"""WITH {B.DEPENDENCIES}, {B.NAMES}, one AS (SELECT split_part(name, '.', -1) AS short, min(name) AS found FROM names WHERE name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) = 1)
    SELECT example_id, kind, pos, found FROM deps LEFT JOIN one ON split_part(dep, '.', -1) = short"""
)
def unique_gate_join(s, d):
    m = B.method_names(s, d).where("name is not null").select(T.last_part("name").alias("short"), F.col("name").alias("found"))
    return R.unique_match(B.dependencies(s, d).withColumn("short", T.last_part("dep")), ["short"], m, "found").select("example_id", "kind", "pos", "found")


@query(f"WITH {B.TASKS} SELECT example_id, namespace FROM tasks WHERE example_id NOT IN (SELECT task_id FROM agent_result WHERE task_id IS NOT NULL)")
def resume_anti_join(s, d):
    return R.not_done(B.tasks(s, d, "namespace"), table(s, d, "agent_result", "task_id").withColumnRenamed("task_id", "example_id"), ["example_id"])


@query(
    f"""WITH {B.TASKS}, p AS (SELECT DISTINCT split_part(lower(replace({B.sql_strip('project_path')}, '\\', '/')), '/', 2) AS part FROM projects)
    SELECT example_id, part FROM tasks, p WHERE part <> '' AND contains(lower(completion_path), part)"""
)
def containment_join(s, d):
    """Tasks whose path holds a project's name anywhere."""
    parts = table(s, d, "projects", "project_path").select(F.substring_index(F.substring_index(T.project_key("project_path"), "/", 2), "/", -1).alias("part")).distinct()
    return R.containment_join(B.tasks(s, d, "completion_path").select("example_id", F.lower("completion_path").alias("path")), "path", parts, "part").select("example_id", "part")


@query(
    f"""WITH {B.METHODS}, m AS (SELECT DISTINCT func_file, length(func_file) AS n FROM meth WHERE func_file IS NOT NULL), f AS (SELECT DISTINCT split_part(x.file, '/', -1) AS part FROM (SELECT unnest(final_locations.files) AS file FROM agent_result) x WHERE x.file IS NOT NULL)
    SELECT part, CAST(count(*) AS BIGINT) AS files, min(func_file) AS first_file FROM m, f WHERE part <> '' AND contains(func_file, part) GROUP BY part"""
)
def containment_first(s, d):
    """For each located file name the files that hold it, and the first by name."""
    files = table(s, d, "agent_result", "final_locations").select(F.explode("final_locations.files").alias("file"))
    parts = files.select(F.substring_index("file", "/", -1).alias("part")).where("part is not null").distinct()
    held = R.containment_join(table(s, d, "methods", "func_file").where("func_file is not null").distinct(), "func_file", parts, "part")
    return held.groupBy("part").agg(F.count("*").alias("files"), F.min("func_file").alias("first_file"))


@query(
    f"""WITH {B.DEPENDENCIES}, m AS (SELECT DISTINCT regexp_replace(namespace, '\\.?[^.]*$', '') AS module FROM tasks WHERE namespace IS NOT NULL), x AS (SELECT DISTINCT dep FROM deps)
    SELECT dep, CAST(count(*) AS BIGINT) AS modules FROM x, m WHERE module <> '' AND starts_with(dep, module) GROUP BY dep"""
)
def prefix_join(s, d):
    """Dependencies that start with the module of a task, segments or not."""
    modules = B.tasks(s, d, "namespace").where("namespace is not null").select(T.parent_part("namespace").alias("module")).distinct()
    return R.prefix_join(B.dependencies(s, d).select("dep").distinct(), "dep", modules, "module").groupBy("dep").agg(F.count("*").alias("modules"))


@query(
    f"""WITH {B.DEPENDENCIES}, m AS (SELECT DISTINCT regexp_replace(namespace, '\\.?[^.]*$', '') AS module FROM tasks WHERE namespace IS NOT NULL), x AS (SELECT DISTINCT dep FROM deps)
    SELECT dep, arg_max(module, length(module)) AS module FROM x, m WHERE module <> '' AND starts_with(dep, module) GROUP BY dep"""
)
def longest_prefix_join(s, d):
    modules = B.tasks(s, d, "namespace").where("namespace is not null").select(T.parent_part("namespace").alias("module"))
    return R.longest_prefix(B.dependencies(s, d).select("dep").distinct(), "dep", ["dep"], modules, "module")


LOCATED = "loc AS (SELECT DISTINCT run_id, e.file AS file, e.symbol AS symbol, e.\"start\" AS s, e.\"end\" AS t FROM (SELECT run_id, unnest(final_locations.entities) AS e FROM agent_result) WHERE e IS NOT NULL)"


def _located(s, d):
    e = table(s, d, "agent_result", "run_id", "final_locations").select("run_id", F.explode("final_locations.entities").alias("e")).where("e is not null")
    return e.select("run_id", "e.file", "e.symbol", F.col("e.start").alias("s"), F.col("e.end").alias("t")).distinct()


@query(
    f"""WITH {LOCATED}, iv AS (SELECT DISTINCT file, symbol, s, t FROM loc WHERE symbol IS NOT NULL AND s <= t), pt AS (SELECT DISTINCT file, s AS line FROM loc WHERE file IS NOT NULL AND s IS NOT NULL),
    h AS (SELECT pt.file, line, symbol, t - s AS span, row_number() OVER (PARTITION BY pt.file, line ORDER BY t - s, s, symbol) AS r FROM pt JOIN iv ON pt.file = iv.file AND line BETWEEN s AND t)
    SELECT file, line, symbol, CAST(span AS BIGINT) AS span FROM h WHERE r = 1"""
)
def smallest_interval_join(s, d):
    loc = _located(s, d)
    iv = loc.where("symbol is not null").select("file", "symbol", "s", "t").distinct()
    pt = loc.where("file is not null and s is not null").select("file", F.col("s").alias("line")).distinct()
    return R.smallest_interval(pt, ["file"], "line", iv, "s", "t", "symbol")


@query(
    f"""WITH {LOCATED}, {B.NAMES}, u AS (SELECT DISTINCT symbol FROM loc WHERE symbol IS NOT NULL), n AS (SELECT DISTINCT name FROM names WHERE name IS NOT NULL),
    m AS (SELECT symbol, name FROM u JOIN n ON symbol = name UNION SELECT symbol, name FROM u JOIN n ON split_part(symbol, '.', -1) = split_part(name, '.', -1))
    SELECT symbol, min(name) AS name FROM m GROUP BY symbol HAVING count(*) = 1"""
)
def name_or_symbol_join(s, d):
    """Symbols that one method alone matches, by its full name or its last segment."""
    u = _located(s, d).where("symbol is not null").select("symbol").distinct()
    n = B.method_names(s, d).where("name is not null").select("name").distinct()
    both = u.join(n, F.col("symbol") == F.col("name")).union(u.join(n, T.last_part("symbol") == T.last_part("name"))).distinct()
    return both.groupBy("symbol").agg(F.min("name").alias("name"), F.count("*").alias("n")).where("n = 1").drop("n")


@query(
    f"""WITH {B.DEPENDENCIES}, q AS (SELECT DISTINCT regexp_replace(h, '^[^.]*\\.', '') AS q FROM (SELECT unnest(final_stage.hit_dependencies) AS h FROM agent_result) WHERE h IS NOT NULL), n AS (SELECT DISTINCT dep AS name FROM deps),
    x AS (SELECT name, unnest(range(0, len(string_split(name, '.')))) AS extra FROM n), y AS (SELECT name, extra, array_to_string(string_split(name, '.')[extra + 1:], '.') AS suffix FROM x)
    SELECT q, arg_min(name, (extra, name)) AS name, CAST(min(extra) AS BIGINT) AS extra FROM q JOIN y ON q = suffix GROUP BY q"""
)
def suffix_match_lookup(s, d):
    """Dependencies that runs hit, without their root, looked up among all that tasks name."""
    hits = table(s, d, "agent_result", "final_stage").select(F.explode("final_stage.hit_dependencies").alias("h")).where("h is not null")
    return R.suffix_lookup(hits.select(T.drop_first_part("h").alias("q")), "q", B.dependencies(s, d).select(F.col("dep").alias("name")), "name")


@query("SELECT coalesce(a.run_id, b.run_id) AS run_id, CASE WHEN b.run_id IS NULL THEN 'missing' ELSE 'unexpected' END AS side FROM (SELECT DISTINCT run_id FROM agent_result) a FULL OUTER JOIN (SELECT DISTINCT run_id FROM job_summary) b ON a.run_id = b.run_id WHERE a.run_id IS NULL OR b.run_id IS NULL")
def key_set_difference(s, d):
    return R.key_differences(table(s, d, "agent_result", "run_id"), table(s, d, "job_summary", "run_id"), "run_id")


@query(
    """SELECT task_id, source, CAST(count(*) AS BIGINT) AS rows FROM (SELECT DISTINCT task_id, run_id AS k, 'agent' AS source FROM agent_result UNION ALL SELECT DISTINCT task_id, run_id, 'job' FROM job_summary
    UNION ALL SELECT DISTINCT task_id, metric_id, 'metric' FROM task_metrics) GROUP BY task_id, source"""
)
def multi_source_assembly(s, d):
    parts = [table(s, d, t, "task_id", k).distinct().select("task_id", F.lit(n).alias("source")) for t, k, n in (("agent_result", "run_id", "agent"), ("job_summary", "run_id", "job"), ("task_metrics", "metric_id", "metric"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("task_id", "source").agg(F.count("*").alias("rows"))


@query(
    """WITH r AS (SELECT DISTINCT run_id, task_id, model, final_stage.dr AS dr FROM agent_result), m AS (SELECT task_id, model, max(dr) AS dr FROM r WHERE dr IS NOT NULL GROUP BY 1, 2)
    SELECT a.task_id, a.model AS model_a, b.model AS model_b, round(b.dr - a.dr, 6) AS gain FROM m a JOIN m b ON a.task_id = b.task_id AND a.model < b.model"""
)
def paired_runs(s, d):
    """Best recall of every pair of models that both ran a task."""
    r = table(s, d, "agent_result", "run_id", "task_id", "model", "final_stage").select("run_id", "task_id", "model", F.col("final_stage.dr").alias("dr")).distinct()
    m = r.where("dr is not null").groupBy("task_id", "model").agg(F.max("dr").alias("dr"))
    a, b = (m.select("task_id", F.col("model").alias(f"model_{x}"), F.col("dr").alias(f"dr_{x}")) for x in "ab")
    return a.join(b, "task_id").where("model_a < model_b").select("task_id", "model_a", "model_b", F.round(F.col("dr_b") - F.col("dr_a"), 6).alias("gain"))


@query(
    f"""WITH {B.NAMES}, one AS (SELECT file, id, name, row_number() OVER (PARTITION BY file ORDER BY id) AS r FROM names WHERE file IS NOT NULL) SELECT file, id, name FROM one WHERE r <= 3"""
)
def first_k_per_group(s, d):
    w = Window.partitionBy("file").orderBy("id")
    return B.method_names(s, d).where("file is not null").withColumn("r", F.row_number().over(w)).where("r <= 3").select("file", "id", "name")
