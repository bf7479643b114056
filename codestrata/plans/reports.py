"""Reports over runs and cohorts, masks of targets, further scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import graph as G
from codestrata.plans import base as B
from codestrata.plans.catalog import query
from codestrata.plans.graph import LINKS, OWN, _links, _own
from codestrata.sources.tables import table

RUNS = "runs AS (SELECT DISTINCT ON (run_id) * FROM agent_result)"
JOBS = "jobs AS (SELECT DISTINCT ON (run_id) * FROM job_summary)"


def _runs(s, d, *columns):
    return table(s, d, "agent_result", "run_id", *columns).dropDuplicates(["run_id"])


def _jobs(s, d, *columns):
    return table(s, d, "job_summary", "run_id", *columns).distinct()


_CODE = "SELECT run_id, e.symbol AS sig, e.code AS code FROM (SELECT run_id, unnest(final_locations.entities) AS e FROM runs)"


@query(
    f"""WITH {B.DEPENDENCIES}, {RUNS}, l AS ({_CODE}), t AS (SELECT run_id, dep, count(*) AS n FROM runs JOIN deps ON task_id = example_id GROUP BY 1, 2), x AS (SELECT DISTINCT run_id, sig AS dep FROM l),
    w AS (SELECT DISTINCT run_id, unnest(regexp_extract_all(code, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM l),
    h AS (SELECT t.run_id, t.dep, n, x.dep IS NOT NULL AS exact, w.word IS NOT NULL AS soft FROM t LEFT JOIN x ON t.run_id = x.run_id AND t.dep = x.dep LEFT JOIN w ON t.run_id = w.run_id AND split_part(t.dep, '.', -1) = w.word)
    SELECT run_id, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (exact OR soft) AS BIGINT) AS hits, round(coalesce(sum(n) FILTER (exact OR soft), 0) / sum(n)::DOUBLE, 6) AS recall FROM h GROUP BY run_id"""
)
def simple_recall(s, d):
    """Recall by occurrence: a dependency is hit if it was located, or else if its last segment stands in located code."""
    r = _runs(s, d, "task_id", "final_locations")
    located = r.select("run_id", F.explode("final_locations.entities").alias("e")).select("run_id", F.col("e.symbol").alias("sig"), F.col("e.code").alias("code"))
    truth = r.select("run_id", F.col("task_id").alias("example_id")).join(B.dependencies(s, d), "example_id").groupBy("run_id", "dep").agg(F.count("*").alias("n"))
    exact = located.select("run_id", F.col("sig").alias("dep")).distinct().withColumn("exact", F.lit(True))
    words = located.select("run_id", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(T.WORD), F.lit(0)))).alias("word")).distinct().withColumn("soft", F.lit(True))
    h = truth.withColumn("word", T.last_part("dep")).join(exact, ["run_id", "dep"], "left").join(words, ["run_id", "word"], "left")
    hit = F.coalesce("exact", "soft", F.lit(False))
    n = h.groupBy("run_id").agg(F.sum("n").alias("total"), F.sum(F.when(hit, F.col("n"))).alias("hits"))
    return n.select("run_id", "total", "hits", F.round(F.coalesce("hits", F.lit(0)) / F.col("total"), 6).alias("recall"))


@query(
    f"""WITH {B.DEPENDENCIES}, {RUNS}, p AS (SELECT run_id, task_id, i AS pos, e[i].symbol AS sig, e[i].code AS code FROM (SELECT run_id, task_id, final_locations.entities AS e, unnest(range(1, len(final_locations.entities) + 1)) AS i FROM runs) WHERE e[i] IS NOT NULL),
    t AS (SELECT DISTINCT example_id AS task_id, dep, split_part(dep, '.', -1) AS word FROM deps),
    x AS (SELECT run_id, pos FROM p JOIN t ON p.task_id = t.task_id AND p.sig = t.dep UNION SELECT run_id, pos FROM (SELECT run_id, task_id, pos, unnest(list_distinct(regexp_extract_all(code, '[\\p{{L}}\\p{{N}}_]+'))) AS word FROM p) w JOIN t ON w.task_id = t.task_id AND w.word = t.word)
    SELECT p.run_id, CAST(p.pos AS BIGINT) AS pos, x.run_id IS NOT NULL AS hit FROM p LEFT JOIN x ON p.run_id = x.run_id AND p.pos = x.pos"""
)
def match_flags(s, d):
    """For every located entity whether it matches a dependency of the task, by its symbol or by a word of its code."""
    p = _runs(s, d, "task_id", "final_locations").select("run_id", "task_id", F.posexplode("final_locations.entities").alias("p", "e")).where("e is not null")
    p = p.select("run_id", "task_id", (F.col("p") + 1).cast("long").alias("pos"), F.col("e.symbol").alias("sig"), F.col("e.code").alias("code"))
    t = B.dependencies(s, d).select(F.col("example_id").alias("task_id"), "dep", T.last_part("dep").alias("word")).distinct()
    exact = p.join(t, (p.task_id == t.task_id) & (p.sig == t.dep), "left_semi").select("run_id", "pos")
    words = p.select("run_id", "task_id", "pos", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(T.WORD), F.lit(0)))).alias("word"))
    soft = words.join(t.select("task_id", "word").distinct(), ["task_id", "word"], "left_semi").select("run_id", "pos")
    found = exact.unionByName(soft).distinct().withColumn("hit", F.lit(True))
    return p.select("run_id", "pos").join(found, ["run_id", "pos"], "left").select("run_id", "pos", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(
    f"""WITH {B.DEPENDENCIES}, {JOBS}, c AS (SELECT 'all' AS cohort, namespace FROM tasks UNION SELECT 'cross file', namespace FROM tasks JOIN deps USING (example_id, namespace) WHERE kind = 'cross_file' UNION SELECT 'standalone', namespace FROM tasks WHERE example_id NOT IN (SELECT example_id FROM deps) UNION SELECT 'method', namespace FROM tasks WHERE lower(trim(type)) = 'method')
    SELECT cohort, method, CAST(count(*) AS BIGINT) AS runs, CAST(count(dr) AS BIGINT) AS scored, round(avg(dr), 6) AS mean_dr, round(avg(exact_dr), 6) AS mean_exact_dr FROM jobs JOIN c USING (namespace) GROUP BY ALL"""
)
def cohort_metrics(s, d):
    """Scores of runs by cohorts of tasks, which overlap."""
    t = B.tasks(s, d, "namespace", "type").where("namespace is not null")
    deps = B.dependencies(s, d).select("example_id", "kind").distinct()
    cohorts = {"all": t, "cross file": t.join(deps.where("kind = 'cross_file'"), "example_id", "left_semi"), "standalone": t.join(deps, "example_id", "left_anti"), "method": t.where("lower(trim(type)) = 'method'")}
    c = None
    for name, rows in cohorts.items():
        part = rows.select(F.lit(name).alias("cohort"), "namespace").distinct()
        c = part if c is None else c.unionByName(part)
    j = _jobs(s, d, "namespace", "method", "dr", "exact_dr").join(c, "namespace")
    return j.groupBy("cohort", "method").agg(F.count("*").alias("runs"), F.count("dr").alias("scored"), F.round(F.avg("dr"), 6).alias("mean_dr"), F.round(F.avg("exact_dr"), 6).alias("mean_exact_dr"))


@query(
    f"""WITH {RUNS}, {JOBS}, a AS (SELECT task_id, method AS arm, arg_max(dr, (finished_at IS NOT NULL, finished_at, run_id)) AS dr, max(run_id) AS run_id FROM jobs WHERE method IS NOT NULL AND dr IS NOT NULL GROUP BY 1, 2), o AS (SELECT task_id, max(final_stage.dr) AS dr FROM runs WHERE final_stage.dr IS NOT NULL GROUP BY 1)
    SELECT coalesce(a.task_id, o.task_id) AS task_id, coalesce(arm, 'rescored') AS arm, coalesce(o.dr, a.dr) AS dr, CASE WHEN a.task_id IS NULL THEN 'added' WHEN o.dr IS NULL THEN 'kept' ELSE 'overridden' END AS origin FROM a FULL OUTER JOIN o ON a.task_id = o.task_id"""
)
def arm_overrides(s, d):
    """The last score of every task and arm, replaced by rescored ones where there are any; tasks that were only rescored are added."""
    last = F.struct(F.col("finished_at").isNotNull().alias("a"), F.col("finished_at").alias("b"), F.col("run_id").alias("c"))
    a = _jobs(s, d, "task_id", "method", "dr", "finished_at").where("method is not null and dr is not null").groupBy(F.col("task_id").alias("ta"), F.col("method").alias("arm")).agg(F.max_by("dr", last).alias("old"))
    o = _runs(s, d, "task_id", "final_stage").where("final_stage.dr is not null").groupBy(F.col("task_id").alias("tb")).agg(F.max("final_stage.dr").alias("new"))
    x = a.join(o, F.col("ta") == F.col("tb"), "full_outer")
    origin = F.when(F.col("ta").isNull(), "added").when(F.col("new").isNull(), "kept").otherwise("overridden")
    return x.select(F.coalesce("ta", "tb").alias("task_id"), F.coalesce("arm", F.lit("rescored")).alias("arm"), F.coalesce("new", "old").alias("dr"), origin.alias("origin"))


@query(
    f"""WITH {JOBS}, k AS (SELECT method, project, CAST(nullif(regexp_extract(result_file, '(\\d+)', 1), '') AS BIGINT) % 3 AS k, dr FROM jobs WHERE method IS NOT NULL)
    SELECT method, round(avg(dr) FILTER (k = 0), 6) AS k_0, round(avg(dr) FILTER (k = 1), 6) AS k_1, round(avg(dr) FILTER (k = 2), 6) AS k_2, CAST(count(*) FILTER (k IS NULL) AS BIGINT) AS without FROM k GROUP BY method"""
)
def stage_columns(s, d):
    """Mean score by the stage that the name of a result file gives, as columns."""
    j = _jobs(s, d, "method", "result_file", "dr").where("method is not null")
    k = j.withColumn("k", T.safe_long(F.regexp_extract("result_file", r"(\d+)", 1)) % 3)
    wide = k.groupBy("method").pivot("k", [0, 1, 2]).agg(F.round(F.avg("dr"), 6))
    return wide.select("method", *(F.col(str(i)).alias(f"k_{i}") for i in range(3))).join(k.groupBy("method").agg(F.count_if(F.col("k").isNull()).alias("without")), "method")


@query(
    f"""WITH {B.CODE_GRAPH}, {LINKS}, {OWN}, t AS (SELECT example_id AS task_id, namespace AS target FROM tasks), m AS (SELECT own.task_id, node FROM own LEFT JOIN t USING (task_id) WHERE target IS NULL OR NOT (node = target OR starts_with(node, target || '.'))),
    e AS (SELECT a.task_id, src, dst, kind FROM links JOIN m a ON src = a.node JOIN m b ON dst = b.node AND a.task_id = b.task_id)
    SELECT task_id, CAST(count(*) AS BIGINT) AS nodes, CAST(coalesce(sum(n_out), 0) AS BIGINT) AS edges, CAST(count(n_out) AS BIGINT) AS with_out, CAST(count(n_in) AS BIGINT) AS with_in
    FROM m LEFT JOIN (SELECT task_id, src AS node, count(*) AS n_out FROM e GROUP BY ALL) USING (task_id, node) LEFT JOIN (SELECT task_id, dst AS node, count(*) AS n_in FROM e GROUP BY ALL) USING (task_id, node) GROUP BY task_id"""
)
def target_masking(s, d):
    """Graphs of the tasks without their targets and what lies inside them: nodes, edges, and the nodes that keep a list of out- and of
    in-neighbors."""
    t = B.tasks(s, d, "namespace").select(F.col("example_id").alias("task_id"), F.col("namespace").alias("target"))
    m, e = G.masked(_own(s, d), G.induced(_links(s, d), _own(s, d), "task_id"), t, "task_id")
    n_out = e.groupBy("task_id", F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    n_in = e.groupBy("task_id", F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    x = m.join(n_out, ["task_id", "node"], "left").join(n_in, ["task_id", "node"], "left")
    return x.groupBy("task_id").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("n_out"), F.lit(0)).alias("edges"), F.count("n_out").alias("with_out"), F.count("n_in").alias("with_in"))


@query(
    f"""WITH {B.METHODS}, p AS (SELECT id, func_file, method_signature, list_filter(list_transform(string_split(regexp_extract(method_signature, '(?s)\\((.*)\\)', 1), ','), lambda p: regexp_replace({B.sql_strip("regexp_extract(p, '(?s)^([^:=]*)', 1)")}, '^[*/]+', '')), lambda p: p <> '' AND p <> 'self' AND p <> 'cls') AS p,
      len(list_filter(string_split(regexp_extract(method_signature, '(?s)\\((.*)\\)', 1), ','), lambda p: contains(p, '='))) AS dflt FROM meth WHERE method_signature IS NOT NULL AND func_file IS NOT NULL)
    SELECT id, CAST(len(p) AS BIGINT) AS n_parameters, (2 >= len(p) - dflt - CASE WHEN contains(method_signature, '*') THEN 1 ELSE 0 END) AND (2 <= len(p) OR contains(method_signature, '*')) AS takes_two,
      regexp_extract(func_file, '([^/]*?)(?:\\.py)?$', 1) || '.' || split_part(split_part(method_signature, '(', 1), '.', -1) || '(' || array_to_string(p, ', ') || ')' AS description FROM p"""
)
def signature_functions(s, d):
    """Parameters of every method, whether a call with two arguments fits, and a short description."""
    m = B.methods(s, d, "func_file", "method_signature").where("method_signature is not null and func_file is not null")
    return m.select("id", F.size(T.parameters("method_signature")).cast("long").alias("n_parameters"), T.fits_arity("method_signature", F.lit(2)).alias("takes_two"), T.short_description("func_file", "method_signature").alias("description"))


@query(
    f"""WITH {B.METHODS}, l AS (SELECT id, string_split(method_code, chr(10)) AS l, method_signature AS sig FROM meth WHERE method_code IS NOT NULL AND method_signature IS NOT NULL)
    SELECT id, array_to_string(list_concat(list_concat(l[1:1], ['    pass']), l[4:]), chr(10)) AS patched, replace(array_to_string(l, chr(10)), split_part(split_part(sig, '(', 1), '.', -1), '***') AS hidden FROM l WHERE split_part(split_part(sig, '(', 1), '.', -1) <> ''"""
)
def patched_methods(s, d):
    """Codes with their second and third line replaced, and with the name of the method hidden."""
    m = B.methods(s, d, "method_code", "method_signature").where("method_code is not null and method_signature is not null")
    name = T.last_part(F.substring_index("method_signature", "(", 1))
    return m.where(name != "").select("id", T.patched_lines("method_code", F.lit(2), F.lit(3), F.lit("    pass")).alias("patched"), T.redacted("method_code", name).alias("hidden"))
