"""Evaluation: recall of runs, roll-ups, pass@k, comparisons, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import evaluation as E
from codestrata.plans import base as B
from codestrata.plans.catalog import query
from codestrata.sources.tables import table

METRICS = "tm AS (SELECT DISTINCT ON (metric_id) * FROM task_metrics)"
RUNS = "runs AS (SELECT DISTINCT ON (run_id) * FROM agent_result)"
JOBS = "jobs AS (SELECT DISTINCT ON (run_id) * FROM job_summary)"
LOC = RUNS + ", loc AS (SELECT run_id, task_id, e.symbol AS sig, coalesce(e.code, '') AS code FROM (SELECT run_id, task_id, unnest(final_locations.entities) AS e FROM runs) WHERE e IS NOT NULL AND e.symbol IS NOT NULL)"


def _metrics(s, d, *columns):
    return table(s, d, "task_metrics", "metric_id", *columns).dropDuplicates(["metric_id"])


def _jobs(s, d, *columns):
    return table(s, d, "job_summary", "run_id", *columns).distinct()


def _context(s, d):
    """(key run, sig, code) of the located entities, and the truth of the run's task."""
    e = table(s, d, "agent_result", "run_id", "task_id", "final_locations").select("run_id", "task_id", F.posexplode("final_locations.entities").alias("p", "e")).where("e is not null")
    return e.select(F.col("run_id").alias("key"), "task_id", "p", F.col("e.symbol").alias("sig"), F.coalesce("e.code", F.lit("")).alias("code")).where("sig is not null").distinct()


def _truth(s, d):
    runs = table(s, d, "agent_result", "run_id", "task_id").distinct()
    return runs.join(B.dependencies(s, d).select(F.col("example_id").alias("task_id"), "dep"), "task_id").select(F.col("run_id").alias("key"), "dep")


@query(f"WITH {B.DEPENDENCIES} SELECT example_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT dep) AS BIGINT) AS n_distinct, array_to_string(list_sort(list_distinct(list(dep))), '|') AS deps FROM deps GROUP BY example_id")
def dependency_flatten(s, d):
    return B.dependencies(s, d).groupBy("example_id").agg(F.count("*").alias("n"), F.count_distinct("dep").alias("n_distinct"), F.array_join(F.array_sort(F.collect_set("dep")), "|").alias("deps"))


def _canonical_sql(x: str) -> str:
    return f"replace(regexp_replace({B.sql_strip(f'split_part({x}, chr(40), 1)')}, '^\\.+', ''), '.__init__.', '.')"


def _legacy_sql(x: str) -> str:
    return f"replace({B.sql_strip(f'split_part({x}, chr(40), 1)')}, '.__init__', '')"


def _hits_sql(norm) -> str:
    return f"""WITH {B.CODE_GRAPH}, {LOC},
    truth AS (SELECT run_id AS key, {norm('dep')} AS dep, count(*) AS n FROM runs JOIN deps ON task_id = example_id GROUP BY 1, 2 HAVING {norm('dep')} <> ''),
    ctx AS (SELECT run_id AS key, {norm('sig')} AS sig, code FROM loc),
    kinds AS (SELECT DISTINCT {norm('node')} AS dep, category FROM nodes),
    words AS (SELECT key, sig, unnest(list_distinct(regexp_extract_all(code, '[\\p{{L}}\\p{{N}}_]+'))) AS word FROM ctx),
    typed AS (SELECT key, dep, category, split_part(dep, '.', -1) AS word, regexp_replace(dep, '\\.?[^.]*$', '') AS owner FROM truth JOIN kinds USING (dep)),
    soft AS (SELECT DISTINCT t.key, dep FROM typed t JOIN words w ON t.key = w.key AND t.word = w.word WHERE category = 'Variable'
      UNION SELECT DISTINCT t.key, dep FROM typed t JOIN words w ON t.key = w.key AND t.word = w.word WHERE category = 'Unresolved Attribute' AND (sig = owner OR starts_with(sig, owner || '.'))
      UNION SELECT DISTINCT t.key, dep FROM typed t JOIN ctx c ON t.key = c.key WHERE category IN ('Module', 'Package') AND starts_with(sig, dep)),
    hits AS (SELECT truth.key, truth.dep, n, e.key IS NOT NULL AS exact, s.key IS NOT NULL AS soft FROM truth
      LEFT JOIN (SELECT DISTINCT key, sig AS dep FROM ctx) e ON truth.key = e.key AND truth.dep = e.dep LEFT JOIN soft s ON truth.key = s.key AND truth.dep = s.dep)"""


@query(
    _hits_sql(_canonical_sql)
    + """ SELECT key AS run_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (exact OR soft) AS BIGINT) AS hits, CAST(count(*) FILTER (exact) AS BIGINT) AS exact_hits,
    round(count(*) FILTER (exact OR soft) / count(*)::DOUBLE, 6) AS dr, round(count(*) FILTER (exact) / count(*)::DOUBLE, 6) AS exact_dr FROM hits GROUP BY key"""
)
def recall_relaxed_unique(s, d):
    hits = E.relaxed_hits(_truth(s, d), _context(s, d), B.code_nodes(s, d).withColumnRenamed("node", "name"))
    return E.unique_recall(hits).withColumnRenamed("key", "run_id")


@query(
    _hits_sql(_legacy_sql)
    + """ SELECT key AS run_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (exact) + coalesce(sum(n) FILTER (soft), 0) AS BIGINT) AS hits,
    round((count(*) FILTER (exact) + coalesce(sum(n) FILTER (soft), 0)) / count(*)::DOUBLE, 6) AS recall FROM hits GROUP BY key"""
)
def recall_legacy_dup(s, d):
    hits = E.relaxed_hits(_truth(s, d), _context(s, d), B.code_nodes(s, d).withColumnRenamed("node", "name"), legacy=True)
    return E.legacy_recall(hits).withColumnRenamed("key", "run_id")


@query(
    _hits_sql(_canonical_sql)
    + """ SELECT CASE WHEN exact THEN 'exact' WHEN soft AND category = 'Variable' THEN 'variable in code' WHEN soft THEN 'attribute or module' ELSE 'missed' END AS rule, CAST(count(*) AS BIGINT) AS n
    FROM hits LEFT JOIN (SELECT dep, min(category) AS category FROM kinds GROUP BY dep) USING (dep) GROUP BY 1"""
)
def recall_rule_audit(s, d):
    """How often each rule decides a match."""
    nodes = B.code_nodes(s, d)
    hits = E.relaxed_hits(_truth(s, d), _context(s, d), nodes.withColumnRenamed("node", "name"))
    kinds = nodes.groupBy(T.canonical("node").alias("dep")).agg(F.min("category").alias("category"))
    rule = F.when(F.col("exact"), "exact").when(F.col("soft") & (F.col("category") == "Variable"), "variable in code").when(F.col("soft"), "attribute or module").otherwise("missed")
    return hits.join(kinds, "dep", "left").groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {B.DEPENDENCIES}, {METRICS}, p AS (SELECT 'metric' AS src, metric_id AS rec_id, task_id, unnest(top_predictions) AS pred FROM tm UNION ALL SELECT 'run', run_id, task_id, unnest(final_stage.hit_dependencies) FROM (SELECT DISTINCT ON (run_id) * FROM agent_result)), t AS (SELECT DISTINCT example_id AS task_id, dep FROM deps),
    h AS (SELECT DISTINCT src, rec_id, dep FROM p JOIN t ON p.task_id = t.task_id AND (pred = dep OR starts_with(pred, dep || '.') OR pred = 'src.' || dep OR starts_with(pred, 'src.' || dep || '.')))
    SELECT src, rec_id, CAST(count(*) AS BIGINT) AS hits FROM h GROUP BY src, rec_id"""
)
def path_hits(s, d):
    """Predictions, of metrics and of runs, that are a dependency or a member of it, with or without the source root: each prediction is cut
    into its prefixes, which meet the truth by equality."""
    m = table(s, d, "task_metrics", "metric_id", "task_id", "top_predictions").distinct()
    r = table(s, d, "agent_result", "run_id", "task_id", "final_stage").select("run_id", "task_id", F.col("final_stage.hit_dependencies").alias("hits")).distinct()
    p = m.select(F.lit("metric").alias("src"), F.col("metric_id").alias("rec_id"), "task_id", F.explode("top_predictions").alias("pred"))
    p = p.unionByName(r.select(F.lit("run").alias("src"), F.col("run_id").alias("rec_id"), "task_id", F.explode("hits").alias("pred")))
    parts = F.split(F.regexp_replace("pred", r"^src\.", ""), r"\.")
    whole = F.split("pred", r"\.")
    cuts = F.array_union(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")), F.transform(F.sequence(F.lit(1), F.size(whole)), lambda n: F.array_join(F.slice(whole, F.lit(1), n), ".")))
    truth = B.dependencies(s, d).select(F.col("example_id").alias("task_id"), "dep").distinct()
    return p.select("src", "rec_id", "task_id", F.explode(cuts).alias("dep")).distinct().join(truth, ["task_id", "dep"]).groupBy("src", "rec_id").agg(F.count("*").alias("hits"))


KS = f"""{METRICS}, long AS (SELECT metric_id, project, 'exact' AS measure, e.key AS k, e.value AS v FROM (SELECT metric_id, project, unnest(map_entries(exact)) AS e FROM tm)
    UNION ALL SELECT metric_id, project, 'relaxed', e.key, e.value FROM (SELECT metric_id, project, unnest(map_entries(relaxed)) AS e FROM tm))"""


def _long(s, d):
    m = _metrics(s, d, "project", "exact", "relaxed")
    parts = [m.select("metric_id", "project", F.lit(x).alias("measure"), F.explode(x).alias("k", "v")) for x in ("exact", "relaxed")]
    return parts[0].unionByName(parts[1]).select("metric_id", "project", "measure", "k", "v.*")


@query(f"WITH {KS} SELECT metric_id, measure, k, CAST(v.hits AS BIGINT) AS hits, CAST(v.gt AS BIGINT) AS gt, round(v.recall, 6) AS recall, round(v.f1, 6) AS f1 FROM long")
def metrics_long(s, d):
    return _long(s, d).select("metric_id", "measure", "k", F.col("hits").cast("long").alias("hits"), F.col("gt").cast("long").alias("gt"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


@query(
    f"""WITH {KS}, g AS (SELECT measure, k, count(*) AS rows, avg(v.hits / nullif(v.gt, 0)::DOUBLE) AS mr, avg(v.hits / nullif(v.pred, 0)::DOUBLE) AS mp, sum(v.hits) AS h, sum(v.gt) AS t, sum(v.pred) AS q FROM long GROUP BY 1, 2),
    x AS (SELECT *, coalesce(h / nullif(t, 0)::DOUBLE, 0) AS r, coalesce(h / nullif(q, 0)::DOUBLE, 0) AS p FROM g)
    SELECT measure, k, CAST(rows AS BIGINT) AS rows, round(mr, 6) AS macro_r, round(mp, 6) AS macro_p, round(r, 6) AS micro_r, round(p, 6) AS micro_p, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS micro_f1 FROM x"""
)
def prf_macro_micro(s, d):
    return E.macro_micro(_long(s, d), ["measure", "k"], "hits", "gt", "pred")


@query(
    f"""WITH {KS}, pr AS (SELECT project, round(avg(v.recall), 6) AS r, round(avg(v.precision), 6) AS p, count(*) AS n FROM long WHERE measure = 'exact' AND k = (SELECT min(k) FROM long) AND v.recall IS NOT NULL AND v.precision IS NOT NULL AND project IS NOT NULL GROUP BY project),
    g AS (SELECT CAST(sum(n) AS BIGINT) AS tasks, coalesce(sum(r * n) / sum(n), 0) AS wr, coalesce(sum(p * n) / sum(n), 0) AS wp FROM pr)
    SELECT tasks, round(wr, 6) AS recall, round(wp, 6) AS "precision", round(coalesce(2 * wp * wr / nullif(wp + wr, 0), 0), 6) AS f1 FROM g"""
)
def project_weighted_rollup(s, d):
    rows = _long(s, d)
    least = rows.agg(F.min("k").alias("k"))
    rows = rows.where("measure = 'exact' and recall is not null and precision is not null and project is not null").join(F.broadcast(least), "k")  # one row
    projects = rows.groupBy("project").agg(F.avg("recall").alias("r"), F.avg("precision").alias("p"), F.count("*").alias("n"))
    return E.weighted_rollup(projects, "r", "p", "n")


@query(
    f"""WITH {KS} SELECT coalesce(project, 'ALL') AS project, measure, k, CAST(count(*) AS BIGINT) AS tasks, CAST(sum(v.hits) AS BIGINT) AS hits, CAST(sum(v.gt) AS BIGINT) AS gt FROM long WHERE project IS NOT NULL GROUP BY GROUPING SETS ((project, measure, k), (measure, k))"""
)
def batch_rollup(s, d):
    rows = _long(s, d).where("project is not null")
    return rows.groupingSets([[F.col("project"), F.col("measure"), F.col("k")], [F.col("measure"), F.col("k")]], "project", "measure", "k").agg(F.count("*").alias("tasks"), F.sum("hits").cast("long").alias("hits"), F.sum("gt").cast("long").alias("gt")).withColumn("project", F.coalesce("project", F.lit("ALL")))


@query(
    f"""WITH {RUNS} SELECT task_id, round(max(final_stage.dr) FILTER (model = 'agent-small'), 6) AS dr_small, round(max(final_stage.dr) FILTER (model = 'agent-large'), 6) AS dr_large,
    coalesce(max(final_stage.dr) FILTER (model = 'agent-large') > max(final_stage.dr) FILTER (model = 'agent-small'), FALSE) AS improved FROM runs GROUP BY task_id"""
)
def stage_compare_pivot(s, d):
    r = table(s, d, "agent_result", "run_id", "task_id", "model", "final_stage").select("run_id", "task_id", "model", F.col("final_stage.dr").alias("dr")).distinct()
    p = r.groupBy("task_id").pivot("model", ["agent-small", "agent-large"]).agg(F.max("dr"))
    a, b = F.col("`agent-small`"), F.col("`agent-large`")
    return p.select("task_id", F.round(a, 6).alias("dr_small"), F.round(b, 6).alias("dr_large"), F.coalesce(b > a, F.lit(False)).alias("improved"))


@query(
    f"""WITH {JOBS}, g AS (SELECT task_id, project, count(*) AS n, count(*) FILTER (returncode = 0 AND dr > 0.5) AS c FROM jobs GROUP BY 1, 2),
    k AS (SELECT unnest([1, 2, 3]) AS k), v AS (SELECT project, k, CASE WHEN n - c < k THEN 1.0 ELSE 1 - list_reduce(list_prepend(1.0, list_transform(range(n - c + 1, n + 1), lambda i: 1 - k / i::DOUBLE)), lambda a, b: a * b) END AS p FROM g, k WHERE n >= k)
    SELECT coalesce(project, 'overall') AS project, CAST(k AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS tasks, round(avg(p), 6) AS pass_at_k FROM v WHERE project IS NOT NULL GROUP BY GROUPING SETS ((project, k), (k))"""
)
def pass_at_k(s, d):
    g = _jobs(s, d, "task_id", "project", "returncode", "dr").groupBy("task_id", "project").agg(F.count("*").alias("n"), F.count_if(F.expr("returncode = 0 and dr > 0.5")).alias("c"))
    ks = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), E.pass_at_k(F.col("n"), F.col("c"), k).alias("p")) for k in (1, 2, 3)))
    v = g.where("project is not null").select("project", F.explode(ks).alias("x")).select("project", "x.k", "x.p").where("p is not null")
    out = v.groupingSets([[F.col("project"), F.col("k")], [F.col("k")]], "project", "k").agg(F.count("*").alias("tasks"), F.round(F.avg("p"), 6).alias("pass_at_k"))
    return out.withColumn("project", F.coalesce("project", F.lit("overall")))


@query(
    f"""WITH {JOBS}, p AS (SELECT task_id, dr, row_number() OVER (PARTITION BY task_id ORDER BY run_id) AS r FROM jobs), b AS (SELECT task_id, k, max(dr) AS best FROM p, (SELECT unnest([1, 3, 5]) AS k) WHERE r <= k GROUP BY 1, 2)
    SELECT CAST(k AS BIGINT) AS k, round(avg(best), 6) AS recall, CAST(count(best) AS BIGINT) AS tasks FROM b GROUP BY k"""
)
def recall_at_k(s, d):
    j = _jobs(s, d, "task_id", "dr")
    ranked = E.first_k(j, ["task_id"], ["run_id"], 5)
    best = ranked.select("task_id", "dr", F.explode(F.filter(F.array(*(F.lit(k).cast("long") for k in (1, 3, 5))), lambda k: k >= F.col("place"))).alias("k")).groupBy("task_id", "k").agg(F.max("dr").alias("best"))
    return best.groupBy("k").agg(F.round(F.avg("best"), 6).alias("recall"), F.count("best").alias("tasks"))


@query(
    f"""WITH {B.TASKS}, {JOBS}, m AS (SELECT task_id, max(dr) AS dr FROM jobs GROUP BY 1) SELECT type AS kind, CAST(count(*) AS BIGINT) AS tasks, CAST(count(m.task_id) AS BIGINT) AS run, round(avg(coalesce(dr, 0)), 6) AS dr_missing_0 FROM
    (SELECT example_id, lower({B.sql_strip('type')}) AS type FROM tasks) t LEFT JOIN m ON example_id = m.task_id GROUP BY 1"""
)
def benchmark_coverage(s, d):
    """All tasks count; those without a run have 0."""
    t = B.tasks(s, d, "type").select("example_id", F.lower(T.strip("type")).alias("kind"))
    m = _jobs(s, d, "task_id", "dr").groupBy(F.col("task_id").alias("example_id")).agg(F.max("dr").alias("dr"), F.lit(1).alias("ran"))
    return t.join(m, "example_id", "left").groupBy("kind").agg(F.count("*").alias("tasks"), F.count("ran").alias("run"), F.round(F.avg(F.coalesce("dr", F.lit(0.0))), 6).alias("dr_missing_0"))


@query(
    f"""WITH {JOBS} SELECT state, CAST(count(*) AS BIGINT) AS runs, CAST(sum(usage.calls) AS BIGINT) AS calls, CAST(sum(usage.prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(usage.total_tokens) AS BIGINT) AS total_tokens,
    CAST(count(*) FILTER (usage IS NULL) AS BIGINT) AS missing, round(sum(usage.seconds), 3) AS seconds FROM jobs GROUP BY state"""
)
def usage_counters(s, d):
    u = _jobs(s, d, "state", "usage")
    return u.groupBy("state").agg(F.count("*").alias("runs"), *(F.sum(f"usage.{c}").cast("long").alias(c) for c in ("calls", "prompt_tokens", "total_tokens")), F.count_if(F.col("usage").isNull()).alias("missing"), F.round(F.sum("usage.seconds"), 3).alias("seconds"))


@query(
    f"""WITH {JOBS} SELECT project, CAST(count(*) AS BIGINT) AS n, round(avg(dr) FILTER (state = 'done'), 6) AS done_dr, round(avg(dr) FILTER (stop_reason = 'budget'), 6) AS budget_dr, round(avg(exact_dr), 6) AS exact_dr FROM jobs GROUP BY project"""
)
def arm_stage_pivot(s, d):
    j = _jobs(s, d, "project", "state", "stop_reason", "dr", "exact_dr")
    mean = lambda c, x: F.round(F.avg(F.when(c, F.col(x))), 6)
    return j.groupBy("project").agg(F.count("*").alias("n"), mean(F.col("state") == "done", "dr").alias("done_dr"), mean(F.col("stop_reason") == "budget", "dr").alias("budget_dr"), F.round(F.avg("exact_dr"), 6).alias("exact_dr"))


@query(
    f"""WITH {B.TASKS}, {RUNS}, o AS (SELECT task_id, count(*) AS n, count(final_stage.dr) AS scored, count(*) FILTER (status <> 'completed') AS open FROM runs GROUP BY 1)
    SELECT CAST(count(*) AS BIGINT) AS expected, CAST(count(o.task_id) AS BIGINT) AS run, CAST(count(*) FILTER (scored > 0) AS BIGINT) AS scored, CAST(count(*) FILTER (o.task_id IS NULL) AS BIGINT) AS pending, CAST(coalesce(sum(open), 0) AS BIGINT) AS open_runs FROM tasks LEFT JOIN o ON example_id = o.task_id"""
)
def coverage_report(s, d):
    r = table(s, d, "agent_result", "run_id", "task_id", "status", "final_stage").select("run_id", "task_id", "status", F.col("final_stage.dr").alias("dr")).distinct()
    o = r.groupBy(F.col("task_id").alias("example_id")).agg(F.count("dr").alias("scored"), F.count_if(F.expr("status <> 'completed'")).alias("open"))
    t = B.tasks(s, d).join(o, "example_id", "left")
    return t.agg(F.count("*").alias("expected"), F.count("scored").alias("run"), F.count_if(F.expr("scored > 0")).alias("scored"), F.count_if(F.col("scored").isNull()).alias("pending"), F.coalesce(F.sum("open"), F.lit(0)).cast("long").alias("open_runs"))


@query(
    f"""WITH {RUNS} SELECT run_id, rule FROM (SELECT run_id, CASE WHEN final_stage.dr < 0 OR final_stage.dr > 1 THEN 'dr out of range' WHEN final_stage.exact_entity_dr > final_stage.dr THEN 'exact above relaxed'
    WHEN abs(final_stage.dr - len(list_distinct(final_stage.hit_dependencies)) / final_stage.dependency_count::DOUBLE) > 1e-9 THEN 'dr is not hits over dependencies' END AS rule FROM runs) WHERE rule IS NOT NULL"""
)
def invariant_violations(s, d):
    """Runs that break a rule of the archive; a sound one has none."""
    f = table(s, d, "agent_result", "run_id", "final_stage").distinct()
    dr, n = F.col("final_stage.dr"), F.size(F.array_distinct(F.filter("final_stage.hit_dependencies", lambda x: x.isNotNull())))
    rule = F.when((dr < 0) | (dr > 1), "dr out of range").when(F.col("final_stage.exact_entity_dr") > dr, "exact above relaxed").when(F.abs(dr - E.ratio(n, F.col("final_stage.dependency_count"))) > 1e-9, "dr is not hits over dependencies")
    return f.select("run_id", rule.alias("rule")).where("rule is not null")


@query(
    f"""WITH {LOC}, {B.NAMES}, code AS (SELECT name, arg_min(method_code, meth.id) AS method_code FROM names JOIN meth USING (id) WHERE method_code IS NOT NULL GROUP BY name)
    SELECT run_id, sig, round(max(CASE WHEN greatest(length(code), length(method_code)) = 0 THEN 1.0 ELSE 1 - levenshtein(regexp_replace(code, '[^\\x00-\\x7F]', '?', 'g'), regexp_replace(method_code, '[^\\x00-\\x7F]', '?', 'g')) / greatest(length(code), length(method_code))::DOUBLE END), 6) AS similarity, bool_or(code = method_code) AS exact
    FROM loc JOIN code ON sig = name GROUP BY run_id, sig"""
)
def edit_similarity(s, d):
    """Code of a located entity against the method of its name."""
    from codestrata.operators.relational import first_wins

    m = B.methods(s, d, "method_signature", "method_code").select("id", T.no_args("method_signature").alias("sig"), "method_code").where("method_code is not null")
    one = first_wins(m, ["sig"], ["id"], ["method_code"])
    j = _context(s, d).join(one, "sig")
    return j.groupBy(F.col("key").alias("run_id"), "sig").agg(F.round(F.max(E.edit_similarity("code", "method_code")), 6).alias("similarity"), F.bool_or(F.col("code") == F.col("method_code")).alias("exact"))


@query(f"WITH {B.METHODS} SELECT func_file, CAST(count(*) AS BIGINT) AS n, round(avg(length(method_code)), 6) AS mean_len, round(quantile_cont(length(method_code), 0.5), 6) AS median_len, round(quantile_cont(length(method_code), 0.9), 6) AS p90_len, CAST(max(length(method_code)) AS BIGINT) AS max_len, CAST(count(*) FILTER (coalesce(method_code, '') = '') AS BIGINT) AS empty FROM meth GROUP BY func_file")
def percentiles(s, d):
    m = B.methods(s, d, "func_file", "method_code").withColumn("n", F.length("method_code"))
    q = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9)))
    g = m.groupBy("func_file").agg(F.count("*").alias("rows"), F.avg("n").alias("a"), q.alias("q"), F.max("n").alias("m"), F.count_if(F.coalesce("method_code", F.lit("")) == "").alias("empty"))
    return g.select("func_file", F.col("rows").alias("n"), F.round("a", 6).alias("mean_len"), F.round(F.col("q")[0], 6).alias("median_len"), F.round(F.col("q")[1], 6).alias("p90_len"), F.col("m").cast("long").alias("max_len"), "empty")


@query(
    f"""WITH {B.METHODS}, e AS (SELECT * FROM (VALUES (0, 100), (100, 200), (200, 300), (300, 400), (400, 600), (600, 800), (800, 1000), (1000, NULL)) t(lo, hi)), v AS (SELECT length(method_code) AS n FROM meth WHERE method_code IS NOT NULL)
    SELECT lo::DOUBLE AS lo, hi::DOUBLE AS hi, CAST((SELECT count(*) FROM v WHERE (n > lo OR (lo = 0 AND n >= 0)) AND (hi IS NULL OR n <= hi)) AS BIGINT) AS n FROM e"""
)
def histogram_right_closed(s, d):
    v = B.methods(s, d, "method_code").where("method_code is not null").select(F.length("method_code").alias("n"))
    return E.right_closed_bins(v, "n", [0, 100, 200, 300, 400, 600, 800, 1000])


@query(
    f"""WITH {B.DEPENDENCIES}, n AS (SELECT example_id, count(*) AS n FROM deps GROUP BY 1), t AS (SELECT example_id, lower(replace({B.sql_strip('project_path')}, '\\', '/')) AS p FROM tasks WHERE project_path IS NOT NULL),
    x AS (SELECT split_part(p, '/', 1) AS domain, p, example_id, coalesce(n, 0) AS n FROM t LEFT JOIN n USING (example_id)), f AS (SELECT lower(project_path) AS p, python_function_count AS f FROM projects)
    SELECT coalesce(domain, 'ALL') AS domain, CAST(count(*) AS BIGINT) AS tasks, CAST(count(DISTINCT x.p) AS BIGINT) AS projects, round(avg(n), 6) AS mean_deps, round(avg(f), 6) AS mean_functions FROM x LEFT JOIN f ON x.p = f.p GROUP BY GROUPING SETS ((domain), ())"""
)
def domain_rollup(s, d):
    n = B.dependencies(s, d).groupBy("example_id").agg(F.count("*").alias("n"))
    t = B.tasks(s, d, "project_path").where("project_path is not null").select("example_id", T.project_key("project_path").alias("p"))
    f = table(s, d, "projects", "project_path", "python_function_count").select(F.lower("project_path").alias("p"), F.col("python_function_count").alias("f"))
    x = t.join(n, "example_id", "left").join(f, "p", "left").withColumn("domain", F.substring_index("p", "/", 1))
    g = x.groupingSets([[F.col("domain")], []], "domain").agg(F.count("*").alias("tasks"), F.count_distinct("p").alias("projects"), F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("mean_deps"), F.round(F.avg("f"), 6).alias("mean_functions"))
    return g.withColumn("domain", F.coalesce("domain", F.lit("ALL")))


@query(
    f"""WITH {B.TASKS} SELECT coalesce({B.sql_strip('project_path')}, '(missing)') AS project, CAST(count(*) AS BIGINT) AS n FROM tasks GROUP BY 1 ORDER BY n DESC, project LIMIT 20"""
)
def count_by_project(s, d):
    """The 20 projects with most tasks, missing ones counted."""
    p = F.coalesce(T.strip("project_path"), F.lit("(missing)"))
    return B.tasks(s, d, "project_path").groupBy(p.alias("project")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(20)


@query(
    f"""WITH {B.METHODS}, {B.DEPENDENCIES}, u AS (SELECT dep, count(*) AS uses FROM deps GROUP BY 1) SELECT id, func_file, CAST(length(method_code) AS BIGINT) AS chars, CAST(len(string_split(method_code, chr(10))) AS BIGINT) AS lines, CAST(coalesce(uses, 0) AS BIGINT) AS uses
    FROM meth LEFT JOIN u ON {B.sql_strip("split_part(method_signature, '(', 1)")} = dep"""
)
def method_inventory(s, d):
    u = B.dependencies(s, d).groupBy("dep").agg(F.count("*").alias("uses"))
    m = B.methods(s, d, "method_signature", "func_file", "method_code").withColumn("dep", T.no_args("method_signature"))
    return m.join(u, "dep", "left").select("id", "func_file", F.length("method_code").cast("long").alias("chars"), F.size(F.split("method_code", "\n")).cast("long").alias("lines"), F.coalesce("uses", F.lit(0)).cast("long").alias("uses")).withColumn("lines", F.when(F.col("chars").isNotNull(), F.col("lines")))
