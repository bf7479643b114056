"""Clustering queries: embeddings inside their label (module), partitions of documents, links between files."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import clustering as C
from codestrata.operators.numbering import number_in_order
from codestrata.plans import base as B
from codestrata.plans.catalog import query
from codestrata.plans.retrieval import VEC, _vectors
from codestrata.sources.tables import table

PAIRS = VEC + ', p AS MATERIALIZED (SELECT a.label AS g, a.vec_id AS i, b.vec_id AS j, (list_dot_product(a.v, b.v) + 1) / 2 AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id)'
SYM = "sym AS MATERIALIZED (SELECT g, i, j, w FROM p UNION ALL SELECT g, j, i, w FROM p)"


def _knn(name: str, k: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT g, least(i, j) AS i, greatest(i, j) AS j, max(w) AS w FROM (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY round(w, 9) DESC, j) AS r FROM sym JOIN (SELECT g, count(DISTINCT i) AS m FROM sym GROUP BY g) USING (g)) WHERE r <= {k} GROUP BY ALL)"""


def _grouped(s, d):
    return _vectors(s, d).select(F.col("label").alias("group"), F.col("vec_id").alias("id"), "v")


DYNAMIC = "least(greatest(least(greatest(floor(2.5 * sqrt(m)), 3), 30), 1), m - 1)"


@query(f"WITH {PAIRS}, {SYM}, {_knn('k', DYNAMIC)} SELECT g AS \"group\", i, j, round(w, 6) AS w FROM k")
def knn_graph(s, d):
    return C.nearest(C.similarity_pairs(_grouped(s, d)), C.dynamic_k(F.col("m"))).withColumn("w", F.round("w", 6))


@query(
    f"""WITH {PAIRS}, {SYM}, {_knn('l', '3')}, n AS (SELECT g, i, j, CASE WHEN hi > lo THEN (w - lo) / (hi - lo) ELSE 0 END AS w FROM (SELECT *, least(min(w) OVER (PARTITION BY g), 0) AS lo, greatest(max(w) OVER (PARTITION BY g), 0) AS hi FROM p))
    SELECT g AS "group", CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (f >= 0.5) AS BIGINT) AS strong, round(sum(f), 4) AS total FROM (SELECT coalesce(n.g, l.g) AS g, round(0.25 * coalesce(n.w, 0) + 0.75 * CASE WHEN l.w IS NULL THEN 0 ELSE 1 END, 6) AS f FROM n FULL OUTER JOIN l ON n.g = l.g AND n.i = l.i AND n.j = l.j) GROUP BY g"""
)
def sim_matrix_fused(s, d):
    """Scaled similarities fused with links to the three nearest, and what a threshold of 0.5 leaves."""
    p = C.similarity_pairs(_grouped(s, d))
    f = C.fuse(C.scaled(p), C.nearest(p, 3).withColumn("w", F.lit(1.0)), 0.25).withColumn("w", F.round("w", 6))
    return f.groupBy("group").agg(F.count("*").alias("pairs"), F.count_if(F.col("w") >= 0.5).alias("strong"), F.round(F.sum("w"), 4).alias("total"))


LAB = "lab AS (SELECT label AS g, vec_id AS id, vec_id % 4 AS c FROM v)"


@query(
    f"""WITH {PAIRS}, {LAB}, x AS (SELECT p.g, a.c AS a, b.c AS b, sum(w) AS s FROM p JOIN lab a ON p.g = a.g AND p.i = a.id JOIN lab b ON p.g = b.g AND p.j = b.id GROUP BY ALL), sz AS (SELECT g, c AS a, count(*) AS n FROM lab GROUP BY ALL),
    de AS (SELECT g, a, n, coalesce(s, 0) / (n * (n - 1) / 2) AS dens FROM sz LEFT JOIN (SELECT g, a, sum(s) AS s FROM x WHERE a = b GROUP BY g, a) USING (g, a) WHERE n > 1),
    it AS (SELECT g, sum(dens * n) / sum(n) AS intra, stddev_pop(dens) AS spread FROM de GROUP BY g), t AS (SELECT g, (sum(n) * sum(n) - sum(n * n)) / 2 AS cross_n FROM sz GROUP BY g), ie AS (SELECT g, sum(s) AS s FROM x WHERE a <> b GROUP BY g)
    SELECT g AS "group", round(coalesce(intra, 0), 6) AS intra, round(coalesce(coalesce(s, 0) / nullif(cross_n, 0), 0), 6) AS inter, round(coalesce(intra, 0) - coalesce(coalesce(s, 0) / nullif(cross_n, 0), 0), 6) AS separation, round(coalesce(spread, 0), 6) AS density_std FROM t LEFT JOIN it USING (g) LEFT JOIN ie USING (g)"""
)
def cluster_quality(s, d):
    g = _grouped(s, d)
    return C.separation(C.similarity_pairs(g), g.select("group", "id", (F.col("id") % 4).alias("label")))


@query(
    f"""WITH x AS (SELECT lower({B.sql_strip('source')}) AS s, project_path AS label FROM documents WHERE project_path IS NOT NULL AND source IS NOT NULL), z AS (SELECT s, label, count(*) AS c FROM x GROUP BY ALL)
    SELECT s AS source, CAST(sum(c) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS clusters, round(count(*) FILTER (c = 1) / count(*)::DOUBLE, 6) AS singleton_share, round(count(*) FILTER (c <= 3) / count(*)::DOUBLE, 6) AS tiny_share, round(stddev_pop(c) / avg(c), 6) AS cv FROM z GROUP BY s"""
)
def cluster_size_stats(s, d):
    x = table(s, d, "documents", "source", "project_path").where("source is not null and project_path is not null")
    return C.size_stats(x.select(F.lower(T.strip("source")).alias("source"), F.col("project_path").alias("label")), ["source"])


ARI = f"x AS (SELECT coalesce(lang, '') AS a, coalesce(lower({B.sql_strip('source')}), '') AS b, coalesce(project_path, '') AS c FROM documents)"


def _ari_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}-{b}' AS pair, (SELECT count(*) FROM x) AS n, round((ij - ai * bj / t) / ((ai + bj) / 2 - ai * bj / t), 6) AS ari FROM (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*)::DOUBLE AS n FROM x GROUP BY {a}, {b})) AS ij,
    (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*)::DOUBLE AS n FROM x GROUP BY {a})) AS ai, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*)::DOUBLE AS n FROM x GROUP BY {b})) AS bj, (SELECT count(*)::DOUBLE * (count(*) - 1) / 2 FROM x) AS t)"""


@query(f"WITH {ARI} {_ari_sql('a', 'b')} UNION ALL {_ari_sql('a', 'c')} UNION ALL {_ari_sql('b', 'c')}")
def pairwise_ari(s, d):
    """Adjusted Rand index of language, source and project as partitions of the documents."""
    x = table(s, d, "documents", "lang", "source", "project_path").select(F.coalesce("lang", F.lit("")).alias("a"), F.coalesce(F.lower(T.strip("source")), F.lit("")).alias("b"), F.coalesce("project_path", F.lit("")).alias("c"))
    parts = [C.adjusted_rand(x, p, q).withColumn("pair", F.lit(f"{p}-{q}")) for p, q in (("a", "b"), ("a", "c"), ("b", "c"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""WITH {VEC}, r AS (SELECT label AS g, vec_id AS id, 0 AS run, vec_id % 3 AS c FROM v UNION ALL SELECT label, vec_id, 1, vec_id % 4 FROM v UNION ALL SELECT label, vec_id, 2, vec_id % 5 FROM v)
    SELECT a.g AS "group", a.id AS i, b.id AS j, round(count(*) / 3.0::DOUBLE, 6) AS w FROM r a JOIN r b ON a.g = b.g AND a.run = b.run AND a.c = b.c AND a.id < b.id GROUP BY ALL"""
)
def coassociation(s, d):
    g = _grouped(s, d)
    runs = F.explode(F.array(*(F.struct(F.lit(i).alias("run"), (F.col("id") % m).alias("label")) for i, m in enumerate((3, 4, 5)))))
    return C.coassociation(g.select("group", "id", runs.alias("r")).select("group", "id", "r.run", "r.label"), 3).withColumn("w", F.round("w", 6))


LP_ROUNDS = 4


def _lp_sql() -> str:
    steps = ["b0 AS MATERIALIZED (SELECT label AS g, vec_id AS id, vec_id AS l FROM v)", "s2 AS MATERIALIZED (SELECT g, i, j, w FROM k UNION ALL SELECT g, j, i, w FROM k)"]
    for n in range(1, LP_ROUNDS + 1):
        steps.append(f"v{n} AS (SELECT s2.g, i AS id, l, round(sum(w), 6) AS v FROM s2 JOIN b{n - 1} b ON s2.g = b.g AND s2.j = b.id GROUP BY ALL)")
        steps.append(f"b{n} AS MATERIALIZED (SELECT b.g, b.id, coalesce(x.l, b.id) AS l FROM b0 b LEFT JOIN (SELECT g, id, arg_min(l, (-v, l)) AS l FROM v{n} GROUP BY g, id) x ON b.g = x.g AND b.id = x.id)")
    return f"WITH {PAIRS}, {SYM}, {_knn('k', '3')}, " + ", ".join(steps) + f' SELECT g AS "group", id, l AS label FROM b{LP_ROUNDS}'


@query(_lp_sql())
def label_propagation(s, d):
    """Labels of the three-nearest graph after four rounds; a deterministic stand-in for a modularity library."""
    g = _grouped(s, d)
    return C.propagate(C.nearest(C.similarity_pairs(g), 3), g, LP_ROUNDS)


@query()
def gamma_sweep_best(s, d):
    """Communities of each module at the resolution with the best separation, tiny ones merged. The share of clusters of
    one member is taken off the separation."""
    g = _grouped(s, d)
    knn = C.cut(C.nearest(C.similarity_pairs(g), C.dynamic_k(F.col("m"))), "knn")
    found = C.cut(C.communities(knn, g, [0.3, 0.5, 0.55, 0.6, 0.65]), "found")
    gamma = F.concat_ws(":", F.col("group").cast("string"), F.col("gamma").cast("string"))
    named = found.withColumn("group", gamma)
    pairs = knn.join(found.select("group", "gamma").distinct(), "group").withColumn("group", gamma)
    score = C.separation(pairs, named).join(C.size_stats(named, ["group"]), "group").select("group", (F.col("separation") - F.col("singleton_share")).alias("score"))
    keyed = found.select("group", "gamma").distinct().select(F.col("group").alias("module"), "gamma", gamma.alias("group")).join(score, "group")
    best = keyed.groupBy("module").agg(F.max_by("gamma", F.struct("score", -F.col("gamma"))).alias("gamma")).withColumnRenamed("module", "group")
    chosen = found.join(best, ["group", "gamma"]).select("group", "id", "label")
    return C.merge_tiny(knn, chosen).join(best, "group")


@query(
    f"""WITH {B.METHODS}, {B.DEPENDENCIES}, f AS (SELECT DISTINCT func_file, regexp_extract(func_file, '([^/]+)\\.py$', 1) AS base FROM meth WHERE func_file IS NOT NULL), n AS (SELECT DISTINCT completion_path, dep FROM deps JOIN tasks USING (example_id) WHERE completion_path IS NOT NULL),
    w AS (SELECT DISTINCT func_file, unnest(regexp_extract_all(method_code, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM meth WHERE func_file IS NOT NULL UNION SELECT completion_path, unnest(regexp_extract_all(dep, '[A-Za-z_][A-Za-z0-9_]*')) FROM n)
    SELECT DISTINCT least(w.func_file, f.func_file) AS i, greatest(w.func_file, f.func_file) AS j FROM w JOIN f ON word = base AND w.func_file <> f.func_file"""
)
def identifier_links(s, d):
    """Files whose name stands among the identifiers of another file: those of its code and of what its tasks use."""
    m = B.methods(s, d, "func_file", "method_code").where("func_file is not null")
    f = m.select(F.col("func_file").alias("other"), F.regexp_extract("func_file", r"([^/]+)\.py$", 1).alias("word")).distinct()
    paths = B.tasks(s, d, "completion_path").where("completion_path is not null")
    used = B.dependencies(s, d).join(paths, "example_id").select(F.col("completion_path").alias("func_file"), "dep").distinct()
    words = lambda c: F.explode(F.array_distinct(T.identifiers(c))).alias("word")
    w = m.select("func_file", words("method_code")).unionByName(used.select("func_file", words("dep"))).distinct()
    return w.join(f, "word").where("func_file <> other").select(F.least("func_file", "other").alias("i"), F.greatest("func_file", "other").alias("j")).distinct()


@query(f"""WITH {B.METHODS} SELECT CAST(dense_rank() OVER (ORDER BY func_file) AS BIGINT) AS feature, func_file, CAST(count(*) AS BIGINT) AS members, min(id) AS first FROM meth WHERE func_file IS NOT NULL GROUP BY func_file""")
def feature_ids(s, d):
    """Numbered groups of methods; the groups, not the methods, are numbered."""
    g = B.methods(s, d, "func_file").where("func_file is not null").groupBy("func_file").agg(F.count("*").alias("members"), F.min("id").alias("first"))
    return number_in_order(g, ["func_file"], "feature").select("feature", "func_file", "members", "first")


def _three_runs(s, d):
    e = table(s, d, "embeddings", "vec_id", "label").select(F.col("label").alias("group"), F.col("vec_id").alias("id"))
    runs = [F.col("id") % 40, F.col("id") % 20, F.floor(F.col("id") % 40 / 2)]
    return e, e.select("group", "id", F.explode(F.array(*(F.struct(F.lit(i).alias("run"), r.cast("long").alias("label")) for i, r in enumerate(runs)))).alias("r")).select("group", "id", "r.run", "r.label")


@query(
    """WITH RECURSIVE r AS (SELECT label AS g, vec_id AS id, 0 AS run, vec_id % 40 AS l FROM embeddings UNION ALL SELECT label, vec_id, 1, vec_id % 20 FROM embeddings UNION ALL SELECT label, vec_id, 2, vec_id % 40 // 2 FROM embeddings),
    p AS (SELECT a.g, a.id AS i, b.id AS j FROM r a JOIN r b ON a.g = b.g AND a.run = b.run AND a.l = b.l AND a.id < b.id GROUP BY ALL HAVING count(*) / 3.0 >= 0.6 - 1e-9), e AS MATERIALIZED (SELECT g, i, j FROM p UNION SELECT g, j, i FROM p),
    c(g, i, j) AS (SELECT label, vec_id, vec_id FROM embeddings UNION SELECT c.g, c.i, e.j FROM c JOIN e ON c.g = e.g AND c.j = e.i)
    SELECT g AS "group", i AS id, min(j) AS label FROM c GROUP BY 1, 2"""
)
def consensus_clusters(s, d):
    """Clusters of the members that are together in two of three partitions, directly or by way of others."""
    e, runs = _three_runs(s, d)
    return C.consensus(C.coassociation(runs, 3), e, 0.6)


@query(
    f"""WITH {PAIRS}, {LAB}, b AS (SELECT g, i, j, 1 - w AS d FROM p UNION ALL SELECT g, j, i, 1 - w FROM p), t AS (SELECT b.g, b.i, l.c AS other, avg(d) AS d FROM b JOIN lab l ON b.g = l.g AND b.j = l.id GROUP BY ALL),
    o AS (SELECT l.g, l.id, max(d) FILTER (other = c) AS a, min(d) FILTER (other <> c) AS b FROM lab l JOIN t ON l.g = t.g AND l.id = t.i GROUP BY ALL)
    SELECT g AS "group", round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM o WHERE b IS NOT NULL GROUP BY g"""
)
def cluster_silhouette(s, d):
    g = _grouped(s, d)
    return C.silhouette(C.similarity_pairs(g), g.select("group", "id", (F.col("id") % 4).alias("label")))


@query(
    f"""WITH {PAIRS}, {LAB}, x AS (SELECT p.g, avg(w) FILTER (a.c = b.c) AS intra, avg(w) FILTER (a.c <> b.c) AS inter FROM p JOIN lab a ON p.g = a.g AND p.i = a.id JOIN lab b ON p.g = b.g AND p.j = b.id GROUP BY p.g), n AS (SELECT g, count(*) AS m, max(k) AS most FROM (SELECT g, c, count(*) AS k FROM lab GROUP BY ALL) GROUP BY g),
    y AS (SELECT g, intra - inter AS sep, m, most FROM x JOIN n USING (g)) SELECT g AS "group", round(CASE WHEN max(sep) OVER () > min(sep) OVER () THEN (sep - min(sep) OVER ()) / (max(sep) OVER () - min(sep) OVER ()) ELSE 0 END * 0.45 + 0.45 / m - 0.1 / most, 6) AS score FROM y"""
)
def combined_score(s, d):
    """Separation, scaled over the groups, and numbers of clusters and of members in one score, with the weights of the engine's sweep."""
    g = _grouped(s, d)
    lab = g.select("group", "id", (F.col("id") % 4).alias("label"))
    at = lambda c, n: lab.select("group", F.col("id").alias(c), F.col("label").alias(n))
    p = C.similarity_pairs(g).join(at("i", "a"), ["group", "i"]).join(at("j", "b"), ["group", "j"])
    x = p.groupBy("group").agg((F.avg(F.when(F.col("a") == F.col("b"), F.col("w"))) - F.avg(F.when(F.col("a") != F.col("b"), F.col("w")))).alias("sep"))
    n = lab.groupBy("group", "label").agg(F.count("*").alias("k")).groupBy("group").agg(F.count("*").alias("m"), F.max("k").alias("most"))
    scaled = C.scaled_finite(x.withColumn("all", F.lit(1)), ["all"], "sep", "z")  # one row a group
    return scaled.join(n, "group").select("group", F.round(F.col("z") * 0.45 + 0.45 / F.col("m") - 0.1 / F.col("most"), 6).alias("score"))


@query("""SELECT label AS "group", vec_id % 4 AS label, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list(vec_id)), ',') AS members FROM embeddings GROUP BY label, vec_id % 4""")
def cluster_members(s, d):
    e = table(s, d, "embeddings", "vec_id", "label")
    return C.members_of(e.select(F.col("label").alias("group"), F.col("vec_id").alias("id"), (F.col("vec_id") % 4).alias("label")))


@query(f"WITH {B.CODE_GRAPH}, x AS (SELECT DISTINCT least(src, dst) AS i, greatest(src, dst) AS j, regexp_replace(src, '\\.?[^.]*$', '') AS owner FROM edges WHERE src <> dst AND regexp_replace(src, '\\.?[^.]*$', '') = regexp_replace(dst, '\\.?[^.]*$', '')) SELECT owner, i, j, CAST(1 AS BIGINT) AS w FROM x")
def call_links(s, d):
    """Symmetric links of 1 between functions of one owner of which one uses the other."""
    e = B.code_edges(s, d).where("src <> dst").where(T.parent_part("src") == T.parent_part("dst"))
    return e.select(T.parent_part("src").alias("owner"), F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), F.lit(1).cast("long").alias("w")).distinct()
