"""Graph queries over the code graph (tasks use dependencies) and the supplier-part graph of lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import graph as G
from codestrata.plans import base as B
from codestrata.plans.catalog import query
from codestrata.session import cut
from codestrata.sources.tables import table

SEEDS = (
    B.CODE_GRAPH
    + """, seeds AS (SELECT task_id, node, bool_or(regexp_replace(node, '\\.?[^.]*$', '') = regexp_replace(namespace, '\\.?[^.]*$', '')) AS same_owner, bool_or(split_part(node, '.', 1) = split_part(namespace, '.', 1)) AS same_root, bool_or(category = 'Function') AS is_function
      FROM (SELECT DISTINCT task_id, namespace, e.symbol AS node FROM (SELECT task_id, namespace, unnest(final_locations.entities) AS e FROM agent_result)) JOIN nodes USING (node) GROUP BY task_id, node)"""
)


def _seeds(s, d):
    e = table(s, d, "agent_result", "task_id", "namespace", "final_locations").select("task_id", "namespace", F.explode("final_locations.entities").alias("e")).select("task_id", "namespace", F.col("e.symbol").alias("node")).distinct()
    same = lambda f: F.bool_or(f("node") == f("namespace"))
    root = lambda c: F.substring_index(c, ".", 1)
    return e.join(B.code_nodes(s, d), "node").groupBy("task_id", "node").agg(same(T.parent_part).alias("same_owner"), same(root).alias("same_root"), F.bool_or(F.col("category") == "Function").alias("is_function"))


@query(f"WITH {SEEDS} SELECT * FROM seeds")
def seed_nodes(s, d):
    return _seeds(s, d)


@query(f"WITH {SEEDS} SELECT CAST(count(DISTINCT task_id) AS BIGINT) AS tasks, CAST(count(DISTINCT task_id) FILTER (same_owner) AS BIGINT) AS with_owner, CAST(count(DISTINCT task_id) FILTER (same_root) AS BIGINT) AS with_root FROM seeds")
def seed_summary(s, d):
    when = lambda c: F.count_distinct(F.when(F.col(c), F.col("task_id")))
    return _seeds(s, d).agg(F.count_distinct("task_id").alias("tasks"), when("same_owner").alias("with_owner"), when("same_root").alias("with_root"))


LINKS = """links AS (SELECT DISTINCT src, dst, kind FROM edges UNION SELECT DISTINCT dst, src, 'Define' FROM edges WHERE kind = 'Contain')"""


def _links(s, d):
    e = B.code_edges(s, d).select("src", "dst", "kind").distinct()
    return e.unionByName(e.where("kind = 'Contain'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("Define").alias("kind")))


def _own(s, d):
    """Seeds and what the task itself names, the members of a task's graph."""
    deps = B.dependencies(s, d).select(F.col("example_id").alias("task_id"), F.col("dep").alias("node"))
    named = B.tasks(s, d, "namespace").where("namespace is not null").select(F.col("example_id").alias("task_id"), F.col("namespace").alias("node"))
    return deps.unionByName(named).distinct()


OWN = "own AS (SELECT DISTINCT example_id AS task_id, dep AS node FROM deps UNION SELECT example_id, namespace FROM tasks WHERE namespace IS NOT NULL)"


@query(f"WITH {B.CODE_GRAPH}, {LINKS}, {OWN} SELECT a.task_id, src, dst, kind FROM links JOIN own a ON src = a.node JOIN own b ON dst = b.node AND a.task_id = b.task_id")
def induced_subgraph(s, d):
    return G.induced(_links(s, d), _own(s, d), "task_id")


@query(
    f"""WITH {SEEDS}, {LINKS}, sd AS (SELECT task_id, node FROM seeds), x AS (SELECT task_id, dst AS node FROM sd JOIN links ON node = src WHERE kind IN ('Call', 'Use', 'Contain') UNION SELECT task_id, src FROM sd JOIN links ON node = dst WHERE kind = 'Call')
    SELECT task_id, node, 'original' AS src_type FROM sd UNION ALL SELECT task_id, node, 'expand' FROM x WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.task_id = x.task_id AND sd.node = x.node)"""
)
def one_hop_expand(s, d):
    return G.expand_one_hop(_links(s, d), _seeds(s, d), "task_id", ["Call", "Use", "Contain"], ["Call"])


@query(
    f"""WITH {SEEDS}, {LINKS}, u AS (SELECT src AS u, dst AS v FROM links WHERE src <> dst UNION SELECT dst, src FROM links WHERE src <> dst),
    g AS (SELECT task_id, v AS node, round(sum((same_owner::INT + same_root::INT + is_function::INT) * 0.1), 6) AS bonus FROM seeds JOIN u ON node = u WHERE same_owner::INT + same_root::INT + is_function::INT > 0 GROUP BY 1, 2)
    SELECT task_id, node, bonus::DOUBLE AS bonus FROM g WHERE NOT EXISTS (SELECT 1 FROM seeds WHERE seeds.task_id = g.task_id AND seeds.node = g.node)"""
)
def neighbor_bonus(s, d):
    return G.neighbor_bonus(_links(s, d), _seeds(s, d), "task_id", ["same_owner", "same_root", "is_function"])


def _restart(s, d, links):
    seeds = cut(_seeds(s, d), "seeds")
    members = G.expand_one_hop(links, seeds, "task_id", ["Call", "Use", "Contain"], ["Call"])
    bonus = G.neighbor_bonus(links, seeds, "task_id", ["same_owner", "same_root", "is_function"])
    return members.join(bonus, ["task_id", "node"], "left").select("task_id", "node", (F.when(F.col("src_type") == "original", 1.0).otherwise(0.0) + F.coalesce("bonus", F.lit(0.0))).alias("w"))


@query()
def ppr_converged_topk(s, d):
    """The 15 best nodes of every task's graph by converged personalized PageRank, without the task itself."""
    from pyspark.sql.window import Window

    links = cut(_links(s, d), "links")
    restart = cut(_restart(s, d, links), "restart")
    ranks = G.pagerank_by_group(G.induced(links, restart, "task_id"), restart, "task_id").withColumn("rank", F.round("rank", 6))
    target = B.tasks(s, d, "namespace").select(F.col("example_id").alias("task_id"), F.col("namespace").alias("target"))
    from codestrata.operators.relational import outside

    kept = ranks.join(target, "task_id", "left").where(outside("node", "target"))
    w = Window.partitionBy("task_id").orderBy(F.desc("rank"), "node")
    return kept.withColumn("place", F.row_number().over(w)).where("place <= 15").select("task_id", "node", "rank", "place")


PPR_ROUNDS = 10


def _ppr_sql() -> str:
    ctes = [
        "e AS MATERIALIZED (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)",
        "n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e UNION SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0)",
        "w AS (SELECT 's' || s_suppkey AS node, 1.0::DOUBLE AS w FROM supplier WHERE s_acctbal > 0)",
        "b AS MATERIALIZED (SELECT node, coalesce(w, 0) / (SELECT sum(w) FROM w) AS p FROM n LEFT JOIN w USING (node))",
        "sym AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e)",
        "st AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS deg FROM sym)",
        "r0 AS MATERIALIZED (SELECT node, p AS rank FROM b)",
    ]
    for i in range(1, PPR_ROUNDS + 1):
        ctes.append(f"l{i} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{i - 1} WHERE node NOT IN (SELECT src FROM st))")
        ctes.append(f"f{i} AS (SELECT dst AS node, sum(rank / deg) AS flow FROM st JOIN r{i - 1} ON src = node GROUP BY dst)")
        ctes.append(f"r{i} AS MATERIALIZED (SELECT b.node, 0.85 * (coalesce(flow, 0) + lost * p) + 0.15 * p AS rank FROM b LEFT JOIN f{i} USING (node), l{i})")
    return "WITH " + ", ".join(ctes) + f" SELECT node, round(rank, 9) AS rank FROM r{PPR_ROUNDS}"


@query(_ppr_sql())
def ppr_fixed_iters(s, d):
    """Ten rounds over the undirected graph of all supplies, restarting at suppliers in credit."""
    li = table(s, d, "lineitem", "l_suppkey", "l_partkey")
    e = li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    restart = table(s, d, "supplier", "s_suppkey", "s_acctbal").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.lit(1.0).alias("w"))
    return G.pagerank(both, restart, rounds=PPR_ROUNDS).select("node", F.round("rank", 9).alias("rank"))


@query(
    f"""WITH RECURSIVE {B.CODE_GRAPH}, u AS MATERIALIZED (SELECT src AS u, dst AS v FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
    src AS (SELECT DISTINCT e.symbol AS node FROM (SELECT unnest(final_locations.entities) AS e FROM agent_result) WHERE e.symbol IN (SELECT node FROM nodes)),
    b(node, dist) USING KEY (node) AS (SELECT node, 0 FROM src UNION SELECT v, min(b.dist) + 1 FROM b JOIN u ON b.node = u.u WHERE NOT EXISTS (SELECT 1 FROM recurring.b r WHERE r.node = v) GROUP BY v)
    SELECT node, CAST(dist AS BIGINT) AS dist FROM b"""
)
def bfs_shortest_path_len(s, d):
    """Steps of every node that a located one reaches, from the nearest, however far."""
    return G.shortest_paths(B.code_edges(s, d), _located(s, d)).select("node", F.col("dist").cast("long").alias("dist"))


def _located(s, d):
    e = table(s, d, "agent_result", "final_locations").select(F.explode("final_locations.entities").alias("e")).select(F.col("e.symbol").alias("node")).distinct()
    return e.join(B.code_nodes(s, d), "node", "left_semi")


TRADE = """edges AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'ordered by' AS kind FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'lives in' FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'based in' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part of' FROM nation)"""


def trade_edges(s, d):
    """(src, dst, kind): orders, customers, suppliers, nations and regions as one graph."""
    one = lambda t, a, x, b, y, kind: table(s, d, t, a, b).select(F.concat(F.lit(x), a).alias("src"), F.concat(F.lit(y), b).alias("dst"), F.lit(kind).alias("kind"))
    return (
        one("orders", "o_orderkey", "o", "o_custkey", "c", "ordered by")
        .unionByName(one("customer", "c_custkey", "c", "c_nationkey", "n", "lives in"))
        .unionByName(one("supplier", "s_suppkey", "s", "s_nationkey", "n", "based in"))
        .unionByName(one("nation", "n_nationkey", "n", "n_regionkey", "r", "part of"))
    )


@query(
    f"""WITH {TRADE}, k AS (SELECT src, dst, array_to_string(list_sort(list_distinct(list(kind))), '|') AS kinds FROM edges WHERE src <> dst GROUP BY 1, 2)
    SELECT a.kinds || '>' || b.kinds AS pattern, CAST(count(*) AS BIGINT) AS n FROM k a JOIN k b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY 1 ORDER BY n DESC, pattern LIMIT 50"""
)
def path_pattern_hist(s, d):
    """The 50 most frequent patterns of two steps in the trade graph."""
    return G.two_step_patterns(trade_edges(s, d)).select("pattern", F.col("n").cast("long").alias("n")).orderBy(F.desc("n"), "pattern").limit(50)


@query()
def missing_path_patterns(s, d):
    """Named dependencies that a task's located symbols lack, by how the graph leads to them: (measure, value, n) with the
    counts of all, matched, missing outside the graph, unreachable and reachable ones, and of reachable ones
    by length and by pattern. Every mention counts; tasks without a run count in "ground truth" only."""
    deps = B.dependencies(s, d).groupBy(F.col("example_id").alias("task_id"), F.col("dep").alias("node")).agg(F.count("*").alias("n"))
    nodes = cut(B.code_nodes(s, d), "nodes")
    located = table(s, d, "agent_result", "task_id", "final_locations").select("task_id", F.explode("final_locations.entities").alias("e")).select("task_id", F.col("e.symbol").alias("node")).distinct()
    seeds = cut(located.join(nodes, "node", "left_semi"), "seeds")
    ran = table(s, d, "agent_result", "task_id").distinct().withColumn("ran", F.lit(1))
    marks = deps.join(ran, "task_id", "left").join(seeds.withColumn("seed", F.lit(1)), ["task_id", "node"], "left").join(nodes.select("node", F.lit(1).alias("known")), "node", "left")
    marks = cut(marks, "marks")
    missing = marks.where("ran = 1 and seed is null")
    paths = cut(G.path_patterns(B.code_edges(s, d), nodes, seeds, missing.where("known = 1"), "task_id"), "paths")
    found = missing.join(paths.withColumnRenamed("target", "node"), ["task_id", "node"], "left")
    state = F.when(F.col("known").isNull(), "missing, not in graph").when(F.col("length").isNull(), "missing, unreachable").otherwise("missing, reachable")
    counted = lambda df, measure, value: df.groupBy(measure.alias("measure"), value.alias("value")).agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    out = counted(marks, F.lit("ground truth"), none).unionByName(counted(marks.where("ran = 1 and seed = 1"), F.lit("matched"), none)).unionByName(counted(found, state, none))
    reached = found.where("length is not null")
    return out.unionByName(counted(reached, F.lit("length"), F.col("length").cast("string"))).unionByName(counted(reached, F.lit("pattern"), F.col("pattern")))


@query(f"WITH {B.CODE_GRAPH} SELECT src, dst, array_to_string(list_sort(list_distinct(list(kind))), '|') AS kinds FROM edges GROUP BY 1, 2")
def kinds_digraph(s, d):
    return G.kinds_between(B.code_edges(s, d))


@query(
    f"""WITH {B.CODE_GRAPH} SELECT kind, a.category AS src_category, b.category AS dst_category, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT src, dst, kind FROM edges) e JOIN nodes a ON src = a.node JOIN nodes b ON dst = b.node
    WHERE NOT (dst = src OR starts_with(dst, src || '.')) GROUP BY ALL ORDER BY n DESC, kind, src_category, dst_category LIMIT 50"""
)
def relation_histogram(s, d):
    """Relations by kind and category of both ends, what lies inside the source left out."""
    from codestrata.operators.relational import outside

    n = B.code_nodes(s, d)
    e = B.code_edges(s, d).select("src", "dst", "kind").distinct().where(outside("dst", "src"))
    e = e.join(n.select(F.col("node").alias("src"), F.col("category").alias("src_category")), "src").join(n.select(F.col("node").alias("dst"), F.col("category").alias("dst_category")), "dst")
    return e.groupBy("kind", "src_category", "dst_category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind", "src_category", "dst_category").limit(50)


@query(
    f"""WITH {B.CODE_GRAPH}, a AS (SELECT DISTINCT src, dst FROM edges), b AS (SELECT DISTINCT namespace AS src, h AS dst FROM (SELECT namespace, unnest(final_stage.hit_dependencies) AS h FROM agent_result) WHERE namespace IS NOT NULL AND h IS NOT NULL)
    SELECT src, dst, 'base only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT src, dst, 'other only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
)
def graph_diff(s, d):
    """Dependencies that no run found, and found ones that the tasks do not name."""
    found = table(s, d, "agent_result", "namespace", "final_stage").select(F.col("namespace").alias("src"), F.explode("final_stage.hit_dependencies").alias("dst")).where("src is not null and dst is not null")
    return G.difference(B.code_edges(s, d), found, ["src", "dst"])


@query(
    f"""WITH {B.DEPENDENCIES}, x AS (SELECT kind, regexp_replace(namespace, '\\.?[^.]*$', '') AS owner, regexp_replace(dep, '\\.?[^.]*$', '') AS dep_owner, split_part(namespace, '.', 1) = split_part(dep, '.', 1) AS root FROM deps WHERE namespace IS NOT NULL)
    SELECT kind, CASE WHEN owner = dep_owner THEN 'same owner' WHEN starts_with(dep_owner, owner) OR starts_with(owner, dep_owner) THEN 'nested' WHEN root THEN 'same root' ELSE 'other' END AS place, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1, 2"""
)
def edge_class(s, d):
    """What the names alone say of a relation, against its declared kind."""
    x = B.dependencies(s, d).where("namespace is not null").select("kind", T.parent_part("namespace").alias("o"), T.parent_part("dep").alias("p"), (F.substring_index("namespace", ".", 1) == F.substring_index("dep", ".", 1)).alias("root"))
    place = F.when(F.col("o") == F.col("p"), "same owner").when(F.startswith("p", "o") | F.startswith("o", "p"), "nested").when(F.col("root"), "same root").otherwise("other")
    return x.groupBy("kind", place.alias("place")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {B.DEPENDENCIES}, {B.NAMES}, o AS (SELECT split_part(name, '.', -1) AS short, count(DISTINCT regexp_replace(name, '\\.?[^.]*$', '')) AS owners FROM names WHERE name IS NOT NULL GROUP BY 1)
    SELECT short, CAST(count(*) AS BIGINT) AS uses, CAST(coalesce(max(owners), 0) AS BIGINT) AS owners, CASE WHEN coalesce(max(owners), 0) = 0 THEN 'unresolved' WHEN max(owners) = 1 THEN 'definite' ELSE 'ambiguous' END AS state
    FROM (SELECT split_part(dep, '.', -1) AS short FROM deps) LEFT JOIN o USING (short) GROUP BY short"""
)
def ambiguous_resolution(s, d):
    n = B.method_names(s, d).where("name is not null")
    o = n.groupBy(T.last_part("name").alias("short")).agg(F.count_distinct(T.parent_part("name")).alias("owners"))
    u = B.dependencies(s, d).groupBy(T.last_part("dep").alias("short")).agg(F.count("*").alias("uses")).join(o, "short", "left").withColumn("owners", F.coalesce("owners", F.lit(0)).cast("long"))
    return u.select("short", "uses", "owners", F.when(F.col("owners") == 0, "unresolved").when(F.col("owners") == 1, "definite").otherwise("ambiguous").alias("state"))


@query(
    f"""WITH {B.DEPENDENCIES}, {B.NAMES}, m AS (SELECT DISTINCT split_part(name, '.', -1) AS short, name FROM names WHERE name IS NOT NULL) SELECT dep, CAST(count(*) AS BIGINT) AS targets, min(name) AS first FROM (SELECT DISTINCT dep FROM deps) JOIN m ON split_part(dep, '.', -1) = short GROUP BY dep"""
)
def same_name_fan_out(s, d):
    """Methods of the same last segment. They are counted by it before the join, so a name that very many share is one row there."""
    m = B.method_names(s, d).where("name is not null").select(T.last_part("name").alias("short"), "name").distinct()
    m = m.groupBy("short").agg(F.count("*").alias("targets"), F.min("name").alias("first"))
    return B.dependencies(s, d).select("dep", T.last_part("dep").alias("short")).distinct().join(m, "short").select("dep", "targets", "first")


@query(
    f"""WITH {B.DEPENDENCIES}, {B.NAMES}, f AS (SELECT regexp_extract(name, '^[^.]*\\.[^.]*') AS module, arg_min(file, id) AS file FROM names WHERE file IS NOT NULL AND name IS NOT NULL GROUP BY 1)
    SELECT a.file AS src_file, b.file AS dst_file, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT namespace, dep FROM deps) JOIN f a ON regexp_extract(namespace, '^[^.]*\\.[^.]*') = a.module JOIN f b ON regexp_extract(dep, '^[^.]*\\.[^.]*') = b.module WHERE a.module <> '' AND b.module <> '' AND a.file <> b.file GROUP BY 1, 2"""
)
def file_adjacency(s, d):
    """Relations between files, a name belonging to the file of its module (its first two segments)."""
    from codestrata.operators.relational import first_wins

    module = lambda c: F.regexp_extract(c, r"^[^.]*\.[^.]*", 0)
    named = B.method_names(s, d).where("file is not null and name is not null").withColumn("module", module("name"))
    f = first_wins(named, ["module"], ["id"], ["file"]).where("module <> ''")
    e = B.dependencies(s, d).select("namespace", "dep").distinct().select(module("namespace").alias("a"), module("dep").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    e = e.join(f.select(F.col("module").alias("a"), F.col("file").alias("src_file")), "a").join(f.select(F.col("module").alias("b"), F.col("file").alias("dst_file")), "b")
    return e.where("src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.sum("n").alias("n"))


@query(f"WITH {B.CODE_GRAPH} SELECT src, array_to_string(list_sort(list_distinct(list(dst))), '|') AS targets FROM edges GROUP BY src")
def name_adjacency(s, d):
    return B.code_edges(s, d).groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), "|").alias("targets"))


@query(
    f"""WITH {B.CODE_GRAPH}, x AS (SELECT regexp_replace(src, '\\.?[^.]*$', '') AS a, regexp_replace(dst, '\\.?[^.]*$', '') AS b, kind FROM edges) SELECT a AS src, b AS dst, kind, CAST(count(*) AS BIGINT) AS n FROM x WHERE a <> b AND a <> '' AND b <> '' GROUP BY ALL"""
)
def collapse_inner(s, d):
    """Nodes are drawn into what holds them; relations inside of it vanish."""
    e = B.code_edges(s, d).select(T.parent_part("src").alias("src"), T.parent_part("dst").alias("dst"), "kind")
    return e.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {B.DEPENDENCIES}, p AS (SELECT DISTINCT string_split(dep, '.') AS p FROM deps WHERE contains(dep, '.')), q AS MATERIALIZED (SELECT DISTINCT array_to_string(p[1:k], '.') AS src, array_to_string(p[1:k - 1], '.') AS dst FROM (SELECT p, unnest(range(2, len(p) + 1)) AS k FROM p)),
    c(src, dst, depth) AS (SELECT src, dst, 1 FROM q UNION SELECT c.src, q.dst, depth + 1 FROM c JOIN q ON c.dst = q.src)
    SELECT src, dst, CAST(min(depth) AS BIGINT) AS depth FROM c GROUP BY 1, 2"""
)
def ancestor_closure(s, d):
    """Everything that holds a name, by steps: the closure of the parent relation."""
    parts = B.dependencies(s, d).select(F.split("dep", r"\.").alias("p")).where(F.size("p") > 1).distinct()
    name = lambda n: F.array_join(F.slice("p", F.lit(1), n), ".")
    e = parts.select("p", F.explode(F.sequence(F.lit(2), F.size("p"))).alias("k")).select(name(F.col("k")).alias("src"), name(F.col("k") - 1).alias("dst"))
    return G.closure(e).select("src", "dst", F.col("depth").cast("long").alias("depth"))


@query(
    f"""WITH {B.DEPENDENCIES}, {B.NAMES}, f AS (SELECT name, arg_min(file, id) AS file FROM names WHERE file IS NOT NULL AND name IS NOT NULL GROUP BY name), e AS (SELECT DISTINCT namespace, dep, kind FROM deps)
    SELECT file, CAST(count(*) AS BIGINT) AS relations FROM (SELECT file, namespace, dep, kind FROM e JOIN f ON namespace = name UNION SELECT file, namespace, dep, kind FROM e JOIN f ON dep = name) GROUP BY file"""
)
def relations_by_file(s, d):
    """Relations listed with the files of both ends, once a file."""
    from codestrata.operators.relational import first_wins

    f = first_wins(B.method_names(s, d).where("file is not null and name is not null"), ["name"], ["id"], ["file"])
    e = B.dependencies(s, d).select("namespace", "dep", "kind").distinct()
    both = e.join(f.withColumnRenamed("name", "namespace"), "namespace").select("file", "namespace", "dep", "kind").unionByName(e.join(f.withColumnRenamed("name", "dep"), "dep").select("file", "namespace", "dep", "kind"))
    return both.distinct().groupBy("file").agg(F.count("*").alias("relations"))


@query(
    f"""WITH {B.NAMES}, m AS (SELECT DISTINCT name, split_part(name, '.', -1) AS short, regexp_replace(name, '\\.?[^.]*$', '') AS owner FROM names WHERE name IS NOT NULL)
    SELECT owner, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (regexp_matches(short, '^__.*__$')) AS BIGINT) AS special, CAST(count(*) FILTER (regexp_matches(short, '^_') AND NOT regexp_matches(short, '^__.*__$')) AS BIGINT) AS private FROM m GROUP BY owner"""
)
def visibility(s, d):
    m = B.method_names(s, d).where("name is not null").select("name").distinct().select(T.last_part("name").alias("short"), T.parent_part("name").alias("owner"))
    special = F.col("short").rlike("^__.*__$")
    return m.groupBy("owner").agg(F.count("*").alias("n"), F.count_if(special).alias("special"), F.count_if(F.col("short").rlike("^_") & ~special).alias("private"))
