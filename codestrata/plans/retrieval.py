"""Retrieval over methods, documents and embeddings. Searches take the tasks or vectors whose id is divisible by
50 as their queries, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.functions import text as T
from codestrata.operators import graph as G
from codestrata.operators import retrieval as R
from codestrata.plans import base as B
from codestrata.plans.catalog import query
from codestrata.session import cut
from codestrata.sources.tables import table

WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def sql_words(x: str) -> str:
    return WORDS.format(x)


QUERY_TEXT = "coalesce(requirement.Functionality, '') || ' ' || coalesce(requirement.Arguments, '')"


def bm25_sql(docs: str, queries: str, tail: str, before: str = "") -> str:
    """``docs`` selects (doc, tokens), ``queries`` (query, tokens); ``scores`` (query, doc, score) is for the tail."""
    return f"""WITH {before + ', ' if before else ''} d AS MATERIALIZED ({docs}), q AS MATERIALIZED ({queries}),
    st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d),
    tf AS MATERIALIZED (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(tokens) AS dl, unnest(tokens) AS term FROM d) GROUP BY ALL),
    raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
    idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    a AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest(tokens) AS term FROM q) GROUP BY ALL),
    scores AS MATERIALIZED (SELECT query, doc, sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) AS score FROM a JOIN idf USING (term) JOIN tf USING (term), st GROUP BY query, doc)
    {tail}"""


def rank_sql(k: int, extra: str = "") -> str:
    return f"SELECT query, doc, rank, score{extra} FROM (SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM scores) WHERE rank <= {k}"


TASK_Q = f"SELECT example_id AS query, {sql_words(QUERY_TEXT)} AS tokens FROM tasks WHERE example_id % 50 = 0"
CODE_D = f"SELECT id AS doc, {sql_words(chr(99) + 'oalesce(method_code, ' + chr(39) * 2 + ')')} AS tokens FROM meth"
SIG_WORDS = "regexp_extract_all(lower(regexp_replace(split_part(coalesce(method_signature, ''), '.', -1), '[_(),.:]', ' ', 'g')), '[\\p{L}\\p{N}_]+')"
SIG_D = f"SELECT id AS doc, {SIG_WORDS} AS tokens FROM meth"
BOTH = f"{B.TASKS}, {B.METHODS}"


def _task_queries(s, d, *columns):
    text = F.concat(F.coalesce("requirement.Functionality", F.lit("")), F.lit(" "), F.coalesce("requirement.Arguments", F.lit("")))
    t = B.tasks(s, d, "requirement", *columns).where("example_id % 50 = 0")
    return t.select(F.col("example_id").alias("query"), T.words(text).alias("tokens"), *columns)


def _code_docs(s, d):
    return B.methods(s, d, "method_code").select(F.col("id").alias("doc"), T.words(F.coalesce("method_code", F.lit(""))).alias("tokens"))


def _sig_docs(s, d):
    return B.methods(s, d, "method_signature").select(F.col("id").alias("doc"), T.signature_words("method_signature").alias("tokens"))


@query("SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, " + sql_words("coalesce(text, '')") + " AS w FROM documents)")
def tokenize_docs(s, d):
    w = T.words(F.coalesce("text", F.lit("")))
    return table(s, d, "documents", "doc_id", "text").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query(f"WITH {B.METHODS} SELECT id, array_to_string({SIG_WORDS}, ' ') AS words, split_part(method_signature, '.', -1) AS last FROM meth")
def tokenize_signature(s, d):
    return B.methods(s, d, "method_signature").select("id", F.array_join(T.signature_words("method_signature"), " ").alias("words"), T.last_part("method_signature").alias("last"))


@query("SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM (SELECT doc_id, unnest(" + sql_words("text") + ") AS term FROM documents) GROUP BY term ORDER BY df DESC, term LIMIT 100")
def doc_freq_topk(s, d):
    """The 100 terms that most documents hold."""
    t = table(s, d, "documents", "doc_id", "text").select(F.explode(F.array_distinct(T.words("text"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(100)


@query(bm25_sql(CODE_D, TASK_Q, rank_sql(15), BOTH))
def bm25_code_topk(s, d):
    return R.bm25_top(_code_docs(s, d), _task_queries(s, d), 15).select("query", "doc", F.col("rank").cast("long").alias("rank"), "score")


@query(bm25_sql(SIG_D, TASK_Q, rank_sql(15), BOTH))
def bm25_signature_topk(s, d):
    return R.bm25_top(_sig_docs(s, d), _task_queries(s, d), 15).select("query", "doc", F.col("rank").cast("long").alias("rank"), "score")


DOC_D = "SELECT doc_id AS doc, " + sql_words("coalesce(text, '')") + " AS tokens FROM documents"


@query(bm25_sql(DOC_D, TASK_Q, rank_sql(10), B.TASKS))
def bm25_documents_topk(s, d):
    docs = table(s, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("doc"), T.words(F.coalesce("text", F.lit(""))).alias("tokens"))
    return R.bm25_top(docs, _task_queries(s, d), 10).select("query", "doc", F.col("rank").cast("long").alias("rank"), "score")


@query(
    bm25_sql(
        SIG_D,
        f"SELECT example_id AS query, {sql_words(chr(39) * 2 + ' || coalesce(split_part(namespace, ' + chr(39) + '.' + chr(39) + ', -1), ' + chr(39) * 2 + ')')} AS tokens FROM tasks WHERE example_id % 50 = 0",
        """, r AS (SELECT query, doc, CAST(rank AS BIGINT) AS rank, score FROM (SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM scores) WHERE rank <= 5),
        h AS (SELECT query, count(r.doc) AS had FROM q LEFT JOIN r USING (query) GROUP BY query),
        z AS (SELECT h.query, x.doc, had, row_number() OVER (PARTITION BY h.query ORDER BY x.doc) AS p FROM h, (SELECT doc FROM d ORDER BY doc LIMIT 10) x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query = h.query AND r.doc = x.doc))
        SELECT * FROM r UNION ALL SELECT query, doc, CAST(had + p AS BIGINT), 0.0 FROM z WHERE had + p <= 5""",
        BOTH,
    )
)
def bm25_zero_fill(s, d):
    """Top 5 signatures for the name of a task; methods without a common word fill up with 0."""
    q = B.tasks(s, d, "namespace").where("example_id % 50 = 0").select(F.col("example_id").alias("query"), T.words(F.coalesce(T.last_part("namespace"), F.lit(""))).alias("tokens"))
    docs = _sig_docs(s, d)
    ranked = R.top_k(R.bm25(docs, q), 5)
    return R.zero_filled(ranked, q, docs, 5).withColumn("rank", F.col("rank").cast("long"))


@query(
    bm25_sql(
        CODE_D,
        TASK_Q,
        f""", t AS (SELECT example_id AS query, namespace AS target FROM tasks), n AS (SELECT id AS doc, {B.sql_strip("split_part(method_signature, '(', 1)")} AS name FROM meth),
        u AS (SELECT query, name, max(round(score, 6)) AS score FROM scores JOIN n USING (doc) JOIN t USING (query) WHERE name IS NOT NULL AND name IS DISTINCT FROM target GROUP BY 1, 2)
        SELECT query, name, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS rank FROM u) WHERE rank <= 3""",
        BOTH,
    )
)
def similar_methods_unique(s, d):
    """Methods most like a task, without the task itself, one a name: dropped before the rank is counted."""
    m = B.methods(s, d, "method_code", "method_signature")
    docs = m.select(F.col("id").alias("doc"), T.words(F.coalesce("method_code", F.lit(""))).alias("tokens"), T.no_args("method_signature").alias("name"))
    q = _task_queries(s, d, "namespace").withColumnRenamed("namespace", "target")
    return R.bm25_top_names(docs, q, 3).select("query", "name", "score", F.col("rank").cast("long").alias("rank"))


@query(
    bm25_sql(
        CODE_D,
        TASK_Q,
        f""", n AS (SELECT id AS doc, {B.sql_strip("split_part(method_signature, '(', 1)")} AS name FROM meth), t AS (SELECT example_id AS query, namespace AS target FROM tasks),
        r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM scores),
        x AS (SELECT query, rank, name = target AS hit FROM r JOIN n USING (doc) JOIN t USING (query) WHERE rank <= 20),
        k AS (SELECT unnest([5, 10, 15, 20]) AS k) SELECT CAST(k AS BIGINT) AS k, CAST(count(DISTINCT query) FILTER (hit) AS BIGINT) AS hits FROM k JOIN x ON rank <= k GROUP BY k""",
        BOTH,
    )
)
def bm25_grid_k(s, d):
    """Tasks that find their own method among the first k."""
    n = B.method_names(s, d).select(F.col("id").alias("doc"), "name")
    t = B.tasks(s, d, "namespace").select(F.col("example_id").alias("query"), F.col("namespace").alias("target"))
    r = R.bm25_top(_code_docs(s, d), _task_queries(s, d), 20).join(n, "doc").join(t, "query")
    ks = F.filter(F.array(*(F.lit(k).cast("long") for k in (5, 10, 15, 20))), lambda k: k >= F.col("rank"))
    x = r.select("query", F.coalesce(F.col("name") == F.col("target"), F.lit(False)).alias("hit"), F.explode(ks).alias("k"))
    return x.groupBy("k").agg(F.count_distinct(F.when(F.col("hit"), F.col("query"))).alias("hits"))


PROJECT = f"lower(replace({B.sql_strip('project_path')}, '\\', '/'))"


@query(
    bm25_sql(DOC_D, TASK_Q, f""", g AS (SELECT doc_id AS doc, {PROJECT} AS p FROM documents), t AS (SELECT example_id AS query, {PROJECT} AS p FROM tasks),
    x AS (SELECT s.query, s.doc, row_number() OVER (PARTITION BY s.query ORDER BY round(score, 6) DESC, s.doc) AS rank, round(score, 6) AS score FROM scores s JOIN g USING (doc) JOIN t ON t.query = s.query AND t.p = g.p)
    SELECT query, doc, rank, score FROM x WHERE rank <= 5""", B.TASKS)
)
def gated_bm25(s, d):
    """Documents of the task's project only: the gate is joined before the rank."""
    raw = table(s, d, "documents", "doc_id", "text", "project_path")
    docs = raw.select(F.col("doc_id").alias("doc"), T.words(F.coalesce("text", F.lit(""))).alias("tokens"), T.project_key("project_path").alias("p"))
    q = _task_queries(s, d, "project_path").select("query", "tokens", T.project_key("project_path").alias("p"))
    return R.bm25_top(docs, q, 5, "p").select("query", "doc", F.col("rank").cast("long").alias("rank"), "score")


VEC = "v AS MATERIALIZED (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))"


def _vectors(s, d):
    return table(s, d, "embeddings", "vec_id", "embedding", "label").select("vec_id", "label", R.normalized("embedding").alias("v"))


@query(f"WITH {VEC}, x AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_dot_product(a.v, b.v), 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM x) WHERE rank <= 10")
def cosine_topk(s, d):
    v = _vectors(s, d)
    found = R.cosine_top(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "v"), v.select(F.col("vec_id").alias("doc"), "v"), 10, True)
    return found.select("query", "doc", "score", "rank").withColumn("rank", F.col("rank").cast("long"))


CENTROIDS = """c AS MATERIALIZED (SELECT label AS doc, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY label),
    n AS MATERIALIZED (SELECT doc, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS c FROM c),
    sc AS MATERIALIZED (SELECT vec_id AS query, label, doc, list_dot_product(v, n.c) AS score FROM v, n WHERE vec_id % 50 = 0)"""


def _cluster_scores(s, d):
    v = _vectors(s, d)
    mean = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("p"))
    c = mean.select(F.col("label").alias("doc"), R.normalized(F.transform("p", lambda x: x["m"])).alias("v"))
    return R.cosine_scores(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "v"), c), v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("forced"))


@query(f"WITH {VEC}, {CENTROIDS} SELECT query, doc, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM sc) WHERE rank <= 3")
def centroid_topk(s, d):
    return R.top_k(_cluster_scores(s, d)[0], 3).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""WITH {VEC}, {CENTROIDS}, g AS (SELECT query, doc AS label FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS r FROM sc) WHERE r <= 3),
    x AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_dot_product(a.v, b.v), 6) AS score FROM v a JOIN g ON g.query = a.vec_id JOIN v b ON b.label = g.label WHERE a.vec_id <> b.vec_id)
    SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM x) WHERE rank <= 10"""
)
def gated_dense(s, d):
    """The ten nearest vectors in the three clusters whose centroids are nearest."""
    v = _vectors(s, d)
    gates = R.top_k(_cluster_scores(s, d)[0], 3).select("query", F.col("doc").alias("gate"))
    q, docs = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "v"), v.select(F.col("vec_id").alias("doc"), "v", F.col("label").alias("gate"))
    return R.cosine_top(q, docs, 10, True, gates).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


TITLE_Q = "SELECT doc_id AS query, " + sql_words("coalesce(title, '')") + " AS tokens FROM documents WHERE doc_id % 50 = 0"


@query(
    bm25_sql(DOC_D, TITLE_Q, f""", c AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_dot_product(a.v, b.v), 9) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id IN (SELECT doc_id FROM documents) AND b.vec_id IN (SELECT doc_id FROM documents)),
    m AS (SELECT query, doc, coalesce(round(s.score, 9), 0) AS a, coalesce(c.score, 0) AS b FROM scores s FULL OUTER JOIN c USING (query, doc)), w AS (SELECT *, min(a) OVER p AS la, max(a) OVER p AS ha, min(b) OVER p AS lb, max(b) OVER p AS hb FROM m WINDOW p AS (PARTITION BY query)),
    f AS (SELECT query, doc, round(0.5 * CASE WHEN ha > la THEN (a - la) / (ha - la) WHEN a > 0 THEN 1 ELSE 0 END + 0.5 * CASE WHEN hb > lb THEN (b - lb) / (hb - lb) WHEN b > 0 THEN 1 ELSE 0 END, 6) AS score FROM w)
    SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f) WHERE rank <= 10""", VEC)
)
def hybrid_dense(s, d):
    """Titles against texts, BM25 with the cosine of the vectors of the same ids."""
    v = _vectors(s, d).select(F.col("vec_id").alias("doc"), "v")
    raw = table(s, d, "documents", "doc_id", "text", "title").select(F.col("doc_id").alias("doc"), T.words(F.coalesce("text", F.lit(""))).alias("tokens"), T.words(F.coalesce("title", F.lit(""))).alias("asked")).join(v, "doc", "left")
    q = raw.where("doc % 50 = 0").select(F.col("doc").alias("query"), F.col("asked").alias("tokens"), "v")
    return R.hybrid_dense_top(raw.drop("asked"), q, 10).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {VEC}, x AS (SELECT a.vec_id AS query, b.vec_id AS node, greatest(0, list_dot_product(a.v, b.v)) + CASE WHEN abs(a.vec_id - b.vec_id) = 1 THEN 0.1 ELSE 0 END AS w FROM v a JOIN v b ON a.label = b.label WHERE a.vec_id % 50 = 0)
    SELECT query, node, round(CASE WHEN sum(w) OVER p > 0 THEN w / sum(w) OVER p ELSE 1.0 / count(*) OVER p END, 6) AS w FROM x WINDOW p AS (PARTITION BY query)"""
)
def restart_vector(s, d):
    """Restart weights of every query vector over the vectors of its module: cosines, not below 0, with a bonus for its neighbors by id."""
    v = _vectors(s, d)
    a = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "label", F.col("v").alias("q"))
    sims = a.join(v, "label").select("query", F.col("vec_id").alias("node"), R.dot("q", "v").alias("sim"))
    bonus = a.select("query", F.explode(F.array(F.col("query") - 1, F.col("query") + 1)).alias("node")).withColumn("bonus", F.lit(0.1))
    return G.restart_weights(sims, bonus, "query").withColumn("w", F.round("w", 6))


@query(
    f"""WITH {VEC}, {CENTROIDS}, f AS (SELECT *, CASE WHEN query % 100 = 0 THEN label END AS forced FROM sc), r AS (SELECT query, doc, round(score, 6) AS score, coalesce(doc = forced, FALSE) AS is_forced, forced FROM f),
    x AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY is_forced DESC, score DESC, doc) AS rank FROM r)
    SELECT 1 AS k, query, doc, score, is_forced, rank FROM x WHERE rank <= 1 AND forced IS NOT NULL UNION ALL SELECT 3, query, doc, score, is_forced, rank FROM x WHERE rank <= 3"""
)
def forced_cluster_topk(s, d):
    """Every second query has a forced cluster; with k = 1 the others get nothing."""
    scores, own = _cluster_scores(s, d)
    forced = own.select("query", F.when(F.col("query") % 100 == 0, F.col("forced")).alias("forced"))
    parts = [R.forced_top(scores, forced, k).withColumn("rank", F.col("rank").cast("long")).withColumn("k", F.lit(k)) for k in (1, 3)]
    return parts[0].unionByName(parts[1])


@query(
    bm25_sql(CODE_D, TASK_Q, "SELECT query, doc, score FROM scores", BOTH).replace("SELECT query, doc, score FROM scores", "").rstrip()
    + f""", d2 AS MATERIALIZED ({SIG_D}), st2 AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d2),
    tf2 AS MATERIALIZED (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(tokens) AS dl, unnest(tokens) AS term FROM d2) GROUP BY ALL),
    raw2 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf2 GROUP BY term), st2),
    idf2 AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw2) ELSE raw END AS idf FROM raw2),
    s2 AS (SELECT query, doc, sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) AS score FROM a JOIN idf2 USING (term) JOIN tf2 USING (term), st2 GROUP BY query, doc),
    m AS (SELECT query, doc, coalesce(round(s.score, 9), 0) AS a, coalesce(round(s2.score, 9), 0) AS b FROM scores s FULL OUTER JOIN s2 USING (query, doc)),
    w AS (SELECT *, min(a) OVER p AS la, max(a) OVER p AS ha, min(b) OVER p AS lb, max(b) OVER p AS hb FROM m WINDOW p AS (PARTITION BY query)),
    f AS (SELECT query, doc, round(0.5 * CASE WHEN ha > la THEN (a - la) / (ha - la) WHEN a > 0 THEN 1 ELSE 0 END + 0.5 * CASE WHEN hb > lb THEN (b - lb) / (hb - lb) WHEN b > 0 THEN 1 ELSE 0 END, 6) AS score FROM w)
    SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f) WHERE rank <= 10"""
)
def hybrid_minmax(s, d):
    m = B.methods(s, d, "method_code", "method_signature")
    docs = m.select(F.col("id").alias("doc"), T.words(F.coalesce("method_code", F.lit(""))).alias("a"), T.signature_words("method_signature").alias("b"))
    return R.hybrid_top(docs, _task_queries(s, d), 10).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


SENTENCES = f"SELECT example_id * 100 + n AS query, {sql_words('part')} AS tokens FROM (SELECT example_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT example_id, string_split(coalesce(requirement.Functionality, ''), '. ') AS parts FROM tasks WHERE example_id % 50 = 0))"


@query(bm25_sql(CODE_D, SENTENCES, """SELECT DISTINCT query // 100 AS query, doc FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM scores) WHERE rank <= 3""", BOTH))
def multi_query_union(s, d):
    """Each sentence of a task is a query of its own; the first three of each are united."""
    t = B.tasks(s, d, "requirement").where("example_id % 50 = 0")
    parts = t.select("example_id", F.posexplode(F.split(F.coalesce("requirement.Functionality", F.lit("")), r"\. ")).alias("p", "part"))
    q = parts.select((F.col("example_id") * 100 + F.col("p") + 1).alias("query"), T.words("part").alias("tokens"))
    return R.bm25_top(_code_docs(s, d), q, 3).select(F.floor(F.col("query") / 100).cast("long").alias("query"), "doc").distinct()


@query(
    bm25_sql(CODE_D, TASK_Q, """, k AS (SELECT example_id AS query, count(DISTINCT dep) AS budget FROM deps GROUP BY 1), r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM scores)
    SELECT query, doc, rank FROM r JOIN k USING (query) WHERE rank <= budget""", f"{B.DEPENDENCIES}, {B.METHODS}")
)
def budget_matched_topk(s, d):
    """As many methods as the task has dependencies."""
    k = B.dependencies(s, d).groupBy(F.col("example_id").alias("query")).agg(F.count_distinct("dep").alias("k"))
    return R.bm25_top(_code_docs(s, d), _task_queries(s, d), k).select("query", "doc", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {B.METHODS}, x AS (SELECT func_file, id, method_code AS t, sum(length(method_code)) OVER (PARTITION BY func_file ORDER BY id) - length(method_code) AS b FROM meth WHERE method_code IS NOT NULL AND func_file IS NOT NULL)
    SELECT func_file, id, substring(t, 1, CAST(least(length(t), 4000 - b) AS BIGINT)) AS kept FROM x WHERE b < 4000"""
)
def char_budget_context(s, d):
    m = B.methods(s, d, "func_file", "method_code").where("method_code is not null and func_file is not null")
    return R.within_budget(m, ["func_file"], ["id"], "method_code", 4000).select("func_file", "id", "kept")


@query(
    """WITH e AS (SELECT DISTINCT task_id, model, x.symbol AS symbol, x.file AS file FROM (SELECT task_id, model, unnest(final_locations.entities) AS x FROM agent_result) WHERE x.symbol IS NOT NULL)
    SELECT task_id, symbol, array_to_string(list_sort(list_distinct(list(model))), '|') AS views, array_to_string(list_sort(list_distinct(list(file))), '|') AS files FROM e GROUP BY task_id, symbol"""
)
def merge_views(s, d):
    """Locations of a task over all models, with the models that found each."""
    e = table(s, d, "agent_result", "task_id", "model", "final_locations").select("task_id", "model", F.explode("final_locations.entities").alias("x")).select("task_id", "model", "x.symbol", "x.file").where("symbol is not null")
    both = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return e.groupBy("task_id", "symbol").agg(both("model").alias("views"), both("file").alias("files"))


@query(
    f"""WITH {B.NAMES}, e AS (SELECT DISTINCT x.name AS name, x.file AS file, x.symbol AS symbol FROM (SELECT unnest(final_locations.entities) AS x FROM agent_result) WHERE x.name IS NOT NULL),
    m AS (SELECT DISTINCT name AS sig, file AS path, split_part(name, '.', -1) AS short FROM names WHERE name IS NOT NULL), c AS (SELECT e.*, sig, (CASE WHEN sig = symbol THEN 4 ELSE 0 END) + (CASE WHEN ends_with(path, file) THEN 2 ELSE 0 END) + (CASE WHEN ends_with(sig, '.' || e.name) THEN 1 ELSE 0 END) AS score FROM e JOIN m ON split_part(e.name, '.', -1) = short)
    SELECT name, file, symbol, sig, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY name, file, symbol ORDER BY score DESC, length(sig), sig) AS r FROM c) WHERE r = 1"""
)
def choose_best_signature(s, d):
    """Method that fits a located entity best: by symbol, file and name; ties go to the shorter name."""
    e = table(s, d, "agent_result", "final_locations").select(F.explode("final_locations.entities").alias("x")).select("x.name", "x.file", "x.symbol").where("name is not null").distinct()
    m = B.method_names(s, d).where("name is not null").select(F.col("name").alias("sig"), F.col("file").alias("path"), T.last_part("name").alias("short")).distinct()
    points = lambda c, n: F.when(c, n).otherwise(0)
    c = e.withColumn("short", T.last_part("name")).join(m, "short")
    score = points(F.col("sig") == F.col("symbol"), 4) + points(F.endswith("path", "file"), 2) + points(F.endswith("sig", F.concat(F.lit("."), F.col("name"))), 1)
    best = F.min(F.struct((-score).alias("s"), F.length("sig").alias("n"), "sig")).alias("x")
    return c.groupBy("name", "file", "symbol").agg(best).select("name", "file", "symbol", F.col("x.sig").alias("sig"), (-F.col("x.s")).cast("long").alias("score"))


@query(
    """WITH m AS (SELECT DISTINCT ON (metric_id) metric_id, top_predictions AS p FROM task_metrics), x AS (SELECT metric_id, unnest(p[:10]) AS pred, unnest(range(1, len(p[:10]) + 1)) AS pos FROM m)
    SELECT metric_id, pred, CAST(min(pos) AS BIGINT) AS pos FROM x WHERE pred IS NOT NULL GROUP BY 1, 2"""
)
def first_k_then_dedup(s, d):
    """The first ten predictions, then without repeats, so fewer may be left."""
    m = table(s, d, "task_metrics", "metric_id", "top_predictions").distinct()
    x = m.select("metric_id", F.posexplode(F.slice("top_predictions", 1, 10)).alias("p", "pred")).where("pred is not null")
    return x.groupBy("metric_id", "pred").agg((F.min("p") + 1).cast("long").alias("pos"))


@query(
    f"""WITH {B.METHODS} SELECT func_file, string_agg(method_signature, chr(10) ORDER BY id) AS context, CAST(count(*) AS BIGINT) AS n FROM meth WHERE func_file IS NOT NULL AND method_signature IS NOT NULL GROUP BY func_file"""
)
def context_by_file(s, d):
    m = B.methods(s, d, "func_file", "method_signature").where("func_file is not null and method_signature is not null")
    g = m.groupBy("func_file").agg(F.sort_array(F.collect_list(F.struct("id", "method_signature"))).alias("x"))
    return g.select("func_file", F.array_join(F.transform("x", lambda e: e["method_signature"]), "\n").alias("context"), F.size("x").cast("long").alias("n"))
