"""Small fixtures for the contracts of the metrics, joins and graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import clustering as C
from codestrata.operators import evaluation as E
from codestrata.operators import graph as G
from codestrata.operators import relational as R
from codestrata.operators import retrieval as Q
from codestrata.operators.components import connected_components


def rows(df, *cols):
    return {tuple(r[c] for c in (cols or df.columns)) for r in df.collect()}


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first().y


def recall(spark, truth, context, names, legacy):
    hits = E.relaxed_hits(spark.createDataFrame([(1, d) for d in truth], "key int, dep string"), spark.createDataFrame(context, "key int, sig string, code string"), spark.createDataFrame(names, "name string, category string"), legacy)
    return (E.legacy_recall if legacy else E.unique_recall)(hits).first()


def test_recall_counts(spark):
    args = (["m.v", "m.v"], [(1, "p.f(x)", "return v")], [("m.v", "Variable")])
    old, new = recall(spark, *args, True), recall(spark, *args, False)
    assert (old.total, old.hits, old.recall) == (1, 2, 2.0)
    assert (new.total, new.dr, new.exact_dr) == (1, 1.0, 0.0)
    ctor = (["p.C"], [(1, "p.C.__init__(self)", None)], [("q", "Variable")])
    assert recall(spark, *ctor, True).hits == 1 and recall(spark, *ctor, False).exact_hits == 0
    attr = (["m.C._a"], [(1, "m.C", "self._a = 1")], [("m.C._a", "Unresolved Attribute")])
    assert recall(spark, *attr, False).hits == 1
    mod = (["m"], [(1, "m.f", "")], [("m", "Module")])
    assert recall(spark, *mod, False).hits == 1


def test_pass_at_k(spark):
    df = spark.createDataFrame([(5, 2), (5, 0), (3, 3), (1, 1)], "n long, c long")
    got = [r[0] for r in df.select(E.pass_at_k(F.col("n"), F.col("c"), 2)).collect()]
    assert got[0] == pytest.approx(0.7) and got[1:] == [0.0, 1.0, None]


def test_bins(spark):
    v = spark.createDataFrame([(0,), (5,), (6,), (11,), (None,)], "v int")
    assert rows(E.right_closed_bins(v, "v", [0, 5, 10])) == {(0.0, 5.0, 2), (5.0, 10.0, 1), (10.0, None, 1)}


def test_names(spark):
    assert one(spark, "p.C.__init__(self)", T.legacy_name) == "p.C" and one(spark, "p.C.__init__(self)", T.canonical) == "p.C.__init__"
    assert one(spark, "..p.C.__init__.x", T.canonical) == "p.C.x"
    assert one(spark, "a.a.x", T.one_root) == "a.x" and one(spark, "ab.a.x", T.one_root) == "ab.a.x"
    assert one(spark, "p.m.C.f", T.with_constructor) == "p.m.__init__.C.f" and one(spark, "p.m.f", T.with_constructor) == "p.m.__init__.f"
    assert one(spark, "src/a/__init__.py", T.module_of_path) == "src.a"
    assert one(spark, "a\n```py\nx\n```\n```\nlonger\n```", T.longest_block) == "longer" and one(spark, " t ", T.longest_block) == "t"


def test_joins(spark):
    t = spark.createDataFrame([(1, "abcabc"), (2, "xy"), (3, None), (4, "")], "id int, t string")
    p = spark.createDataFrame([("bca",), ("x",), ("xyz",), ("",), (None,)], "p string")
    assert rows(R.containment_join(t, "t", p, "p"), "id", "p") == {(1, "bca"), (2, "x")}
    m = spark.createDataFrame([("a",), ("a.b",), ("",)], "m string")
    n = spark.createDataFrame([("a.b.c",), ("ab",), ("z",)], "n string")
    assert rows(R.longest_prefix(n, "n", ["n"], m, "m")) == {("a.b.c", "a.b"), ("ab", "a")}
    pt = spark.createDataFrame([("f", 5), ("f", 500), ("g", 5)], "file string, line int")
    iv = spark.createDataFrame([("f", 1, 900, "out"), ("f", 4, 6, "in"), ("f", 9, 2, "bad")], "file string, s int, e int, name string")
    assert rows(R.smallest_interval(pt, ["file"], "line", iv, "s", "e", "name"), "file", "line", "name") == {("f", 5, "in"), ("f", 500, "out")}
    q = spark.createDataFrame([("c.d",), ("zz",)], "q string")
    nm = spark.createDataFrame([("a.c.d",), ("b.a.c.d",)], "name string")
    assert rows(R.suffix_lookup(q, "q", nm, "name")) == {("c.d", "a.c.d", 1)}
    e = spark.createDataFrame([(1, 2, "Call", 0), (1, 2, "Use", 1)], "src int, dst int, kind string, ord int")
    assert R.first_wins(e, ["src", "dst"], ["ord"], ["kind"]).first().kind == "Call" and R.last_wins(e, ["src", "dst"], ["ord"], ["kind"]).first().kind == "Use"


def test_containment_brute(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab.", k=rng.randint(0, 12))) for _ in range(40)]
    parts = list({"".join(rng.choices("ab.", k=rng.randint(1, 5))) for _ in range(20)})
    got = R.containment_join(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", spark.createDataFrame([(p,) for p in parts], "p string"), "p")
    assert sorted(tuple(r) for r in got.select("i", "p").collect()) == sorted((i, p) for i, t in enumerate(texts) for p in parts if p in t)


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, [])], "doc long, tokens array<string>")
    q = spark.createDataFrame([(7, ["a"]), (8, ["zz"])], "query long, tokens array<string>")
    ranked = Q.top_k(Q.bm25(docs, q), 2)
    assert rows(ranked, "query", "doc", "rank") == {(7, 1, 1)}
    assert rows(Q.zero_filled(ranked, q, docs, 2), "query", "doc", "rank") == {(7, 1, 1), (7, 2, 2), (8, 1, 1), (8, 2, 2)}
    assert Q.bm25(docs.limit(0), q).count() == 0
    s = spark.createDataFrame([(1, 5, 0.0), (1, 6, 0.0), (2, 5, 3.0), (2, 6, 3.0)], "query long, doc long, score double")
    z = s.withColumn("score", F.lit(0.0))
    assert rows(Q.fused(s, z), "query", "score") == {(1, 0.0), (2, 0.5)}
    c = spark.createDataFrame([(1, 5, 0.9), (1, 6, 0.1)], "query long, doc long, score double")
    none = spark.createDataFrame([(1, None)], "query long, forced long")
    assert Q.forced_top(c, none, 1).count() == 0 and rows(Q.forced_top(c, none.withColumn("forced", F.lit(6).cast("long")), 1), "doc") == {(6,)}
    b = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "c")], "g int, o int, t string")
    assert rows(Q.within_budget(b, ["g"], ["o"], "t", 6), "o", "kept") == {(1, "aaaa"), (2, "bb")}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(500, i) for i in range(501, 540)] + [(900, 900), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert rows(got) == {(x, find(x)) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pagerank(spark):
    e = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "a")]
    w = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0}
    r = {k: v for k, v in w.items()}
    deg = {"a": 2, "b": 1, "d": 1}
    for _ in range(30):
        lost = r["c"]
        r = {n: 0.85 * (sum(r[s] / deg[s] for s, t in e if t == n) + lost * w[n]) + 0.15 * w[n] for n in r}
    edges = spark.createDataFrame(e, "src string, dst string")
    got = {x.node: x.rank for x in G.pagerank(edges, spark.createDataFrame(list(w.items()), "node string, w double"), rounds=30).collect()}
    assert all(got[n] == pytest.approx(r[n], abs=1e-9) for n in r)
    many = G.pagerank_by_group(edges.withColumn("g", F.lit(1)), spark.createDataFrame([(1, k, v) for k, v in w.items()], "g int, node string, w double"), "g", tolerance=1e-12)
    assert all(x.rank == pytest.approx(r[x.node], abs=1e-3) for x in many.collect())


def test_paths(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    assert rows(G.closure(e), "src", "dst") == set(itertools.product((1, 2, 3), (1, 2, 3, 4)))
    assert rows(G.shortest_paths(e, spark.createDataFrame([(1,)], "node int"))) == {(1, 0), (2, 1), (3, 1), (4, 2)}


def test_clustering(spark):
    p = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y"), (4, "b", "y")], "id long, p string, q string")
    assert C.adjusted_rand(p, "p", "q").first().ari == 1.0
    pairs = spark.createDataFrame([(0, 1, 2, 0.9), (0, 1, 3, 0.1), (0, 2, 3, 0.1), (0, 3, 4, 0.8)], "group long, i long, j long, w double")
    nodes = spark.createDataFrame([(0, i) for i in (1, 2, 3, 4)], "group long, id long")
    assert rows(C.communities(pairs, nodes, [0.4]), "id", "label") == {(1, 1), (2, 1), (3, 3), (4, 3)}
    labels = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 3), (0, 4, 4)], "group long, id long, label long")
    merged = {r.id: r.label for r in C.merge_tiny(pairs, labels, 2).collect()}
    assert merged[3] == merged[4] != merged[1]


def test_bm25_top(spark):
    """The matrix way and the join way agree; ties go by document; null and empty token lists, words that no document has."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    docs = [(i, rng.choices(vocab, k=rng.randint(1, 12)), rng.choice("pq")) for i in range(200)] + [(300, None, "p"), (301, [], "q"), (302, ["w1"], None), (303, ["w1"], "p"), (304, ["w1"], "p")]
    d = spark.createDataFrame(docs, "doc long, tokens array<string>, gate string")
    q = spark.createDataFrame([(1, ["w1", "w2", "w1"], "p"), (2, ["none"], "q"), (3, [], "p"), (4, ["w5", "none"], None), (5, None, "q")], "query long, tokens array<string>, gate string")
    key = lambda df: {(r.query, r.doc, r["rank"], r.score) for r in df.collect()}
    want = Q.top_k(Q.bm25(d.select("doc", "tokens"), q), 7)
    assert key(Q.bm25_top(d, q, 7)) == key(want) and {r.query for r in want.collect()} == {1, 4}
    gated = Q.bm25(d.select("doc", "tokens"), q).join(q.select("query", "gate"), "query").join(d.select("doc", "gate"), ["doc", "gate"])
    assert key(Q.bm25_top(d, q, 7, "gate")) == key(Q.top_k(gated, 7))
    assert Q.bm25_top(d.limit(0), q, 3).count() == Q.bm25_top(d, q.limit(0), 3).count() == 0
    both = d.select("doc", F.col("tokens").alias("a"), F.slice(F.coalesce("tokens", F.array()), 1, 2).alias("b"))
    sides = [Q.bm25(both.select("doc", F.col(c).alias("tokens")), q).withColumn("score", F.round("score", 9)) for c in "ab"]
    assert key(Q.hybrid_top(both, q, 6)) == key(Q.top_k(Q.fused(*sides), 6))


def test_cosine_top(spark):
    v = [(i, [float(i % 5) - 2, float(i % 3), 1.0], "ab"[i % 2]) for i in range(60)]
    d = spark.createDataFrame(v, "doc long, v array<double>, gate string").withColumn("v", Q.normalized("v"))
    q = d.where("doc % 20 = 0").select(F.col("doc").alias("query"), "v")
    key = lambda df: {(r.query, r.doc, r["rank"], r.score) for r in df.collect()}
    scores = Q.cosine_scores(q, d.select("doc", "v")).where("query <> doc")
    assert key(Q.cosine_top(q, d, 4, True)) == key(Q.top_k(scores, 4))
    gates = spark.createDataFrame([(0, "a"), (20, "b"), (20, "a")], "query long, gate string")
    kept = scores.join(d.select("doc", "gate"), "doc").join(gates, ["query", "gate"])
    assert key(Q.cosine_top(q, d, 4, True, gates)) == key(Q.top_k(kept, 4))
    assert Q.cosine_top(q.limit(0), d, 3).count() == Q.cosine_top(q, d.limit(0), 3).count() == 0


def test_log_space(spark):
    got = spark.range(1).select(T.log_space(-2, 1, 4).alias("a"), T.log_space(3, 9, 1).alias("b")).first()
    assert [round(x, 9) for x in got.a] == [0.01, 0.1, 1.0, 10.0] and got.b == [1000.0]
