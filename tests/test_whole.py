"""Queries that must do the whole job: cases that a bound would lose."""

import random
from collections import deque

from codestrata.operators import graph as G
from codestrata.plans import registry

QUERIES = registry.queries()


def rows(df, *cols):
    return {tuple(r[c] for c in (cols or df.columns)) for r in df.collect()}


def written(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_text_whole(spark, tmp_path):
    long = "x" * 250 + "&lt;b&gt; &amp;lt; "
    docs = [(i, t, None, None) for i, t in [(1, long + "12345678901"), (2, "a 123 456"), (3, None), (4, "9" * 30), (5, "none")]]
    folder = written(tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string, title string, lang string"))
    got = {r.doc_id: (r.unescaped, r.first_number) for r in QUERIES["text_functions"](spark, folder).collect()}
    assert got == {1: ("x" * 250 + "<b> &lt; 12345678901", 12345678901), 2: ("a 123 456", 123), 3: ("", None), 4: ("9" * 30, None), 5: ("none", None)}


def brute_distances(edges, sources):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    dist, queue = dict.fromkeys(sources, 0), deque(sources)
    while queue:
        u = queue.popleft()
        for v in near.get(u, ()):
            if v not in dist:
                dist[v] = dist[u] + 1
                queue.append(v)
    return dist


def test_distances_whole(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(20)] + [(rng.randint(30, 90), rng.randint(30, 90)) for _ in range(60)] + [(200, 201), (5, 5)]
    df = spark.createDataFrame(edges, "src int, dst int")
    sources = spark.createDataFrame([(0,), (31,), (300,), (None,)], "node int")
    want = brute_distances(edges, [0, 31, 300])
    assert max(want.values()) == 20
    assert rows(G.shortest_paths(df, sources), "node", "dist") == set(want.items())
    assert G.shortest_paths(df, sources.limit(0)).count() == 0


def test_path_patterns(spark):
    edges = [("t", "a", "Call"), ("t", "b", "Use"), ("u", "b", "Contain"), ("u", "b", "Call"), ("u", "c", "Use"), ("c", "d", "Use"), ("d", "c", "Call"), ("x", "y", "Use"), ("a", "a", "Use")]
    nodes = [(n, "Class" if n == "c" else "Function") for n in "tabucxy"]
    e, n = spark.createDataFrame(edges, "src string, dst string, kind string"), spark.createDataFrame(nodes, "node string, category string")
    src = spark.createDataFrame([(1, "a"), (2, "c"), (2, "zz")], "g long, node string")
    to = spark.createDataFrame([(1, "d"), (1, "b"), (1, "y"), (1, "a"), (2, "d"), (3, "b")], "g long, node string")
    b = "Function <-(Call)- Function / Function -(Use)-> Function"
    d = "Class <->(Call|Use)<-> Unknown"
    assert rows(G.path_patterns(e, n, src, to, "g"), "g", "target", "length", "pattern") == {
        (1, "b", 2, b), (1, "d", 5, f"{b} / Function <-(Call|Contain)- Function / Function -(Use)-> Class / {d}"), (2, "d", 1, d),
    }


def test_path_patterns_brute(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(75)]
    sources = {g: set(rng.sample(range(81), rng.randint(0, 3))) for g in range(12)}
    targets = {(g, rng.randint(0, 80)) for g in sources for _ in range(8)}
    e = spark.createDataFrame([(a, b, "Use") for a, b in edges], "src int, dst int, kind string")
    n = spark.createDataFrame([(i, "F") for i in range(81)], "node int, category string")
    src = spark.createDataFrame([(g, x) for g, xs in sources.items() for x in xs], "g long, node int")
    want = {(g, x, k) for g, x in targets if (k := brute_distances(edges, sources[g]).get(x))}
    assert max(k for *_, k in want) > 3
    assert rows(G.path_patterns(e, n, src, spark.createDataFrame(list(targets), "g long, node int"), "g"), "g", "target", "length") == want


def test_ancestors_whole(spark, tmp_path):
    name = ".".join("abcdefghijklmnop")
    dep = "struct<intra_class: array<string>, intra_file: array<string>, cross_file: array<string>>"
    folder = written(tmp_path, filtered=spark.createDataFrame([(1, "n", ([name], [".x"], ["alone", None]))], f"example_id long, namespace string, dependency {dep}"))
    part = lambda k: name[: 2 * k - 1]
    assert rows(QUERIES["ancestor_closure"](spark, folder), "src", "dst", "depth") == {(part(j), part(i), j - i) for j in range(2, 17) for i in range(1, j)} | {(".x", "", 1)}
