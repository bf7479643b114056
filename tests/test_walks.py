"""Paths of many groups: searched where a task holds the component, not by writing every level of every search."""

import random

import pyarrow as pa
import pytest

from codestrata.operators import graph as G
from codestrata.operators.walks import walks


def brute(near, sources, target):
    """Nodes of the shortest path, of equal ones the one with the least parents from the target back."""
    dist, front = dict.fromkeys(sources, 0), sorted(sources)
    while front and target not in dist:
        front = [v for u in front for v in near.get(u, ()) if v not in dist and not dist.update({v: dist[u] + 1})]
    path = [target]
    while target in dist and dist[path[0]]:
        path.insert(0, min(u for u in near[path[0]] if dist.get(u, 1e9) == dist[path[0]] - 1))
    return path if target in dist else None


def made(n, edges, groups, seed):
    rng, near = random.Random(seed), {}
    pairs = sorted({tuple(sorted(p)) for p in edges(rng) if p[0] != p[1]})
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    sources = {g: set(rng.sample(range(n), rng.randint(0, 3))) for g in range(groups)}
    targets = [(g, t) for g in sources for t in rng.sample(range(n), 4) if t not in sources[g]]
    want = {(g, t, len(p) - 1, " / ".join(f"{a}>{b}" for a, b in zip(p, p[1:]))) for g, t in targets if (p := brute(near, sources[g], t))}
    return pairs, sources, targets, want


@pytest.mark.parametrize("chain", [False, True])
def test_walks_brute(chain):
    """More groups than bits of a word, sparse and dense levels, long chains, nodes outside the graph."""
    edges = (lambda rng: [(i, i + 1) for i in range(390)]) if chain else (lambda rng: [(rng.randrange(400), rng.randrange(400)) for _ in range(380)])
    pairs, sources, targets, want = made(400, edges, 150, 3)
    asked = [(f"g{g}", x, False) for g, xs in sources.items() for x in xs] + [(f"g{g}", t, True) for g, t in targets] + [("g0", 9999, True)]
    array = lambda x, kind: pa.chunked_array([pa.array(x, kind)])
    lo, hi = zip(*pairs)
    of, *rest = walks(array(lo, pa.int64()), array(hi, pa.int64()), array([f"{a}>{b}" for a, b in pairs], pa.string()), array([f"{b}>{a}" for a, b in pairs], pa.string()), *(array([r[i] for r in asked], k) for i, k in enumerate((pa.string(), pa.int64(), pa.bool_()))))
    assert {(int(g[1:]), *r) for g, *r in zip(of.to_pylist(), *rest)} == want
    assert max(k for *_, k, _ in want) > 8


@pytest.mark.parametrize("searched", [2_000_000, 0])
def test_paths_held(spark, monkeypatch, searched):
    """A component that a task holds writes no levels, also where several tasks share its groups; a larger one gives the same rows by joins."""
    monkeypatch.setattr(G, "SEARCHED", searched, raising=False)
    monkeypatch.setattr(G, "WORK", 500, raising=False)
    names, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df, name="step": names.append(name) or cut(df, name))
    pairs, sources, targets, want = made(60, lambda rng: [(rng.randrange(60), rng.randrange(60)) for _ in range(70)], 70, 5)
    node = lambda i: f"n{i:02}"
    e = spark.createDataFrame([(node(a), node(b), "Use") for a, b in pairs], "src string, dst string, kind string")
    n = spark.createDataFrame([(node(i), node(i)) for i in range(60)], "node string, category string")
    src = spark.createDataFrame([(g, node(x)) for g, xs in sources.items() for x in xs], "g long, node string")
    to = spark.createDataFrame([(g, node(t)) for g, t in targets], "g long, node string")
    arrow = lambda step: (lambda a, b: f"{node(a)} -(Use)-> {node(b)}" if a < b else f"{node(a)} <-(Use)- {node(b)}")(*map(int, step.split(">")))
    got = [tuple(r) for r in G.path_patterns(e, n, src, to, "g").select("g", "target", "length", "pattern").collect()]
    assert sorted(got) == sorted((g, node(t), k, " / ".join(map(arrow, p.split(" / ")))) for g, t, k, p in want)
    assert ("level" in names) == (searched == 0)
