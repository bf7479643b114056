"""Searches of many queries with many words: still scored where the documents are read, never by a join over all pairs."""

import random
import tracemalloc

import numpy as np
import oracle
import pyarrow as pa
import pytest

from codestrata.operators import scoring as S
from codestrata.plans import registry

SQL, QUERIES = registry.oracle_sql(), registry.queries()
N = 4800  # queries, and different words: more pairs than the matrix of all queries and words once could have
DEP = "struct<intra_class: array<string>, intra_file: array<string>, cross_file: array<string>>"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("searches")), random.Random(4)
    word = lambda: f"w{rng.randrange(N)}"
    some = lambda n: " ".join(word() for _ in range(rng.randint(1, n)))
    names = [f"m.f{i % 300}" for i in range(700)]
    tasks = [(50 * i, rng.choice([*names, None]), f" P\\{i % 40}", (f"w{i}. {some(4)} the. the", some(3)), ([rng.choice(names) for _ in range(rng.randint(0, 4))], None, ["x"])) for i in range(N)]
    methods = [(i, f"{n}_{word()}_{word()}(self)" if i % 9 else n, f"f{i % 20}", f"{some(40)} the {'the ' * (i % 3)}") for i, n in enumerate(names)]
    documents = [(i, f"{some(150)} the", f"p/{rng.randrange(50)}") for i in range(300)]
    spark.createDataFrame(tasks, f"example_id long, namespace string, project_path string, requirement struct<Functionality: string, Arguments: string>, dependency {DEP}").write.parquet(f"{path}/filtered.parquet")
    spark.createDataFrame(methods + methods[:5], "id long, method_signature string, func_file string, method_code string").write.parquet(f"{path}/methods.parquet")
    spark.createDataFrame(documents, "doc_id long, text string, project_path string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def con(folder):
    import duckdb

    c = duckdb.connect()
    for t in ("filtered", "methods", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return c


@pytest.mark.parametrize("name", ["bm25_code_topk", "bm25_signature_topk", "similar_methods_unique", "bm25_documents_topk", "gated_bm25", "multi_query_union", "hybrid_minmax", "bm25_grid_k", "budget_matched_topk"])
def test_many_queries(spark, con, folder, name):
    assert oracle.compare(spark, con, QUERIES[name], SQL[name], folder) == ""
    assert "MapInArrow" in QUERIES[name](spark, folder)._jdf.queryExecution().toString()


def weights(rng, queries, terms, per):
    rows = {(q, f"t{rng.randrange(terms)}") for q in range(queries) for _ in range(per)}
    q, t = zip(*sorted(rows))
    return S.Weights.of(pa.table({"query": pa.array(q, pa.int64()), "term": pa.array(t), "w": np.array([rng.choice([0.5, 1.25, 2.0]) for _ in q]), "avgdl": np.full(len(q), 6.0), "share": np.array([0.5 if x == "t1" else 0.01 for x in t])}))


@pytest.mark.parametrize("dense", [0.0, 0.01, 2.0])
@pytest.mark.parametrize("zero", [False, True])
def test_blocks_brute(monkeypatch, dense, zero):
    """Frequent terms by matrix and others pair by pair give the scores of brute force, in many small blocks, ties by key."""
    monkeypatch.setattr(S, "DENSE", dense)
    monkeypatch.setattr(S, "BLOCK", 200)
    rng = random.Random(9)
    w = weights(rng, 23, 30, 4)
    if zero:
        w.weight[::5] = 0.0
    docs = [[f"t{rng.randrange(40)}" for _ in range(rng.randint(0, 9))] for _ in range(90)] + [None]
    best, read = S.Best(len(w.ids), 5, w.positive), w.reader(pa.array(docs, pa.list_(pa.string())))
    for a, b in S.blocks(len(docs), len(w.ids)):
        assert (b - a) * len(w.ids) <= 200
        best.add(*read(a, b), pa.array(range(a, b), pa.int64()))
    got = {(r["query"], r["doc"], round(r["score"], 9)) for x in best.batches(w.ids) for r in x.to_pylist()}
    want = set()
    for q in range(len(w.ids)):
        own = {w.terms[t].as_py(): w.weight[i] for t in range(len(w.terms)) for i in range(w.start[t], w.start[t + 1]) if w.query[i] == q}
        found = []
        for d, tokens in enumerate(docs):
            if tokens and own.keys() & set(tokens):
                found.append((d, sum(v * tokens.count(t) * 2.5 / (tokens.count(t) + 1.5 * (0.25 + 0.75 * len(tokens) / 6.0)) for t, v in own.items() if t in tokens)))
        want |= {(q, d, round(s, 9)) for d, s in sorted(found, key=lambda x: (-round(x[1], 6), x[0]))[:5]}
    assert got == want


def test_block_memory():
    """Few words, many queries: what a batch of documents takes does not grow with their number (it took 800 MB and more a copy)."""
    rng = random.Random(2)
    w = weights(rng, 10_000, 40, 3)
    read, best = w.reader(pa.array([[f"t{rng.randrange(40)}"] for _ in range(10_000)], pa.list_(pa.string()))), S.Best(len(w.ids), 3, w.positive)
    tracemalloc.start()
    for a, b in S.blocks(10_000, len(w.ids)):
        best.add(*read(a, b), pa.array(range(a, b), pa.int64()))
        if a > 600:
            break
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6
