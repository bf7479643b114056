"""Problems 3, 8, 9 and 10, and the SQL of the subpackage."""

import os
import random
from collections import Counter

import oracle
import pytest

from codestrata.llm import mixing, packing, quality, registry, sampling
from codestrata.llm.tokens import FOLDER as TOKENIZERS
from codestrata.llm.tokens import token_counts

FOLDER = "/root/testdata/sf0.001"
SQL, QUERIES = registry.oracle_sql(), registry.queries()
rows = lambda df: {tuple(r) for r in df.collect()}
TARGETS = "domain string, type string, target_permille int, min_rows int, sample_size long"


def cell(name, permille, available, floor=0, size=100):
    return {"domain": name, "type": "t", "permille": permille, "floor": floor, "size": size, "wanted": 0, "available": available}


def test_allocate():
    quota = lambda cells: [c["quota"] for c in sampling.allocate(cells)]
    assert quota([]) == [] and quota([cell("a", 500, 900), cell("b", 500, 900)]) == [50, 50]
    assert quota([cell("a", 333, 900), cell("b", 333, 900), cell("c", 334, 900)]) == [33, 33, 34]
    assert quota([cell("a", 500, 10), cell("b", 250, 900), cell("c", 250, 900)]) == [10, 45, 45]
    assert quota([cell("a", 990, 900), cell("b", 10, 900, 5)]) == [95, 5]
    assert quota([cell("a", 500, 0, 5), cell("b", 500, 20, 5)]) == [0, 20]
    rng = random.Random(2)
    for _ in range(200):
        cells = [cell(str(i), rng.randint(0, 400), rng.randint(0, 80), rng.randint(0, 6)) for i in range(rng.randint(1, 8))]
        q = quota(cells)
        assert all(min(c["floor"], c["available"]) <= n <= c["available"] for c, n in zip(cells, q))
        if any(c["permille"] for c in cells):
            least = sum(min(c["floor"], c["available"]) for c in cells)
            most = sum(c["available"] if c["permille"] else min(c["floor"], c["available"]) for c in cells)
            assert sum(q) == max(least, min(100, most))


def test_sample(spark):
    data = [(i, "A".lower(), "f") for i in range(3000)] + [(5000 + i, "b", "f") for i in range(30)] + [(9000, None, "f"), (9001, "b", None), (0, "a", "f")]
    tasks = spark.createDataFrame(data, "id long, domain string, type string")
    targets = spark.createDataFrame([("A", "f", 500, 3, 200), ("b", "F", 490, 3, 200), ("c", "f", 10, 3, 200)], TARGETS)
    got = sampling.sample_to_targets(tasks, targets).collect()
    assert Counter(r.domain for r in got) == {"a": 170, "b": 30} and len({r.id for r in got}) == 200
    report = {r.domain: (r.wanted, r.available, r.shortfall) for r in sampling.report(tasks, targets).collect()}
    assert report == {"a": (100, 3000, 0), "b": (98, 30, 68), "c": (3, 0, 3)}
    again = {r.id for r in sampling.sample_to_targets(tasks.orderBy("id"), targets).collect()}
    assert again == {r.id for r in got}
    assert sampling.sample_to_targets(tasks.limit(0), targets).count() == 0
    drawn = {r.domain: (r.quota, r.drawn) for r in sampling.report(tasks, targets).collect()}
    assert drawn == {"a": (170, 170), "b": (30, 30), "c": (0, 0)}
    for ranked in (1, 10, 10**6):  # several levels of the histogram, or one
        assert {r.id for r in sampling.draw(tasks, targets, ranked=ranked)[0].collect()} == {r.id for r in got}


@pytest.mark.parametrize("capacity", [10, 64, 500])
def test_packing(spark, capacity):
    rng = random.Random(capacity)
    docs = [(i, rng.choice([0, 1, 7, rng.randint(1, capacity * 3)])) for i in range(400)] + [(500 + i, 7) for i in range(300)]
    got = packing.pack_documents(spark.createDataFrame([*docs, docs[1]], "id long, tokens long"), {"p": capacity}).toPandas()
    assert got.groupby("container").tokens.sum().max() <= capacity
    whole = got.groupby("doc_id").tokens.sum().to_dict()
    assert whole == {i: n for i, n in docs if n}
    for i, n in docs:
        pieces = sorted(got[got.doc_id == i][["piece", "first_token", "tokens"]].itertuples(index=False, name=None))
        assert pieces == [(k + 1, k * capacity, min(capacity, n - k * capacity)) for k in range(-(-n // capacity))]
    least = max(-(-sum(n for _, n in docs) // capacity), int((got.tokens > capacity / 2).sum()))  # two halves share none
    assert got.container.nunique() <= least * 11 / 9 + 1
    assert got.groupby("step").container.nunique().max() <= packing.GROUP
    assert sorted(got.container.unique()) == list(range(got.container.nunique()))


def packed_by(counts, capacity):
    """Tokens of each container by the rules, every item placed once; and the tier of each."""
    rules, ranges = packing.pack_histogram(counts, capacity)
    used, tier, taken = {}, {}, dict.fromkeys(counts, 0)
    for size, item, m, first, each in rules:
        assert item == taken[size]
        taken[size] += m * each
        for c in range(first, first + m):
            used[c] = used.get(c, 0) + size * each
    assert taken == counts
    for first, m, room, t in ranges:
        for c in range(first, first + m):
            tier[c] = t
            assert used[c] + room == capacity
    return used, tier


def test_packing_tiers():
    """Short documents alone make containers of the last tier; with long ones they fill their gaps first."""
    used, tier = packed_by({20: 500, 90: 400, 150: 90}, 2048)
    assert set(tier.values()) == {3} and len(used) == -(-(20 * 500 + 90 * 400 + 150 * 90) // 2048)
    used, tier = packed_by({1500: 40, 700: 30, 548: 30, 100: 300}, 2048)
    assert Counter(tier.values())[0] == 40 and len(used) == 63  # the tokens fill 62.2
    used, tier = packed_by({204: 5000}, 2048)
    assert len(used) == 500
    used, _ = packed_by({300: 6 * 10**4, 7: 5000}, 2048)
    assert len(used) == 10**4  # as many as without the short ones
    rng = random.Random(6)
    for _ in range(40):
        capacity = rng.randint(8, 300)
        counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 25))}
        used, tier = packed_by(counts, capacity)
        assert sorted(used) == list(range(len(used))) and max(used.values()) <= capacity
        assert sum(t == 0 for t in tier.values()) == sum(n for s, n in counts.items() if s > capacity // 2)


def test_packing_steps(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, rng.choice([rng.randint(1, 90), rng.randint(100, 900), rng.randint(1000, 3000)])) for i in range(3000)], "id long, tokens long")
    got = packing.pack_documents(docs, {"p": 2048})
    s = packing.steps(got).first()
    assert s.containers_most <= packing.GROUP and s.containers_least >= s.containers_most - 1
    assert s.tokens_most - s.tokens_least <= 1.01 * 2048


def test_packing_empty(spark):
    none = packing.pack_documents(spark.createDataFrame([], "id long, tokens long"), {"p": 5})
    plans = spark.createDataFrame([("p", 5)], "plan string, capacity_tokens int")
    assert none.count() == 0 and packing.fill(none, plans).first()[2:] == (0, 0, 0.0)


def test_mixing(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["Big", " big", "mid"]), rng.randint(1, 40)) for i in range(3000)] + [(5000 + i, "small", 10) for i in range(5)] + [(9000, None, 10), (9001, "other", 10), (9002, "mid", 0)]
    tokens = spark.createDataFrame([*docs, docs[0]], "id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 4), ("mid", 0.4, 4), ("SMALL", 0.1, 3), ("gone", 0.0, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(tokens, targets, budget=40_000)
    r = {x.source: x for x in report.collect()}
    assert r["small"].tokens == 150 and r["small"].short == 3850 and r["gone"].tokens == 0
    assert abs(r["big"].tokens - 20_000) <= 40 and abs(r["mid"].tokens - 16_000) <= 40
    picked = chosen.collect()
    assert len({x.doc_id for x in picked}) == len(picked) and sum(x.tokens * x.copies for x in picked if x.source == "big") == r["big"].tokens
    less = {x.doc_id: x.copies for x in mixing.mix(tokens, targets, budget=20_000)[0].collect()}
    more = {x.doc_id: x.copies for x in picked}
    assert all(more.get(k, 0) >= v for k, v in less.items())
    assert mixing.mix(tokens.limit(0), targets)[0].count() == 0


@pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no tokenizers")
def test_tokens(spark):
    df = spark.createDataFrame([(1, "def f(x): return x"), (2, None), (3, ""), (4, "  \n"), (5, "ab" * 40_000)], "id long, text string")
    got = {r.id: r.tokens for r in token_counts(df).collect()}
    assert got[2] == got[3] == 0 and got[1] == 7 and got[4] > 0 and got[5] > 1000


PROSE = "We moved the queue into its own module because it was hard to test. You may also pass a filter, in which case it is not read."


def test_quality(spark):
    docs = {
        "list": ["- alpha\n- beta gamma\n- delta\n- eps", f"{PROSE}\n" + "\n".join(f"{i}. step {i}x" for i in range(12)), "a_b, c_d, e_f, g_h, i_j, k_l, m_n", "x/y/z.py\nx/q/w.py\nx/e/r.py"],
        "table": ["| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | n/a |", "a;b;c\n1;2;3\n4;;6\n7;8;9", "x\ty\tz\n1\t\t3\n4\t5\t6", "<table><tr><td>1</td><td>x</td></tr><tr><td>2</td><td>y</td></tr></table>"],
        "junk": ["test " * 80, "2026-01-19 21:59:37,896 INFO [a:295] b=33738 0x1e4a\n" * 5, '{"a":{"b":[1,2,3],"c":null},"d":{"e":[4,5],"f":true}}', "udPXJ1cnNaV6bfToTmhZ9XNSxqAETsEB6zx35P9z+8s3XWcS8VzMFXrGTTb33uqG\n" * 3],
        None: [PROSE, f"# Title\n\n{PROSE} {PROSE}\n\n- one\n- two\n\n    x = f(1)\n\n{PROSE}", "", "  \n ", None],
    }
    flat = [(k, t) for k, ts in docs.items() for t in ts]
    df = spark.createDataFrame([(i, t, "x") for i, (_, t) in enumerate(flat)], "id long, text string, kind string")
    words = spark.createDataFrame([(w,) for w in "the of and a to in is it for was we you may also which because not has been own into as with".split()], "word string")
    got = {r.id: r for r in quality.label_shares(df, words).collect()}
    assert [got[i].kind for i in range(len(flat))] == [k for k, _ in flat]
    assert got[len(flat) - 1].lines == 0
    f = {r.id: r for r in quality.figures(df, ["the"]).collect()}
    assert f[len(flat) - 1].n_words == 0 and f[16 - 4].punct_line_share == 1.0


@pytest.fixture(scope="module")
def con():
    return oracle.database(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert oracle.compare(spark, con, QUERIES[name], SQL[name], FOLDER) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
