"""Problems 1, 2, 6 and 7 against brute force on small fixtures with nulls, ties, repeats, empty and long texts."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import census, near_duplicates, set_join, spans, splits

rows = lambda df: {tuple(r) for r in df.collect()}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_blocks_round_trip():
    h = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    c = np.arange(len(h), dtype=np.uint32)
    got, counts = census.decode(census.encode(h, c), True)
    assert (got == h).all() and (counts == c).all()
    assert (census.decode(census.encode(h[:1], None), False)[0] == h[:1]).all()
    assert (census.decode(census.encode(np.array([0, 2**64 - 1], np.uint64), None), False)[0] == np.array([0, 2**64 - 1], np.uint64)).all()


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.9, 1.0])
def test_sets(spark, threshold):
    rng = random.Random(int(threshold * 10))
    words = ["hot", "warm", *(f"t{i}" for i in range(25))]
    data = [(i, rng.sample(words, rng.randint(0, 7)) + (["hot", "warm"] if i % 3 == 0 else [])) for i in range(150)]
    data += [(200, None), (201, []), (202, ["a", None, "a", "b", "c"]), (203, ["c", "b", "a"]), (0, data[0][1])]
    sets = {i: {x for x in t or [] if x} for i, t in data}
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "id long, tokens array<string>, class_id string")
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if min(len(sets[a]), len(sets[b])) >= 3 and jaccard(sets[a], sets[b]) >= threshold - 1e-12}
    assert rows(set_join.similar_sets(df, threshold=threshold, least_values=3)) == want
    links = {r.id: r.links for r in set_join.set_links(df, threshold, 3).collect()}
    assert links == {i: sum(i in p for p in want) for i in sets if len(sets[i]) >= 3}


def test_sets_between_tables(spark):
    a = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x", "y"])], "id long, tokens array<string>")
    b = spark.createDataFrame([(1, ["a", "b", "c"]), (9, ["a", "b", "c", "d"]), (2, None)], "id long, tokens array<string>")
    assert rows(set_join.similar_sets(a, b, 0.7)) == {(1, 1), (1, 9)}
    assert set_join.similar_sets(a.limit(0), b, 0.7).count() == 0


def brute_spans(records, length):
    owner = defaultdict(set)
    for k, t in records.items():
        for s in range(len(t) - length + 1):
            owner[t[s : s + length]].add(k)
    out = set()
    for k, t in records.items():
        cover = [False] * (len(t) + 1)
        for s in range(len(t) - length + 1):
            if len(owner[t[s : s + length]]) > 1:
                cover[s : s + length] = [True] * length
        at = 0
        while at < len(t):
            end = at
            while cover[end]:
                end += 1
            if end > at:
                out.add((*k, at + 1, end - at, len(t)))
            at = end + 1
    return out


@pytest.mark.parametrize("length", [18, 20, 33, 150])
def test_spans(spark, length):
    rng = random.Random(length)
    text = lambda n: "".join(rng.choices("abcdefgh \nü😀", k=n))
    passage = [text(rng.randint(length - 3, length * 3)) for _ in range(12)]
    records = {}
    for i in range(60):
        t = text(rng.randint(0, length * 2))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage)
            a, b = sorted(rng.sample(range(len(p) + 1), 2))
            t += p[a:b] if rng.random() < 0.5 else p
            t += text(rng.randint(0, 20))
        records[("m" if i % 2 else "e", i // 2, i % 3)] = t + (passage[0] if i % 3 == 0 else "")
    records["m", 900, 0], records["m", 901, 0] = "z" * (length * 4), ""
    records["m", 902, 0] = text(5000) + passage[1]
    data = [(*k, v) for k, v in records.items()]
    df = spark.createDataFrame([*data, *data[:5], ("m", 950, 0, None)], "src string, rec_id long, item_pos long, text string")
    got = spans.shared_spans(df, length)
    assert rows(got) == brute_spans(records, length)
    share = {(r.src, r.rec_id, r.item_pos): r.shared_chars for r in spans.shared_extent(got).collect()}
    assert all(v <= len(records[k]) for k, v in share.items())
    assert spans.shared_spans(df.limit(0), length).count() == 0


def test_hashes_of_structured_texts():
    """Texts over two letters with the structure that defeats sums modulo a power of two: the Thue-Morse word and its complement."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    for round_ in (0, 1):
        t = spans.Texts([word, other, "x" + word], round_)
        for n in (128, 1024, 4096):
            a, b, c = t.hashes(np.array([0, 4096, 8193]), n)
            assert a != b and a == c
    windows = spans.Texts([word]).hashes(np.arange(4096 - 200), 200)
    texts = {word[i : i + 200] for i in range(4096 - 200)}
    assert len(set(windows.tolist())) == len(texts)


def test_spans_of_structured_texts(spark):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows_ = [("m", 1, 0, word), ("m", 2, 0, other), ("m", None, 0, word[:300]), ("m", None, 0, word[:300]), (None, 4, 0, None)]
    df = spark.createDataFrame(rows_, "src string, rec_id long, item_pos long, text string")
    got = {(r.rec_id, r.start_pos, r.span_len) for r in spans.shared_spans(df, 900).collect()}
    assert got == set()
    assert {(r.rec_id, r.span_len) for r in spans.shared_spans(df, 290).collect() if r.rec_id is None} == {(None, 300)}


def test_covers():
    for p, d in spans.COVERS.items():
        assert {(a - b) % p for a in d for b in d} == set(range(p)) and len(d) * (len(d) - 1) == p - 1
    with pytest.raises(ValueError):
        spans.period_for(17)


def brute_groups(texts, k, threshold, least):
    sets = {i: set(zip(*(w[j:] for j in range(k)))) for i, t in texts.items() if len(w := near_duplicates.words_of(t or "")) >= least}
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if jaccard(sets[a], sets[b]) >= threshold - 1e-12:
            x, y = sorted((find(a), find(b)))
            group[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("k", "threshold", "rare", "all_pairs"), [(3, 0.7, 48, 96), (3, 0.7, 2, 3), (5, 0.8, 1, 2), (3, 0.5, 3, 8)])
def test_near_duplicates(spark, k, threshold, rare, all_pairs):
    rng = random.Random(k * 7 + rare)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of", "größe"] * 8
    base = [[rng.choice(vocab) for _ in range(rng.randint(20, 70))] for _ in range(40)]
    texts = {}
    for i in range(220):
        w = list(base[0] if i % 3 == 0 else rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 2)] = [rng.choice(vocab)] * rng.randint(0, 2)
        texts[i] = " ".join(w).title()
    texts |= {300: None, 301: "", 302: "too short", 303: "a " * 30, 304: "A, a. " * 20, 305: " ".join(rng.choices(vocab, k=3000)), 306: texts[0]}
    df = spark.createDataFrame([(i, t, 1) for i, t in [*texts.items(), (0, texts[0])]], "id long, text string, group_id int")
    got = near_duplicates.near_duplicates(df, k, threshold, 20, rare, all_pairs)
    want = brute_groups(texts, k, threshold, 20)
    parts = lambda g: {frozenset(x for x in g if g[x] == v) for v in set(g.values())}
    assert parts({r.id: r.group_id for r in got.collect()}) == parts(want)
    pairs = {(a, b) for a, b in itertools.combinations(sorted(want), 2) if want[a] == want[b]}
    assert rows(near_duplicates.pairs_in_groups(got)) == pairs


def test_signatures_meet():
    """Whatever the sizes, thresholds and frequencies, two similar sets share a signature; a long set posts in proportion to its size."""
    rng = random.Random(12)
    for _ in range(400):
        t = rng.choice([0.3, 0.5, 0.55, 0.7, 0.8, 0.9, 1.0])
        size = rng.choice([1, 2, 3, 4, 5, 8, 17, 60, 200])
        x = [rng.getrandbits(60) for _ in range(size)]
        kept = rng.sample(x, max(1, min(size, int(np.ceil(size * t)) + rng.randint(0, 2))))
        y = kept + [rng.getrandbits(60) for _ in range(rng.randint(0, max(0, int(len(kept) / t) - size)))]
        if jaccard(set(x), set(y)) < t - 1e-12:
            continue
        df = {w: rng.choice([2, 5, 60, 90]) for w in {*x, *y}}
        flat = [(0, w) for w in sorted(set(x))] + [(1, w) for w in sorted(set(y))]
        s, r = near_duplicates.signatures(np.array([a for a, _ in flat]), np.array([w for _, w in flat], np.uint64), np.array([df[w] for _, w in flat]), t)
        assert set(s[r == 0].tolist()) & set(s[r == 1].tolist()), (t, len(x), len(y))
    for n in (100, 1000, 20_000):
        h = np.sort(np.random.default_rng(n).integers(0, 2**62, n, dtype=np.uint64))
        assert len(near_duplicates.signatures(np.zeros(n, np.int64), h, np.full(n, 10**6), 0.7)[0]) < 4 * n


def test_near_duplicates_hot_group(spark):
    """A group of near copies longer than a list that is tried pair by pair, with unlike texts that share its lists: recall of links against
    brute force is 1."""
    rng = random.Random(9)
    core = [f"c{i}" for i in range(40)]
    texts = {}
    for i in range(400):
        w = list(core)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(40)] = f"x{rng.randrange(50)}"
        texts[i] = " ".join(w)
    for i in range(400, 520):  # half of the core, and one of 20 tails of their own
        k = i % 20
        texts[i] = " ".join(core[:21] + [f"t{k}_{j}" for j in range(25)] + [f"u{i % 3}"])
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    want = brute_groups(texts, 3, 0.7, 20)
    parts = lambda g: {frozenset(x for x in g if g[x] == v) for v in set(g.values())}
    got = near_duplicates.near_duplicates(df, 3, 0.7, 20, 8, 16)
    assert parts({r.id: r.group_id for r in got.collect()}) == parts(want) and len(parts(want)) > 15


def test_near_duplicates_empty(spark):
    assert near_duplicates.near_duplicates(spark.createDataFrame([], "id long, text string")).count() == 0


def test_splits(spark):
    rng = random.Random(5)
    data = [(i, rng.choice("fm"), rng.choice([None, f"p{rng.randint(0, 60)}"]), rng.choice([None, f"k{rng.randint(0, 60) ** 2 // 60}"])) for i in range(900)] + [(1000, None, None, None)]
    data += [(2000 + i, "f", "hot", None) for i in range(450)]
    df = spark.createDataFrame([*data, data[0]], "id long, label string, a string, b string")
    got = splits.grouped_splits(df, ["a", "b"]).collect()
    assert sorted(r.id for r in got) == sorted(x[0] for x in data)
    split = {r.id: r.split for r in got}
    for c in (2, 3):
        by = defaultdict(set)
        for x in data:
            by[x[c]].add(split[x[0]])
        assert all(len(v) == 1 for key, v in by.items() if key is not None)
    assert splits.grouped_splits(df.limit(0), ["a", "b"]).count() == 0
    even = spark.createDataFrame([(i, "fm"[i % 2], f"p{i // 4}", None) for i in range(4000)], "id long, label string, a string, b string")
    share = {r.split: r["count"] / 4000 for r in splits.grouped_splits(even, ["a", "b"]).groupBy("split").count().collect()}
    assert share == pytest.approx({"train": 0.8, "validation": 0.1, "test": 0.1}, abs=0.01)


def test_pairs_kept_together(spark):
    df = spark.createDataFrame([("p", "x"), ("q", "x"), ("q", "y"), ("r", "y"), ("s", None), (None, "x")], "a string, b string")
    assert rows(splits.pairs_kept_together(splits.link_components(df, ["a", "b"]))) == {("p", "q"), ("p", "r"), ("q", "r")}
    assert splits.link_components(df.limit(0), ["a", "b"]).count() == 0
    assert F is not None


def one_by_one(units, proportions):
    """Iterative stratification as its definition says it, a unit at a time."""
    left, need = {}, {}
    for counts in units.values():
        for x, n in counts.items():
            left[x] = left.get(x, 0) + n
    need = {x: [p * n for p in proportions.values()] for x, n in left.items()}
    total, names, out = [p * sum(left.values()) for p in proportions.values()], list(proportions), {}
    while any(left.values()):
        label = min((x for x in left if left[x] > 0), key=lambda x: (left[x], x))
        free = [u for u in units if u not in out and label in units[u]]
        for u in sorted(free, key=lambda u: (-units[u][label], -sum(units[u].values()), tuple(sorted(units[u].items())))):
            s = max(range(len(names)), key=lambda s: (round(need[label][s], 6), round(total[s], 6), -s))
            out[u] = names[s]
            for x, n in units[u].items():
                need[x][s] -= n
                total[s] -= n
                left[x] -= n
    return out


def test_placement_of_runs_is_that_of_units():
    rng = random.Random(8)
    for _ in range(60):
        kinds = [{f"l{rng.randrange(30)}": rng.randint(1, 9) for _ in range(rng.randint(1, 4))} for _ in range(rng.randint(1, 12))]
        units = {f"u{i}": rng.choice(kinds) for i in range(rng.randint(0, 300))}
        p = rng.choice([{"a": 0.8, "b": 0.1, "c": 0.1}, {"a": 0.5, "b": 0.5}, {"a": 0.6, "b": 0.25, "c": 0.1, "d": 0.05}])
        many = lambda placed: Counter((tuple(sorted(units[u].items())), s) for u, s in placed.items())
        assert many(splits.place(units, p)) == many(one_by_one(units, p))


def test_splits_of_many_labels(spark):
    """200 rare labels in single records and one that all share: every label keeps its proportions."""
    rng = random.Random(3)
    data = [(i, f"rare{i % 200}" if i < 4000 else "common", f"p{i}", None) for i in range(12_000)] + [(20_000 + i, "common", "big", "x") for i in range(500)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "id long, label string, a string, b string")
    placed = splits.grouped_splits(df, ["a", "b"])
    share = {(r.label, r.split): r.records for r in splits.label_shares(df, placed).collect()}
    assert all((share[f"rare{i}", "train"], share[f"rare{i}", "validation"], share[f"rare{i}", "test"]) == (16, 2, 2) for i in range(200))
    assert abs(share["common", "train"] - 6800) <= 1 and abs(share["common", "test"] - 850) <= 1


def test_splits_in_bundles(spark):
    """More different label vectors than the driver may hold: small components are placed in bundles, large ones by themselves."""
    rng = random.Random(4)
    sizes = [rng.randint(1, 40) for _ in range(600)] + [2000]
    data = [(c * 10_000 + i, rng.choice("fmx"), f"p{c}", None) for c, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(data, "id long, label string, a string, b string")
    placed = splits.grouped_splits(df, ["a", "b"], most=300).collect()
    assert len(placed) == len(data) and len({(r.component, r.split) for r in placed}) == len(sizes)
    share = {s: n / len(data) for s, n in Counter(r.split for r in placed).items()}
    assert share == pytest.approx({"train": 0.8, "validation": 0.1, "test": 0.1}, abs=0.02)
