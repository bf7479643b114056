"""Similarity graphs and clusterings in coordinate form (group, i, j, w) with i < j: no dense matrix is built, and pairs
are formed only inside a group (module)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.operators.retrieval import dot
from codestrata.session import cut


def similarity_pairs(vectors: DataFrame) -> DataFrame:
    """(group, i, j, w): cosine mapped to 0..1 for all pairs of one group of (group, id, v), v normalized; a zero
    vector has 0.5 with any other."""
    a = vectors.select("group", F.col("id").alias("i"), F.col("v").alias("a"))
    b = vectors.select("group", F.col("id").alias("j"), F.col("v").alias("b"))
    return a.join(b, "group").where("i < j").select("group", "i", "j", ((dot("a", "b") + 1) / 2).alias("w"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("group", "i", "j", "w").unionByName(pairs.select("group", F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def scaled(pairs: DataFrame) -> DataFrame:
    """Weights scaled by the least and largest of the group; the zero diagonal counts, and a constant group has 0."""
    w = Window.partitionBy("group")
    lo, hi = F.least(F.min("w").over(w), F.lit(0.0)), F.greatest(F.max("w").over(w), F.lit(0.0))
    return pairs.withColumn("w", F.when(hi > lo, (F.col("w") - lo) / F.when(hi > lo, hi - lo)).otherwise(0.0))


def fuse(sims: DataFrame, links: DataFrame, a: float) -> DataFrame:
    """a x similarity + (1 - a) x link, a missing one being 0."""
    both = sims.join(links.withColumnRenamed("w", "l"), ["group", "i", "j"], "full_outer")
    return both.select("group", "i", "j", (a * F.coalesce("w", F.lit(0.0)) + (1 - a) * F.coalesce("l", F.lit(0.0))).alias("w"))


def dynamic_k(m: Column) -> Column:
    return F.least(F.greatest(F.least(F.greatest(F.floor(2.5 * F.sqrt(m)), F.lit(3)), F.lit(30)), F.lit(1)), m - 1)


def nearest(pairs: DataFrame, k: Column | int) -> DataFrame:
    """(group, i, j, w): pairs in which one is among the k nearest of the other (ties to the smaller id). ``k`` may use
    ``m``, the size of the group."""
    sym = both_ways(pairs)
    if not isinstance(k, int):
        ends = sym.groupBy("group").agg(F.count_distinct("i").alias("m"))
        sym = sym.join(ends, "group")
    r = F.row_number().over(Window.partitionBy("group", "i").orderBy(F.desc(F.round("w", 9)), "j"))
    kept = sym.withColumn("r", r).where(F.col("r") <= k)
    return kept.groupBy("group", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("w").alias("w"))


def propagate(pairs: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """(group, id, label) by weighted label propagation: each round every node takes the label with the most weight
    around it, ties to the smaller label; nodes without neighbors keep their own."""
    sym = cut(both_ways(pairs), "pairs")
    labels = nodes.select("group", "id", F.col("id").alias("label"))
    for _ in range(rounds):
        votes = sym.join(labels.select("group", F.col("id").alias("j"), "label"), ["group", "j"]).groupBy("group", F.col("i").alias("id"), "label").agg(F.round(F.sum("w"), 6).alias("v"))
        best = votes.groupBy("group", "id").agg(F.min(F.struct((-F.col("v")).alias("v"), F.col("label").alias("l"))).alias("x"))
        labels = cut(nodes.select("group", "id").join(best, ["group", "id"], "left").select("group", "id", F.coalesce("x.l", "id").alias("label")), "labels")
    return labels


def size_stats(labels: DataFrame, by: list[str], tiny: int = 3) -> DataFrame:
    """(by, n, clusters, singleton_share, tiny_share, cv) of the cluster sizes of (by, label)."""
    s = labels.groupBy(*by, "label").agg(F.count("*").alias("c"))
    part = lambda cond: F.round(F.count_if(cond) / F.count("*"), 6)
    return s.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("clusters"), part(F.col("c") == 1).alias("singleton_share"), part(F.col("c") <= tiny).alias("tiny_share"), F.round(F.stddev_pop("c") / F.avg("c"), 6).alias("cv"))


def separation(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(group, intra, inter, separation, density_std): mean weights within clusters (weighted by their size, singletons
    skipped) and between them, and the spread of the cluster densities."""
    a = labels.select("group", F.col("id").alias("i"), F.col("label").alias("a"))
    b = labels.select("group", F.col("id").alias("j"), F.col("label").alias("b"))
    p = pairs.join(a, ["group", "i"]).join(b, ["group", "j"]).groupBy("group", "a", "b").agg(F.sum("w").alias("s"))
    size = labels.groupBy("group", F.col("label").alias("a")).agg(F.count("*").alias("c"))
    inside = p.where("a = b").groupBy("group", "a").agg(F.sum("s").alias("s"))
    d = size.where("c > 1").join(inside, ["group", "a"], "left").withColumn("density", F.coalesce("s", F.lit(0.0)) / (F.col("c") * (F.col("c") - 1) / 2))
    intra = d.groupBy("group").agg((F.sum(F.col("density") * F.col("c")) / F.sum("c")).alias("intra"), F.stddev_pop("density").alias("spread"))
    total = size.groupBy("group").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("cross"))
    inter = p.where("a <> b").groupBy("group").agg(F.sum("s").alias("s"))
    out = total.join(intra, "group", "left").join(inter, "group", "left")
    e = F.coalesce(F.try_divide(F.coalesce("s", F.lit(0.0)), "cross"), F.lit(0.0))
    i = F.coalesce("intra", F.lit(0.0))
    return out.select("group", F.round(i, 6).alias("intra"), F.round(e, 6).alias("inter"), F.round(i - e, 6).alias("separation"), F.round(F.coalesce("spread", F.lit(0.0)), 6).alias("density_std"))


def adjusted_rand(partitions: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, ari): adjusted Rand index of two columns, from contingency counts; 1 if both are trivial."""
    pairs = F.sum(F.col("cell") * (F.col("cell") - 1) / 2)
    cells = partitions.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").cast("double").alias("cell"))
    ij = cells.agg(pairs.alias("ij"), F.sum("cell").alias("n"))
    ai = cells.groupBy("x").agg(F.sum("cell").alias("cell")).agg(pairs.alias("ai"))
    bj = cells.groupBy("y").agg(F.sum("cell").alias("cell")).agg(pairs.alias("bj"))
    x = ij.crossJoin(ai).crossJoin(bj)  # one row each
    expected = F.col("ai") * F.col("bj") / (F.col("n") * (F.col("n") - 1) / 2)
    top = (F.col("ai") + F.col("bj")) / 2
    return x.select(F.col("n").cast("long").alias("n"), F.round(F.when(top == expected, 1.0).otherwise((F.col("ij") - expected) / F.when(top != expected, top - expected)), 6).alias("ari"))


def coassociation(runs: DataFrame, n_runs: int) -> DataFrame:
    """(group, i, j, w): share of the runs (group, id, run, label) in which two members of a group are together."""
    a = runs.select("group", F.col("id").alias("i"), "run", "label")
    b = runs.select("group", F.col("id").alias("j"), "run", "label")
    return a.join(b, ["group", "run", "label"]).where("i < j").groupBy("group", "i", "j").agg((F.count("*") / n_runs).alias("w"))


def communities(pairs: DataFrame, nodes: DataFrame, gammas: list[float]) -> DataFrame:
    """(group, gamma, id, label): constant Potts model by deterministic local moving, for every resolution; stands in
    for the Leiden library. A move gains the weight to the new cluster less gamma for each of its members; nodes are
    visited in order until none moves. One task a group: groups are the modules of one repository."""
    kind = dict(nodes.dtypes)["group"]
    both = pairs.select("group", "i", "j", "w").unionByName(nodes.select("group", F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("w")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(part[part.i == part.j].i.unique())
        e = part[part.i != part.j]
        src, dst = np.searchsorted(ids, e.i), np.searchsorted(ids, e.j)
        near: list[dict[int, float]] = [{} for _ in ids]
        for x, y, w in zip(src, dst, e.w):
            near[x][y] = near[y][x] = w
        out = []
        for g in gammas:
            label, size = list(range(len(ids))), [1] * len(ids)
            for _ in range(50):
                moved = False
                for x in range(len(ids)):
                    gain: dict[int, float] = {}
                    for y, w in near[x].items():
                        gain[label[y]] = gain.get(label[y], 0.0) + w
                    own = label[x]
                    best, top = own, gain.get(own, 0.0) - g * (size[own] - 1)
                    for c in sorted(gain):
                        if c != own and gain[c] - g * size[c] > top + 1e-12:
                            best, top = c, gain[c] - g * size[c]
                    if best != own:
                        size[own] -= 1
                        size[best] += 1
                        label[x], moved = best, True
                if not moved:
                    break
            first: dict[int, int] = {}
            for x, c in enumerate(label):
                first.setdefault(c, x)
            out.append(pd.DataFrame({"group": part.group.iloc[0], "gamma": g, "id": ids, "label": [ids[first[c]] for c in label]}))
        return pd.concat(out)

    return both.groupBy("group").applyInPandas(run, f"group {kind}, gamma double, id long, label long")


def merge_tiny(pairs: DataFrame, labels: DataFrame, tiny: int = 3, passes: int = 5) -> DataFrame:
    """(group, id, label): clusters of fewer than ``tiny`` members go, smallest first, to the cluster with the highest mean
    weight to them, a large one being penalized by 1 + ln(1 + size); those without any stay."""
    kind = dict(labels.dtypes)["group"]
    both = pairs.select("group", "i", "j", "w", F.lit(None).cast("long").alias("label")).unionByName(labels.select("group", F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("w"), F.col("label").cast("long").alias("label")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own = part[part.label.notna()].sort_values("i")
        label = {int(i): int(c) for i, c in zip(own.i, own.label)}
        e = part[part.label.isna()]
        edges = [(int(i), int(j), w) for i, j, w in zip(e.i, e.j, e.w)]
        for _ in range(passes):
            size: dict[int, int] = {}
            for c in label.values():
                size[c] = size.get(c, 0) + 1
            small = sorted((c for c in size if size[c] < tiny), key=lambda c: (size[c], c))
            changed = False
            for c in small:
                pull: dict[int, float] = {}
                for i, j, w in edges:
                    a, b = label[i], label[j]
                    if a != b and c in (a, b):
                        o = b if a == c else a
                        pull[o] = pull.get(o, 0.0) + w
                if pull and 0 < size.get(c, 0) < tiny:
                    to = max(sorted(pull), key=lambda o: pull[o] / (size[c] * size[o]) / (1 + math.log(1 + size[o])))
                    for i in label:
                        if label[i] == c:
                            label[i] = to
                    size[to] += size.pop(c)
                    changed = True
            if not changed:
                break
        return pd.DataFrame({"group": part.group.iloc[0], "id": list(label), "label": list(label.values())})

    return both.groupBy("group").applyInPandas(run, f"group {kind}, id long, label long")


def consensus(together: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(group, id, label): members (group, id) connected by pairs (group, i, j, w) that are together in at least ``threshold`` of the
    runs; the label is the smallest member. Members without such a pair are alone."""
    from codestrata.operators.components import connected_components

    node = lambda c: F.struct("group", F.col(c).alias("id"))
    strong = together.where(F.col("w") >= threshold - 1e-9)
    found = connected_components(strong.select(node("i").alias("a"), node("j").alias("b"))).select("node.group", "node.id", F.col("component.id").alias("label"))
    return members.select("group", "id").distinct().join(found, ["group", "id"], "left").withColumn("label", F.coalesce("label", "id"))


def silhouette(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(group, silhouette): mean over the members of (b - a) / max(a, b), with distances 1 - w of the pairs (group, i, j, w): a to the own
    cluster, b to the nearest other one. Members alone in their cluster count 0; groups of one cluster have none. Distances are
    summed by member and cluster before anything is compared."""
    both = pairs.select("group", "i", "j", (1 - F.col("w")).alias("dist"))
    both = both.unionByName(both.select("group", F.col("j").alias("i"), F.col("i").alias("j"), "dist"))
    to = both.join(labels.select("group", F.col("id").alias("j"), F.col("label").alias("other")), ["group", "j"]).groupBy("group", "i", "other").agg(F.avg("dist").alias("d"))
    x = labels.select("group", F.col("id").alias("i"), "label").join(to, ["group", "i"])
    own = x.groupBy("group", "i").agg(F.max(F.when(F.col("other") == F.col("label"), F.col("d"))).alias("a"), F.min(F.when(F.col("other") != F.col("label"), F.col("d"))).alias("b")).where("b is not null")
    most = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | (most == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.when(most != 0, most))
    return own.groupBy("group").agg(F.round(F.avg(value), 6).alias("silhouette"))


def scaled_finite(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """With ``name``: the value scaled to 0..1 between the finite bounds of its group; 0 in a constant group, and for what is not finite."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.col(value))
    bounds = df.groupBy(*by).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return df.join(bounds, by).withColumn(name, F.coalesce(F.when(span > 0, (finite - F.col("_lo")) / F.when(span > 0, span)), F.lit(0.0))).drop("_lo", "_hi")


def members_of(labels: DataFrame) -> DataFrame:
    """(group, label, n, members): members in order. A list is as long as its cluster."""
    return labels.groupBy("group", "label").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members"))
