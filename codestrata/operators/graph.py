"""Property-graph operators over (src, dst, kind) edges and (node, category) vertices; every one works for all
groups (tasks) at once."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.components import connected_components
from codestrata.operators.numbering import number_in_order
from codestrata.operators.walks import walks
from codestrata.session import cut, shuffle_partitions


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v) in both directions, distinct, without self-loops."""
    e = edges.where("src <> dst")
    return e.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(e.select(F.col("dst").alias("u"), F.col("src").alias("v"))).distinct()


def induced(edges: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """(group, src, dst, kind): the edges between two members (group, node) of the same group."""
    a = members.select(group, F.col("node").alias("src")).distinct()
    b = members.select(group, F.col("node").alias("dst")).distinct()
    return a.join(edges, "src").join(b, [group, "dst"]).select(group, "src", "dst", "kind")


def expand_one_hop(edges: DataFrame, seeds: DataFrame, group: str, out_kinds: list[str], in_kinds: list[str]) -> DataFrame:
    """(group, node, src_type): seeds ("original") and what is one typed step away from them ("expand"): targets of
    ``out_kinds`` edges and sources of ``in_kinds`` edges."""
    s = seeds.select(group, "node").distinct()
    out = s.join(edges.where(F.col("kind").isin(out_kinds)), F.col("node") == F.col("src")).select(group, F.col("dst").alias("node"))
    into = s.join(edges.where(F.col("kind").isin(in_kinds)), F.col("node") == F.col("dst")).select(group, F.col("src").alias("node"))
    new = out.unionByName(into).distinct().join(s, [group, "node"], "left_anti")
    return s.withColumn("src_type", F.lit("original")).unionByName(new.withColumn("src_type", F.lit("expand")))


def neighbor_bonus(edges: DataFrame, seeds: DataFrame, group: str, flags: list[str], step: float = 0.1) -> DataFrame:
    """(group, node, bonus): each seed gives ``step`` for every true flag to each different neighbor that is no seed."""
    count = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags), F.lit(0))
    s = seeds.select(group, F.col("node").alias("u"), count.alias("n"))
    given = s.where("n > 0").join(undirected(edges), "u").groupBy(group, F.col("v").alias("node")).agg(F.round(F.sum(F.col("n") * step), 6).alias("bonus"))
    return given.join(seeds.select(group, "node"), [group, "node"], "left_anti")


def pagerank(edges: DataFrame, restart: DataFrame, alpha: float = 0.85, rounds: int = 10, tolerance: float | None = None, every: int = 5) -> DataFrame:
    """(node, rank) by personalized PageRank on one large graph: (src, dst) edges, repeats counting once, and (node, w)
    restart weights. What nodes without out-edges hold goes back to the restart set. With ``tolerance`` the
    rounds end once the ranks move less than nodes x tolerance in all. Sums are pre-aggregated before
    each shuffle; every few rounds the ranks are cut into the shared folder."""
    e = edges.select("src", "dst").distinct()
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).union(restart.select("node")).distinct()
    whole = restart.agg(F.sum("w")).first()[0] or 1.0
    base = cut(nodes.join(restart.groupBy("node").agg(F.sum("w").alias("w")), "node", "left").select("node", (F.coalesce("w", F.lit(0.0)) / whole).alias("p")), "restart")
    degree = e.groupBy("src").agg(F.count("*").alias("deg"))
    steps = cut(e.join(degree, "src"), "steps")
    rank, n = base.select("node", F.col("p").alias("rank")), base.count() if tolerance else 0
    dangling = cut(base.select("node").join(steps.select(F.col("src").alias("node")).distinct(), "node", "left_anti"), "dangling")
    for i in range(1, rounds + 1):
        lost = rank.join(dangling, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        flow = steps.join(rank, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("deg")).alias("flow"))
        new = base.join(flow, "node", "left").crossJoin(F.broadcast(lost))  # one row
        new = new.select("node", (alpha * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") * F.col("p")) + (1 - alpha) * F.col("p")).alias("rank"))
        if tolerance or i % every == 0 or i == rounds:
            new = cut(new, "rank")
        if tolerance and new.join(rank.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < n * tolerance:
            return new
        rank = new
    return rank


def pagerank_by_group(edges: DataFrame, restart: DataFrame, group: str, alpha: float = 0.85, most_rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(group, node, rank): the same, to convergence, for very many small graphs, the candidates of single tasks. ``edges``
    (group, src, dst), ``restart`` (group, node, w) with every node of the graph; a group whose weights are all
    zero restarts evenly. Groups are hashed into batches and a batch is iterated as one block-diagonal graph,
    each group stopping at its own convergence; batches grow in number with the partitions of the session."""
    both = restart.select(group, F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), "w").unionByName(edges.select(group, F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0.0).alias("w")))
    kind = dict(restart.dtypes)[group]
    batch = F.pmod(F.xxhash64(group), F.lit(8 * shuffle_partitions(restart.sparkSession)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        nodes = part[part.b.isna()].groupby([group, "a"], sort=True, as_index=False).w.sum()
        place = pd.Series(np.arange(len(nodes)), index=pd.MultiIndex.from_frame(nodes[[group, "a"]]))
        e = part[part.b.notna()].drop_duplicates([group, "a", "b"])
        src = place.reindex(pd.MultiIndex.from_frame(e[[group, "a"]])).to_numpy()
        dst = place.reindex(pd.MultiIndex.from_frame(e[[group, "b"]])).to_numpy()
        known = ~(np.isnan(src) | np.isnan(dst))
        src, dst = src[known].astype(np.int64), dst[known].astype(np.int64)
        of = nodes[group].factorize()[0]
        n, size = len(nodes), np.bincount(of).astype(float)
        w = nodes.w.to_numpy(float)
        total = np.bincount(of, w)
        p = np.where(total[of] > 0, w / np.where(total > 0, total, 1.0)[of], 1 / size[of])
        deg = np.bincount(src, minlength=n)
        r, open_ = 1 / size[of], np.ones(len(size), bool)
        for _ in range(most_rounds):
            lost = np.bincount(of, np.where(deg == 0, r, 0.0))
            new = alpha * (np.bincount(dst, r[src] / deg[src], minlength=n) + lost[of] * p) + (1 - alpha) * p
            moved = np.bincount(of, np.abs(new - r))
            r = np.where(open_[of], new, r)
            open_ &= moved >= size * tolerance
            if not open_.any():
                break
        return pd.DataFrame({group: nodes[group], "node": nodes.a, "rank": r})

    return both.withColumn("_batch", batch).groupBy("_batch").applyInPandas(run, f"{group} {kind}, node string, rank double")


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, dist): steps from the nearest of ``sources`` (node) over undirected edges, as far as they lead. The frontier is joined
    once a step and written once; what it meets again can only lie in the last two. The result reads the parts together."""
    steps = cut(undirected(edges), "undirected")
    front = cut(sources.select("node").where("node is not null").distinct().withColumn("dist", F.lit(0)), "front")
    before, parts = front.limit(0), [front]
    for i in itertools.count(1):
        new = front.select(F.col("node").alias("u")).join(steps, "u").select(F.col("v").alias("node")).distinct()
        new = new.join(front, "node", "left_anti").join(before, "node", "left_anti").withColumn("dist", F.lit(i))
        before, front = front, cut(new, "front")
        if not front.limit(1).count():
            return together(parts)
        parts.append(front)


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, depth): everything reachable along (src, dst), with the least number of steps; semi-naive, so each
    round joins only the pairs that were new in the last one, and writes only what is new. Goes on until nothing new is found, on cycles
    as well."""
    e = cut(edges.select("src", "dst").distinct(), "edges")
    new = e.withColumn("depth", F.lit(1))
    parts = [new]
    for i in itertools.count(2):
        step = new.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        new = cut(step.join(together(parts), ["src", "dst"], "left_anti").withColumn("depth", F.lit(i)), "new")
        if not new.limit(1).count():
            return together(parts)
        parts.append(new)


def together(parts: list[DataFrame]) -> DataFrame:
    """Tables of one schema as one, by a balanced tree of unions."""
    while len(parts) > 1:
        parts = [parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def kinds_between(edges: DataFrame) -> DataFrame:
    """(src, dst, kinds): parallel edges as one, with their kinds in order, joined by "|"."""
    return edges.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"))


def two_step_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, n) over all directed paths of two edges between three different nodes: pre-aggregated by the middle
    node, so paths themselves are never listed; paths that return are taken off."""
    k = cut(kinds_between(edges.where("src <> dst")), "kinds")
    a = k.groupBy(F.col("dst").alias("mid"), F.col("kinds").alias("first")).agg(F.count("*").alias("n_in"))
    b = k.groupBy(F.col("src").alias("mid"), F.col("kinds").alias("second")).agg(F.count("*").alias("n_out"))
    paths = a.join(b, "mid").groupBy("first", "second").agg(F.sum(F.col("n_in") * F.col("n_out")).alias("n"))
    back = k.alias("x").join(k.alias("y"), (F.col("x.dst") == F.col("y.src")) & (F.col("x.src") == F.col("y.dst"))).groupBy(F.col("x.kinds").alias("first"), F.col("y.kinds").alias("second")).agg(F.count("*").alias("r"))
    left = paths.join(back, ["first", "second"], "left").withColumn("n", F.col("n") - F.coalesce("r", F.lit(0)))
    return left.where("n > 0").select(F.concat_ws(">", "first", "second").alias("pattern"), "n")


def signed_pairs(edges: DataFrame, places: DataFrame) -> DataFrame:
    """(lo, hi, there, back): two nodes with edges between them, by their numbers in ``places`` (node, id, category), and the tokens of the
    steps from lo to hi and from hi to lo: the categories of both ends, the direction and the kinds."""
    ends = lambda end: places.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"), F.col("category").alias(f"{end}_category"))
    e = edges.join(ends("src"), "src").join(ends("dst"), "dst").select(F.least("src_id", "dst_id").alias("lo"), F.greatest("src_id", "dst_id").alias("hi"), "src_id", "src_category", "dst_category", "kind")
    up = F.col("src_id") == F.col("lo")
    own = lambda first, a, b: F.when(up, F.col(a)).otherwise(F.col(b)).alias(first)
    s = e.groupBy("lo", "hi", own("lo_category", "src_category", "dst_category"), own("hi_category", "dst_category", "src_category"))
    s = s.agg(F.max(up).alias("out"), F.max(~up).alias("in"), F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"))
    name = lambda end: F.coalesce(f"{end}_category", F.lit("Unknown"))
    kinds = F.when(F.col("kinds") == "", "Unknown").otherwise(F.col("kinds"))

    def token(u: str, v: str, out: str, into: str) -> Column:
        way = lambda two, one, other: F.when(F.col(out) & F.col(into), two).when(F.col(out), one).otherwise(other)
        return F.concat(name(u), way(" <->(", " -(", " <-("), kinds, way(")<-> ", ")-> ", ")- "), name(v))

    return s.select("lo", "hi", token("lo", "hi", "out", "in").alias("there"), token("hi", "lo", "in", "out").alias("back"))


SEARCHED = 2_000_000  # most connected pairs of a component that one task holds
WORK = 250_000_000  # searches x connected pairs of a task, about


def path_patterns(edges: DataFrame, nodes: DataFrame, sources: DataFrame, targets: DataFrame, group: str) -> DataFrame:
    """(group, target, length, pattern): the shortest undirected path to each of ``targets`` (group, node) from the
    nearest of its group's ``sources`` (group, node); without a row where none leads there. Of equal paths the one with
    the least parents by name, from the target back. Targets no source shares a component with are not searched
    for, and a group's search ends with its last target.

    Nodes are numbered in their order. Components are hashed into batches; a batch is one graph that a task holds, in which 64 groups are
    searched at a time, as the bits of a word of each node. A component with many groups goes to several tasks, each with some of the
    groups; one that is too large for a task is searched level by level, with joins."""
    e = cut(edges.select("src", "dst", "kind").where("src <> dst").distinct(), "between")
    places = number_in_order(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), ["node"], "id")
    places = cut(places.join(nodes.select("node", "category"), "node", "left"), "places")
    pairs = cut(signed_pairs(e, places), "pairs")
    places = cut(places.select("node", "id").join(connected_components(pairs, "lo", "hi").select(F.col("node").alias("id"), "component"), "id"), "components")
    srcs = cut(sources.select(group, "node").distinct().join(places, "node").select(group, "component", "id"), "sources")
    want = targets.select(group, "node").distinct().join(places, "node").select(group, "component", "id").join(srcs, [group, "id"], "left_anti")
    want = cut(want.join(srcs, [group, "component"], "left_semi"), "targets")
    srcs = srcs.join(want, [group, "component"], "left_semi")
    pairs = pairs.join(places.select(F.col("id").alias("lo"), "component"), "lo")

    most = 2 * edges.sparkSession.sparkContext.defaultParallelism
    held = pairs.groupBy("component").agg(F.count("*").alias("pairs")).join(want.groupBy("component").agg(F.count_distinct(group).alias("groups")), "component")
    held = cut(held.withColumn("tasks", F.least(F.lit(most), F.ceil(F.col("pairs") * F.col("groups") / F.lit(WORK))).cast("int")), "held")
    few, many = held.where(F.col("pairs") <= SEARCHED).select("component", "tasks"), held.where(F.col("pairs") > SEARCHED).select("component")
    found = _held_paths(pairs.join(few, "component"), srcs.join(few, "component"), want.join(few, "component"), group, most)
    if many.limit(1).count():
        found = found.unionByName(_level_paths(*(x.join(many, "component", "left_semi") for x in (pairs, srcs, want)), group))
    return found.join(places.select("id", F.col("node").alias("target")), "id").select(group, "target", "length", "pattern")


def _held_paths(pairs: DataFrame, srcs: DataFrame, want: DataFrame, group: str, most: int) -> DataFrame:
    """(group, id, length, pattern) for components that a task holds, each to be searched by a number of ``tasks``."""
    n = shuffle_partitions(pairs.sparkSession)
    alone = lambda slot: F.when(F.col("tasks") > 1, -1 - F.col("component") * most - slot).otherwise(F.pmod(F.xxhash64("component"), F.lit(8 * n)))
    by_slot = pairs.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    graphs = by_slot.select(alone(F.col("slot")).alias("_batch"), "lo", "hi", "there", "back").repartition(n, "_batch")
    both = srcs.withColumn("wanted", F.lit(False)).unionByName(want.withColumn("wanted", F.lit(True)))
    asked = both.select(alone(F.pmod(F.xxhash64(group), F.col("tasks"))).alias("_batch"), F.col(group).alias("of"), "id", "wanted").repartition(n, "_batch")

    def run(asked: pa.Table, graph: pa.Table) -> pa.Table:
        of, place, length, pattern = walks(*(graph[c] for c in ("lo", "hi", "there", "back")), *(asked[c] for c in ("of", "id", "wanted")))
        return pa.table({group: of, "id": pa.array(place, pa.int64()), "length": pa.array(length, pa.int32()), "pattern": pa.array(pattern, pa.string())})

    return asked.groupBy("_batch").cogroup(graphs.groupBy("_batch")).applyInArrow(run, f"{group} {dict(want.dtypes)[group]}, id long, length int, pattern string")


def _level_paths(pairs: DataFrame, srcs: DataFrame, want: DataFrame, group: str) -> DataFrame:
    """The same for components of any size: the frontiers of all groups are joined with the steps, level by level."""
    steps = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"), F.col("there").alias("token"))
    steps = cut(steps.unionByName(pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v"), F.col("back").alias("token"))), "signed")
    want, srcs = (x.withColumnRenamed("id", "node") for x in (want, srcs))
    left, levels, front = want, [], srcs
    before = front.limit(0)
    while left.limit(1).count():
        new = front.withColumnRenamed("node", "u").join(steps, "u").groupBy(group, "component", F.col("v").alias("node")).agg(F.min(F.struct("u", "token")).alias("by"))
        new = cut(new.join(front, [group, "node"], "left_anti").join(before, [group, "node"], "left_anti"), "level")
        levels.append(new)
        left = cut(left.join(new, [group, "node"], "left_anti"), "left")
        before, front = front, cut(new.select(group, "component", "node").join(left, [group, "component"], "left_semi"), "front")
    start = want.select(group, F.col("node").alias("id"), "node", F.lit(0).alias("length"), F.array().cast("array<string>").alias("tokens"))
    walked = start.limit(0)
    for i in range(len(levels), 0, -1):
        walked = walked.unionByName(start.join(levels[i - 1], [group, "node"], "left_semi").withColumn("length", F.lit(i)).select(*start.columns))
        back = levels[i - 1].select(group, "node", "by")
        walked = walked.join(back, [group, "node"]).select(group, "id", F.col("by.u").alias("node"), "length", F.concat(F.array("by.token"), "tokens").alias("tokens"))
        if i % 4 == 0:
            walked = cut(walked, "walked")
    return walked.select(group, "id", "length", F.array_join("tokens", " / ").alias("pattern"))


def difference(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): edges of one graph that the other lacks."""
    a, b = base.select(*keys).distinct(), other.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("base only")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("other only")))


def masked(nodes: DataFrame, edges: DataFrame, targets: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (group, node) and edges (group, src, dst, kind) without the ``target`` of their group and without what lies inside it. Both
    adjacencies follow from the edges, so none of them keeps a trace of the target. A group without a target stays whole."""
    from codestrata.operators.relational import outside

    kept = nodes.join(targets, group, "left").where(F.col("target").isNull() | outside("node", "target")).drop("target")
    ends = edges.join(targets, group, "left").where(F.col("target").isNull() | (outside("src", "target") & outside("dst", "target"))).drop("target")
    return kept, ends


def restart_weights(similar: DataFrame, bonus: DataFrame, group: str) -> DataFrame:
    """(group, node, w): restart weights that sum to 1 in each group: the similarity (group, node, sim), not below 0, and the ``bonus`` (group,
    node, bonus) of the nodes that have one; all alike where everything is 0. Null similarities count as 0."""
    raw = similar.join(bonus, [group, "node"], "left").select(group, "node", (F.greatest(F.lit(0.0), F.coalesce("sim", F.lit(0.0))) + F.coalesce("bonus", F.lit(0.0))).alias("w"))
    whole = raw.groupBy(group).agg(F.sum("w").alias("s"), F.count("*").alias("n"))
    return raw.join(whole, group).select(group, "node", F.when(F.col("s") > 0, F.col("w") / F.when(F.col("s") > 0, F.col("s"))).otherwise(1 / F.col("n")).alias("w"))
