"""Splits that keep related records together (problem 7): grouped iterative stratification.

Records that share a value of any link column, directly or by way of others, form a component. Label vectors
are aggregated by component; components with the rarest outstanding label are placed first, into the split
that needs that label most.

Components with the same label vector are alike to this placement, so the driver gets the different vectors with the
number of components of each, not the components: as many entries as vectors have labels. A run of like components is placed in
closed form, with the same outcome as one by one. Which components of a vector go where is decided by their number
within it. All labels count, however many there are.

The driver holds at most ``MAX_ENTRIES`` entries of vectors. Up to there every component is placed by itself. Where there are more
different vectors, the components of the smallest sizes are joined in bundles by hash, in as few as are needed, and a bundle is
placed as one: the balance is then that of bundles, the labels in them all counted.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.components import connected_components
from codestrata.operators.numbering import number_within
from codestrata.session import cut

MAX_ENTRIES = 1_000_000
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def link_components(links: DataFrame, columns: list[str]) -> DataFrame:
    """(node, component) of the values of ``columns``, a node being "column number:value". Nulls link nothing;
    a row with one value still makes that value a node."""
    nodes = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(c).cast("string"))) for i, c in enumerate(columns)]
    pairs = links.select(*(n.alias(f"n{i}") for i, n in enumerate(nodes))).distinct()
    ends = F.filter(F.array(*(f"n{i}" for i in range(len(nodes)))), lambda x: x.isNotNull())
    held = pairs.select(ends.alias("ends")).where(F.size("ends") > 0)
    # The first value is linked with each other one, or with itself if it is alone.
    edges = held.select(F.get("ends", F.lit(0)).alias("a"), F.explode(F.when(F.size("ends") > 1, F.slice("ends", 2, len(columns))).otherwise(F.col("ends"))).alias("b")).distinct()
    return connected_components(edges)


Vector = tuple[tuple[str, int], ...]


def _shares(need: list[float], total: list[float], step: int, size: int, n: int) -> list[int]:
    """How many of ``n`` like units, each with ``step`` of a label and ``size`` in all, each split gets when every unit goes to
    the split that then needs most of the label, and of equals to the one that needs most in all.

    All splits are brought down to one level of need in one go, short of the last few units, which go one by one."""
    given = [0] * len(need)
    order = sorted(range(len(need)), key=lambda s: -need[s])
    level, sum_, count = -math.inf, 0.0, 0
    for k, s in enumerate(order, 1):  # the level at which the highest k splits share n units
        sum_ += need[s]
        here = (sum_ - n * step) / k
        if k == len(order) or here >= need[order[k]]:
            level, count = here, k
            break
    for s in order[:count]:
        given[s] = max(0, int((need[s] - level) / step) - 1)
    for _ in range(n - sum(given)):
        s = max(range(len(need)), key=lambda s: (round(need[s] - given[s] * step, 6), round(total[s] - given[s] * size, 6), -s))
        given[s] += 1
    return given


def place_vectors(vectors: dict[Vector, int], proportions: dict[str, float]) -> dict[Vector, dict[str, int]]:
    """How many of the units of each label vector, of which there are so many, each split gets, by iterative stratification: the label with
    the fewest outstanding records first; of its units those with most of it first; each into the split that needs it most. Ties
    go by name, and by the order of the splits."""
    names = list(proportions)
    left: dict[str, int] = defaultdict(int)
    by_label: dict[str, list[Vector]] = defaultdict(list)
    for v, m in vectors.items():
        for label, n in v:
            left[label] += n * m
            by_label[label].append(v)
    need = {label: [p * n for p in proportions.values()] for label, n in left.items()}
    size = {v: sum(n for _, n in v) for v in vectors}
    total = [p * sum(left.values()) for p in proportions.values()]
    out: dict[Vector, dict[str, int]] = {}
    queue = [(n, label) for label, n in left.items()]
    heapq.heapify(queue)
    while queue:
        n, label = heapq.heappop(queue)
        if n != left[label] or n <= 0:  # an older entry
            continue
        held = [(dict(v)[label], size[v], v) for v in by_label[label] if v not in out]
        for step, all_, v in sorted(held, key=lambda x: (-x[0], -x[1], x[2])):
            given = _shares(need[label], total, step, all_, vectors[v])
            out[v] = {s: g for s, g in zip(names, given) if g}
            for i, g in enumerate(given):
                total[i] -= all_ * g
            for x, k in v:
                left[x] -= k * vectors[v]
                need[x] = [a - k * g for a, g in zip(need[x], given)]
                if x != label and left[x] > 0:
                    heapq.heappush(queue, (left[x], x))
    return out


def place(units: dict[str, dict[str, int]], proportions: dict[str, float]) -> dict[str, str]:
    """Split of each unit (name -> label counts); of like units the first by name go to the first splits."""
    alike: dict[Vector, list[str]] = defaultdict(list)
    for u in sorted(units):
        alike[tuple(sorted(units[u].items()))].append(u)
    out = {}
    for v, given in place_vectors({v: len(us) for v, us in alike.items()}, proportions).items():
        out |= dict(zip(alike[v], (s for s, n in given.items() for _ in range(n))))
    return out


def _bundled(vectors: DataFrame, most: int) -> DataFrame:
    """(component, unit, label, n): the unit of a component is itself, or a bundle where there are too many different vectors. ``vectors`` has
    (component, label, n)."""
    entries = _alike(vectors.withColumnRenamed("component", "unit")).agg(F.sum(F.size("vector"))).first()[0] or 0
    if entries <= most:
        return vectors.withColumn("unit", F.col("component"))
    sizes = vectors.groupBy("component").agg(F.sum("n").alias("size"), F.count("*").alias("labels"))
    by_size = sizes.groupBy("size").agg(F.sum("labels").alias("e")).orderBy(F.desc("size")).limit(most // 4).collect()  # the largest sizes, that many at most
    kept, least = 0, None
    for r in by_size:
        kept += r["e"]
        if kept > most // 2:
            break
        least = r["size"]
    labels = vectors.select("label").distinct().count()
    bundles = max(1, most // 2 // max(1, labels))
    large = F.col("size") >= F.lit(least) if least is not None else F.lit(False)
    unit = F.when(large, F.col("component")).otherwise(F.concat(F.lit("bundle:"), F.pmod(F.xxhash64("component"), F.lit(bundles)).cast("string")))
    return vectors.join(sizes.select("component", unit.alias("unit")), "component")


def _alike(units: DataFrame) -> DataFrame:
    """(vector, count) of (unit, label, n)."""
    return _vector_of(units).groupBy("vector").agg(F.count("*").alias("count"))


def _vector_of(units: DataFrame) -> DataFrame:
    summed = units.groupBy("unit", "label").agg(F.sum("n").alias("n"))
    return summed.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("vector"))


def grouped_splits(rows: DataFrame, columns: list[str], proportions: dict[str, float] | None = None, most: int = MAX_ENTRIES) -> DataFrame:
    """(id, component, split) for rows of (id, label, *columns), one a record. A record with no link value is
    a component of its own ("row:id"); a null label is the label ''. Repeated rows are one record."""
    proportions = proportions or PROPORTIONS
    base = rows.select("id", F.coalesce("label", F.lit("")).alias("label"), *columns).distinct()
    components = cut(link_components(base, columns), "components")
    node = F.coalesce(*(F.concat(F.lit(f"{i}:"), F.col(c).cast("string")) for i, c in enumerate(columns)), F.concat(F.lit("row:"), F.col("id").cast("string")))
    base = base.select("id", "label", node.alias("node"))
    counts = base.groupBy("node", "label").agg(F.count("*").alias("n")).join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    vectors = cut(counts.groupBy("component", "label").agg(F.sum("n").alias("n")), "vectors")
    units = cut(_bundled(vectors, most), "units")
    held = cut(_vector_of(units.select("unit", "label", "n")).select("unit", "vector"), "held")
    alike = held.groupBy("vector").agg(F.count("*").alias("count")).collect()  # at most ``most`` entries
    by_vector = {tuple((x["label"], x["n"]) for x in r["vector"]): r["count"] for r in alike}
    spark, names = rows.sparkSession, list(proportions)
    ranges = [(i, [{"label": x, "n": n} for x, n in v], [sum(given.get(s, 0) for s in names[: k + 1]) for k in range(len(names))]) for i, (v, given) in enumerate(place_vectors(by_vector, proportions).items())]
    placed = spark.createDataFrame(ranges, "code long, vector array<struct<label: string, n: long>>, upto array<long>")
    coded = cut(held.join(F.broadcast(placed), "vector").select("unit", "code", "upto"), "coded")
    numbered = number_within(coded, ["code"], ["unit"])
    split = F.get(F.array(*map(F.lit, names)), F.size(F.filter("upto", lambda x: x <= F.col("number"))))
    of_component = units.select("component", "unit").distinct().join(numbered.select("unit", split.alias("split")), "unit").select("component", "split")
    of_node = components.join(of_component, "component").select("node", "component", "split")
    alone = of_component.where(F.col("component").startswith("row:")).select(F.col("component").alias("node"), "component", "split")
    return base.select("id", "node").join(of_node.unionByName(alone), "node").select("id", "component", "split")


def label_shares(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(label, split, records, share): how the records of each label lie over the splits of ``placed`` (id, split)."""
    labelled = rows.select("id", F.coalesce("label", F.lit("")).alias("label")).distinct()
    found = labelled.join(placed.select("id", "split"), "id").groupBy("label", "split").agg(F.count("*").alias("records"))
    whole = labelled.groupBy("label").agg(F.count("*").alias("all"))
    return found.join(whole, "label").select("label", "split", "records", F.round(F.col("records") / F.col("all"), 6).alias("share"))


def pairs_kept_together(components: DataFrame, column: int = 0) -> DataFrame:
    """(a, b) of all pairs of different values of one link column that lie in the same component, a < b."""
    tag = f"{column}:"
    values = components.where(F.col("node").startswith(tag)).select("component", F.substring("node", len(tag) + 1, 1 << 30).alias("v"))
    a, b = values.select("component", F.col("v").alias("a")), values.select("component", F.col("v").alias("b"))
    return a.join(b, "component").where("a < b").select("a", "b")
