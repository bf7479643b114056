"""Filters, keyed dedup and join patterns. All are set-at-a-time and keep to equi-joins: containment, prefix and
range conditions are turned into keys first, so none falls back to comparing all rows with all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.functions.text import strip
from codestrata.session import cut


def first_wins(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row a key: the values of the row that comes first by ``order``; pre-aggregated, no window. A null key is a
    key like any other; ties in ``order`` are decided by the values, smallest first."""
    return _wins(df, keys, order, values, F.min)


def last_wins(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row a key: the values of the row that comes last by ``order``."""
    return _wins(df, keys, order, values, F.max)


def _wins(df: DataFrame, keys: list[str], order: list[str], values: list[str], agg) -> DataFrame:
    rest = [v for v in values if v not in order]
    picked = df.groupBy(*keys).agg(agg(F.struct(*order, *rest)).alias("x"))
    return picked.select(*keys, *(F.col(f"x.{v}").alias(v) for v in values))


def ordered_distinct(values: Column) -> Column:
    """Array without repeats, first places kept (nulls count as one value)."""
    return F.array_distinct(values)


def array_items(df: DataFrame, keys: list[str], array: Column, name: str = "item") -> DataFrame:
    """(keys, pos, item) with positions from 1; null and empty arrays give no rows."""
    return df.select(*keys, F.posexplode(array).alias("p", name)).select(*keys, (F.col("p") + 1).cast("long").alias("pos"), name)


def non_empty(df: DataFrame, array: str) -> DataFrame:
    return df.where(F.coalesce(F.size(F.col(array)), F.lit(0)) > 0)


def in_folded(df: DataFrame, column: str, wanted: DataFrame, wanted_column: str) -> DataFrame:
    """Rows whose trimmed, lower-cased value is among those of ``wanted``, treated alike; nulls are not."""
    keys = wanted.select(F.lower(strip(wanted_column)).alias("_k")).where("_k is not null").distinct()
    return df.withColumn("_k", F.lower(strip(column))).join(keys, "_k", "left_semi").drop("_k")


def valid_edges(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges (src, dst, ...) with both ends among ``nodes``."""
    ends = nodes.select(node).distinct()
    return edges.join(ends.withColumnRenamed(node, "src"), "src", "left_semi").join(ends.withColumnRenamed(node, "dst"), "dst", "left_semi")


def outside(name: str | Column, target: str | Column) -> Column:
    """True unless ``name`` is ``target`` or nested in it (``target.x``); null targets exclude nothing."""
    name, target = (F.col(c) if isinstance(c, str) else c for c in (name, target))
    return ~F.coalesce((name == target) | name.startswith(F.concat(target, F.lit("."))), F.lit(False))


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, default: str | None = None) -> DataFrame:
    """Left join with a default; ``table`` must have one row a key (see ``first_wins``)."""
    t = table.select(F.col(table_key).alias(key), F.col(value).alias(value))
    out = df.join(t, key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def fallback_lookup(df: DataFrame, keys: list[tuple[str, Column]], table: DataFrame, table_keys: list[Column], order: list[str], value: str) -> DataFrame:
    """Look ``value`` up by the first of several keys that finds it. ``keys`` are (tier name, key of the row),
    ``table_keys`` the matching keys of the table; each tier is a join with a table of one row a key (first by
    ``order``). Adds ``value`` and ``tier``, both null where nothing is found."""
    out = df
    for i, ((_, left), right) in enumerate(zip(keys, table_keys)):
        tier = first_wins(table.select(right.alias(f"_k{i}"), *{*order, value}).where(F.col(f"_k{i}").isNotNull()), [f"_k{i}"], order, [value])
        out = out.withColumn(f"_k{i}", left).join(tier.withColumnRenamed(value, f"_v{i}"), f"_k{i}", "left")
    values = [F.col(f"_v{i}") for i in range(len(keys))]
    tier = F.coalesce(*(F.when(v.isNotNull(), F.lit(name)) for v, (name, _) in zip(values, keys)))
    return out.select(*df.columns, F.coalesce(*values).alias(value), tier.alias("tier"))


def unique_match(df: DataFrame, keys: list[str], table: DataFrame, value: str) -> DataFrame:
    """Left join that takes ``value`` only where exactly one different value has the key."""
    one = table.groupBy(*keys).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n")).where("_n = 1").drop("_n")
    return df.join(one, keys, "left")


def zip_by_place(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str], group: list[str]) -> DataFrame:
    """Join row i of a group with row i of the same group on the other side, by explicit orders."""
    a = left.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*left_order)))
    b = right.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*right_order)))
    return a.join(b, [*group, "place"])


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``todo`` without a partner in ``done``, one a key: what a resumed run still has to do."""
    return todo.dropDuplicates(keys).join(done.select(*keys).distinct(), keys, "left_anti")


def containment_join(texts: DataFrame, text: str, parts: DataFrame, part: str, gram: int = 3) -> DataFrame:
    """Pairs where ``part`` stands in ``text``. Parts meet texts through their first ``gram`` characters as an equi-key; shorter parts meet
    substrings of their own length. Only numbers of the different texts travel with their substrings; a text joins each of its pairs
    once, to be verified. Empty parts match nothing."""
    t = texts.where(F.length(text) > 0)
    numbered = cut(t.select(F.col(text).alias("_t")).distinct().withColumn("_i", F.monotonically_increasing_id()), "texts")
    p = parts.where(F.length(part) > 0).select(F.col(part).alias("_q")).distinct()
    at = F.sequence(F.lit(1), F.length("_t"))
    grams = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(gram)), lambda n: F.when(i + n - 1 <= F.length("_t"), F.substring(F.col("_t"), i, n))))))
    cut_up = numbered.select("_i", F.explode(F.filter(grams, lambda x: x.isNotNull())).alias("_g"))
    met = cut_up.join(p.withColumn("_g", F.substring("_q", 1, gram)), "_g").select("_i", "_q")
    pairs = met.join(numbered, "_i").where(F.col("_t").contains(F.col("_q"))).select("_t", "_q")
    return t.join(pairs, F.col(text) == F.col("_t")).join(parts, F.col("_q") == F.col(part)).drop("_t", "_q")


def prefix_join(texts: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Pairs where ``text`` starts with ``prefix``: each text is cut to the lengths that prefixes have (fewer than
    the longest of them has characters) and joined by equality."""
    lengths = [r[0] for r in prefixes.select(F.length(prefix).alias("n")).where("n > 0").distinct().orderBy("n").collect()]
    cuts = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length(text)) if lengths else F.array().cast("array<int>")
    cut_up = texts.withColumn("_n", F.explode(cuts)).withColumn("_p", F.substring(F.col(text), F.lit(1), F.col("_n"))).drop("_n")
    return cut_up.join(prefixes.where(F.length(prefix) > 0), F.col("_p") == F.col(prefix)).drop("_p")


def longest_prefix(texts: DataFrame, text: str, key: list[str], prefixes: DataFrame, prefix: str) -> DataFrame:
    """(key, prefix): the longest prefix of each text; texts without one have no row."""
    pairs = prefix_join(texts.select(*key, text), text, prefixes.select(prefix).distinct(), prefix)
    return pairs.groupBy(*key).agg(F.max(F.struct(F.length(prefix).alias("n"), F.col(prefix).alias("p"))).alias("x")).select(*key, F.col("x.p").alias(prefix))


def smallest_interval(points: DataFrame, key: list[str], place: str, intervals: DataFrame, start: str, end: str, name: str, width: int = 64) -> DataFrame:
    """For each point the shortest interval with the same key that holds it; ties go to the smaller start, then
    name. Intervals are put into bins of ``width``, so a point meets only those of its bin. Points in none, and
    intervals that end before they start, have no row."""
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    iv = intervals.where(F.col(start) <= F.col(end)).select(*key, start, end, name, F.explode(bins).alias("_b"))
    pt = points.withColumn("_b", F.floor(F.col(place) / width))
    held = pt.join(iv, [*key, "_b"]).where((F.col(place) >= F.col(start)) & (F.col(place) <= F.col(end)))
    best = F.min(F.struct((F.col(end) - F.col(start)).alias("span"), F.col(start).alias("s"), F.col(name).alias("n"))).alias("x")
    return held.groupBy(*points.columns).agg(best).select(*points.columns, F.col("x.n").alias(name), F.col("x.span").cast("long").alias("span"))


def suffix_lookup(queries: DataFrame, query: str, names: DataFrame, name: str) -> DataFrame:
    """(query, name): the name that is the query or ends with "." and the query, with the fewest further segments;
    ties go by name. Names are cut into their suffixes and joined by equality."""
    parts = F.split(name, r"\.")
    cut_up = names.select(name).distinct().select(name, F.posexplode(parts).alias("extra", "_s")).select(name, "extra", F.array_join(F.slice(parts, F.col("extra") + 1, F.size(parts)), ".").alias("_q"))
    found = queries.select(query).distinct().join(cut_up, F.col(query) == F.col("_q"))
    return found.groupBy(query).agg(F.min(F.struct("extra", name)).alias("x")).select(query, F.col(f"x.{name}").alias(name), F.col("x.extra").cast("long").alias("extra"))


def key_differences(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has, "missing" or "unexpected"."""
    a, b = expected.select(key).distinct().withColumn("e", F.lit(1)), got.select(key).distinct().withColumn("g", F.lit(1))
    side = F.when(F.col("g").isNull(), "missing").otherwise("unexpected")
    return a.join(b, key, "full_outer").where("e is null or g is null").select(key, side.alias("side"))


def total(df: DataFrame, order: list[str], partition: list[str], value: Column) -> Column:
    """Running total in order."""
    return F.sum(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
