"""Recall, precision and their roll-ups, and pass@k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.functions.text import canonical, last_part, legacy_name, parent_part
from codestrata.operators.relational import prefix_join


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b in doubles; ``empty`` (null by default) where b is 0 or null."""
    r = F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))
    return r if empty is None else F.coalesce(r, F.lit(empty))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r, 0.0)


def relaxed_hits(truth: DataFrame, context: DataFrame, names: DataFrame, legacy: bool = False) -> DataFrame:
    """(key, dep, exact, relaxed, n): for every different dependency of a key whether the retrieved context holds it.

    ``truth`` (key, dep), ``context`` (key, sig, code) with null codes read as empty, ``names`` (name, category) of
    the entities. A dependency is relaxed if it is exact, a variable whose last segment stands in a
    retrieved code, an unresolved attribute whose class is retrieved with the attribute in its code, or a module or package
    that a retrieved signature starts with. ``n`` is how often the truth names it. ``legacy`` reads a
    constructor as its class; else only names inside a constructor go to the class.

    The code rules meet through equal identifiers: a name stands in a code if it is one of its identifiers."""
    norm = legacy_name if legacy else canonical
    dep = truth.select("key", norm("dep").alias("dep")).where("dep <> ''").groupBy("key", "dep").agg(F.count("*").alias("n"))
    ctx = context.select("key", norm("sig").alias("sig"), F.coalesce("code", F.lit("")).alias("code"))
    exact = ctx.select("key", F.col("sig").alias("dep")).distinct().withColumn("exact", F.lit(True))
    kinds = names.select(norm("name").alias("dep"), "category").distinct()
    in_code = ctx.select("key", "sig", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("word"))
    typed = dep.join(kinds, "dep").select("key", "dep", "category", last_part("dep").alias("word"), parent_part("dep").alias("owner"))
    variable = typed.where("category = 'Variable'").join(in_code.select("key", "word").distinct(), ["key", "word"], "left_semi").select("key", "dep")
    owners = in_code.select("key", F.col("sig").alias("inside"), "word").distinct()
    attribute = typed.where("category = 'Unresolved Attribute'").join(owners, ["key", "word"]).where("inside = owner or startswith(inside, owner || '.')").select("key", "dep")
    modules = typed.where("category in ('Module', 'Package')").select("key", "dep")
    starts = prefix_join(ctx.select("key", "sig").distinct(), "sig", modules.select("dep").distinct(), "dep").select("key", "dep").join(modules, ["key", "dep"], "left_semi")
    soft = variable.unionByName(attribute).unionByName(starts).distinct().withColumn("soft", F.lit(True))
    out = dep.join(exact, ["key", "dep"], "left").join(soft, ["key", "dep"], "left")
    out = out.withColumn("exact", F.coalesce("exact", F.lit(False)))
    return out.select("key", "dep", "exact", (F.col("exact") | F.coalesce("soft", F.lit(False))).alias("relaxed"), F.coalesce("soft", F.lit(False)).alias("soft"), "n")


def unique_recall(hits: DataFrame) -> DataFrame:
    """(key, total, hits, exact_hits, dr, exact_dr): every dependency counts once; keys without one have no row."""
    g = hits.groupBy("key").agg(F.count("*").alias("total"), F.count_if("relaxed").alias("hits"), F.count_if("exact").alias("exact_hits"))
    return g.select("key", "total", "hits", "exact_hits", F.round(ratio(F.col("hits"), F.col("total")), 6).alias("dr"), F.round(ratio(F.col("exact_hits"), F.col("total")), 6).alias("exact_dr"))


def legacy_recall(hits: DataFrame) -> DataFrame:
    """(key, total, hits, recall) the old way: exact hits count once, relaxed ones on top for every mention in the
    truth, exact or not, so that recall can exceed 1."""
    g = hits.groupBy("key").agg(F.count("*").alias("total"), (F.count_if("exact") + F.coalesce(F.sum(F.when(F.col("soft"), F.col("n"))), F.lit(0))).cast("long").alias("hits"))
    return g.select("key", "total", "hits", F.round(ratio(F.col("hits"), F.col("total")), 6).alias("recall"))


def macro_micro(rows: DataFrame, by: list[str], hits: str, truth: str, predicted: str) -> DataFrame:
    """Macro recall and precision (nulls skipped) and micro ones from sums, by group."""
    r, p = ratio(F.col(hits), F.col(truth)), ratio(F.col(hits), F.col(predicted))
    g = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(r).alias("macro_r"), F.avg(p).alias("macro_p"), F.sum(hits).alias("h"), F.sum(truth).alias("t"), F.sum(predicted).alias("q"))
    r, p = ratio(F.col("h"), F.col("t"), 0.0), ratio(F.col("h"), F.col("q"), 0.0)
    return g.select(*by, "rows", F.round("macro_r", 6).alias("macro_r"), F.round("macro_p", 6).alias("macro_p"), F.round(r, 6).alias("micro_r"), F.round(p, 6).alias("micro_p"), F.round(f1(p, r), 6).alias("micro_f1"))


def weighted_rollup(projects: DataFrame, r: str, p: str, weight: str) -> DataFrame:
    """Roll-up of per-project recall and precision, rounded to six places first, weighted by tasks; F1 from both."""
    w = F.sum(weight)
    g = projects.agg(F.sum(F.round(F.col(r), 6) * F.col(weight)).alias("sr"), F.sum(F.round(F.col(p), 6) * F.col(weight)).alias("sp"), w.alias("tasks"))
    wr, wp = ratio(F.col("sr"), F.col("tasks"), 0.0), ratio(F.col("sp"), F.col("tasks"), 0.0)
    return g.select("tasks", F.round(wr, 6).alias("recall"), F.round(wp, 6).alias("precision"), F.round(f1(wp, wr), 6).alias("f1"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - prod(1 - k / i) for i from n - c + 1 to n; 1 if fewer than k fail; null if n < k."""
    whole = F.aggregate(F.when(c > 0, F.sequence(n - c + 1, n)).otherwise(F.array().cast("array<bigint>")), F.lit(1.0), lambda a, i: a * (1 - F.lit(float(k)) / i))
    return F.when(n < k, None).when(n - c < k, 1.0).otherwise(1 - whole)


def first_k(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


def recall_at_k(df: DataFrame, by: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """(by, best): the best of the first k values of each group, nulls skipped."""
    return first_k(df, by, order, k).groupBy(*by).agg(F.max(value).alias("best"))


def edit_similarity(a: str | Column, b: str | Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return ratio(F.greatest(F.length(a), F.length(b)) - F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)), 1.0)


def right_closed_bins(values: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(lo, hi, n) of bins (lo, hi], the first one with its lower edge; empty bins have 0, the last row (hi null)
    counts what is above."""
    spark = values.sparkSession
    bins = [(float(a), float(b)) for a, b in zip(edges, edges[1:])] + [(float(edges[-1]), None)]
    table = spark.createDataFrame(bins, "lo double, hi double")
    v = F.col(value).cast("double")
    place = F.when(v.isNull() | (v < edges[0]), None)
    for a, b in zip(edges, edges[1:]):
        place = place.when(v <= b, F.lit(float(a)))
    counts = values.select(place.otherwise(F.lit(float(edges[-1]))).alias("lo")).where(F.col("lo").isNotNull()).groupBy("lo").agg(F.count("*").alias("n"))
    return table.join(counts, "lo", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
