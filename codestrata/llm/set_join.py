"""All similar pairs between set-valued records (problem 1): a prefix-filtered join.

Tokens are ordered by rarity; a set posts only the tokens of the prefix that its size and the threshold demand;
postings meet only where length and position still allow enough overlap; overlaps are then verified exactly.

Equal sets form one class, so the join runs between distinct sets and copies are expanded only at the end.
The length filter and each side's part of the positional filter are put into the join key as length classes: a common token of short
sets, which could not reach the threshold, posts nothing. Postings of a token are spread over salts in
proportion to how many sets hold it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut

STEPS = 4  # length classes within one factor of 1 / threshold
POSTINGS_A_SALT = 2000
HOT = 10_000
_SLACK = 1e-9


def classes_of(sets: DataFrame, least_values: int = 1) -> tuple[DataFrame, DataFrame]:
    """(class_id, tokens, n) of the distinct sets and (class_id, id, side) of their members. ``sets``: id, side,
    tokens. Nulls and repeated values in a set are dropped; sets with fewer than ``least_values`` values
    belong to no class; repeated rows are one member."""
    clean = F.array_sort(F.array_distinct(F.filter("tokens", lambda x: x.isNotNull())))
    held = sets.select("id", "side", clean.alias("tokens")).where(F.size("tokens") >= least_values)
    held = cut(held.select("id", "side", F.md5(F.to_json("tokens")).alias("class_id"), "tokens").distinct(), "sets")
    return held.select("class_id", "tokens", F.size("tokens").alias("n")).distinct(), held.select("class_id", "id", "side")


def _need(x: Column, y: Column, t: float) -> Column:
    """Overlap that sets of sizes x and y need."""
    return F.ceil(t / (1 + t) * (x + y) - _SLACK)


def with_rarity(tokens: DataFrame) -> DataFrame:
    """Rows of (token, ...) with ``df``, how many hold the token. Tokens with more than one in ``HOT`` of all rows, of which there are fewer than
    ``HOT``, are joined by broadcast, so that the shuffle of the others has no hot key."""
    rarity = cut(tokens.groupBy("token").agg(F.count("*").alias("df")), "rarity")
    total = rarity.agg(F.sum("df")).first()[0] or 0
    hot = rarity.where(F.col("df") > total / HOT)
    marked = tokens.join(F.broadcast(hot.withColumnRenamed("df", "hot")), "token", "left")
    columns = [*tokens.columns, "df"]
    return marked.where("hot is not null").withColumn("df", F.col("hot")).select(columns).unionByName(marked.where("hot is null").join(rarity, "token").select(columns))


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """(class_a, class_b, overlap, n_a, n_b): all pairs of different classes with a Jaccard similarity of at least
    ``threshold``; class_a is the shorter set, or of equal ones the one with the smaller class_id."""
    base = math.log(1 / threshold) / STEPS if threshold < 1 else math.log(2)
    grade = lambda n: F.floor(F.log(n.cast("double")) / base + _SLACK)
    lowest = lambda c: F.greatest(F.lit(1), F.ceil(F.exp(c * base) - 1e-6))
    tokens = classes.select("class_id", "n", F.explode("tokens").alias("token"))
    ordered = with_rarity(tokens).groupBy("class_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ordered"))
    prefix = F.slice("ordered", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - _SLACK) + 1).cast("int"))
    posted = ordered.select("class_id", "n", grade(F.col("n")).alias("g"), F.posexplode(prefix).alias("p", "x"))
    posted = posted.select("class_id", "n", "g", (F.col("p") + 1).alias("p"), "x.token", "x.df").where("df > 1")
    posted = cut(posted.withColumn("salts", F.ceil(F.col("df") / POSTINGS_A_SALT).cast("int")), "postings")

    room = F.col("n") - F.col("p") + 1
    # Each side names the grades of its partners; a grade is left out if even its shortest sets would need more room.
    short = posted.select("*", F.explode(F.sequence("g", F.col("g") + STEPS + 1)).alias("g_long"))
    short = short.where(room >= _need(F.col("n"), F.greatest(F.col("n"), lowest(F.col("g_long"))), threshold))
    short = short.select("token", F.col("g").alias("g_short"), "g_long", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("class_id").alias("class_a"), F.col("n").alias("n_a"), F.col("p").alias("p_a"))
    long_ = posted.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("g") - STEPS - 1), "g")).alias("g_short"))
    long_ = long_.where(room >= _need(F.col("n"), F.greatest(lowest(F.col("g_short")), F.ceil(F.col("n") * threshold - _SLACK)), threshold))
    long_ = long_.select("token", "g_short", F.col("g").alias("g_long"), F.pmod(F.xxhash64("class_id"), F.col("salts")).cast("int").alias("salt"), F.col("class_id").alias("class_b"), F.col("n").alias("n_b"), F.col("p").alias("p_b"))

    need = _need(F.col("n_a"), F.col("n_b"), threshold)
    fits = (
        (F.col("n_a") >= F.col("n_b") * threshold - _SLACK)
        & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("class_a") < F.col("class_b"))))
        & (F.col("n_a") - F.col("p_a") + 1 >= need)
        & (F.col("n_b") - F.col("p_b") + 1 >= need)
    )
    candidates = short.join(long_, ["token", "g_short", "g_long", "salt"]).where(fits).select("class_a", "class_b").distinct()
    a = classes.select(F.col("class_id").alias("class_a"), F.col("tokens").alias("t_a"))
    b = classes.select(F.col("class_id").alias("class_b"), F.col("tokens").alias("t_b"))
    checked = candidates.join(a, "class_a").join(b, "class_b").select("class_a", "class_b", F.size(F.array_intersect("t_a", "t_b")).alias("overlap"), F.size("t_a").alias("n_a"), F.size("t_b").alias("n_b"))
    return checked.where(F.col("overlap") >= threshold * (F.col("n_a") + F.col("n_b") - F.col("overlap")) - _SLACK)


def similar_sets(left: DataFrame, right: DataFrame | None = None, threshold: float = 0.6, least_values: int = 1) -> DataFrame:
    """(id_a, id_b) of all pairs of records (id, tokens) whose sets have a Jaccard similarity of at least
    ``threshold``: within ``left`` with id_a < id_b, or from ``left`` to ``right``. Sets with fewer than
    ``least_values`` values, empty ones included, are in no pair; an empty table gives none."""
    both = left.select("id", F.lit(0).alias("side"), "tokens")
    if right is not None:
        both = both.unionByName(right.select("id", F.lit(1).alias("side"), "tokens"))
    classes, members = classes_of(both, max(1, least_values))
    pairs = cut(similar_classes(classes, threshold).select("class_a", "class_b"), "pairs")
    return expand(pairs, members, right is not None)


def expand(pairs: DataFrame, members: DataFrame, across: bool = False) -> DataFrame:
    """Pairs of records from pairs of classes: between the classes, and between the copies in a class."""
    a = members.select(F.col("class_id").alias("class_a"), F.col("id").alias("x"), F.col("side").alias("s"))
    b = members.select(F.col("class_id").alias("class_b"), F.col("id").alias("y"), F.col("side").alias("r"))
    between = pairs.join(a, "class_a").join(b, "class_b").where("s <> r" if across else "true")
    within = a.join(b, F.col("class_a") == F.col("class_b")).where("s < r" if across else "x < y")
    both = between.select("x", "y", "s").unionByName(within.select("x", "y", "s"))
    if across:
        return both.select(F.when(F.col("s") == 0, F.col("x")).otherwise(F.col("y")).alias("id_a"), F.when(F.col("s") == 0, F.col("y")).otherwise(F.col("x")).alias("id_b"))
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def set_links(sets: DataFrame, threshold: float = 0.6, least_values: int = 1) -> DataFrame:
    """(id, class_id, links): one row per record, with its class of equal sets and its number of partners."""
    classes, members = classes_of(sets.select("id", F.lit(0).alias("side"), "tokens"), max(1, least_values))
    sizes = members.groupBy("class_id").agg(F.count("*").alias("copies"))
    pairs = cut(similar_classes(classes, threshold).select("class_a", "class_b"), "pairs")
    both = pairs.unionByName(pairs.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    others = both.join(sizes.select(F.col("class_id").alias("class_b"), "copies"), "class_b").groupBy(F.col("class_a").alias("class_id")).agg(F.sum("copies").alias("others"))
    links = sizes.join(others, "class_id", "left").select("class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return members.join(links, "class_id").select("id", "class_id", "links")
