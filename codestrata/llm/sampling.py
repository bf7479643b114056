"""Sample that matches target category proportions (problem 3).

Categories are counted; integer quotas are allocated by largest remainder, raised to the floor of small
categories and capped by what there is; the rows with the smallest random keys of each category are drawn; shortfalls are reported.
Only the counts of the target categories, as many as the target table has, reach the driver.

The draw is one plan: the records that count are written once; the counts, the allocation, the thresholds of the keys and the report
all come from that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codestrata.session import cut

CELL = ["domain", "type"]
BITS = 12  # of the key that one level of the histogram resolves
RANKED = 100_000  # rows that may be ranked in one bin


def cells_of(tasks: DataFrame) -> DataFrame:
    """(id, domain, type) of the records that count: one row a key; a null in either category counts nowhere."""
    return tasks.where("domain is not null and type is not null and id is not null").select("id", *CELL).distinct()


def demand(targets: DataFrame) -> DataFrame:
    """Targets in lower case with ``wanted``: the floor or the share of the sample, rounded up, if that is more.
    A null share, floor or size counts as 0."""
    share, floor, size = (F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("target_permille", "min_rows", "sample_size"))
    return targets.select(F.lower("domain").alias("domain"), F.lower("type").alias("type"), share.alias("permille"), floor.alias("floor"), size.alias("size"), F.greatest(floor, F.expr("div(coalesce(cast(target_permille as bigint), 0) * coalesce(sample_size, 0) + 999, 1000)")).alias("wanted"))


def allocate(cells: list[dict]) -> list[dict]:
    """Quotas of cells (domain, type, permille, floor, size, wanted, available): largest remainder of the shares, floors kept,
    never more than there is; what capped cells cannot take goes to the others in proportion to their
    shares, by largest remainder again. Ties go by name."""
    if not cells:
        return []
    size, whole = max(c["size"] for c in cells), sum(c["permille"] for c in cells) or 1
    low = [min(c["floor"], c["available"]) for c in cells]
    quota = list(low)
    free = [i for i, c in enumerate(cells) if c["permille"]]
    fixed: set[int] = set()
    while free:
        rest = max(0, size - sum(quota[i] for i in range(len(cells)) if i in fixed or i not in free))
        parts = sum(cells[i]["permille"] for i in free)
        exact = {i: rest * cells[i]["permille"] / parts for i in free}
        bound = {i: min(max(exact[i], low[i]), cells[i]["available"]) for i in free}
        over = sum(bound.values()) - sum(exact.values())
        # Cells held by a bound leave the division; those held from below first if bounds take more than they give.
        out = [i for i in free if bound[i] != exact[i] and (over == 0 or (bound[i] > exact[i]) == (over > 0))]
        if not out:
            floors = {i: int(exact[i]) for i in free}
            spare = rest - sum(floors.values())
            for i in sorted(free, key=lambda i: (floors[i] - exact[i], cells[i]["domain"], cells[i]["type"])):
                more = 1 if spare > 0 and floors[i] < cells[i]["available"] else 0
                quota[i], spare = floors[i] + more, spare - more
            break
        for i in out:
            quota[i] = min(max(low[i], int(exact[i])), cells[i]["available"])
        fixed |= set(out)
        free = [i for i in free if i not in fixed]
    return [c | {"quota": q} for c, q in zip(cells, quota)]


QUOTAS = T.StructType([*(T.StructField(c, T.StringType()) for c in CELL), *(T.StructField(c, T.LongType()) for c in ("wanted", "available", "quota"))])


def _demand_and_supply(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """The target cells with ``available``; the counts are pre-aggregated before the shuffle."""
    counts = cells.groupBy(*CELL).agg(F.count("*").alias("available"))
    return demand(targets).join(counts, CELL, "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))


def allocated(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """(domain, type, wanted, available, quota) of every target cell, allocated to the counts of ``cells``."""
    quotas = allocate([r.asDict() for r in _demand_and_supply(cells, targets).orderBy(*CELL).collect()])  # as many as targets
    return cells.sparkSession.createDataFrame([tuple(c[f.name] for f in QUOTAS) for c in quotas], QUOTAS)


def draw(tasks: DataFrame, targets: DataFrame, seed: int = 7, ranked: int = RANKED) -> tuple[DataFrame, DataFrame]:
    """The sample (id, domain, type), and its report (domain, type, wanted, available, quota, drawn, shortfall): the quota of every target
    cell, what was drawn for it, and what it lacks of ``wanted`` because there are no more records.

    Of each cell the rows with the smallest keys (a hash of id and ``seed``) are taken. A histogram of the leading bits of the keys finds
    the bin in which the quota ends; its rows are counted by the next bits, until the bin has at most ``ranked`` rows or all 64 bits are
    used. Rows below are kept by a filter, and only the last bin is ranked."""
    cells = cut(cells_of(tasks).withColumn("key", F.xxhash64("id", F.lit(seed))), "cells")
    quotas = allocated(cells, targets)
    # Cells whose quota takes all or nothing need no threshold.
    open_ = quotas.where("quota > 0 and quota < available").select(*CELL, F.col("quota").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    most, level = ranked + 1, 0
    edges = cut(open_, "edges")
    while most > ranked and (level + 1) * BITS <= 60:
        shift = 64 - BITS * (level + 1)
        of = F.shiftrightunsigned("key", shift)
        inner = cells.join(F.broadcast(edges), CELL)  # no more cells than targets
        if level:
            inner = inner.where(F.shiftrightunsigned("key", shift + BITS) == F.col("prefix"))
        bins = inner.groupBy(*CELL, "rest", of.alias("bin")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*CELL).orderBy("bin"))  # 2^BITS bins a cell
        at = bins.withColumn("upto", upto).where("upto >= rest and upto - n < rest")
        edges = cut(at.select(*CELL, (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"), F.col("bin").alias("prefix"), "n"), "edges")
        most, level = edges.agg(F.max("n")).first()[0] or 0, level + 1
        edges = edges.drop("n")
    bin_ = F.shiftrightunsigned("key", 64 - BITS * level)
    placed = cells.join(F.broadcast(quotas.select(*CELL, "quota", "available").where("quota > 0")), CELL).join(F.broadcast(edges), CELL, "left")
    inside = placed.where((F.col("quota") == F.col("available")) | (bin_ < F.col("prefix")))
    rank = F.row_number().over(Window.partitionBy(*CELL).orderBy("key", "id"))
    last = placed.where((F.col("quota") < F.col("available")) & (bin_ == F.col("prefix"))).withColumn("rank", rank).where("rank <= rest")
    sample = cut(inside.select("id", *CELL).unionByName(last.select("id", *CELL)), "sample")
    drawn = sample.groupBy(*CELL).agg(F.count("*").alias("drawn"))
    report = quotas.join(drawn, CELL, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))
    return sample, report.withColumn("shortfall", F.greatest(F.lit(0).cast("long"), F.col("wanted") - F.col("available")))


def report(tasks: DataFrame, targets: DataFrame) -> DataFrame:
    """(domain, type, wanted, available, quota, drawn, shortfall) of every target cell, from the draw."""
    return draw(tasks, targets)[1]


def sample_to_targets(tasks: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(id, domain, type) of the sample."""
    return draw(tasks, targets, seed)[0]
