"""Numbers for rows without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.session import cut, small_enough

BUCKET_ROWS = 50_000


def number_within(df: DataFrame, by: list[str], key: list[str], name: str = "number", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``name``: 0 to n - 1 within the group ``by``, in an order fixed by the hash of ``key`` (which should tell
    the rows of a group apart; equal keys are numbered in any order). ``df`` should be a written table, as it is read three times.

    A group is cut into hash buckets in proportion to its rows, so a group that holds a third of all rows is numbered by as many
    tasks as it needs; offsets come from the counts of the buckets. Groups may have nulls in ``by``."""
    sizes = df.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(bucket_rows)).cast("int").alias("_buckets"))
    both = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    right = F.broadcast(sizes) if small_enough(sizes) else sizes
    own = F.pmod(F.xxhash64(*(F.col(f"l.{c}") for c in key)), F.col("r._buckets")).cast("int")
    placed = df.alias("l").join(right.alias("r"), both).select("l.*", own.alias("_bucket"))
    counts = placed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = (F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket")) - F.col("_n")).alias("_before")
    offsets = counts.select(*by, "_bucket", before)
    offsets = F.broadcast(offsets) if small_enough(offsets) else offsets
    place = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*key)) - 1
    numbered = placed.withColumn("_place", place).alias("l").join(offsets.alias("r"), [*both, F.col("l._bucket") == F.col("r._bucket")])
    return numbered.select("l.*", (F.col("r._before") + F.col("l._place")).cast("long").alias(name)).drop("_bucket", "_place")


def number_in_order(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``df`` with ``name``: 1 to n in the order of the columns ``order`` (nulls first; ties in any order). Rows are
    partitioned by ranges, numbered where they are, and shifted by what the partitions before them hold."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # partition * 2^33 + place in it
    rows = cut(sorted_.withColumn("_at", at), "ordered")
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    place = F.col("_at") - F.shiftleft("_part", 33) + 1
    return rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + place).cast("long")).drop("_part", "_at", "_before")
