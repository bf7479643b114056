"""Mixing sources to target weights (problem 9): hash-threshold histograms.

Tokens are summed by source and by the leading bits of a hash of the document. The running sums give the bucket
in which a source's budget ends; only the documents of that bucket are summed again by the next bits, and those
of the last bucket one by one. A filter on the hash then gives the selection without sorting, and selections
are nested: a larger budget takes all that a smaller one takes.

A source whose budget exceeds its tokens is repeated: whole rounds first, the rest by threshold, never more
than its cap. What a capped source cannot give is reported and not made up by the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.functions.text import strip
from codestrata.llm.tokens import keyed
from codestrata.session import cut

BITS = 12
LEVELS = 2


def source_key(x: str):
    return F.lower(strip(x))


def mix(tokens: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Selection (doc_id, source, tokens, copies) and report (source, target_share, available, target_tokens,
    tokens, actual_share, short) for documents (id, source, tokens) and targets (source, target_share,
    max_repeats). ``budget`` is the total size in tokens, by default that of all documents of these sources.

    Sources are compared trimmed and in lower case; documents of other or null sources, and those without
    tokens, are left out; repeated rows are one document; a source without documents or with a null share gets 0."""
    wanted = targets.select(source_key("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("cap"))
    docs = tokens.where("tokens > 0 and source is not null").select("id", source_key("source").alias("source"), "tokens").distinct()
    docs = keyed(docs.join(F.broadcast(wanted.select("source")), "source", "left_semi"), seed)
    docs = docs.select("id", "source", "tokens", *(F.shiftrightunsigned("key", 63 - BITS * (i + 1)).bitwiseAND((1 << BITS) - 1).alias(f"b{i}") for i in range(LEVELS)), "key")

    first = cut(docs.groupBy("source", "b0").agg(F.sum("tokens").alias("t")), "histogram")  # at most sources x 2^BITS rows
    totals = first.groupBy("source").agg(F.sum("t").alias("available"))
    if budget is None:
        budget = totals.agg(F.sum("available")).first()[0] or 0
    plan = wanted.join(totals, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))
    plan = plan.withColumn("target_tokens", F.round(F.col("target_share") * F.lit(float(budget))).cast("long"))
    plan = plan.withColumn("rounds", F.least("cap", F.floor(F.coalesce(F.try_divide(F.col("target_tokens").cast("double"), F.col("available").cast("double")), F.lit(0.0)))).cast("long"))
    plan = cut(plan.withColumn("rest", F.when(F.col("rounds") < F.col("cap"), F.col("target_tokens") - F.col("rounds") * F.col("available")).otherwise(F.lit(0)).cast("long")), "plan")

    # Level by level: the bucket where the rest ends (edge), and what remains of it there.
    at = plan.where("available > 0").select("source", "rounds", "rest")
    edges, level = at, first.withColumnRenamed("b0", "b")
    for i in range(LEVELS):
        upto = F.sum("t").over(Window.partitionBy("source").orderBy("b"))
        ends = level.withColumn("upto", upto).join(F.broadcast(edges), "source").where("upto > rest").groupBy("source").agg(F.min_by(F.struct(F.col("b").alias("b"), (F.col("upto") - F.col("t")).alias("before")), "b").alias("x"))
        edges = edges.join(ends, "source", "left").select(*[c for c in edges.columns if c != "rest"], F.coalesce("x.b", F.lit(1 << BITS)).alias(f"e{i}"), (F.col("rest") - F.coalesce("x.before", F.lit(0))).alias("rest"))
        if i + 1 < LEVELS:
            inner = docs.join(F.broadcast(edges.select("source", *(f"e{j}" for j in range(i + 1)))), "source")
            for j in range(i + 1):
                inner = inner.where(F.col(f"b{j}") == F.col(f"e{j}"))
            edges = cut(edges, "edges")
            level = inner.groupBy("source", F.col(f"b{i + 1}").alias("b")).agg(F.sum("tokens").alias("t"))
    edges = cut(edges, "edges")
    placed = docs.join(F.broadcast(edges), "source")
    below, same = F.lit(False), F.lit(True)
    for i in range(LEVELS):
        below = below | (same & (F.col(f"b{i}") < F.col(f"e{i}")))
        same = same & (F.col(f"b{i}") == F.col(f"e{i}"))
    whole = placed.where(~same).select("id", "source", "tokens", (F.col("rounds") + below.cast("long")).alias("copies"))
    # The last bucket holds a 2^-(BITS * LEVELS) part of a source: taken one by one, the last one if that brings the sum nearer.
    run = F.sum("tokens").over(Window.partitionBy("source").orderBy("key", "id"))
    last = placed.where(same).withColumn("run", run).select("id", "source", "tokens", (F.col("rounds") + (2 * F.col("run") - F.col("tokens") < 2 * F.col("rest")).cast("long")).alias("copies"))
    chosen = whole.unionByName(last).where("copies > 0").select(F.col("id").alias("doc_id"), "source", "tokens", "copies")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    report = plan.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long"))
    share = F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy(F.lit(1)))), F.lit(0.0))  # one row a target
    report = report.select("source", "target_share", "available", "target_tokens", "tokens", F.round(share, 6).alias("actual_share"), F.greatest(F.lit(0), F.col("target_tokens") - F.col("tokens")).cast("long").alias("short"))
    return chosen, report
