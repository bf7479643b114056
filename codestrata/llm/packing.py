"""Filling containers of fixed capacity with items (problem 8): hierarchical multi-length packing.

Documents are routed to tiers of context size: tier t takes those above half of its window, which is the capacity halved t times
(the last tier takes all shorter ones). Each tier is packed by itself, longest first: a container of tier t is 2^t
windows of that tier, each begun with one of its documents. What the windows leave free is pooled in their container and
filled with the largest documents that fit, from the shorter tiers and from what is left of the tier, by best
fit. Containers are opened in rounds, half of what the tier still needs at a time, so that there are documents left to fill
the gaps of each round. Containers are then dealt to step groups of the same number of containers, by tier and
fill back and forth, so that the steps have about the same number of tokens.

Items of one size are alike, so the packing runs on the histogram of sizes, which has at most as many entries as the
capacity: its outcome is a list of rules "items number j to j + n of size s go to containers a to a + n". The rows find
their container from their number within their size. Documents are cut only above the capacity: into full
pieces, each filling a container, and the rest.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.numbering import number_within
from codestrata.session import cut

TIERS = 4
GROUP = 8  # containers a step


def tier_of(size: int, capacity: int) -> int:
    """0 for the longest window; windows halve from tier to tier."""
    t = 0
    while t + 1 < TIERS and size <= capacity >> (t + 1):
        t += 1
    return t


class _Packer:
    """Packing of one histogram. Like containers are kept as ranges (first container, how many) by the room they have."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {s: n for s, n in counts.items() if n}
        self.taken = dict.fromkeys(self.left, 0)
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []
        self.rules: list[tuple[int, int, int, int, int]] = []
        self.tiers: list[tuple[int, int]] = []  # first container of a round, tier
        self.next = 0

    def take(self, size: int, containers: int, first: int, each: int) -> None:
        self.rules.append((size, self.taken[size], containers, first, each))
        self.taken[size] += containers * each
        self.left[size] -= containers * each
        if not self.left[size]:
            del self.left[size]

    def put(self, first: int, n: int, room: int) -> None:
        if n:
            if not self.open[room]:
                insort(self.rooms, room)
            self.open[room].append((first, n))

    def begin(self, tier: int, sizes: list[int], containers: int) -> None:
        """Open that many containers, or as many as the documents of the tier suffice for, with a document in each window."""
        self.tiers.append((self.next, tier))
        windows, part, used = 1 << tier, 0, 0  # windows begun in the last container, and its tokens
        end = self.next + containers
        for size in sizes:
            if part:
                n = min(self.left[size], windows - part)
                self.take(size, 1, self.next, n)
                part, used = part + n, used + n * size
                if part < windows:
                    continue
                self.put(self.next, 1, self.capacity - used)
                self.next, part, used = self.next + 1, 0, 0
            if self.next == end:
                break
            m = min(self.left.get(size, 0) // windows, end - self.next)
            if m:
                self.take(size, m, self.next, windows)
                self.put(self.next, m, self.capacity - windows * size)
                self.next += m
            if self.next == end:
                break
            if n := self.left.get(size, 0):
                self.take(size, 1, self.next, n)
                part, used = n, n * size
        if part:
            self.put(self.next, 1, self.capacity - used)
            self.next += 1

    def fill(self, sizes: list[int]) -> None:
        """Fill the rooms, largest documents first, each into the tightest room that takes it."""
        for size in sizes:
            while (left := self.left.get(size, 0)) and (i := bisect_left(self.rooms, size)) < len(self.rooms):
                room = self.rooms[i]
                first, n = self.open[room].pop()
                if not self.open[room]:
                    self.rooms.pop(i)
                each = min(room // size, left)
                m = min(n, left // each)
                self.take(size, m, first, each)
                self.put(first + m, n - m, room)
                self.put(first, m, room - each * size)

    def run(self) -> None:
        for tier in range(TIERS):
            while own := sorted((s for s in self.left if tier_of(s, self.capacity) == tier), reverse=True):
                shorter = sorted((s for s in self.left if tier_of(s, self.capacity) >= tier), reverse=True)
                needed = sum(s * self.left[s] for s in own) / self.capacity
                containers = sum(self.left[s] for s in own) if tier == 0 else max(1, int(needed / 2))
                self.begin(tier, own, containers)
                self.fill(shorter)


def pack_histogram(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int, int]]]:
    """Rules (size, first item, containers, first container, items a container), and the ranges of
    like containers (first container, containers, room, tier), for sizes of 1 to ``capacity``."""
    p = _Packer(counts, capacity)
    p.run()
    ranges = sorted((first, n, room) for room, held in p.open.items() for first, n in held)
    begun = [first for first, _ in p.tiers]
    return p.rules, [(first, n, room, p.tiers[bisect_right(begun, first) - 1][1]) for first, n, room in ranges]


def pack_documents(tokens: DataFrame, plans: dict[str, int]) -> DataFrame:
    """(plan, doc_id, piece, first_token, tokens, tier, container, step) for documents (id, tokens), under every plan
    (name -> capacity, a positive number). ``first_token`` counts from 0, pieces from 1; documents without
    tokens are in no container; repeated rows are one document. Steps number groups of ``GROUP`` containers or one
    less, of about the same number of tokens each."""
    items = tokens.where("tokens > 0").select("id", "tokens").distinct()
    plan_rows = tokens.sparkSession.createDataFrame(list(plans.items()), "plan string, capacity long")
    both = items.crossJoin(F.broadcast(plan_rows))  # a few plans
    pieces = both.select("plan", "id", "capacity", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("div(tokens - 1, capacity)"))).alias("k"))
    pieces = pieces.select("plan", "id", "k", (F.col("k") * F.col("capacity")).alias("first_token"), F.least("capacity", F.col("tokens") - F.col("k") * F.col("capacity")).alias("size"))
    pieces = cut(pieces, "pieces")
    counts = pieces.groupBy("plan", "size").agg(F.count("*").alias("n"))
    numbered = number_within(pieces, ["plan", "size"], ["id", "k"], "item")

    histogram: dict[str, dict[int, int]] = {p: {} for p in plans}
    for r in counts.collect():  # at most the sum of the capacities
        histogram[r["plan"]][r["size"]] = r["n"]
    tables = {p: _tables(*pack_histogram(h, plans[p]), plans[p]) for p, h in histogram.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.array(b.column("plan").to_pylist(), dtype=object)
            size, item = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "item"))
            container, tier, step = (np.zeros(len(size), np.int64) for _ in range(3))
            for p in set(names.tolist()):
                at = names == p
                container[at], tier[at], step[at] = _find(tables[p], size[at], item[at])
            yield pa.RecordBatch.from_arrays(
                [b.column("plan"), b.column("id"), pa.array(b.column("k").to_numpy() + 1), b.column("first_token"), b.column("size"), pa.array(tier.astype(np.int32)), pa.array(container), pa.array(step)],
                names=["plan", "doc_id", "piece", "first_token", "tokens", "tier", "container", "step"],
            )

    return numbered.select("plan", "id", "k", "first_token", "size", "item").mapInArrow(run, "plan string, doc_id long, piece long, first_token long, tokens long, tier int, container long, step long")


def _tables(rules: list, ranges: list, capacity: int) -> dict:
    r = np.array(sorted(rules), np.int64).reshape(-1, 5)
    g = np.array(ranges, np.int64).reshape(-1, 4)
    places = np.zeros(len(g), np.int64)
    at = np.lexsort((g[:, 2], g[:, 3]))  # by tier, then by room
    places[at] = np.cumsum(g[at, 1]) - g[at, 1]
    return {"rules": r, "key": r[:, 0] * (1 << 44) + r[:, 1], "ranges": g, "places": places, "steps": -(-int(g[:, 1].sum()) // GROUP)}


def _find(t: dict, size: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = t["rules"][np.searchsorted(t["key"], size * (1 << 44) + item, side="right") - 1]
    container = r[:, 3] + (item - r[:, 1]) // r[:, 4]
    g = np.searchsorted(t["ranges"][:, 0], container, side="right") - 1
    place = t["places"][g] + container - t["ranges"][g, 0]
    turn, at = np.divmod(place, t["steps"])
    return container, t["ranges"][g, 3], np.where(turn % 2 == 0, at, t["steps"] - 1 - at)


def fill(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan, capacity_tokens, containers, tokens, fill) of each plan, a plan without documents included."""
    held = packed.groupBy("plan", "container").agg(F.sum("tokens").alias("t")).groupBy("plan").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    n, t = F.coalesce("containers", F.lit(0)), F.coalesce("tokens", F.lit(0))
    return plans.join(held, "plan", "left").select("plan", F.col("capacity_tokens").cast("long").alias("capacity_tokens"), n.alias("containers"), t.alias("tokens"), F.round(F.coalesce(F.try_divide(t.cast("double"), n * F.col("capacity_tokens")), F.lit(0.0)), 6).alias("fill"))


def steps(packed: DataFrame) -> DataFrame:
    """(plan, steps, containers_least, containers_most, tokens_least, tokens_most): how evenly the steps of a plan are filled."""
    each = packed.groupBy("plan", "step").agg(F.count_distinct("container").alias("c"), F.sum("tokens").alias("t"))
    return each.groupBy("plan").agg(F.count("*").alias("steps"), F.min("c").alias("containers_least"), F.max("c").alias("containers_most"), F.min("t").alias("tokens_least"), F.max("t").alias("tokens_most"))
