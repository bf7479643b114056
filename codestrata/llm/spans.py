"""Long exact spans shared between records (problem 2), by difference-cover anchors.

Windows of ``length - period + 1`` characters are hashed only at cover positions modulo ``period``. For any two places a
shift below the period brings both to cover positions, so two records that share ``length`` characters share
an aligned window inside of them. Records with a window that other records hold are looked at again: the
anchors are extended to every start at which a stretch of ``length`` characters could hold one, and these
stretches, hashed whole, are asked for once more. A character is shared if such a stretch covers it.

No pair of records is ever formed: both rounds ask which hashes occur in several records (see census.py), so a
passage that stands in a third of all records costs no more than any other. A hash is two polynomials over the prime field of
2^31 - 1 with bases of their own, other ones in each round. Two different stretches of n characters meet with a chance of at most
(n / 2^31)^2 each, whatever their structure; a stretch that is reported has met twice, with its anchor and as a whole.

Defined cases: null and short codes give nothing; characters are code points; a stretch that a record repeats only within
itself is not shared; repeated rows (equal keys and text) are one record.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.census import U, ask, mix, pack_rows, packed_row, ranges_for, read_answers, with_answers, PACKED
from codestrata.session import cut, small_enough

# Perfect difference sets (Singer): every residue but 0 is the difference of exactly one pair. Fixed values.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (1, 5, 11, 24, 25, 27),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
}
BATCH_CHARS = 1_000_000
MOST_BATCH_CHARS = 8_000_000
PRIME = (1 << 31) - 1
# Bases of the polynomials, two for each of the two rounds: any numbers below the prime.
BASES = ((0x5A17C0DE, 0x1D872B41), (0x6C8E9CF5, 0x39E2D46B))


def period_for(length: int) -> int:
    """Largest period of at most two fifths of ``length``."""
    return max([p for p in COVERS if p <= 0.4 * length], default=0) or _too_short(length)


def _too_short(length: int) -> int:
    raise ValueError(f"spans of {length} characters are too short: at least 18")


def _mod(x: np.ndarray) -> np.ndarray:
    """Remainder of numbers below 2^62."""
    x = (x & U(PRIME)) + (x >> U(31))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1)."""
    out = np.ones(n, U)
    done, step = 1, base % PRIME
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = _mod(out[:more] * U(step))
        done, step = done + more, step * step % PRIME
    return out


class Texts:
    """Texts of a batch laid end to end; places are counted through all of them. ``round_`` chooses the bases."""

    def __init__(self, texts: list[str], round_: int = 0):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
        self.size = len(points)
        n = 1 << max(12, int(self.size + 1).bit_length())
        self.sums = []
        for base in BASES[round_]:
            # Window sums of point * base^place; a negative power of the base then takes their place out.
            sums = np.zeros(self.size + 1, U)
            np.cumsum(_mod((points + U(1)) * _powers(base, n)[: self.size]), dtype=U, out=sums[1:])
            self.sums.append((sums, _powers(pow(base, -1, PRIME), n)))

    def hashes(self, at: np.ndarray, width: int) -> np.ndarray:
        """Hash of ``width`` characters from each place; it depends on these alone."""
        parts = [_mod(_mod(sums[at + width] - sums[at]) * down[at]) for sums, down in self.sums]
        return mix(parts[0] << U(31) | parts[1])

    def record_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def cover(self, period: int, width: int) -> np.ndarray:
        """Places at cover positions of their text from which ``width`` characters remain."""
        local = np.arange(self.size) - np.repeat(self.starts, self.lengths)
        room = np.repeat(self.lengths, self.lengths) - local >= width
        table = np.zeros(period, bool)
        table[list(COVERS[period])] = True
        return np.flatnonzero(room & table[local % period])


class Grouped:
    """Hashes of places: the different ones in order, and which of them several records of the batch hold."""

    def __init__(self, texts: Texts, at: np.ndarray, width: int):
        h = texts.hashes(at, width)
        self.order = np.argsort(h, kind="stable")
        self.at, h = at, h[self.order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        begin = np.flatnonzero(first)
        self.unique = h[begin]
        record = texts.record_of(at[self.order])
        last = np.append(begin[1:], len(h)) - 1
        self.local = record[begin] != record[last] if len(h) else np.zeros(0, bool)
        self.group = np.cumsum(first) - 1

    def shared(self, elsewhere: np.ndarray) -> np.ndarray:
        """Places whose hash other records hold, in the batch or elsewhere, ascending."""
        held = self.local | (elsewhere > 0)
        return np.sort(self.at[self.order[held[self.group]]]) if len(self.at) else self.at


def _union(from_: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    """Mask of the places in any of the half-open ranges."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, from_, 1)
    np.add.at(steps, to, -1)
    return np.cumsum(steps[:-1]) > 0


def _runs(mask: np.ndarray, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a mask, none across two texts."""
    cut_ = np.zeros(len(mask) + 1, bool)
    cut_[0] = cut_[-1] = True
    cut_[1:-1] = mask[1:] != mask[:-1]
    cut_[texts.starts] = True
    edges = np.flatnonzero(cut_)
    begin, end = edges[:-1], edges[1:]
    keep = mask[begin] if len(mask) else np.zeros(0, bool)
    return begin[keep], end[keep]


def one_a_record(texts: DataFrame) -> DataFrame:
    """(src, rec_id, item_pos, text, size) with repeated rows once. Keys alone are counted; only texts of repeated keys are moved, the
    others stay where they are read."""
    keys = ["src", "rec_id", "item_pos"]
    texts = texts.withColumn("size", F.length("text"))
    repeated = cut(texts.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys), "repeated")
    right = F.broadcast(repeated) if small_enough(repeated) else repeated
    met = [texts[k].eqNullSafe(right[k]) for k in keys]
    return texts.join(right, met, "left_anti").unionByName(texts.join(right, met, "left_semi").distinct())


def batch_chars(chars: int) -> int:
    """Characters of a batch. A batch sends a block to each range that it has hashes for, and ranges grow with the data; batches grow
    along with them, up to what a task can hold, so that blocks do not shrink to a few hashes."""
    return int(min(MOST_BATCH_CHARS, max(BATCH_CHARS, chars / 4000)))


def shared_spans(records: DataFrame, length: int = 150) -> DataFrame:
    """(src, rec_id, item_pos, start_pos, span_len, chars) for records of (src, rec_id, item_pos, text): the longest
    runs of characters covered by stretches of at least ``length`` that also stand in another record; chars
    is the length of the record's text."""
    period = period_for(length)
    width = length - period + 1
    density = len(COVERS[period]) / period
    held = one_a_record(records.where(f"length(text) >= {length}").select("src", "rec_id", "item_pos", "text"))
    chars = held.agg({"size": "sum"}).first()[0] or 0
    batches = pack_rows(held.drop("size"), lambda row: len(row[3]), batch_chars(chars), "texts")
    ranges = ranges_for(chars * density)

    def anchors(payload: dict) -> tuple[np.ndarray, None]:
        t = Texts(payload["text"])
        return Grouped(t, t.cover(period, width), width).unique, None

    def extend(batch: int, payload: dict, answers: list) -> Iterator[pa.RecordBatch]:
        """Records with shared anchors, and the starts of stretches that hold one."""
        t = Texts(payload["text"])
        g = Grouped(t, t.cover(period, width), width)
        at = g.shared(read_answers(answers, g.unique, ranges, False))
        if not len(at):
            return
        rec = t.record_of(at)
        low = np.maximum(t.starts[rec], at - (period - 1))
        high = np.minimum(at, t.ends[rec] - length)
        begin, end = _runs(_union(low[low <= high], high[low <= high] + 1, t.size), t)
        of = t.record_of(begin)
        kept = np.unique(of)
        new = {c: [payload[c][i] for i in kept] for c in ("src", "rec_id", "item_pos", "text")}
        new["starts"] = [(begin[of == i] - t.starts[i], end[of == i] - t.starts[i]) for i in kept]
        yield packed_row(batch, len(kept), int((end - begin).sum()), new)

    def candidates(payload: dict) -> tuple[Texts, Grouped]:
        t = Texts(payload["text"], 1)
        at = [np.arange(a, b) + s for s, (x, y) in zip(t.starts, payload["starts"]) for a, b in zip(x, y)]
        return t, Grouped(t, np.concatenate(at) if at else np.zeros(0, np.int64), length)

    found = cut(with_answers(batches, ask(batches, anchors, ranges, False), extend, PACKED), "anchored")
    starts = found.agg({"size": "sum"}).first()[0] or 0
    whole = ranges_for(starts)

    def spans(batch: int, payload: dict, answers: list) -> Iterator[pa.RecordBatch]:
        t, g = candidates(payload)
        at = g.shared(read_answers(answers, g.unique, whole, False))
        begin, end = _runs(_union(at, at + length, t.size), t)
        rec = t.record_of(begin)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([payload["src"][i] for i in rec], pa.string()),
                pa.array([payload["rec_id"][i] for i in rec], pa.int64()),
                pa.array([payload["item_pos"][i] for i in rec], pa.int64()),
                pa.array(begin - t.starts[rec] + 1, pa.int64()),
                pa.array(end - begin, pa.int64()),
                pa.array(t.lengths[rec], pa.int64()),
            ],
            names=["src", "rec_id", "item_pos", "start_pos", "span_len", "chars"],
        )

    asked = ask(found, lambda p: (candidates(p)[1].unique, None), whole, False)
    return with_answers(found, asked, spans, "src string, rec_id long, item_pos long, start_pos long, span_len long, chars long")


def shared_extent(spans: DataFrame) -> DataFrame:
    """(src, rec_id, item_pos, spans, shared_chars, share) of every record with a shared span."""
    return spans.groupBy("src", "rec_id", "item_pos").agg({"span_len": "sum", "start_pos": "count", "chars": "max"}).selectExpr(
        "src", "rec_id", "item_pos", "`count(start_pos)` as spans", "`sum(span_len)` as shared_chars", "round(`sum(span_len)` / `max(chars)`, 6) as share"
    )
