"""Which hashes occur in more than one place: the exchange that problems 2 and 6 share.

Records are packed into batches, one row a batch, so that a batch can be worked on again without a shuffle of its texts.
A batch sends each of its different hashes once, however often it holds them, as sorted and delta-coded
blocks by range of the hash (about six bytes a hash); the task of a range finds what several batches hold and
answers each batch with one number a hash, in the order in which it was sent. A hash that a third of all
records hold thus costs one entry a batch, never one a record.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut

U = np.uint64
HASHES_A_RANGE = 1_000_000
PACKED = "batch long, n long, size long, payload binary"
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread of 64-bit numbers; one to one."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def pack(value: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, protocol=5))


def unpack(blob: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def pack_rows(df: DataFrame, size_of: Callable[[tuple], int], most: int, name: str) -> DataFrame:
    """Table of batches of the rows of ``df`` (lists of columns in the payload), each of about ``most`` in size, one
    larger row being a batch of its own. It is written, so the number of a batch is fixed from then on."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def full() -> pa.RecordBatch:
            return packed_row((part << 32) | k, len(held), size, dict(zip(columns, map(list, zip(*held)))))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(row)
                size += size_of(row)
                if size >= most:
                    yield full()
                    k, held, size = k + 1, [], 0
        if held:
            yield full()

    return cut(df.mapInArrow(run, PACKED), name)


def packed_row(batch: int, n: int, size: int, payload: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([pack(payload)], pa.binary())], names=["batch", "n", "size", "payload"])


def encode(h: np.ndarray, counts: np.ndarray | None) -> bytes:
    """Sorted different hashes, with a count each if given."""
    d = np.diff(h, prepend=U(0))
    planes = d.view(np.uint8).reshape(-1, 8).T
    used = 8 - int((planes[::-1].any(axis=1)).argmax())
    body = bytes([used]) + np.ascontiguousarray(planes[:used]).tobytes()
    if counts is not None:
        body += counts.astype("<u4").tobytes()
    return len(h).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def decode(blob: bytes, counted: bool) -> tuple[np.ndarray, np.ndarray | None]:
    n, body = int.from_bytes(blob[:4], "little"), zstandard.ZstdDecompressor().decompress(blob[4:])
    used = body[0]
    planes = np.zeros((8, n), np.uint8)
    planes[:used] = np.frombuffer(body, np.uint8, used * n, 1).reshape(used, n)
    h = np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(U), dtype=U)
    return h, np.frombuffer(body, "<u4", n, 1 + used * n) if counted else None


def range_starts(ranges: int) -> np.ndarray:
    return np.array([i * ((_MASK + 1) // ranges) for i in range(ranges)], U)


def ranges_for(hashes: float) -> int:
    return max(8, int(hashes / HASHES_A_RANGE) + 1)


def ask(batches: DataFrame, hashes_of: Callable[[object], tuple[np.ndarray, np.ndarray | None]], ranges: int, counted: bool) -> DataFrame:
    """Answers (batch, answers): for each batch the ranges it asked, each with one number a hash. ``hashes_of``
    gives the sorted different hashes of a payload, and how many of its records hold each if ``counted``.
    The number answered is the sum of these counts, or else that of the batches that hold the hash."""
    starts = range_starts(ranges)

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for batch, blob in zip(b.column("batch").to_pylist(), b.column("payload").to_pylist()):
                h, counts = hashes_of(unpack(blob))
                ends = [*np.searchsorted(h, starts[1:]).tolist(), len(h)]
                out, at = ([], []), 0
                for r, end in enumerate(ends):
                    if end > at:
                        out[0].append(r)
                        out[1].append(encode(h[at:end], counts[at:end] if counted else None))
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([batch] * len(out[0]), pa.int64()), pa.array(out[1], pa.binary())], names=["range", "batch", "block"])

    def answer(group: pa.Table) -> pa.Table:
        blocks = [decode(x.as_py(), counted) for x in group.column("block")]
        order_of = np.concatenate([h for h, _ in blocks])
        weights = np.concatenate([c for _, c in blocks]).astype(np.int64) if counted else np.ones(len(order_of), np.int64)
        _, at = np.unique(order_of, return_inverse=True)
        total = np.minimum(np.bincount(at, weights), 2**32 - 1)[at].astype("<u4")
        cuts = np.cumsum([len(h) for h, _ in blocks])[:-1]
        if not counted:
            replies = [np.packbits(x > 1).tobytes() for x in np.split(total, cuts)]
        else:
            replies = [zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()) for x in np.split(total, cuts)]
        return pa.table({"batch": group.column("batch"), "range": group.column("range"), "reply": pa.array(replies, pa.binary())})

    sent = batches.select("batch", "payload").mapInArrow(send, "range int, batch long, block binary")
    replies = sent.groupBy("range").applyInArrow(answer, "batch long, range int, reply binary")
    return replies.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("range", "reply"))).alias("answers"))


def read_answers(answers: Iterable[dict] | None, h: np.ndarray, ranges: int, counted: bool) -> np.ndarray:
    """Numbers for the hashes ``h`` that a batch sent, in their order: counts, or else 1 where other batches hold it."""
    ends = [0, *np.searchsorted(h, range_starts(ranges)[1:]).tolist(), len(h)]
    out = np.zeros(len(h), np.uint32)
    for a in answers or ():
        at, end = ends[a["range"]], ends[a["range"] + 1]
        if counted:
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(a["reply"]), np.uint8).reshape(4, end - at)
            out[at:end] = np.ascontiguousarray(raw.T).reshape(-1).view("<u4")
        else:
            out[at:end] = np.unpackbits(np.frombuffer(a["reply"], np.uint8), count=end - at)
    return out


def with_answers(batches: DataFrame, answers: DataFrame, work: Callable[[int, object, list], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work(batch, payload, answers)`` over all batches joined with their answers."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for batch, blob, replies in zip(b.column("batch").to_pylist(), b.column("payload").to_pylist(), b.column("answers")):
                yield from work(batch, unpack(blob), replies.as_py())

    return batches.select("batch", "payload").join(answers, "batch", "left").mapInArrow(run, schema)
