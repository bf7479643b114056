"""Shortest paths of many searches in one graph at a time, as a NumPy kernel of the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from codestrata.operators.scoring import ranges

BITS = 64  # searches at a time


def walks(lo: pa.ChunkedArray, hi: pa.ChunkedArray, there: pa.ChunkedArray, back: pa.ChunkedArray, of: pa.ChunkedArray, place: pa.ChunkedArray, wanted: pa.ChunkedArray) -> tuple[pa.Array, list[int], list[int], list[str]]:
    """(search, node, length, pattern) of each wanted node that its search reaches from its nearest other node: pairs ``lo``, ``hi`` of
    connected nodes with the tokens of the steps ``there`` and ``back``, and for each search ``of`` the nodes where it starts and the ``wanted``
    ones. Of equal paths the one with the least parents, from the wanted node back; its tokens are joined by " / "."""
    places, searches = (np.asarray(x.to_numpy(), np.int64) for x in (lo, hi)), of.combine_chunks().dictionary_encode()
    if isinstance(searches, pa.ChunkedArray):
        searches = searches.combine_chunks()
    lo, hi = places
    nodes, ends = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    tokens = pa.chunked_array([*back.chunks, *there.chunks], pa.string()).combine_chunks().dictionary_encode()  # of the step from the second node to the first
    if isinstance(tokens, pa.ChunkedArray):
        tokens = tokens.combine_chunks()
    order = np.lexsort((np.roll(ends, len(lo)), ends))
    near, token = np.roll(ends, len(lo))[order], tokens.indices.to_numpy()[order].astype(np.int32)
    start = np.append(0, np.cumsum(np.bincount(ends, minlength=len(nodes))))
    words = np.array(tokens.dictionary.to_pylist(), object)

    search, place, wanted = searches.indices.to_numpy(), np.asarray(place.to_numpy(), np.int64), np.asarray(wanted.to_numpy(), bool)
    at = np.minimum(np.searchsorted(nodes, place), max(0, len(nodes) - 1))
    known = nodes[at] == place if len(nodes) else np.zeros(len(place), bool)
    search, at, wanted = search[known], at[known], wanted[known]
    out: tuple[list, list, list, list] = ([], [], [], [])
    order = np.argsort(search // BITS, kind="stable")
    search, at, wanted = search[order], at[order], wanted[order]
    cuts = np.flatnonzero(np.diff(search // BITS)) + 1
    for s, x, w in zip(np.split(search, cuts), np.split(at, cuts), np.split(wanted, cuts)):
        bit = np.uint64(1) << (s % BITS).astype(np.uint64)
        length, levels = _levels(start, near, x[~w], bit[~w], x[w], bit[w])
        steps = _back(start, near, token, levels, x[w], bit[w], length)
        for i in np.flatnonzero(length > 0):
            out[0].append(s[w][i])
            out[1].append(int(nodes[x[w][i]]))
            out[2].append(int(length[i]))
            out[3].append(" / ".join(words[steps[i, : length[i]]]))
    return searches.dictionary.take(pa.array(out[0], pa.int64())), *out[1:]


def _or_by(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with all its bits."""
    if not len(key):
        return key, bits
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.bitwise_or.reduceat(bits[order], first)


def _levels(start: np.ndarray, near: np.ndarray, source: np.ndarray, source_bit: np.ndarray, target: np.ndarray, target_bit: np.ndarray) -> tuple[np.ndarray, list]:
    """Steps to each target, 0 where none lead there, and the nodes of each level with the bits of the searches that first meet them there."""
    front, bits = _or_by(source, source_bit)
    seen, length, levels = np.zeros(len(start) - 1, np.uint64), np.zeros(len(target), np.int64), [(front, bits)]
    seen[front] = bits
    open_ = (seen[target] & target_bit) == 0
    while open_.any():
        bits = bits & np.bitwise_or.reduce(target_bit[open_])  # a search ends with its last target
        front, bits = front[bits != 0], bits[bits != 0]
        if not len(front):
            break
        count = start[front + 1] - start[front]
        if count.sum() > len(near) // 8:
            whole = np.zeros(len(seen), np.uint64)
            whole[front] = bits
            got = np.bitwise_or.reduceat(whole[near], start[:-1])  # every node has a neighbor
            got &= ~seen
            front = np.flatnonzero(got)
            bits = got[front]
        else:
            v = near[ranges(start[front], count)]
            b = np.repeat(bits, count) & ~seen[v]
            front, bits = _or_by(v[b != 0], b[b != 0])
        seen[front] |= bits
        levels.append((front, bits))
        hit = open_ & ((seen[target] & target_bit) != 0)
        length[hit] = len(levels) - 1
        open_ &= ~hit
    return length, levels


def _back(start: np.ndarray, near: np.ndarray, token: np.ndarray, levels: list, target: np.ndarray, target_bit: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The tokens of the path to each target, a row each."""
    steps, node, whole = np.zeros((len(target), int(length.max(initial=0))), np.int32), target.copy(), np.zeros(len(start) - 1, np.uint64)
    for d in range(steps.shape[1], 0, -1):
        rows = np.flatnonzero(length >= d)
        front, bits = levels[d - 1]
        whole[front] = bits
        count = start[node[rows] + 1] - start[node[rows]]
        at, row = ranges(start[node[rows]], count), np.repeat(np.arange(len(rows)), count)
        at, row = (x[(whole[near[at]] & target_bit[rows[row]]) != 0] for x in (at, row))
        at = at[np.unique(row, return_index=True)[1]]  # neighbors are in order, so the first is the least
        steps[rows, d - 1], node[rows] = token[at], near[at]
        whole[front] = 0
    return steps
