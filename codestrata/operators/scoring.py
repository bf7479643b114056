"""Scores of a query set against Arrow batches of documents, and the best of them, as NumPy kernels of the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

K1, B, EPSILON = 1.5, 0.75, 0.25
MATRIX = 8_000_000  # most numbers of the matrix of frequent terms
BLOCK = 2_000_000  # most scores of a block of documents
CACHED = 400_000  # scores of a block that stay in a core's cache, if that is enough documents for the matrix
DENSE = 0.001  # terms that more than this share of all pairs of query and document have go into the matrix

Block = Callable[[int, int], tuple[np.ndarray, np.ndarray | None]]


def blocks(documents: int, queries: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of which the scores of all queries fit in a block."""
    queries = max(1, queries)
    step = max(1, min(BLOCK // queries, max(64, CACHED // queries)))
    for a in range(0, documents, step):
        yield a, min(documents, a + step)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Held:
    """Terms of a query set that documents hold, ordered by document, each with its saturated frequency."""

    start: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, tokens: pa.ListArray, terms: pa.Array, avgdl: float) -> Held:
        n, t = len(tokens), max(1, len(terms))
        counts = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place = pc.index_in(tokens.flatten(), terms).fill_null(-1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(place >= 0)
        doc = np.searchsorted(np.cumsum(counts), known, side="right")
        key, tf = np.unique(doc * t + place[known], return_counts=True)
        doc, term = np.divmod(key, t)
        norm = K1 * (1 - B + B * counts / avgdl) if avgdl else np.ones(n)
        return cls(np.searchsorted(doc, np.arange(n + 1)), doc, term, tf * (K1 + 1) / (tf + norm[doc]))


@dataclass
class Weights:
    """Weights of a query set, ordered by term: those of term t are ``start[t]:start[t + 1]``, with the row of their query. Terms
    that many pairs of query and document share are multiplied as a matrix, the rest is added where it is."""

    ids: np.ndarray
    terms: pa.Array
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    share: np.ndarray
    avgdl: float

    @classmethod
    def of(cls, t: pa.Table) -> Weights:
        """From (query, term, w, avgdl, share). Weights of exactly 0 are kept apart from no weight."""
        ids, query = np.unique(t["query"].to_numpy().astype(np.int64), return_inverse=True)
        words = pa.array([], pa.string()).dictionary_encode() if not len(t) else t["term"].cast(pa.string()).combine_chunks().dictionary_encode()
        term, terms, w = words.indices.to_numpy(), words.dictionary, t["w"].to_numpy()
        share = np.zeros(len(terms))
        share[term] = t["share"].to_numpy()
        order = np.lexsort((query, term))
        start = np.append(0, np.cumsum(np.bincount(term, minlength=len(terms))))
        return cls(ids, terms, start, query[order], np.where(w == 0, np.finfo(float).tiny, w)[order], share, t["avgdl"][0].as_py() if len(t) else 1.0)

    @cached_property
    def positive(self) -> bool:
        """True if a score is above 0 just where query and document share a term."""
        return bool((self.weight > 1e-9).all())

    @cached_property
    def by_query(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the rows of queries, and for each of their entries its place and its term."""
        order = np.argsort(self.query, kind="stable")
        return np.append(0, np.cumsum(np.bincount(self.query, minlength=len(self.ids)))), order, np.repeat(np.arange(len(self.terms)), np.diff(self.start))[order]

    def only(self, rows: np.ndarray) -> Weights:
        """The same for some of the queries."""
        start, place, term = self.by_query
        count = start[rows + 1] - start[rows]
        at = ranges(start[rows], count)
        order = np.argsort(term[at], kind="stable")
        new = np.repeat(np.arange(len(rows)), count)[order]
        return Weights(self.ids[rows], self.terms, np.append(0, np.cumsum(np.bincount(term[at], minlength=len(self.terms)))), new, self.weight[place[at]][order], self.share, self.avgdl)

    @cached_property
    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """The column of each frequent term, -1 for other terms, and the matrix (queries x frequent terms)."""
        n, held = max(1, len(self.ids)), np.diff(self.start)
        load = held / n * self.share
        top = np.flatnonzero(load > DENSE)
        top = top[np.argsort(-load[top])][: MATRIX // n]
        column = np.full(len(self.terms), -1)
        column[top] = np.arange(len(top))
        m, at = np.zeros((len(self.ids), len(top))), ranges(self.start[top], held[top])
        m[self.query[at], np.repeat(np.arange(len(top)), held[top])] = self.weight[at]
        return column, m

    def reader(self, tokens: pa.ListArray) -> Block:
        held = Held.of(tokens, self.terms, self.avgdl)
        return lambda a, b: self.block(held, a, b)

    def block(self, held: Held, a: int, b: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Scores (queries x documents a to b), and which pairs share a term; None where that is a score above 0."""
        at = slice(held.start[a], held.start[b])
        doc, term, x = held.doc[at] - a, held.term[at], held.x[at]
        (columns, m), width = self.matrix, b - a
        column = columns[term]
        dense = column >= 0
        frequent = np.zeros((m.shape[1], width))
        frequent[column[dense], doc[dense]] = x[dense]
        score = m @ frequent
        doc, term, x = doc[~dense], term[~dense], x[~dense]
        count = self.start[term + 1] - self.start[term]
        at = ranges(self.start[term], count)
        pair = self.query[at] * width + np.repeat(doc, count)
        np.add.at(score.reshape(-1), pair, self.weight[at] * np.repeat(x, count))
        if self.positive:
            return score, None
        shared = (m != 0).astype(float) @ (frequent > 0).astype(float)
        np.add.at(shared.reshape(-1), pair, 1.0)
        return score, shared > 0


class Best:
    """For each of ``n`` queries the first ``k`` (one number, or one a query) by (score to six places descending, key) of all that was added. A query takes only what
    reaches its k-th best so far. With ``distinct`` a key counts once, with its best score. ``slack``: how far added scores may be off by query."""

    def __init__(self, n: int, k: int | np.ndarray, positive: bool, distinct: bool = False, slack: np.ndarray | float = 0.0) -> None:
        self.k, self.distinct, self.slack = np.broadcast_to(k, (n,)), distinct, np.broadcast_to(slack, (n,))
        self.most = int(self.k.max(initial=0))
        self.least = np.nextafter(0.0, 1.0) if positive else np.finfo(float).min
        self.floor = np.full(n, self.least)
        self.q, self.key, self.score = [], [], []
        self.new, self.room = 0, 100_000 + int(self.k.sum()) // 2

    def add(self, score: np.ndarray, has: np.ndarray | None, keys: pa.Array, rows: np.ndarray | None = None, exact: Callable | None = None, barred: Callable | None = None) -> None:
        """Scores (``rows`` of the queries x ``keys``). ``exact`` gives the scores of pairs of row and place, ``barred`` the pairs to leave out."""
        rows = np.arange(len(score)) if rows is None else rows
        if not score.size or self.most < 1:
            return
        if has is None and self.least < 0:
            has = score > 0
        if has is not None:
            score = np.where(has, score, -np.inf)
        first, seeds = self.floor[rows] == self.least, self.most * (4 if self.distinct else 1)
        if score.size > CACHED // 4 and score.shape[1] > 2 * seeds and first.any():  # the best of a first block bound what follows
            edge = np.partition(score[first], score.shape[1] - seeds, axis=1)[:, -seeds:]
            if not self.distinct and self.k.min() < seeds:
                edge = np.take_along_axis(np.sort(edge, axis=1), np.minimum(seeds - self.k[rows[first]], seeds - 1)[:, None], axis=1)
            edge = edge[:, 0]
            self._take(score[first], np.maximum(edge - self.slack[rows[first]], self.least), keys, rows[first], exact and (lambda q, d, at=np.flatnonzero(first): exact(at[q], d)), barred and (lambda q, d, at=np.flatnonzero(first): barred(at[q], d)))
            self._keep()
        self._take(score, self.floor[rows], keys, rows, exact, barred)
        if self.new > self.room:
            self._keep()

    def _take(self, score: np.ndarray, floor: np.ndarray, keys: pa.Array, rows: np.ndarray, exact: Callable | None, barred: Callable | None) -> None:
        at = np.flatnonzero(score >= floor[:, None])
        q, d = np.divmod(at, score.shape[1])
        if barred is not None:
            open_ = ~barred(q, d)
            at, q, d = at[open_], q[open_], d[open_]
        if len(at):
            self.q.append(rows[q])
            self.key.append(keys.take(pa.array(d)))
            self.score.append(score.reshape(-1)[at] if exact is None else exact(q, d))
            self.new += len(at)

    def _keep(self) -> None:
        if not self.q:
            return
        q, key, score = np.concatenate(self.q), pa.concat_arrays(self.key), np.concatenate(self.score)
        words = key.dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code, micro = place[words.indices.to_numpy()], np.rint(score * 1e6)
        order = np.lexsort((code, -micro, q))
        first = np.unique(q[order] * len(place) + code[order], return_index=True)[1]  # repeats of a key count with their best score
        order = order[np.sort(first)]
        q = q[order]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        last = order[rank == self.k[q] - 1]
        of = q[rank == self.k[q] - 1]
        self.floor[of] = np.maximum(self.floor[of], (micro[last] - 0.51) * 1e-6 - self.slack[of])
        order, q = order[rank < self.k[q]], q[rank < self.k[q]]
        self.q, self.key, self.score, self.new = [q], [key.take(pa.array(order))], [score[order]], 0

    def batches(self, ids: np.ndarray, key: str = "doc") -> Iterator[pa.RecordBatch]:
        """(query, key, score) of what is kept."""
        self._keep()
        if self.q:
            yield from pa.table({"query": pa.array(ids[self.q[0]], pa.int64()), key: self.key[0], "score": pa.array(self.score[0])}).to_batches(100_000)
