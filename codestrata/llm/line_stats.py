"""Discrete statistics of lines, computed for all lines of an Arrow batch at once (NumPy over code points, Arrow kernels
for patterns). They are what the hidden Markov model of problem 10 observes."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Sorts of characters.
LOWER, UPPER, LETTER, DIGIT, UNDERSCORE, SYMBOL, SPACE = range(7)
# What a line may begin with, in order; the first pattern that matches names the mark (RE2 syntax, on lines without outer blanks).
MARKS = (
    ("box", r"^(?:\[[ xX]?\]|☐|☑)(?:\s|$)"),
    ("number", r"^(?:\(?\d{1,4}[.)]|[a-zA-Z][.)])\s"),
    ("bullet", r"^[-*+•–◦▪·]\s"),
    ("tag", r"^</?(?:table|tr|td|th|tbody|thead)\b"),
    ("item", r"^</?(?:li|ul|ol)\b"),
    ("rule", r"^[+|]?[-=+:| ]{4,}[+|]?$"),
    ("pipe", r"^\|.*\|$"),
    ("object", r'^(?:\{"|\[\{|\[\[)'),
    ("brace", r"^[{}\[\]<]"),
    ("head", r"^#{1,6} "),
    ("quote", r"^>\s"),
    ("stamp", r"^(?:\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d|[0-9a-f]{8}\s)"),
    ("at", r'^(?:at \S+ ?\(|File ".*", line \d|"[\w.-]+"\s*:)'),
    ("pair", r"^[\p{L}\p{N}_.\[\]-]+\s*(?:->|=>|[=~<>!]=|=|:)\s*\S+(?:\s\S+)?$"),
    ("path", r"^[\p{L}\p{N}_.-]+(?:[/\\][\p{L}\p{N}_.-]+)+$"),
)
MARK = {name: i + 1 for i, (name, _) in enumerate(MARKS)}
_SENTENCE = r"[\p{L}_]{2,}[.!?…][\"'”’)]?(?:\s|$)"
# Separators of items on one line, and of cells of a row.
ITEM_SEPARATORS = (", ", "; ", " / ", " | ", " » ", " > ", " · ", " • ")
CELL_SEPARATORS = ("|", "\t", "  ", "<td", ";", ",")
FEATURES = ("mark", "known", "words", "ending", "symbols", "digits", "longest", "items", "cells", "distinct", "same", "kinds", "switches", "foreign")
WIDTHS = (len(MARKS) + 1, 5, 7, 3, 6, 5, 5, 3 * 9, 4 * 7 * 3, 5, 2, 3, 4, 4)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Sort and lower case of every character of the basic plane; of the others letters and digits count as letters."""
    sort, lower = np.full(1 << 16, SYMBOL, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            sort[i] = SPACE
        elif c.isdigit():
            sort[i] = DIGIT
        elif c.isalpha():
            sort[i] = LOWER if "a" <= c <= "z" else UPPER if "A" <= c <= "Z" else LETTER
            if len(c.lower()) == 1:
                lower[i] = ord(c.lower())
        elif c.isalnum():
            sort[i] = LETTER
    sort[ord("_")] = UNDERSCORE
    return sort, lower


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)


def _word_hashes(lower: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the words laid end to end in ``lower``; equal words have equal hashes."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    with np.errstate(over="ignore"):
        x = (lower.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        place = np.arange(len(x)) - np.repeat(bounds[:-1], size)
        x *= (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
        x ^= x >> np.uint64(31)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]


def word_hashes(words: list[str]) -> np.ndarray:
    _, lower = _tables()
    p = [_points(w) for w in words]
    return _word_hashes(lower[np.minimum(np.concatenate(p), 0xFFFF)], np.array([len(x) for x in p])) if p else np.zeros(0, np.uint64)


def _grade(x: np.ndarray, *bounds: float) -> np.ndarray:
    return np.searchsorted(np.array(bounds, float), x, side="right")


class Lines:
    """Stripped, non-empty lines laid end to end. ``first`` marks the lines that begin a document."""

    def __init__(self, lines: list[str], first: np.ndarray):
        self.n, self.first = len(lines), first
        sort, lower = _tables()
        sizes = np.array([len(x) for x in lines], np.int64)
        self.size = sizes
        self.end = np.cumsum(sizes + 1)  # a line feed ends each line
        self.begin = self.end - sizes - 1
        points = _points("\n".join(lines) + "\n")
        self.points = points
        plane = np.minimum(points, 0xFFFF)
        self.sort = np.where(points > 0xFFFF, np.uint8(SYMBOL), sort[plane])
        self.lower = lower[plane]
        self.text = pa.array(lines, pa.string())

    def count(self, mask: np.ndarray) -> np.ndarray:
        upto = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, dtype=np.int32, out=upto[1:])
        return (upto[self.end] - upto[self.begin]).astype(np.int64)

    def count_at(self, at: np.ndarray) -> np.ndarray:
        return np.bincount(self.line_of(at), minlength=self.n)

    def places(self, text: str) -> np.ndarray:
        """Where ``text`` begins; its first character that is no blank is looked for."""
        pivot = len(text) - len(text.lstrip(" "))
        at = np.flatnonzero(self.points == ord(text[pivot])) - pivot
        at = at[(at >= 0) & (at + len(text) <= len(self.points))]
        for i, c in enumerate(text):
            at = at[self.points[at + i] == ord(c)] if i != pivot else at
        return at

    def line_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at, side="right")

    def longest(self) -> np.ndarray:
        """Length of the longest run without a blank."""
        blank = np.flatnonzero(self.sort == SPACE)
        run = np.diff(np.concatenate([[-1], blank])) - 1
        best = np.zeros(self.n, np.int64)
        np.maximum.at(best, self.line_of(blank), run)
        return best

    def most_words_between(self, at: np.ndarray, width: int, word_starts: np.ndarray) -> np.ndarray:
        """Most blank-separated words between separators at ``at``, by line."""
        edges = np.sort(np.concatenate([self.begin, at + width]))
        upto = np.searchsorted(word_starts, np.append(edges, self.end[-1] if self.n else 0))
        best = np.zeros(self.n, np.int64)
        np.maximum.at(best, self.line_of(edges), np.diff(upto))
        return best


def describe(lines: list[str], first: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Matrix (lines x FEATURES) of small numbers. ``lines`` have no outer blanks and are not empty; ``common`` are the
    sorted hashes of the common words."""
    t = Lines(lines, first)
    if not t.n:
        return np.zeros((0, len(FEATURES)), np.uint8)
    sort, points, size = t.sort, t.points, t.size
    word = sort <= UNDERSCORE
    edge = np.diff(np.concatenate([[False], word]).astype(np.int8))
    begin = np.flatnonzero(edge == 1)
    end = np.flatnonzero(np.diff(np.append(word, False).astype(np.int8)) == -1) + 1
    h = _word_hashes(t.lower[word], end - begin)
    of = t.line_of(begin)
    n = np.bincount(of, minlength=t.n)
    known = np.bincount(of, np.isin(h, common), t.n) / np.maximum(n, 1)
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.where(n >= 4, _grade(np.bincount(of[order], new, t.n) / np.maximum(n, 1), 0.25, 0.5, 0.8), 4)
    with np.errstate(over="ignore"):
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        mixed = h * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
        whole = sums[np.cumsum(n)] - sums[np.cumsum(n) - n]
    before = np.zeros(t.n, bool)
    before[1:] = ~t.first[1:]
    same = before & (n > 0)
    same[1:] &= whole[1:] == whole[:-1]

    symbol = (sort == SYMBOL) | (sort == UNDERSCORE)
    at = np.flatnonzero(symbol)
    pairs = np.unique(t.line_of(at) << 21 | points[at].astype(np.int64))
    kinds = np.bincount(pairs >> 21, minlength=t.n)
    # Changes between capitals, small letters and digits inside words, but for a capital before small letters.
    a, b = sort[:-1], sort[1:]
    switch = np.zeros(len(sort), bool)
    switch[1:] = (a != b) & (a <= DIGIT) & (b <= DIGIT) & ~((a == UPPER) & (b == LOWER))

    blank = sort == SPACE
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    items, by = np.ones(t.n, np.int64), np.zeros(t.n, np.int64)
    for i, sep in enumerate(ITEM_SEPARATORS):
        places = t.places(sep)
        if not len(places):
            continue
        count = t.count_at(places) + 1
        better = (count > items) & (t.most_words_between(places, len(sep), starts) <= 3)
        items[better], by[better] = count[better], i + 1
    gaps = blank & np.concatenate([[False], ~blank[:-1]]) & (points != 10)
    wide = gaps & ((points == 9) | np.concatenate([blank[1:] & (points[1:] != 10), [False]]))
    counts = np.ones((len(CELL_SEPARATORS), t.n), np.int64)
    edges = (points[t.begin] == ord("|")).astype(np.int64) + ((points[t.end - 2] == ord("|")) & (size > 1))
    counts[0] = np.maximum(1, t.count_at(t.places("|")) + 1 - edges)
    counts[1] = t.count_at(t.places("\t")) + 1
    counts[2] = t.count_at(np.flatnonzero(wide)) + 1
    counts[3] = t.count_at(t.places("<td")) + t.count_at(t.places("<th"))
    for i, c in ((4, ";"), (5, ",")):  # rows of such tables have no blank behind the separator
        counts[i] = np.where(t.count_at(t.places(c + " ")) > 0, 1, t.count_at(t.places(c)) + 1)
    sep = counts.argmax(axis=0)
    cells = counts.max(axis=0)
    sep = np.where(cells > 1, sep + 1, 0)
    like = np.zeros(t.n, np.int64)
    like[1:] = (cells[1:] == cells[:-1]) & (sep[1:] == sep[:-1]) & (cells[1:] > 1)
    text_same = np.zeros(t.n, bool)
    text_same[1:] = same[1:] & (size[1:] == size[:-1])
    like = np.where(text_same, 2, like) * before

    mark = np.zeros(t.n, np.int64)
    for i, (_, pattern) in reversed(list(enumerate(MARKS))):
        mark[pc.match_substring_regex(t.text, pattern).to_numpy(zero_copy_only=False)] = i + 1
    last = points[t.end - 2]
    ending = np.where(pc.match_substring_regex(t.text, _SENTENCE).to_numpy(zero_copy_only=False), 2, np.isin(last, [ord(c) for c in ".!?:,;"]))
    out = np.stack(
        [
            mark,
            _grade(known, 0.01, 0.12, 0.22, 0.35),
            _grade(n, 1, 2, 4, 6, 10, 25),
            ending,
            _grade(t.count(symbol) / size, 0.03, 0.08, 0.15, 0.3, 0.5),
            _grade(t.count(sort == DIGIT) / size, 0.01, 0.1, 0.25, 0.5),
            _grade(t.longest(), 15, 24, 40, 60),
            _grade(items, 3, 6) * 9 + np.where(items > 2, by, 0),
            (_grade(cells, 2, 3, 5) * 7 + sep) * 3 + like,
            distinct,
            same,
            _grade(kinds, 5, 8),
            _grade(t.count(switch) / size, 0.02, 0.1, 0.25),
            _grade(t.count(points > 127) / size, 0.001, 0.06, 0.2),
        ],
        axis=1,
    )
    return out.astype(np.uint8)
