"""Text quality of documents (problem 10): figures per document, and line labels by a hidden Markov model.

Every line that is not blank is described by a few discrete statistics (see line_stats). A hidden Markov model labels the
lines of a document together, so a line that says little by itself takes the label of its surroundings. Each
of the labels prose, list, table and junk has several states, one a sort of line that ``SEEDS`` names; label
shares are aggregated per document. Every line of every document is labelled by the model, with its whole text.

The model is trained here, on the documents with the ``TRAIN_DOCUMENTS`` smallest hashes of their id (a bounded sample):
first on the lines that the seeds recognize, then, by Viterbi training, ``ROUNDS`` times on all lines of the
sample, seeds keeping their state. Seeds serve the training alone and decide nothing when documents are labelled.

Defined cases: null and blank texts have figures of 0 and no label; a document is of a kind if prose has less
than half of its weight, a line weighing its length in units of 60 characters, one at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import words
from codestrata.llm.line_stats import CELL_SEPARATORS, FEATURES, ITEM_SEPARATORS, MARK, WIDTHS, describe, word_hashes
from codestrata.session import cut

LABELS = ("prose", "list", "table", "junk")
TRAIN_DOCUMENTS = 3000
ROUNDS = 2
PRIOR = 1.0  # pseudo-counts of a feature of a state, spread over its values
STAY = 8.0  # pseudo-count of staying in a state
UNIT = 60
CHARS = 1_000_000  # of lines described at once


def _marked(f: dict, *names: str) -> np.ndarray:
    return np.isin(f["mark"], [MARK[n] for n in names])


def _split_by(f: dict, *seps: str) -> np.ndarray:
    return (f["items"] // 9 >= 2) & np.isin(f["items"] % 9, [ITEM_SEPARATORS.index(s) + 1 for s in seps])


def _plain(f: dict) -> np.ndarray:
    return (f["cells"] // 21 < 1) & (f["symbols"] < 3)


def _columns(f: dict) -> np.ndarray:
    sep = f["cells"] // 3 % 7
    return (f["cells"] // 21 >= 2) & np.isin(sep, [CELL_SEPARATORS.index(s) + 1 for s in ("\t", "  ", ";", ",")]) & (f["cells"] % 3 == 1)


# States: label, and the lines of the training sample that are taken for it at first. The first that holds counts.
SEEDS = (
    ("table", lambda f: _marked(f, "tag")),
    ("table", lambda f: _marked(f, "rule", "pipe")),
    ("junk", lambda f: _marked(f, "stamp")),
    ("junk", lambda f: _marked(f, "at")),
    ("junk", lambda f: _split_by(f, " | ", " > ", " » ", " · ", " • ")),
    ("junk", lambda f: (f["same"] == 1) | ((f["words"] >= 4) & (f["distinct"] == 0))),
    ("junk", lambda f: _marked(f, "object")),
    ("prose", lambda f: (f["known"] >= 3) & (f["words"] >= 3) & _plain(f) & (_marked(f, "quote", "head") | (f["mark"] == 0))),
    ("prose", lambda f: (f["ending"] == 2) & (f["known"] >= 2) & (f["words"] >= 3) & _plain(f)),
    ("junk", lambda f: (f["longest"] == 4) & (f["words"] <= 4) & (f["known"] == 0) & (f["switches"] >= 2)),
    ("junk", lambda f: ((f["symbols"] >= 4) & (f["kinds"] >= 1)) | (_marked(f, "brace") & (f["symbols"] >= 3))),
    ("junk", lambda f: f["foreign"] == 3),
    ("list", lambda f: _marked(f, "box", "number", "bullet", "item") & (f["known"] <= 1)),
    ("list", lambda f: _marked(f, "pair") & (f["known"] <= 1)),
    ("list", lambda f: _marked(f, "path") & (f["known"] <= 1)),
    ("list", lambda f: _split_by(f, ", ", "; ", " / ")),
    ("table", _columns),
)
STATES = len(SEEDS)
LABEL_OF = np.array([LABELS.index(label) for label, _ in SEEDS])


def seeds_of(features: np.ndarray) -> np.ndarray:
    """State of each line for the first round of the training, -1 where no seed holds."""
    f = dict(zip(FEATURES, features.T))
    out = np.full(len(features), -1)
    for s in reversed(range(STATES)):
        out[SEEDS[s][1](f)] = s
    return out


class Model:
    """Log probabilities from counts (kind, state, feature or state, value, n), with a prior for what was never seen."""

    def __init__(self, counts: list[tuple]):
        self.emit = [np.full((STATES, w), PRIOR / w) for w in WIDTHS]
        start, step = np.ones(STATES), np.full((STATES, STATES), PRIOR / STATES) + np.eye(STATES) * STAY
        for kind, s, k, v, n in counts:
            if kind == "emit":
                self.emit[k][s, v] += n
            elif kind == "step":
                step[s, k] += n
            else:
                start[s] += n
        self.emit = [np.log(e / e.sum(axis=1, keepdims=True)) for e in self.emit]
        self.start = np.log(start / start.sum())
        self.step = np.log(step / step.sum(axis=1, keepdims=True))

    def best(self, features: np.ndarray, sizes: np.ndarray, fixed: np.ndarray | None = None) -> np.ndarray:
        """Most likely states of the lines of documents with ``sizes`` lines each; ``fixed`` ones (not -1) are kept. The documents of a
        batch go through the lines side by side, longest first, so that each step is one operation on all of them."""
        score = np.zeros((len(features), STATES))
        for k, e in enumerate(self.emit):
            score += e.T[features[:, k]]
        if fixed is not None:
            at = np.flatnonzero(fixed >= 0)
            score[at] = -1e9
            score[at, fixed[at]] = 0.0
        order = np.argsort(-sizes, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        came = np.zeros((len(features), STATES), np.int8)
        most = int(sizes[0]) if len(sizes) else 0
        alive = np.searchsorted(-sizes, -np.arange(most), side="left")  # documents with more than t lines
        score[begin[sizes > 0]] += self.start
        for t in range(1, most):
            at = begin[: alive[t]] + t
            through = score[at - 1][:, :, None] + self.step
            came[at] = through.argmax(axis=1)
            score[at] += through.max(axis=1)
        out = np.zeros(len(features), np.int64)
        for t in range(most - 1, -1, -1):
            at = begin[: alive[t]] + t
            ends = sizes[: alive[t]] == t + 1
            out[at[ends]] = score[at[ends]].argmax(axis=1)
            on = at[~ends]
            out[on] = came[on + 1, out[on + 1]]
        return out


def _parts(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Lines without outer blanks, and how many each text has, for stretches of the batch of about ``CHARS`` characters."""
    lines, sizes, chars = [], [], 0
    for text in texts:
        own = [x for x in map(str.strip, (text or "").splitlines()) if x]
        lines += own
        sizes.append(len(own))
        chars += len(text or "")
        if chars >= CHARS:
            yield lines, np.array(sizes)
            lines, sizes, chars = [], [], 0
    if sizes:
        yield lines, np.array(sizes)


def _described(lines: list[str], sizes: np.ndarray, common: np.ndarray) -> np.ndarray:
    first = np.zeros(len(lines), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return describe(lines, first, common)


def _counted(states: np.ndarray, features: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
    """Counts of what the lines with a state (not -1) emit, and of the steps between them."""
    at = states >= 0
    for k, w in enumerate(WIDTHS):
        n = np.bincount(states[at] * w + features[at, k], minlength=STATES * w)
        yield from (("emit", int(i // w), k, int(i % w), float(n[i])) for i in np.flatnonzero(n))
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    n = np.bincount(states[begin][states[begin] >= 0], minlength=STATES)
    yield from (("start", int(s), 0, 0, float(n[s])) for s in np.flatnonzero(n))
    inner = np.ones(len(states), bool)
    inner[begin] = False
    to = np.flatnonzero(inner)
    to = to[(states[to] >= 0) & (states[to - 1] >= 0)]
    n = np.bincount(states[to - 1] * STATES + states[to], minlength=STATES * STATES)
    yield from (("step", int(i // STATES), int(i % STATES), 0, float(n[i])) for i in np.flatnonzero(n))


_COUNTS = "kind string, a int, b int, v int, n double"


def train(documents: DataFrame, common: np.ndarray) -> Model:
    """Model from the bounded sample of (id, text). Only counts reach the driver: as many as the model has numbers."""
    sample = cut(documents.where("length(trim(text)) > 0").select("id", "text").orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCUMENTS).select("text"), "sample")

    def counts(model: Model | None) -> Model:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lines, sizes in _parts(b.column(0).to_pylist()):
                    f = _described(lines, sizes, common)
                    states = seeds_of(f)
                    if model:
                        states = model.best(f, sizes, states)
                    cols = list(zip(*_counted(states, f, sizes))) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["kind", "a", "b", "v", "n"])

        found = sample.mapInArrow(run, _COUNTS).groupBy("kind", "a", "b", "v").agg(F.sum("n").alias("n")).collect()
        return Model([tuple(r) for r in found])

    model = counts(None)
    for _ in range(ROUNDS):
        model = counts(model)
    return model


def label_shares(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(id, lines, prose, list, table, junk, kind) of (id, text): shares of the labels by weight, and the kind, null
    for prose and for texts without a line. ``common_words`` (word) is a fixed list of a few hundred."""
    listed = sorted(r[0].lower() for r in common_words.select("word").where("word is not null").distinct().collect())
    common = np.unique(word_hashes(listed))
    model = train(documents, common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at = b.column(0), 0
            for lines, sizes in _parts(b.column(1).to_pylist()):
                states = model.best(_described(lines, sizes, common), sizes)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                weight = np.maximum(1.0, np.array([len(" ".join(x.split())) for x in lines], float) / UNIT)
                total = np.bincount(doc * len(LABELS) + LABEL_OF[states], weight, len(sizes) * len(LABELS)).reshape(-1, len(LABELS))
                shares = np.round(total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12), 6)
                kind = np.where((sizes > 0) & (shares[:, 0] < 0.5), 1 + total[:, 1:].argmax(axis=1), 0)
                names = np.array([None, *LABELS[1:]], object)[kind]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(sizes)), pa.array(sizes.astype(np.int64)), *(pa.array(shares[:, i]) for i in range(len(LABELS))), pa.array(names, pa.string())], names=["id", "lines", *LABELS, "kind"]
                )
                at += len(sizes)

    return documents.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, lines long, prose double, list double, table double, junk double, kind string")


def figures(documents: DataFrame, common_words: list[str]) -> DataFrame:
    """(id, n_words, mean_word_len, symbol_ratio, punct_line_share, common_share) of (id, text), all built-in
    expressions. ``common_words`` are lower-case words of a fixed list."""
    text = F.coalesce("text", F.lit(""))
    w = words(text)
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.length(F.regexp_replace(x, r"\s", "")) > 0)
    base = documents.select("id", text.alias("text"), w.alias("w"), lines.alias("ls"))
    n, m = F.size("w").cast("long"), F.size("ls")
    solid = F.length(F.regexp_replace("text", r"\s", ""))
    symbols = F.length(F.regexp_replace("text", r"[\p{L}\p{N}\s]", ""))
    ended = F.size(F.filter("ls", lambda x: x.rlike(r"[.!?]\s*$")))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    return base.select(
        "id",
        n.alias("n_words"),
        ratio(F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + F.length(x)), n).alias("mean_word_len"),
        ratio(symbols, solid).alias("symbol_ratio"),
        ratio(ended, m).alias("punct_line_share"),
        ratio(F.size(F.filter("w", lambda x: x.isin(common_words) if common_words else F.lit(False))), n).alias("common_share"),
    )
