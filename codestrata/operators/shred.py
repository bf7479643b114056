"""Deeply nested records as flat tables with parent-child links.

A JSON text is read as a stream: a loop over its tokens emits path-value-ordinal triples - the path of a value, the places
it has in the arrays on its way, and the value - without building the tree. Triples are grouped by their repeated ancestor,
the part of the path up to an array or object that makes rows, and each group is pivoted into one table. As all
triples of a record come from one row, groups are formed where the record is read, without a shuffle. Typed columns
need no parser: their schema gives the paths, and ``shred_struct`` makes their tables by ``posexplode``.

While a record is read, a path is a chain of ``Step`` objects that share their beginnings. As text, steps are joined by dots, an
array step is ``[]``, and dots, brackets and backslashes in names have a backslash before them.

Defined cases: null, blank or invalid JSON gives no triples, also where only its end is wrong; of repeated keys the last
value stands in a table; null elements of arrays make no row but keep their ordinal; a text that itself holds a
valid JSON object or array is read as that object or array; an object where others have a list of objects counts as a
list of one. Nothing recurses on depth or length; the text of a path is as long as the value lies deep.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARRAY = None  # name of a step into an element of an array


class Step:
    """Where a value stands: the step to what holds it, its name there or ARRAY, its ordinal there, and the last name on
    the way."""

    __slots__ = ("up", "name", "ordinal", "last")

    def __init__(self, up: Step | None, name: str | None = "", ordinal: int = 0):
        self.up, self.name, self.ordinal = up, name, ordinal
        self.last = name if name is not ARRAY or up is None else up.last

    def way(self) -> list[Step]:
        """Steps from the record, which has none, to the value."""
        out, at = [], self
        while at.up is not None:
            out.append(at)
            at = at.up
        return out[::-1]


Triple = tuple[Step, Any]

_SCALAR = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?|true|false|null|NaN|-?Infinity", re.A)
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
_SPACE = re.compile(r"[ \t\n\r]*")
_NAME = re.compile(r"([\\.\[\]])")


def path_text(step: Step) -> str:
    return "".join("[]" if s.name is ARRAY else ("." if i else "") + _NAME.sub(r"\\\1", s.name) for i, s in enumerate(step.way()))


def ordinals(step: Step) -> list[int]:
    return [s.ordinal for s in step.way() if s.name is ARRAY]


def stream(text: str, step: Step | None = None) -> Iterator[Triple]:
    """Triples of a JSON text in the order of the record; an object or array that begins gives a triple of its own (value {} or
    []) ahead of what it holds. ValueError where the text stops being JSON."""
    skip = _SPACE.match
    step = step or Step(None)
    holder: list[Step] = []  # open containers
    places: list[int] = []  # of the element that is read in each, 0 in objects
    at = skip(text).end()
    while True:
        # A value begins here.
        c = text[at : at + 1]
        if c == "{" or c == "[":
            yield step, {} if c == "{" else []
            at = skip(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                holder.append(step)
                places.append(0 if c == "{" else 1)
                if c == "{":
                    step, at = _member(text, at, step)
                else:
                    step = Step(step, ARRAY, 1)
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1)
            inner = _inner(value, step) if value[:1] in ("{", "[") else None
            if inner:
                yield from inner
            else:
                yield step, value
        else:
            m = _SCALAR.match(text, at)
            if not m:
                raise ValueError(f"no value at {at}")
            word = m[0]
            yield step, _WORDS[word] if word in _WORDS else float(word) if m[2] or m[3] else _whole(word)
            at = m.end()
        # A value has ended; so have all containers that close here.
        while True:
            at = skip(text, at).end()
            if not holder:
                if at != len(text):
                    raise ValueError(f"more than one value, at {at}")
                return
            c = text[at : at + 1]
            at = skip(text, at + 1).end()
            if c == ",":
                if places[-1]:
                    places[-1] += 1
                    step = Step(holder[-1], ARRAY, places[-1])
                else:
                    step, at = _member(text, at, holder[-1])
                break
            if c != ("]" if places[-1] else "}"):
                raise ValueError(f"container not closed at {at}")
            holder.pop()
            places.pop()


def _member(text: str, at: int, holder: Step) -> tuple[Step, int]:
    """Step to the member whose name stands at ``at``, and where its value begins."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no name at {at}")
    name, at = scanstring(text, at + 1)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no value for a name at {at}")
    return Step(holder, name), _SPACE.match(text, at + 1).end()


def _whole(word: str) -> int | float:
    return int(word) if len(word) < 4000 else float(word)


def _inner(value: str, step: Step | None) -> list[Triple] | None:
    """Triples of a text that holds JSON itself, or None. Each level of texts in texts doubles what must be escaped, so the
    levels are few however long the record."""
    try:
        return list(stream(value, step))
    except ValueError:
        return None


def triples(text: str | None) -> list[Triple]:
    """All triples of a record, or none if it is not valid to its end."""
    return (_inner(text, None) or []) if text and text.strip() else []


def _leaves(found: list[Triple]) -> Iterator[Triple]:
    """Triples of values, and of the objects and arrays that hold nothing."""
    for (step, value), after in zip(found, [*found[1:], (None, None)]):
        if not isinstance(value, (dict, list)) or after[0] is None or after[0].up is not step:
            yield step, value


def _text(v: Any) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v)


def path_values(df: DataFrame, key: str | Column, document: str | Column) -> DataFrame:
    """(rec_id, seq, path, ordinals, value): the triples of every JSON document, ``seq`` in record order; objects and arrays have
    one only where they hold nothing."""
    key, document = (F.col(c) if isinstance(c, str) else c for c in (key, document))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, path_text(s), ordinals(s), _text(v)) for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, (s, v) in enumerate(_leaves(triples(d)), 1)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string()))], names=["rec_id", "seq", "path", "ordinals", "value"])

    rows = df.select(key.cast("long").alias("rec_id"), document.alias("document"))
    return rows.mapInArrow(run, "rec_id long, seq long, path string, ordinals array<int>, value string")


def pivot_group(triples_: DataFrame, ancestor: str, columns: dict[str, str]) -> DataFrame:
    """One table of a group of triples: a row for each occurrence of ``ancestor`` (such as ``a.b[]``) that is no null, keyed by
    rec_id and the ordinals on the way (``parent`` without the last, for the link to the parent table), with
    ``columns`` as output name -> path below the ancestor."""
    depth = ancestor.count("[]")
    here = triples_.where((F.col("path") == ancestor) & F.col("value").isNotNull() | F.col("path").startswith(ancestor + "."))
    row = F.slice("ordinals", 1, depth)
    picks = [F.max_by(F.when(F.col("path") == F.lit(f"{ancestor}.{p}"), F.col("value")), F.when(F.col("path") == F.lit(f"{ancestor}.{p}"), F.col("seq"))).alias(c) for c, p in columns.items()]
    out = here.groupBy("rec_id", row.alias("row")).agg(*picks)
    return out.select("rec_id", F.slice("row", 1, max(depth - 1, 0)).alias("parent") if depth > 1 else F.expr("cast(array() as array<int>)").alias("parent"), F.element_at("row", -1).alias("ordinal"), *columns)


def nested_rows(record: list[Triple], rows_key: str, list_key: str, below: str, columns: tuple[str, ...], inherited: tuple[str, ...] = ()) -> list[tuple]:
    """Rows of one record: a row for every object that stands under ``rows_key``, itself or in an array, anywhere
    below ``below``; (place in the list ``list_key``, place among the rows of that place, values of
    ``columns``). Triples are grouped by the object they lie in and pivoted as they come. A column of ``inherited`` that the object lacks
    is taken from the objects around it, innermost first, up to ``below``; '' where none has it."""
    groups: dict[int, dict[str, Any]] = {}  # by the identity of the step, of which a record makes one a value
    starts: list[Step] = []
    for step, value in record:
        if isinstance(value, dict):
            groups[id(step)] = {}
            if step.last == rows_key:
                starts.append(step)
        elif step.name in columns and not isinstance(value, list) and (held := groups.get(id(step.up))) is not None:
            held[step.name] = value
    around: dict[int, tuple] = {}  # step -> (whether ``below`` lies above its last name, whether it is that name, place in the list, inherited values)

    def seen_from(step: Step) -> tuple:
        way, at = [], step
        while at is not None and id(at) not in around:
            way.append(at)
            at = at.up
        inside, named, place, values = around[id(at)] if at is not None else (False, False, 0, (None,) * len(inherited))
        for at in reversed(way):
            if at.name is not ARRAY:
                inside, named = inside or named, at.name == below
            elif not place and at.up.name == list_key:
                place = at.ordinal
            own = groups.get(id(at))
            if named:  # nothing is taken from what lies around ``below``
                values = (None,) * len(inherited)
            if own is not None:
                values = tuple(v if own.get(c) is None else own[c] for c, v in zip(inherited, values))
            around[id(at)] = inside, named, place, values
        return around[id(step)]

    out, counts = [], {}
    for step in starts:
        inside, _, place, values = seen_from(step)
        if not inside:
            continue
        place, own, above = place or 1, groups[id(step)], dict(zip(inherited, values))
        counts[place] = counts.get(place, 0) + 1
        found = (above.get(c) if own.get(c) is None else own[c] for c in columns)
        out.append((place, counts[place], *("" if v is None else _text(v) for v in found)))
    return out


def shred_rows(
    df: DataFrame, key: str | Column, document: str | Column, rows_key: str, list_key: str, below: str, columns: tuple[str, ...], inherited: tuple[str, ...] = ()
) -> DataFrame:
    """(rec_id, attempt_pos, entity_pos, *columns) of every row that ``nested_rows`` finds in the JSON texts of
    ``document``. One pass, no shuffle; repeated input rows give repeated output rows."""
    key, document = (F.col(c) if isinstance(c, str) else c for c in (key, document))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *r) for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in nested_rows(triples(d), rows_key, list_key, below, columns, inherited)]
            cols = list(zip(*rows)) or [[]] * (3 + len(columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 3 else pa.string()) for i, c in enumerate(cols)], names=["rec_id", "attempt_pos", "entity_pos", *columns])

    rows = df.select(key.cast("long").alias("rec_id"), document.alias("document")).where(F.col("document").isNotNull())
    return rows.mapInArrow(run, "rec_id long, attempt_pos long, entity_pos long, " + ", ".join(f"`{c}` string" for c in columns))


def shred_struct(df: DataFrame, key: str, column: str) -> dict[str, DataFrame]:
    """Flat tables of a nested column, by the path of their repeated ancestor ('' for the table of the records): rec_id, the places
    ``ord_1`` .. ``ord_k`` in the arrays on the way (the link to the parent is all but the last), and the values below
    the ancestor that are in no further array, named by their path (an array of plain values has the column ``value``).
    Places count from 1 and leave null elements out; null arrays and structs make no rows."""
    out: dict[str, DataFrame] = {}

    def fields(kind: T.DataType, at: Column, name: str) -> Iterator[tuple[str, T.DataType, Column]]:
        """Plain values and arrays below ``at``, through structs."""
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from fields(f.dataType, at.getField(f.name), f"{name}.{_NAME.sub(r'\\\1', f.name)}" if name else _NAME.sub(r"\\\1", f.name))
        else:
            yield name, kind, at

    def visit(rows: DataFrame, kind: T.DataType, path: str, depth: int) -> None:
        links = ["rec_id", *(f"ord_{i + 1}" for i in range(depth))]
        found = list(fields(kind, F.col("_v"), ""))
        plain = [at.alias(name or "value") for name, k, at in found if not isinstance(k, T.ArrayType)]
        out[path] = rows.select(*links, *plain)
        for name, k, at in found:
            if isinstance(k, T.ArrayType):
                inner = rows.select(*links, F.posexplode(F.filter(at, lambda x: x.isNotNull())).alias("_p", "_v"))
                below = f"{path}.{name}" if path and name else path or name
                visit(inner.select(*links, (F.col("_p") + 1).cast("long").alias(f"ord_{depth + 1}"), "_v"), k.elementType, below + "[]", depth + 1)

    visit(df.select(F.col(key).alias("rec_id"), F.col(column).alias("_v")), df.schema[column].dataType, "", 0)
    return out
