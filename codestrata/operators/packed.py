"""Several values packed in one field: one row per value, with its position and an error flag.

The parsers are parsing expression grammars. Alternatives are tried in order, and one that fails gives its place back
to the next:

    field     <- item (SEP item)* END
    item      <- OPEN* (quoted / bare) CLOSE*
    quoted    <- Q (QQ / !Q .)* Q  &(CLOSE* (SEP / END))       for Q in " ' `
    bare      <- (!(CLOSE* (SEP / END)) .)*
    bracketed <- OPEN item (SEP item)* CLOSE
    OPEN, CLOSE <- BLANK* '[' BLANK*, BLANK* ']' BLANK*

SEP is a comma, semicolon, bar, tab or line break. A quote opens only at the start of an item; where it is not closed
before the item ends, ``quoted`` fails and the item is read again as ``bare``, its value with the flag ``malformed_quote``. A bracket
inside a bare value belongs to that value together with its partner there. Whether an OPEN is closed shows only further
on: a first pass finds the partners with a stack, and where ``bracketed`` failed for want of one, the second pass gives
the bracket back to the item, whose text it is if it is balanced there (``[a] b``); else the value has the flag
``malformed_bracket``, as has one before a CLOSE without partner. Nothing recurses, and a field takes time in proportion to its
length, however many brackets it has and however deep they lie.

Defined cases: a null or blank field gives no rows; empty values are not counted; repeated values stay;
texts are read whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BREAKS = "\t\n\r\v\f\x1c-\x1e\x85\u2028\u2029"
_BLANK = rf"[^\S{_BREAKS}]*+"
_SEP = f",;|{_BREAKS}"
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_OPEN = re.compile(rf"(?:{_BLANK}\[)*+{_BLANK}")
_QUOTED = re.compile(rf"([\"'`])((?:(?!\1).|\1\1)*+)\1((?:{_BLANK}\])*+){_BLANK}(?=[{_SEP}]|\Z)", re.S)
_SEGMENT = re.compile(rf"[^{_SEP}]*+")


class _Item:
    """One item: places of its opening brackets, its value, how many closing brackets end it that no bracket in the value
    opened, and where it ends."""

    def __init__(self, text: str, at: int):
        core = _OPEN.match(text, at).end()
        self.opens = [i for i in range(at, core) if text[i] == "["]
        if m := _QUOTED.match(text, core):
            self.quoted, self.body, self.kept = True, m[2].replace(m[1] * 2, m[1]).strip(), ""
            self.free, self.end = m[3].count("]"), m.end()
            return
        self.quoted, segment = False, _SEGMENT.match(text, core)[0]
        self.end = core + len(segment)
        self.body = segment.rstrip("]" + _BLANKS) if segment.rstrip()[-1:] == "]" else segment.rstrip()
        tail = segment[len(self.body) :]
        inner = min(tail.count("]"), max(0, self.body.count("[") - self.body.count("]")))
        self.free = tail.count("]") - inner
        cut = 0
        for _ in range(inner):
            cut = tail.index("]", cut) + 1
        self.kept = tail[:cut]  # closing brackets that belong to the value


def _items(text: str) -> Iterator[_Item]:
    at = 0
    while at <= len(text):
        item = _Item(text, at)
        yield item
        at = item.end + 1


def _closed(text: str) -> set[int]:
    """Places of the opening brackets that find a partner."""
    found, stack = set(), []
    for item in _items(text):
        stack += item.opens
        for _ in range(min(item.free, len(stack))):
            found.add(stack.pop())
    return found


def _values(text: str) -> Iterator[tuple[str, str]]:
    closed, depth, flag = _closed(text) if "[" in text else set(), 0, ""
    for item in _items(text):
        stray = [i for i in item.opens if i not in closed]
        depth += len(item.opens) - len(stray)
        value, held = item.body + item.kept, item.free - min(item.free, depth)
        depth -= item.free - held
        if not item.quoted:
            if stray and len(stray) + item.body.count("[") <= item.body.count("]") + len(item.kept):
                value, stray = text[stray[0] : item.end].strip(), []
            if value[:1] in ('"', "'", "`"):
                value, flag = value[1:].strip(), flag or "malformed_quote"
        if stray or held:
            flag = "malformed_bracket"
        if value:
            yield value, flag
        if value or not item.opens:  # an item that is only an opening bracket hands its flag on
            flag = ""


def parse_packed(text: str | None) -> list[tuple[str, str]]:
    """Values of one field in order, each with its error flag ('' if it parsed cleanly)."""
    return list(_values(text)) if text else []


# Endings of files that a location can name, and words that only say what a symbol is: fixed values.
FILE_ENDINGS = ("py", "pyi", "pyx", "java", "js", "ts", "go", "rs", "c", "h", "cc", "cpp", "rb", "sh")
SYMBOL_KINDS = ("function", "method", "class", "def", "variable", "constant", "module", "attribute", "property", "symbol", "name")

_NAME = r"[^\W\d]\w*(?:\.\w+)*"
_KINDS = "|".join(SYMBOL_KINDS)
_PATH = r"[^\s\"'`,;|()\[\]{}<>:*]+"
_LOCATION = re.compile(
    rf"(?P<file>(?:{_PATH}\.py|{_PATH}[/\\]{_PATH}\.(?:{'|'.join(FILE_ENDINGS)})))(?![\w/\\-])[\"'`]*"
    rf"(?::\d+(?:-\d+)?(?!\w))*"
    rf"(?:(?:::?[^\S\n]*|\t|[^\S\n]+\()(?:(?:{_KINDS})\s*:\s*|(?:async[^\S\n]+)?(?:def|class)[^\S\n]+)?[\"'`]*(?P<name>{_NAME}))?",
    re.I,
)
_KIND_LINE = re.compile(rf"\W*(?:{_KINDS})\s*:\s*[\"'`]*(?P<name>{_NAME})(?:\(.*\))?[\"'`),;.\s]*\Z", re.I)
_PLACE_LINE = re.compile(r"\W*lines?\b\s*(?::|\d)", re.I)


def parse_locations(text: str | None) -> list[tuple[str, str]]:
    """Code locations named in a free text, in order, as ``file:symbol`` or the file alone.

        text     <- (named / located / place / other)*        one alternative per line
        named    <- KIND ':' NAME END                          belongs to the last file
        located  <- (FILE (LINES? (':' / '::' / TAB / '(' KIND ':') NAME)?)+
        place    <- 'line' ...                                 left out

    A file that has no symbol of its own, nor a ``named`` line before the next file, stands alone. A ``named``
    line with no file before it has the flag ``no_file`` and is left out of the positions (value '')."""
    out: list[tuple[str, str]] = []
    current, open_ = None, False
    for line in (text or "").splitlines():
        m = _KIND_LINE.match(line)
        found = [] if m else list(_LOCATION.finditer(line))
        if found:
            for x in found:
                if open_:
                    out.append((current, ""))
                current, open_ = x["file"], not x["name"]
                if x["name"]:
                    out.append((f"{current}:{x['name']}", ""))
        elif m:
            out.append((f"{current}:{m['name']}", "") if current else ("", "no_file"))
            open_ = False
        elif line.strip() and not _PLACE_LINE.match(line):
            if open_:
                out.append((current, ""))
            current, open_ = None, False
    if open_:
        out.append((current, ""))
    return out


PARSERS: dict[str, Callable[[str | None], list[tuple[str, str]]]] = {"values": parse_packed, "locations": parse_locations}


def split_packed(df: DataFrame, key: str | Column, field: str | Column, grammar: str = "values") -> DataFrame:
    """(rec_id, pos, val, flag) for each value packed in ``field``; no shuffle, one pass over two columns.

    ``key`` must be an integer column; rows with a null key keep it. ``pos`` counts the values that are not
    empty from 1. Other columns, whatever their names, are not read."""
    key, field = (F.col(c) if isinstance(c, str) else c for c in (key, field))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = PARSERS[grammar]
        for batch in batches:
            ids, pos, vals, flags = [], [], [], []
            for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = 0
                for value, flag in parse(text):
                    if value:
                        k += 1
                        ids.append(rec)
                        pos.append(k)
                        vals.append(value)
                        flags.append(flag)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pos, pa.int64()), pa.array(vals, pa.string()), pa.array(flags, pa.string())],
                names=["rec_id", "pos", "val", "flag"],
            )

    rows = df.select(key.cast("long").alias("rec_id"), field.alias("field")).where(F.col("field").isNotNull())
    return rows.mapInArrow(run, "rec_id long, pos long, val string, flag string")
