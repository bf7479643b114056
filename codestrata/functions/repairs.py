"""Repairs of code that a model wrote, as functions of one text. ``Layout`` holds the lines and their indents; the repairs
choose among layouts."""

from __future__ import annotations

import ast
import keyword
import re
import textwrap
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.functions.snippets import Snippet

_FENCE = re.compile(r"\A\s*```[^\n`]*\n(?P<inside>.*?)\n?[ \t]*```\s*\Z", re.S)
# Statements that a word may open, to find out which words do: any that makes one of these parse.
_FORMS = ("{} x:\n 0", "{} x in y:\n 0", "{} f():\n 0", "{} def f(): 0", "{} x:\n case 1: 0", "match x:\n {} 1: 0", "if x: 0\n{}:\n 0", "if x: 0\n{} y:\n 0", "{}:\n 0\nfinally: 0", "try: 0\n{}:\n 0", "try: 0\n{} x:\n 0")


def unix(text: str | None) -> str:
    return re.sub("\r\n?", "\n", text or "")


def parses(text: str) -> bool:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


@lru_cache(maxsize=1)
def opening_words() -> frozenset[str]:
    """Keywords that begin a compound statement or a clause of one, asked of the parser."""
    return frozenset(w for w in (*keyword.kwlist, *keyword.softkwlist) if w.isalpha() and any(parses(f.format(w)) and not parses(f.format("x")) for f in _FORMS))


class Layout:
    """Lines of a text and the indents of those that have text."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.widths = {i: len(x) - len(x.lstrip(" ")) for i, x in enumerate(self.lines) if x.strip()}
        self.head = min(self.widths, default=0)
        self.others = sorted({w for i, w in self.widths.items() if i != self.head})

    def with_head_at(self, width: int) -> str:
        head = " " * width + self.lines[self.head].lstrip(" ")
        return "\n".join([*self.lines[: self.head], head, *self.lines[self.head + 1 :]])


def _is_body(text: str) -> bool:
    return parses("async def _():\n" + textwrap.indent(textwrap.dedent(text), "\t"))


def first_line_indented(code: str | None) -> str:
    """A body that does not parse, with the one deeper indent of its first line, taken from the other lines, that
    makes it parse; unchanged if none or several do."""
    code = code or ""
    layout = Layout(code)
    tries = (layout.with_head_at(w) for w in layout.others if w > layout.widths[layout.head])
    good = [] if _is_body(code) else [t for t in tries if _is_body(t)]
    return good.pop() if len(good) == 1 else code


def indent_levelled(code: str | None) -> str:
    """First line moved to the least indent of the others, if it stands left of them all and opens no block."""
    text = unix(code)
    layout = Layout(text)
    if not layout.others or layout.widths[layout.head] >= layout.others[0]:
        return text
    word = re.match(r"\s*(@|\w*)", layout.lines[layout.head])[1]
    return text if word == "@" or word in opening_words() else layout.with_head_at(layout.others[0])


def unwrapped(code: str | None, name: str) -> str:
    """Body of a snippet that only repeats the definition of ``name``; any other snippet, without its fence."""
    text = unix(code)
    if m := _FENCE.match(text):
        text = m["inside"]
    s = Snippet(text, wrap=False)
    block = s.function(name.rpartition(".")[2]) if s.tree and len(s.tree.body) == 1 else None
    if block is None or s.tree.body[0] is not block.node:
        return text
    first, last = block.body_lines
    rows = s.text.split("\n")[first - 1 : last]
    start = block.node.body[0].col_offset if first == block.node.lineno else 0  # a body on the line of its head
    return "\n".join([rows[0].encode()[start:].decode(), *rows[1:]]) if start else "\n".join(rows)


def only_completion(text: str | None, signature: str, comment: str, requirement: str) -> str:
    """What a model wrote, less the comment block, any triple-quoted block with the start of the requirement, and all
    up to the last repeat of the signature."""
    out = unix(text)
    if block := unix(comment).strip("\n"):
        out = out.replace(block, "")
    if start := requirement.strip()[:30]:
        quoted = rf"(?s)('''|\"\"\")(?:(?!'''|\"\"\").)*?{re.escape(start)}.*?\1"
        out = re.sub(quoted, "", out)
    head = unix(signature).strip("\n")
    return (out.split(head)[-1] if head else out).lstrip("\n")


def fitted_messages(messages: list[tuple[str, str]], limit: int, marker: str = "...") -> list[tuple[str, str]]:
    """(role, text) messages cut to ``limit`` characters in all: tool messages first, then those of the assistant, in
    order, each keeping what still fits ahead of the marker. Others are never cut."""
    sizes = [len(t) for _, t in messages]
    over = sum(sizes) - limit
    for role in ("tool", "assistant"):
        for i, (r, text) in enumerate(messages):
            if over > 0 and r == role and text:
                kept = max(0, len(text) - over - len(marker))
                over -= sizes[i] - kept - len(marker)
                sizes[i] = kept
    return [(r, t if len(t) == n else t[:n] + marker) for (r, t), n in zip(messages, sizes)]


REPAIRED = T.StructType([T.StructField(n, T.StringType()) for n in ("unwrapped", "first_line", "levelled", "completion")])


@F.pandas_udf(REPAIRED)
def repaired(code: pd.Series, name: pd.Series, signature: pd.Series, comment: pd.Series, requirement: pd.Series) -> pd.DataFrame:
    """The repairs of one text side by side."""
    rows = [(unwrapped(c, n or ""), first_line_indented(c), indent_levelled(c), only_completion(c, s or "", m or "", r or "")) for c, n, s, m, r in zip(code, name, signature, comment, requirement)]
    return pd.DataFrame(rows, columns=REPAIRED.names)
