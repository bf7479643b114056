"""What Python code says about itself. A snippet is tokenized and parsed once; all figures and tables come from that one
reading. Nothing here runs the code.

``Snippet.blocks`` is the table of the classes and functions of a snippet in the order of the text; outlines, entities,
counts and bodies are selections from it. Null, blank and broken code have the results that each function states."""

from __future__ import annotations

import ast
import copy
import io
import re
import symtable
import textwrap
import tokenize
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BROKEN = (SyntaxError, ValueError, RecursionError, MemoryError)
# How much a construct adds to the cyclomatic complexity, by its name in the grammar of Python: fixed values. Operands are the
# values of a chain of "and" or "or", of which the first is free; guards are the conditions of a comprehension.
DECISIONS = {
    "If": 1, "IfExp": 1, "For": 1, "AsyncFor": 1, "While": 1, "With": 1, "AsyncWith": 1, "Assert": 1, "ExceptHandler": 1,
    "match_case": 1, "comprehension": 1, "guards": 1, "operands": 1, "BoolOp": -1,
}
_PARTS = ("body", "handlers", "orelse", "finalbody", "cases")  # of a statement, that hold statements, in the order of the text
_CODE_TOKENS = {getattr(tokenize, n) for n in ("NAME", "NUMBER", "STRING", "OP", "FSTRING_START", "FSTRING_MIDDLE", "FSTRING_END", "ERRORTOKEN") if hasattr(tokenize, n)}


@dataclass
class Block:
    """A class or function: its node, the place of the block around it in the table (-1 for none), and its dotted name."""

    node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef
    outer: int
    name: str
    depth: int

    @property
    def is_class(self) -> bool:
        return isinstance(self.node, ast.ClassDef)

    @property
    def first(self) -> int:
        """First line, decorators included."""
        return min([self.node.lineno, *(d.lineno for d in self.node.decorator_list)])

    @property
    def body_lines(self) -> tuple[int, int]:
        return self.node.body[0].lineno, self.node.end_lineno


class Snippet:
    """Code, dedented. If it is no module, it is read as the body of a function (``wrapped``)."""

    def __init__(self, code: str | None, wrap: bool = True):
        self.text = textwrap.dedent(code or "").strip("\n")
        self.wrapped = False
        self.shifted = self.text[:1] != (code or "").lstrip("\n")[:1]  # its indent was taken off
        self.tree = self._parsed(self.text)
        if self.tree is None and wrap and self.text.strip():
            inner = self._parsed("def _():\n" + textwrap.indent(self.text, " "))
            self.wrapped, self.tree = inner is not None, inner

    @staticmethod
    def _parsed(text: str) -> ast.Module | None:
        try:
            return ast.parse(text) if text.strip() else None
        except _BROKEN:
            return None

    @cached_property
    def tokens(self) -> list[tokenize.TokenInfo]:
        """Tokens up to the first one that cannot be read."""
        return list(_until_broken(tokenize.generate_tokens(io.StringIO(self.text + "\n").readline)))

    @cached_property
    def blocks(self) -> list[Block]:
        out: list[Block] = []
        todo: list[tuple[ast.AST, int]] = [(n, -1) for n in reversed(self.tree.body)] if self.tree else []
        while todo:
            node, outer = todo.pop()
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                around = out[outer] if outer >= 0 else None
                out.append(Block(node, outer, f"{around.name}.{node.name}" if around else node.name, around.depth + 1 if around else 0))
                outer = len(out) - 1
            inner = [n for part in _PARTS for n in getattr(node, part, ())]
            todo += [(n, outer) for n in reversed(inner)]
        return out[1:] if self.wrapped else out

    @cached_property
    def constructs(self) -> Counter:
        """How often each construct of the grammar occurs, with the operands and guards that belong to some."""
        found: Counter = Counter()
        for node in ast.walk(self.tree) if self.tree else ():
            found[type(node).__name__] += 1
            found["operands"] += len(node.values) if isinstance(node, ast.BoolOp) else 0
            found["guards"] += len(node.ifs) if isinstance(node, ast.comprehension) else 0
        return found

    def function(self, name: str | None = None) -> Block | None:
        """First function, or the first one of a name, of the text."""
        return next((b for b in self.blocks if not b.is_class and name in (None, b.node.name)), None)


def _until_broken(tokens: Iterator) -> Iterator:
    while True:
        try:
            yield next(tokens)
        except (StopIteration, tokenize.TokenError, SyntaxError):
            return


def complexity(s: Snippet) -> int | None:
    """1 plus the decisions; None for what does not parse."""
    return 1 + sum(DECISIONS[k] * n for k, n in s.constructs.items() if k in DECISIONS) if s.tree else None


def token_length(s: Snippet) -> int:
    """Tokens that are neither comment nor layout."""
    return sum(t.type in _CODE_TOKENS for t in s.tokens) if s.text.strip() else 0


def notes(s: Snippet) -> str:
    """Docstrings of functions, of code that is a module as it stands, and then comments, each once, joined by "."; comments by a
    pattern where the code has tokens that cannot be read."""
    alone = s.tree and not (s.wrapped or s.shifted)
    docs = [d for n in ast.walk(s.tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and (d := ast.get_docstring(n))] if alone else []
    whole = bool(s.tokens) and s.tokens[-1].type == tokenize.ENDMARKER
    comments = [t.string for t in s.tokens if t.type == tokenize.COMMENT] if whole else re.findall("#.+", s.text)
    marks = dict.fromkeys(c.strip().lstrip("#").strip() for c in comments)
    return ".".join(docs + [m for m in marks if m and m not in docs])


def java_notes(code: str | None) -> str:
    """Comments of Java code, block comments without their stars and tags, each once, joined by "."."""
    found = [b or line for b, line in re.findall(r"/\*+(.*?)\*/|//([^\n]*)", code or "", re.S)]
    clean = (" ".join(x.strip(" \t*") for x in c.splitlines() if not x.strip(" \t*").startswith("@")).strip() for c in found)
    return ".".join(dict.fromkeys(filter(None, clean)))


def outer_functions(s: Snippet) -> int:
    """Functions that lie in no other function, those of classes included; 0 for what does not parse."""
    covered: list[bool] = []
    base = 1 if s.wrapped else 0
    for b in s.blocks:
        covered.append(not b.is_class or b.outer >= base and covered[b.outer - base])
    return sum(not b.is_class and not (b.outer >= base and covered[b.outer - base]) for b in s.blocks)


def rendered_signature(s: Snippet) -> str | None:
    """``name(parameters)`` of the first function, without defaults and annotations."""
    b = s.function()
    if b is None:
        return None
    bare = copy.deepcopy(b.node.args)
    bare.defaults, bare.kw_defaults = [], [None] * len(bare.kwonlyargs)
    for a in ast.walk(bare):
        if isinstance(a, ast.arg):
            a.annotation = None
    return f"{b.node.name}({ast.unparse(bare)})"


def skeleton(s: Snippet) -> str:
    """Classes and functions by their heads, bodies left out."""
    heads = []
    for b in s.blocks:
        head = copy.copy(b.node)
        head.body, head.decorator_list = [ast.Expr(ast.Constant(...))], []
        if not b.is_class:
            head.returns = None
        text = ast.unparse(head).rpartition(":")[0] + (":" if b.is_class else ": ...")
        heads.append(textwrap.indent(text, "    " * (b.depth - s.wrapped)))
    return "\n".join(heads)


def used_globals(s: Snippet, name: str) -> list[str]:
    """Names assigned at module level that the function ``name`` reads as globals."""
    if s.tree is None or s.wrapped:
        return []
    table = symtable.symtable(s.text, "snippet", "exec")
    assigned = {x.get_name() for x in table.get_symbols() if x.is_assigned() and not x.is_imported()}
    todo, read = [table], None
    while todo and read is None:
        t = todo.pop(0)
        if t.get_type() == "function" and t.get_name() == name:
            read = {x.get_name() for x in t.get_symbols() if x.is_global() and x.is_referenced()}
        todo += t.get_children()
    blocks = {b.name for b in s.blocks}
    return sorted((read or set()) & assigned - blocks)


def module_of(path: str) -> str:
    """Dotted module of a source path; a leading ``src`` and a closing ``__init__`` belong to no name."""
    steps = re.sub(r"\.py$", "", path).split("/")
    return ".".join(steps[steps[0] == "src" : len(steps) - (steps[-1] == "__init__" and len(steps) > 1)])


def entities_of(path: str, s: Snippet) -> list[tuple]:
    """(file, name, kind, symbol, start, end) of the classes, functions and module variables of a source file."""
    if s.tree is None or s.wrapped:
        return []
    rows = [(b.name, "class" if b.is_class else "function", b.node) for b in s.blocks]
    for node in s.tree.body:
        if isinstance(node, (ast.Assign, ast.AnnAssign)):
            stored = [n for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)]
            rows += [(n.id, "variable", node) for n in stored]
    lead = module_of(path)
    return sorted(((path, name, kind, f"{lead}.{name}" if lead else name, n.lineno, n.end_lineno) for name, kind, n in rows), key=lambda r: (r[4], r[1]))


def masked_body(source: str, name: str, start: int, end: int) -> str | None:
    """The source with the body of the function ``name``, whose definition lies in the lines ``start`` to ``end``, as
    ``pass``; as many lines as before. None unless exactly one function is meant."""
    s = Snippet(source, wrap=False)
    shift = len(source) - len(source.lstrip("\n"))  # blank lines that reading took off
    meant = [b for b in s.blocks if not b.is_class and b.node.name == name and b.first + shift <= end and b.node.lineno + shift >= start] if source == textwrap.dedent(source) else []
    if len(meant) != 1:
        return None
    first, last = (n + shift for n in meant[0].body_lines)
    lines = source.split("\n")
    lead = lines[first - 1].encode()[: meant[0].node.body[0].col_offset].decode()
    return "\n".join([*lines[: first - 1], lead + "pass", *[""] * (last - first), *lines[last:]])


def definition_in(text: str | None, name: str) -> str | None:
    """Source of the function ``name`` in what a model wrote: the whole text or its fenced blocks, the first that parses and has it;
    where none parses, the lines from its ``def`` on that are indented deeper."""
    parts = [text or "", *re.findall(r"```[^\n]*\n(.*?)```", text or "", re.S)]
    for part in parts:
        s = Snippet(part, wrap=False)
        if b := s.function(name):
            return "\n".join(s.text.split("\n")[b.first - 1 : b.node.end_lineno])
    for part in reversed(parts):
        if m := re.search(rf"^([ \t]*)(?:async +)?def +{re.escape(name)}\b[^\n]*(?:\n(?:\1[ \t]+[^\n]*|[ \t]*(?=\n)))*", part, re.M):
            return textwrap.dedent(m[0]).rstrip()
    return None


def method_source(source: str | None, name: str, start: int | None = None, end: int | None = None) -> str | None:
    """Code of a method in its file: the lines ``start`` to ``end`` if they hold its ``def``; else its block, by its dotted name or the last
    part of it; else by the pattern of its ``def``. None if no way leads to it."""
    short = name.rpartition(".")[2]
    if source and start and end:
        lines = source.splitlines()[start - 1 : end]
        if any(re.match(rf"\s*(?:async\s+)?def\s+{re.escape(short)}\b", x) for x in lines):
            return "\n".join(lines)
    s = Snippet(source, wrap=False)
    found = [b for b in s.blocks if not b.is_class and (name == b.name or name.endswith("." + b.name))] or [b for b in s.blocks if not b.is_class and b.node.name == short]
    if found:
        return "\n".join(s.text.split("\n")[found[0].first - 1 : found[0].node.end_lineno])
    return definition_in(source, short)


def _struct(texts: tuple[str, ...], numbers: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in texts] + [T.StructField(n, T.IntegerType()) for n in numbers])


FACTS = {"signature": rendered_signature, "notes": notes, "skeleton": skeleton, "complexity": complexity, "tokens": token_length, "functions": outer_functions}
_NUMBERS = ("complexity", "tokens", "functions")
ENTITY = _struct(("file", "name", "kind", "symbol"), ("start", "end"))


def facts(code: str, *names: str) -> Column:
    """A struct of the named facts of a column of code, all from one reading of each snippet."""
    kind = T.StructType([T.StructField(n, T.IntegerType() if n in _NUMBERS else T.StringType()) for n in names])

    @F.pandas_udf(kind)
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = [tuple(FACTS[n](s) for n in names) for s in map(Snippet, texts)]
        return pd.DataFrame(rows, columns=list(names)).astype({n: "Int32" for n in names if n in _NUMBERS})

    return read(code)


@F.pandas_udf(T.ArrayType(ENTITY))
def entities(path: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([entities_of(p or "", Snippet(s, wrap=False)) for p, s in zip(path, source)], dtype=object)
