"""Text and name functions as column expressions; all stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: str | Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def words(x: str | Column) -> Column:
    """Lower-case runs of letters, digits and "_", Unicode."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(WORD), F.lit(0))


def project_key(x: str | Column) -> Column:
    """A project path trimmed, in lower case and with "\\" read as "/"."""
    return F.replace(F.lower(strip(x)), F.lit("\\"), F.lit("/"))


def no_args(x: str | Column) -> Column:
    """A signature without its arguments."""
    return strip(F.substring_index(_c(x), "(", 1))


def no_lead(x: str | Column) -> Column:
    """Without arguments and leading dots."""
    return F.regexp_replace(no_args(x), r"^\.+", "")


def legacy_name(x: str | Column) -> Column:
    """A constructor counts as its class."""
    return F.replace(no_args(x), F.lit(".__init__"), F.lit(""))


def canonical(x: str | Column) -> Column:
    """Names inside a constructor belong to the class; the constructor itself stays."""
    return F.replace(no_lead(x), F.lit(".__init__."), F.lit("."))


def last_part(x: str | Column) -> Column:
    return F.substring_index(_c(x), ".", -1)


def parent_part(x: str | Column) -> Column:
    """All but the last segment; '' if there is one only."""
    return F.regexp_replace(_c(x), r"\.?[^.]*$", "")


def drop_first_part(x: str | Column) -> Column:
    """Without the first segment; the name itself if there is one only."""
    return F.regexp_replace(_c(x), r"^[^.]*\.", "")


def one_root(x: str | Column) -> Column:
    """A doubled root counts once: ``a.a.x`` is ``a.x``."""
    return F.regexp_replace(_c(x), r"^([^.]+)\.\1(?=\.|$)", "$1")


def with_constructor(x: str | Column) -> Column:
    """``__init__`` put ahead of the first segment in capitals, else of the last; never in the first place."""
    parts = F.split(_c(x), r"\.")
    capital = F.filter(F.transform(parts, lambda p, i: F.when((i > 0) & p.rlike("^[A-Z]"), i)), lambda i: i.isNotNull())
    at = F.coalesce(F.try_element_at(capital, F.lit(1)), F.size(parts) - 1)
    at = F.greatest(at, F.lit(1))
    return F.array_join(F.concat(F.slice(parts, F.lit(1), at), F.array(F.lit("__init__")), F.slice(parts, at + 1, F.size(parts))), ".")


def module_of_path(x: str | Column) -> Column:
    """Module of a source path: ``a/b/__init__.py`` is ``a.b``."""
    bare = F.regexp_replace(F.regexp_replace(F.replace(_c(x), F.lit("\\"), F.lit("/")), r"\.py$", ""), r"(^|/)__init__$", "")
    return F.replace(F.regexp_replace(bare, "^/+|/+$", ""), F.lit("/"), F.lit("."))


def dots(x: str | Column) -> Column:
    return F.length(_c(x)) - F.length(F.replace(_c(x), F.lit("."), F.lit("")))


def signature_words(x: str | Column) -> Column:
    """Words of the last dotted segment of a whole signature, "_" and "(),.:" read as blanks."""
    last = F.element_at(F.split(F.coalesce(_c(x), F.lit("")), r"\."), -1)
    return words(F.regexp_replace(last, r"[_(),.:]", " "))


def identifiers(x: str | Column) -> Column:
    return F.regexp_extract_all(_c(x), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))


def truthy(x: str | Column) -> Column:
    return F.coalesce(F.lower(F.trim(_c(x).cast("string"))).isin("true", "1", "yes", "y", "t"), F.lit(False))


def safe_long(x: str | Column) -> Column:
    return F.expr(f"try_cast({x} as bigint)") if isinstance(x, str) else x.try_cast("bigint")


def clipped(x: str | Column, n: int, more: str = "...") -> Column:
    return F.when(F.length(_c(x)) > n, F.concat(F.substring(_c(x), 1, n), F.lit(more))).otherwise(_c(x))


def column_name(x: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(x), "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")


def unescaped(x: str | Column) -> Column:
    """HTML entities of the five mark-up characters read as these."""
    out = _c(x)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def longest_block(x: str | Column) -> Column:
    """Longest fenced block, trimmed, the first of equal ones; the whole text, trimmed, if there is none."""
    blocks = F.transform(F.regexp_extract_all(_c(x), F.lit(r"(?s)```[^\n`]*\n(.*?)```"), F.lit(1)), strip)
    best = F.aggregate(blocks, F.lit(None).cast("string"), lambda s, b: F.when(s.isNull() | (F.length(b) > F.length(s)), b).otherwise(s))
    return F.coalesce(best, strip(x))


def commented(x: str | Column, lead: str = "    # ") -> Column:
    return F.array_join(F.transform(F.split(_c(x), "\n"), lambda line: F.concat(F.lit(lead), strip(line))), "\n")


def dedented(x: str | Column) -> Column:
    """Lines without the blanks that all lines with text share."""
    lines = F.split(_c(x), "\n")
    indent = F.array_min(F.transform(F.filter(lines, lambda s: F.length(F.trim(s)) > 0), lambda s: F.length(s) - F.length(F.ltrim(s))))
    return F.array_join(F.transform(lines, lambda s: F.when(F.length(F.trim(s)) == 0, F.lit("")).otherwise(F.substring(s, F.coalesce(indent, F.lit(0)) + 1, F.length(s)))), "\n")


def line_range(x: str | Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, counted from 1."""
    return F.array_join(F.slice(F.split(_c(x), "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def blanked_lines(x: str | Column, start: Column, end: Column) -> Column:
    """The text with the lines ``start`` to ``end`` emptied, their breaks kept."""
    return F.array_join(F.transform(F.split(_c(x), "\n"), lambda s, i: F.when((i + 1 >= start) & (i + 1 <= end), F.lit("")).otherwise(s)), "\n")


def filled(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def patched_lines(x: str | Column, start: Column, end: Column, new: Column) -> Column:
    """The text with the lines ``start`` to ``end``, counted from 1, replaced by ``new``; null in any of them gives null."""
    lines = F.split(_c(x), "\n")
    return F.array_join(F.concat(F.slice(lines, F.lit(1), F.greatest(start - 1, F.lit(0))), F.array(new), F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))), "\n")


def log_space(low: float, high: float, n: int) -> Column:
    """``n`` numbers from 10^low to 10^high, evenly spaced in their logarithm; one number is 10^low."""
    step = (high - low) / max(1, n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pow(F.lit(10.0), F.lit(low) + i * F.lit(step)))


def parameters(x: str | Column) -> Column:
    """Names of the parameters of a signature, without what follows ":" or "=" and without stars, ``self`` and ``cls``. Commas inside
    brackets of defaults part parameters as well."""
    inside = F.regexp_extract(_c(x), r"(?s)\((.*)\)", 1)
    names = F.transform(F.split(inside, ","), lambda p: F.regexp_replace(strip(F.regexp_extract(p, r"(?s)^([^:=]*)", 1)), r"^[*/]+", ""))
    return F.filter(names, lambda p: (p != "") & ~p.isin("self", "cls"))


def fits_arity(signature: str | Column, arguments: str | Column) -> Column:
    """True if a call with that many arguments can be meant: no more than the parameters, no fewer than those without a default; any
    number above that where the signature has a star."""
    s = _c(signature)
    defaults = F.size(F.filter(F.split(F.regexp_extract(s, r"(?s)\((.*)\)", 1), ","), lambda p: p.contains("=")))
    n, star = F.size(parameters(s)), s.contains("*")
    least = n - defaults - F.when(star, 1).otherwise(0)
    return (_c(arguments) >= least) & ((_c(arguments) <= n) | star)


def short_description(file: str | Column, signature: str | Column) -> Column:
    """``file.method(parameters)``: the file without its folders and ending."""
    base = F.regexp_extract(_c(file), r"([^/]*?)(?:\.py)?$", 1)
    return F.concat(base, F.lit("."), last_part(F.substring_index(_c(signature), "(", 1)), F.lit("("), F.array_join(parameters(signature), ", "), F.lit(")"))


def redacted(x: str | Column, secret: str | Column, mark: str = "***") -> Column:
    """The text with every occurrence of a secret as ``mark``; null and empty secrets hide nothing."""
    s = F.coalesce(_c(secret), F.lit(""))
    return F.when(s == "", _c(x)).otherwise(F.replace(_c(x), s, F.lit(mark)))
