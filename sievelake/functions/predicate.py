"""LIKE, NOT LIKE, ILIKE and NOT ILIKE as Column expressions that Catalyst can push down.

A pattern compiles to the cheapest equivalent: equality, startswith, endswith, contains and length tests
where those say it all, else these as necessary conditions in front of one LIKE. Nulls stay null, as SQL has it.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pattern import ONE, Pattern, Token


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _text(part: tuple[Token, ...]) -> str | None:
    """The part as a string, or None if it holds an underscore."""
    return "".join(part) if ONE not in part else None


def _fixed(c: Column, part: tuple[Token, ...], from_end: bool) -> list[Column]:
    """Literal runs of a part that stands at the start or end of the value."""
    if (text := _text(part)) is not None:
        return [c.endswith(text) if from_end else c.startswith(text)]
    out, at = [], 0
    for is_literal, run in groupby(part, lambda t: isinstance(t, str)):
        run = tuple(run)
        if is_literal:
            start = at - len(part) if from_end else at + 1
            if at == 0 and not from_end:
                out.append(c.startswith("".join(run)))
            elif from_end and at + len(run) == len(part):
                out.append(c.endswith("".join(run)))
            else:
                out.append(F.substring(c, start, len(run)) == "".join(run))
        at += len(run)
    return out


def _longest(part: tuple[Token, ...]) -> str:
    """The longest literal run of a part."""
    return max(("".join(run) for is_literal, run in groupby(part, lambda t: isinstance(t, str)) if is_literal), key=len, default="")


def compile_pattern(c: Column, pattern: Pattern) -> Column:
    """The condition that ``c`` matches: true, false, or null where ``c`` is null."""
    kind, n, parts = pattern.kind, pattern.least_length, pattern.parts
    if kind == "empty":
        return c == ""
    if kind == "all":
        # as null-valued as LIKE itself, so that its negation is too
        return F.length(c) >= 0
    if kind == "length":
        return F.length(c) >= n if pattern.has_run else F.length(c) == n
    if kind == "exact" and (text := _text(parts[0])) is not None:
        return c == text
    conditions: list[Column] = []
    middle = list(parts)
    if not pattern.starts_open:
        conditions += _fixed(c, middle.pop(0), False)
    if not pattern.ends_open and (middle or pattern.has_run):
        if middle:
            conditions += _fixed(c, middle.pop(), True)
    anchored_only = not middle
    needs_length = not pattern.has_run or len(parts) > 1 or any(ONE in p for p in parts)
    if needs_length:
        conditions.insert(0, F.length(c) == n if not pattern.has_run else F.length(c) >= n)
    if anchored_only:
        return reduce(lambda a, b: a & b, conditions)
    if len(middle) == 1 and len(parts) == 1 and (text := _text(middle[0])) is not None:
        return c.contains(text)
    for part in middle:
        if text := _longest(part):
            conditions.append(c.contains(text))
    conditions.append(c.like(pattern.sql))
    return reduce(lambda a, b: a & b, conditions)


def normal_form(pattern: Column, escape: str | None = "\\", on_trailing_escape: str = "error") -> Column:
    """A column of patterns in the form that Spark accepts: only ``%``, ``_`` and backslash are escaped, by a backslash.

    The same rules as for patterns given as text: ``escape`` makes any character literal, and a lone one at the end is an error or literal.
    """
    if escape is not None and len(escape) != 1:
        raise ValueError("escape must be one character or None")
    pairs = f"\\Q{escape}\\E.|." if escape is not None else "."
    literal = lambda x: F.when(x.isin("%", "_", "\\"), F.concat(F.lit("\\"), x)).otherwise(x)

    def token(t: Column) -> Column:
        plain = F.when(t == "\\", F.lit("\\\\")).otherwise(t)
        if escape is None:
            return plain
        lone = literal(t) if on_trailing_escape == "literal" else F.raise_error(F.lit("a pattern ends in its escape character")).cast("string")
        return F.when(F.length(t) == 2, literal(F.substring(t, 2, 1))).when(t == escape, lone).otherwise(plain)

    return F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit("(?s)" + pairs), F.lit(0)), token), "")


def like(c: Column | str, pattern: str | Column | None, escape: str | None = "\\", on_trailing_escape: str = "error") -> Column:
    """``c LIKE pattern``. A Column pattern is brought into its normal form and matched row by row; a null pattern gives null."""
    c = _column(c)
    if pattern is None:
        return F.lit(None).cast("boolean")
    if isinstance(pattern, Column):
        return F.like(c, normal_form(pattern, escape, on_trailing_escape), F.lit("\\"))
    return compile_pattern(c, Pattern.parse(pattern, escape, on_trailing_escape))


def ilike(c: Column | str, pattern: str | Column | None, escape: str | None = "\\", on_trailing_escape: str = "error", lowered: Column | str | None = None) -> Column:
    """``c ILIKE pattern``: both sides lowered. ``lowered``: a stored column of lower(c), whose tests then reach the scan."""
    c = F.lower(_column(c)) if lowered is None else _column(lowered)
    if pattern is None:
        return F.lit(None).cast("boolean")
    if isinstance(pattern, Column):
        return F.like(c, F.lower(normal_form(pattern, escape, on_trailing_escape)), F.lit("\\"))
    return compile_pattern(c, Pattern.parse(pattern, escape, on_trailing_escape).lowered())


def not_like(c: Column | str, pattern: str | Column | None, **kw) -> Column:
    return ~like(c, pattern, **kw)


def not_ilike(c: Column | str, pattern: str | Column | None, **kw) -> Column:
    return ~ilike(c, pattern, **kw)


def any_like(c: Column | str, patterns: list[str], **kw) -> Column:
    """LIKE ANY: an OR of the compiled patterns; no patterns: false for values, null for null."""
    return reduce(lambda a, b: a | b, [like(c, p, **kw) for p in patterns]) if patterns else (F.length(_column(c)) < 0)


def all_like(c: Column | str, patterns: list[str], **kw) -> Column:
    """LIKE ALL: an AND of the compiled patterns."""
    return reduce(lambda a, b: a & b, [like(c, p, **kw) for p in patterns]) if patterns else (F.length(_column(c)) >= 0)
