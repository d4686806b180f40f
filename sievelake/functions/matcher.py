"""A plain Python LIKE: what the tests hold every other path against, and a scalar fallback for single values."""

from __future__ import annotations

from .pattern import ONE, RUN, Pattern


def matches(value: str | None, pattern: Pattern | str | None, ignore_case: bool = False, negated: bool = False) -> bool | None:
    """SQL's [NOT] LIKE / ILIKE of one value; None where either side is null.

    Dynamic programming over the set of token places that the text read so far can have reached: no backtracking, so
    time is text length times pattern length at worst.
    """
    if value is None or pattern is None:
        return None
    if isinstance(pattern, str):
        pattern = Pattern.parse(pattern)
    if ignore_case:
        value, pattern = value.lower(), pattern.lowered()
    tokens = pattern.tokens

    def closed(places: set[int]) -> set[int]:
        out = set()
        for i in places:
            out.add(i)
            while i < len(tokens) and tokens[i] is RUN:
                i += 1
                out.add(i)
        return out

    at = closed({0})
    for c in value:
        at = closed({i if tokens[i] is RUN else i + 1 for i in at if i < len(tokens) and (tokens[i] is RUN or tokens[i] is ONE or tokens[i] == c)})
        if not at:
            break
    return (len(tokens) in at) != negated
