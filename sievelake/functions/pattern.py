"""Wildcard patterns as data: tokens, parts, a normal form that Spark accepts, and the numbers the planner orders by.

A pattern is cut into tokens once, here, on the driver: literal code points, ``ONE`` for an underscore and ``RUN`` for a percent sign.
Everything else works on tokens, so an escaped wildcard can't be mistaken for a wildcard and no byte value is special.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from functools import cached_property
from itertools import groupby


class Wild(Enum):
    ONE = "_"
    RUN = "%"


ONE, RUN = Wild.ONE, Wild.RUN
Token = str | Wild


def tokenize(pattern: str, escape: str | None = "\\", on_trailing_escape: str = "error") -> tuple[Token, ...]:
    """Tokens of a pattern. The character after ``escape`` is literal, whatever it is; None: nothing escapes.

    A lone escape at the end is an error, or a literal with ``on_trailing_escape="literal"``.
    """
    if escape is not None and len(escape) != 1:
        raise ValueError("escape must be one character or None")
    out: list[Token] = []
    chars = iter(pattern)
    for c in chars:
        if c == escape:
            following = next(chars, None)
            if following is None and on_trailing_escape != "literal":
                raise ValueError(f"pattern ends in its escape character: {pattern!r}")
            out.append(c if following is None else following)
        else:
            out.append(RUN if c == "%" else ONE if c == "_" else c)
    return tuple(out)


@dataclass(frozen=True)
class Pattern:
    """A parsed pattern."""

    tokens: tuple[Token, ...]

    @staticmethod
    def parse(pattern: str, escape: str | None = "\\", on_trailing_escape: str = "error") -> Pattern:
        return Pattern(tokenize(pattern, escape, on_trailing_escape))

    @cached_property
    def parts(self) -> tuple[tuple[Token, ...], ...]:
        """Runs of tokens between percent signs."""
        return tuple(tuple(run) for is_run, run in groupby(self.tokens, lambda t: t is RUN) if not is_run)

    @property
    def starts_open(self) -> bool:
        return self.tokens[:1] == (RUN,)

    @property
    def ends_open(self) -> bool:
        return self.tokens[-1:] == (RUN,)

    @property
    def has_run(self) -> bool:
        return RUN in self.tokens

    @property
    def least_length(self) -> int:
        """Code points that any match has at least (exactly, without a percent sign)."""
        return sum(t is not RUN for t in self.tokens)

    def lowered(self) -> Pattern:
        """The pattern with its literals in lower case, lowered together so that context rules apply."""
        out: list[Token] = []
        for wild, run in groupby(self.tokens, lambda t: isinstance(t, Wild)):
            out.extend(run if wild else "".join(run).lower())
        return Pattern(tuple(out))

    @property
    def sql(self) -> str:
        """The normal form: only ``%``, ``_`` and backslash are ever escaped, by a backslash."""
        return "".join(t.value if isinstance(t, Wild) else "\\" + t if t in "%_\\" else t for t in self.tokens)

    @property
    def kind(self) -> str:
        """empty, all, length, exact, prefix, suffix, substring, infix or parts."""
        if not self.tokens:
            return "empty"
        if not any(isinstance(t, str) for t in self.tokens):
            return "all" if set(self.tokens) == {RUN} else "length"
        if len(self.parts) == 1:
            return {(False, False): "exact", (False, True): "prefix", (True, False): "suffix", (True, True): "substring"}[self.starts_open, self.ends_open]
        return "infix" if len(self.parts) == 2 and not self.starts_open and not self.ends_open else "parts"


@dataclass(frozen=True)
class Analysis:
    """What the planner knows of a predicate before it runs."""

    literals: int
    underscores: int
    runs: int
    parts: int
    is_exact: bool
    is_prefix: bool
    is_suffix: bool
    is_substring: bool
    anchor_strength: int
    selectivity: float


def analyze(pattern: Pattern, negated: bool = False) -> Analysis:
    """Statistics, anchor strength and selectivity score (small: few rows expected) of a pattern.

    Fixed values: 10 for an anchored literal and 3 for an anchored underscore, 100 at most; score 0 for exact patterns, 0.1 and 0.1
    for each run with one anchor, 0.5 for substrings, 0.8 otherwise, less 0.05 for each literal; 0.01 below 0, 1 at most.
    A negated predicate scores 1 minus that.
    """
    tokens = pattern.tokens
    literals = sum(isinstance(t, str) for t in tokens)
    runs = sum(1 for is_run, _ in groupby(tokens, lambda t: t is RUN) if is_run)
    has_run = runs > 0
    prefix, suffix = has_run and not pattern.starts_open, has_run and not pattern.ends_open
    inside = has_run and pattern.starts_open and pattern.ends_open and runs >= 2
    exact = not has_run and ONE not in tokens
    worth = lambda part: sum(10 if isinstance(t, str) else 3 for t in part)
    anchor = min(100, (worth(pattern.parts[0]) if prefix else 0) + (worth(pattern.parts[-1]) if suffix else 0))
    score = 0.0 if exact else 0.1 + 0.1 * runs if prefix or suffix else 0.5 if inside else 0.8
    score -= 0.05 * literals
    score = 0.01 if score < 0 else min(1.0, score)
    return Analysis(literals, len(tokens) - literals - sum(t is RUN for t in tokens), runs, len(pattern.parts), exact, prefix, suffix, inside, anchor, 1 - score if negated else score)
