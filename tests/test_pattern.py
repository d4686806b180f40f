import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelake.functions.matcher import matches
from sievelake.functions.pattern import ONE, RUN, Pattern, analyze, tokenize

ALPHABET = "ab%_\\あめ😀\n."


def by_regex(value, tokens):
    body = "".join(".*" if t is RUN else "." if t is ONE else re.escape(t) for t in tokens)
    return re.fullmatch(body, value, re.DOTALL) is not None


@settings(max_examples=1500, deadline=None)
@given(st.text(ALPHABET, max_size=8), st.text(ALPHABET, max_size=8))
def test_matcher_agrees_with_regex(value, pattern):
    tokens = tokenize(pattern, on_trailing_escape="literal")
    assert matches(value, Pattern(tokens)) == by_regex(value, tokens)


@settings(max_examples=500, deadline=None)
@given(st.text(ALPHABET, max_size=10))
def test_normal_form_parses_to_the_same_tokens(pattern):
    parsed = Pattern.parse(pattern, on_trailing_escape="literal")
    assert Pattern.parse(parsed.sql).tokens == parsed.tokens


def test_escape_rules():
    assert tokenize(r"\%\_\\\X") == ("%", "_", "\\", "X")
    assert tokenize("a!%b", escape="!") == ("a", "%", "b")
    assert tokenize("a\\%", escape=None) == ("a", "\\", RUN)
    with pytest.raises(ValueError):
        tokenize("abc\\")
    assert tokenize("abc\\", on_trailing_escape="literal")[-1] == "\\"
    with pytest.raises(ValueError):
        tokenize("a", escape="ab")


@pytest.mark.parametrize(
    ("pattern", "kind"),
    [("", "empty"), ("%", "all"), ("%%", "all"), ("__", "length"), ("%_", "length"), ("ab", "exact"), ("a_b", "exact"), ("ab%", "prefix"), ("%ab", "suffix"), ("%ab%", "substring"), ("a%b", "infix"), ("%a%b%", "parts"), ("a%b%c", "parts"), (r"\%", "exact")],
)
def test_kinds(pattern, kind):
    assert Pattern.parse(pattern).kind == kind


def test_scores():
    score = lambda p, n=False: round(analyze(Pattern.parse(p), n).selectivity, 6)
    assert score("abc") == 0.01  # 0 less 0.15, then the floor
    assert score("") == 0.0
    assert score("a%") == 0.15
    assert score("%a%") == 0.45
    assert score("%") == 0.8
    assert score("____") == 0.8
    assert score("abcdefgh%") == 0.01
    assert score("a%", True) == 0.85
    # an escaped percent sign is a literal: one run here, not two
    assert analyze(Pattern.parse(r"a\%%")).runs == 1
    assert analyze(Pattern.parse("ab_%c")).anchor_strength == 33
    assert analyze(Pattern.parse("abcdefghijkl%")).anchor_strength == 100
    assert analyze(Pattern.parse("%abc%")).anchor_strength == 0


def test_nulls_and_negation():
    assert matches(None, "%") is None
    assert matches("a", None) is None
    assert matches("a", "A", ignore_case=True) is True
    assert matches("a", "a", negated=True) is False
