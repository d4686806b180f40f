import random

import pytest
from pyspark.sql import functions as F

from sievelake.functions.matcher import matches
from sievelake.functions.predicate import ilike, like, not_ilike, not_like
from sievelake.plans.planner import Predicate, conjunction, explain, ordered
from sievelake.sources.files import text_key

LETTERS = ["a", "b", "%", "_", "\\", "あ", "め", "😀", "\n", "É", "\x01"]
VALUES = [
    None, "", "a", "ab", "aba", "abab", "abc", "abcd", "abcde", "a" * 15, "a" * 100, "ab" * 500, "100%", "under_score", "%%", "C:\\dir", "it's", "a\tb", "a\nb", "  ", " a ", "a.c",
    "あ", "め", "ぁ", "あめ", "日本語テキスト", "தமிழ்", "한국어", "العربية", "😀", "a😀b", "É", "é", "café", "naïve", "Straße", "STRASSE", "alex", "a_ex", "\x01", "a\x01b", "ABCD", "AbCd", "12345", "+49 (30) 123",
]
PATTERNS = [
    "", "%", "%%", "_", "__", "_____", "%_", "%___%", "abc", "ABC", "abcd", "ab%", "%ab", "%ab%", "a%b", "ab%ba", "%a%b%", "a%b%c", "%a_c%", "%_lex%", "%a_e%", r"%\_e%", r"%\%%", r"%\%", r"%\\%", r"\a\b%",
    "_b", "a_", "_b%", "%b_", "a__d", "%_b_d", "a_c_e", "あ", "あ%", "%あ", "_", "a_b", "%😀%", "É", "é%", "%É", "%é%", "%aaaaaaaa%", "%a%a%a%a%b%", "%_%_%", "_%b%_", "%.%", "%\n%", "% %", "%\x01%", "%(30)%", "_%", "a%_", "%a", "%b%b%b%b",
]


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    extra = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    return spark.createDataFrame(list(enumerate(VALUES + extra)), "id int, s string").repartition(2).cache()


def check(values, patterns, build, **kw):
    cols = {f"p{i}": build("s", p) for i, p in enumerate(patterns)}
    for row in values.select("s", *[c.alias(n) for n, c in cols.items()]).collect():
        for i, p in enumerate(patterns):
            assert row[f"p{i}"] == matches(row["s"], p, **kw), (row["s"], p)


def test_like(values):
    check(values, PATTERNS, like)


def test_not_like(values):
    check(values, PATTERNS, not_like, negated=True)


def test_ilike(values):
    check(values, PATTERNS, ilike, ignore_case=True)


def test_not_ilike(values):
    check(values, PATTERNS, not_ilike, ignore_case=True, negated=True)


def test_random_patterns(values):
    rng = random.Random(6)
    patterns = ["".join(rng.choice([*LETTERS[:4], *LETTERS[5:9], "%", "_", "\\%", "\\_", "\\\\"]) for _ in range(rng.randint(0, 7))) for _ in range(60)]
    check(values, patterns, like)


def test_filters_drop_nulls(values):
    n = values.where("s is not null").count()
    assert values.where(like("s", "%")).count() == n
    assert values.where(not_like("s", "%")).count() == 0
    assert values.where(like("s", None)).count() == 0
    assert values.where(~like("s", None)).count() == 0


def test_column_patterns(spark):
    df = spark.createDataFrame([("abc", "a%"), ("abc", "_"), ("a%", "a\\%"), (None, "%"), ("x", None)], "s string, p string")
    assert [r[0] for r in df.select(like("s", F.col("p"))).collect()] == [True, False, True, None, None]


def test_case_corners(spark):
    df = spark.createDataFrame([("ΣΕΛΑΣ",), ("İ",)], "s string")
    assert [r[0] for r in df.select(F.length(F.lower("s"))).collect()] == [5, 2]
    assert df.where(ilike("s", "σελας")).count() == 1


def pushed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pushdown(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    for p, name in (("small%", "StringStartsWith"), ("%ring", "StringEndsWith"), ("%l r%", "StringContains"), (r"%\%%", "StringContains"), ("s_al%", "StringStartsWith"), ("%a%r%", "StringContains")):
        assert name in pushed(part.where(like("p_name", p)).select("p_partkey")), p
    plan = pushed(part.where(like("p_name", "%a%")).select("p_partkey"))
    assert "p_brand" not in plan.split("ReadSchema")[1]


def test_planner_order(spark):
    ps = [Predicate("a", "LIKE", "%x%"), Predicate("b", "LIKE", "abc"), Predicate("c", "NOT LIKE", "q%"), Predicate("d", "ILIKE", "a%")]
    assert [p.column for p in ordered(ps)] == ["b", "d", "a", "c"]
    assert [r["column"] for r in explain(ps)] == ["b", "d", "a", "c"]
    df = spark.createDataFrame([("x", "abc", "z", "A"), ("x", "abc", "q", "A"), (None, "abc", "z", "a")], "a string, b string, c string, d string")
    assert df.where(conjunction(ps)).count() == 1
    assert df.where(conjunction([])).count() == 3
    assert df.where(conjunction([Predicate("b", "LIKE", None)])).count() == 0
    with pytest.raises(ValueError):
        Predicate("a", "REGEXP", "x")


def test_keys_must_be_text(spark):
    df = spark.range(1)
    with pytest.raises(TypeError):
        text_key(df, "id")
    text_key(df, F.col("id").cast("string"))


def test_patterns_in_a_column(spark):
    """The same answers as for patterns given as text, whatever they escape."""
    values = ["a", "ab", "a%b", "a_b", "a\\b", "\\", "%", "é", "A%B", "", None]
    patterns = ["a", "a%", "\\a%", "a\\%b", "a\\_b", "a\\\\b", "%\\b", "\\\\", "\\é", "_", "", "A\\%b"]
    df = spark.createDataFrame([(v, p) for v in values for p in [*patterns, None]], "v string, p string")
    got = df.select("v", "p", like("v", F.col("p")).alias("l"), ilike("v", F.col("p")).alias("i"), not_like("v", F.col("p")).alias("n")).collect()
    for r in got:
        assert (r["l"], r["i"], r["n"]) == (matches(r["v"], r["p"]), matches(r["v"], r["p"], True), matches(r["v"], r["p"], False, True)), r
    own = spark.createDataFrame([("50%", "50!%"), ("a\\", "!a\\"), ("a!", "a!!"), ("a", "!a!")], "v string, p string")
    assert [r[0] for r in own.where("p <> '!a!'").select(like("v", F.col("p"), escape="!")).collect()] == [True] * 3
    assert own.select(like(F.concat("v", F.lit("!")), F.col("p"), escape="!", on_trailing_escape="literal").alias("x")).where("x").count() == 1
    with pytest.raises(Exception):
        own.select(like("v", F.col("p"), escape="!")).collect()
    assert df.where(like("v", F.lit("a\\"), escape=None)).count() == 0
    assert spark.createDataFrame([("a\\",)], "v string").where(like("v", F.lit("_\\"), escape=None)).count() == 1
