"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets: every source gets ``level * weight`` words, but no more than ``epochs`` times its size; the level is the one at
which the targets sum to the budget. Clamping a source and resharing its excess by weight, again and again, ends at this
level; here it is found in one pass over the sources in order of cap / weight.

Repetitions: a source with target / size = 1.3 gives every document once, and documents in a seeded order once more
until 0.3 of its words are reached. Prefix sums in that order are taken in hash buckets of each source (a small
table of bucket sums, then a window inside each bucket), so a hot source is dealt over all tasks.
All of it is DataFrame and SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKEN, written
from .sharding import unfold

#: Hex digits of a row's place that name its bucket: 256 buckets in each source, in the order of the places.
BUCKET_DIGITS = 2


def word_count(text: Column) -> Column:
    """Number of tokens [^\\x20\\x09-\\x0D]+; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def place(id_cols: list[str], seed: int) -> Column:
    """Where a row stands in the seeded order: md5 of the seed and its id columns, as hex digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_cols]).cast("binary"))


def targets(sources: DataFrame, weight: Column, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target`` from a table of sources (source, source_size), one row each.

    Sources of size 0 get 0. If the budget is more than all caps, every source is at its cap. The levels are windows over the sources,
    one narrow row each, in one task: fit for millions of sources, not for a source for each document of a huge corpus.
    """
    everything = Window.partitionBy()
    s = sources.withColumn("weight", weight.cast("double")).withColumn("_cap", F.col("source_size") * F.lit(float(epochs)))
    s = s.withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("_level", level)
    # the first source that its level does not clamp sets the level for all
    s = s.withColumn("_level", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level").alias("v")))).over(everything)["v"])
    target = F.when(F.col("_level").isNull() | (F.col("_level") * F.col("weight") >= F.col("_cap")), F.col("_cap")).otherwise(F.col("_level") * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, id_cols: list[str], share: float = 1.5, epochs: float = 2.0, seed: int = 11, pattern: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """One row per row of ``docs`` (source, size, and ``id_cols``): source_size, target, ``repeats``.

    Sources by code point, null last, weigh ``pattern`` repeating. Whole repetitions go to every document; the rest to
    documents in seeded order while the middle of the document is inside the remaining share, so a source's words come
    within half a document of its target. Rows equal in all columns are counted, not shuffled; which of them repeats is no matter.
    """
    # the id columns get names that can't clash with those used on the way
    ids = [f"i{k}" for k in range(len(id_cols))]
    cols = [*ids, "source", "size"]
    grouped = docs.select(*[F.col(c).alias(i) for i, c in zip(ids, id_cols)], "source", "size").groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    grouped = grouped.withColumn("_h", place(ids, seed)).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    parts = grouped.groupBy("source", "_b").agg(F.sum(F.col("size") * F.col("_c")).alias("_words"))
    sizes = parts.groupBy("source").agg(F.sum("_words").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sizes.withColumn("_rank", rank)
    weight = F.element_at(F.array(*[F.lit(x) for x in pattern]), (F.pmod(F.col("_rank") - 1, F.lit(len(pattern))) + 1).cast("int"))
    goal = targets(ranked, weight, share, epochs)
    ratio = F.try_divide("target", "source_size")
    goal = goal.withColumn("_whole", F.coalesce(F.floor(ratio), F.lit(0)).cast("long")).withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size"))
    ahead = F.coalesce(F.sum("_words").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_ahead", ahead)
    goal = _join_null_safe(parts.select("source", "_b", "_ahead"), goal)
    inner = Window.partitionBy("source", "_b").orderBy("_h", *cols).rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("_c")
    placed = grouped.withColumn("_before", F.coalesce(F.sum(words).over(inner), F.lit(0)))
    placed = _join_null_safe(placed, goal, ["_b"])
    room = F.col("_left") - F.col("_ahead") - F.col("_before")
    # of _c equal rows, number i (from 0) repeats once more if the middle of its words is inside
    extra = F.when(F.col("size") > 0, F.least(F.col("_c"), F.greatest(F.lit(0).cast("long"), F.floor(F.try_divide(room, F.col("size")) + 0.5)))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("_extra", extra)
    placed = unfold(placed.select(*cols, "_c", "source_size", "target", "_whole", "_extra"), "_c")
    repeats = F.col("_whole") + F.when(F.col("_k") <= F.col("_extra"), 1).otherwise(0)
    return placed.select(*[F.col(i).alias(c) for i, c in zip(ids, id_cols)], "source", "size", "source_size", "target", repeats.cast("long").alias("repeats"))


def _join_null_safe(left: DataFrame, right: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Join on source (null equals null) and the columns ``also``; the columns of ``left`` once, then those of ``right``."""
    names = ["source", *(also or [])]
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in right.columns])
    on = [left[c].eqNullSafe(r[f"_r_{c}"]) for c in names]
    return left.join(r, on).drop(*[f"_r_{c}" for c in names])


def mix_documents(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, seed: int = 11) -> DataFrame:
    """The mixing digest of ``documents``: doc_id, size, source_size, target, taken (words, repeats counted).

    A null text has size 0; a null source is a source of its own, last; an empty table gives an empty result.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(sized, ["doc_id"], share, epochs, seed)
    return mixed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("repeats")).alias("taken"), "source", "repeats")


def take_mix(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, seed: int = 11) -> DataFrame:
    """``docs`` itself, each row as many times as the mix takes it.

    In seeded order the documents that repeat once more end at a cut in each source, so texts are never shuffled: a row
    only meets its source's cut. Rows that stand exactly at a cut are equal in (doc_id, text); as many repeat as fit.
    """
    # the row travels as one struct, so that no column of it can clash with those used here
    rows = docs.select("source", "doc_id", F.xxhash64("text").alias("_x"), F.struct(*docs.columns).alias("_row")).withColumn("_h", place(["doc_id", "_x"], seed))
    sized = docs.select("doc_id", F.xxhash64("text").alias("_x"), "source", word_count(F.col("text")).alias("size"))
    mixed = mix(sized, ["doc_id", "_x"], share, epochs, seed).withColumn("_h", place(["doc_id", "_x"], seed))
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    at = mixed.groupBy("source", "_h").agg(F.min(whole).alias("_whole"), F.sum(F.col("repeats") - whole).alias("_fit"))
    cuts = at.groupBy("source").agg(F.min("_whole").alias("_whole"), F.max(F.when(F.col("_fit") > 0, F.struct("_h", "_fit"))).alias("_cut"))
    # one row for each source, written so that its size is known: a small table is broadcast and texts stay where they are,
    # a large one is joined by shuffle, with skewed sources split
    met = _join_null_safe(rows, written(cuts, "cuts"))
    inside, on_cut = F.coalesce(F.col("_h") < F.col("_cut._h"), F.lit(False)), F.coalesce(F.col("_h") == F.col("_cut._h"), F.lit(False))
    plain = met.where(~on_cut).withColumn("_times", F.col("_whole") + inside.cast("long"))
    turn = F.row_number().over(Window.partitionBy("source", "_h").orderBy("doc_id"))
    ties = met.where(on_cut).withColumn("_times", F.col("_whole") + (turn <= F.col("_cut._fit")).cast("long"))
    taken = plain.unionByName(ties).where(F.col("_times") > 0)
    return taken.withColumn("_copy", F.explode(F.expr("sequence(1, cast(_times as int))"))).select("_row.*")
