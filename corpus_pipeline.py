"""From raw documents to token ids: quality, language, near-duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, and further columns that docs may have, whatever their names.
An empty table goes through every stage; rows that are equal in all columns are rows of their own until near-dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelake.llm import bpe, langid, mixing, quality, textdedup
from sievelake.llm.common import discard, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more; it learns from the labelled rows of docs.

    A null text is scored as an empty one; a null id never teaches. Equal texts have equal scores, so they stay or go together;
    a score of exactly 0.3 stays. Without labels every score is 0.5, and all stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network recognises; it learns from the lang column of docs.

    Null texts and those without a letter go; a null lang never teaches. Without a row that teaches no language is
    known, and all go. A probability of exactly the bound stays.
    """
    return langid.keep_sure(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id (null ids last), of each group of near-duplicates.

    Null texts and texts without words are no copies of each other and all stay. Of rows that repeat the smallest id one stays.
    """
    return textdedup.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated (or left out) so that the words of each source come to its target.

    A null source is a source of its own; texts that are null or without words count nothing and are taken as often as
    their source's documents are taken whole. Documents that stand alike in the seeded order repeat as far as they fit.
    """
    return mixing.take_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids: what a trainer reads; one row for each row of docs, no ids where the text is null or empty."""
    return bpe.encode(docs, ["doc_id", "lang", "source"], *bpe.default_vocabulary())


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("MinHash near-dedup", without_near_duplicates),
    ("mixing sources to target weights", mixed_sources),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: SQL can't express the trained stages; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what each one keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, docs = docs, written(kept, name.split(" ")[0].lower())
            discard(before)
        else:
            docs = kept
    return docs
