"""A corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a DataFrame; all
but the last return the columns of `documents`. Rows with nulls are handled as each operator's docstring
says; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import langid, mixing, neardup, packing, quality
from tallybook.llm.common import held_out, table
from tallybook.session import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE_SCORE = 0.25  # well below any text in a learned language: held-out texts score 0.48 and more
NEAR_COPIES = 80  # percent of common shingles from which two texts are near copies here
TARGETS = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts unlike every learned language."""
    model = langid.model_of(langid.profiles(docs.where(~held_out("doc_id"))))
    found = langid.identify(docs, model, COLUMNS)
    return found.where((F.col("lang_pred") != langid.UND)
                       & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the classifier doesn't take for good ones."""
    forest = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return quality.score(docs, forest, COLUMNS).where(F.col("score") >= quality.KEEP_AT).select(*COLUMNS)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, from a similarity of 0.8 on."""
    return neardup.one_of_each(docs, COLUMNS, NEAR_COPIES)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents until the languages' tokens meet the targets; no document is dropped for it."""
    return mixing.mixed(docs, "lang", TARGETS, COLUMNS, keep_all=True)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(packing.digests(packing.pieces(docs)))


STAGES = [("language", language), ("quality", good_quality), ("near_duplicates", distinct_texts),
          ("mixture", mixture), ("packing", sequences)]

ORACLE_SQL = None  # learned models and tokenisers: tests hold the stages against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
