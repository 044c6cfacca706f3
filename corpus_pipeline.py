"""A training corpus from ``documents``: five stages, each an operator of ``quillstone.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import jaccard_join, line_dedup, mixing, packing, quality_model
from quillstone.llm.common import materialise, table, unused
from quillstone.llm.queries import tokenizer_path

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of ``docs``.

    Null and empty texts get the score of the labels' prior; texts of any length
    are read whole; equal texts are treated alike. Without rows none are given;
    without labels every score is a half, so all are kept.
    """
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    score = unused("quality_score", docs.columns)
    scored = quality_model.score(docs, model, keep=docs.columns, score_column=score)
    return scored.filter(F.col(score) >= LEAST_QUALITY).drop(score)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated runs of lines; those of which no word is left go. ``n_chars`` follows the text.

    Null and empty texts, and those that lose nothing, stay as they are; texts of
    any length are compared whole; of rows with equal id and text all lose the
    same lines. Without rows none are given.
    """
    lines = unused("n_lines", docs.columns)
    removed = unused("n_removed", docs.columns)
    found = line_dedup.dedup(docs, lines_column=lines, removed_column=removed)
    found = found.filter((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return found.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id: five-word shingles, similarity of 0.8.

    Null texts and those without words stay; of rows with equal id and text one
    stays; texts of any length are compared whole. Without rows none are given.
    """
    return jaccard_join.distinct_documents(docs, words=5, num=80, den=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it.

    A null source is a source, the last; null and empty texts cost nothing and
    are taken as often as the whole part of their source's share says; repeated
    rows are rounded each; texts of any length stay whole. Without rows none are
    given.
    """
    return mixing.apply(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens.

    A null text is empty, its one token the end; long texts are cut; repeated rows
    are packed each. Without rows no pieces are given.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_join_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, the random rounding and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
