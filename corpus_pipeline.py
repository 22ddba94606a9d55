"""Corpus pipeline: quality, line dedup, near-duplicates, decontamination, tokens; each stage works on what the one before kept.

Defined results of every stage: an empty table gives none of its rows and the same columns; columns of documents stay as they
are, whatever their names; texts are read and kept whole, however long; a stage's rows depend on its rows, not on their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainfield.llm import decontaminate, linededup, pieces, quality, shingles
from grainfield.llm.shared import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not reject.

    Defined results: null and empty texts are scored as texts without words; repeated rows have equal scores and stay or go
    together; a score at the threshold stays; without labels all scores are 0.5 and all documents stay."""
    model, _ = quality.train(docs, _table(spark, sf_dir, "labels"), held_out=None)
    return quality.reject(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are similar to an earlier one; those that lost lines and of which only blanks are left go.

    Defined results: null and empty texts stay; earlier is by id (null first), text hash and place; rows with equal id and
    text are one document and keep the same lines."""
    return linededup.clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard 0.8 or more): the one with the smallest id.

    Defined results: null, empty and word-less texts are one group; null ids come last; of equal ids the smallest text hash
    stays, of equal rows one."""
    return shingles.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate.

    Defined results: null, empty and word-less texts have no hit words and stay; repeated rows stay or go together; without
    benchmark items all stay."""
    return decontaminate.remove(docs, _table(spark, sf_dir, "benchmark"))


def tokenization_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and the text they decode to.

    Defined results: a null text has null ids, an empty one none; piece_ids, n_pieces, piece_score and decoded are added, and
    replace columns of these names."""
    return pieces.encode(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokenization", tokenization_stage),
]

#: No SQL: the classifier's fit and the piece encoder are no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{name}")
    return docs
