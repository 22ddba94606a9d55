"""The operators of this subpackage over whole tables, under the names and with the columns that the driver reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, linededup, lm, oracles, pieces, quality, secrets, sharding, simhash, topk
from .shared import crc_mod


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; held-out documents are not learned from."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model, stats = quality.train(docs, _read(spark, sf_dir, "labels"))
    return quality.score(stats.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "stats"), model)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, by way of a new ledger."""
    found = secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = secrets.spans(F.col("found"))
    counts = [secrets.count(F.col("found"), k).alias(f"n_{r.kind}") for k, r in enumerate(secrets.RULES)]
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), base.alias("spans"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents; held-out documents are not learned from."""
    docs = _read(spark, sf_dir, "documents")
    filters = langid.train(docs.where(crc_mod("doc_id", 4) != 2))
    return langid.predict(docs, filters, keep=["doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out")])


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return topk.top_k(_read(spark, sf_dir, "embeddings"), lambda id: id % 20 == 0)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words hit in every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.hits(docs, _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that have an earlier similar line."""
    found = linededup.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the text they decode to."""
    found = pieces.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_pieces", "piece_ids", "piece_score", "decoded", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents; held-out documents are not learned from."""
    return lm.score(_read(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod("doc_id", 7) != 2)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    placed = sharding.shard(_read(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_secrets, op3_language, op4_topk, op5_decontaminate, op6_linededup, op7_simhash, op8_sentencepiece, op9_lm, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
