"""The corpus pipeline: quality rules, line deduplication, n-gram join, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept; all but the last return
the columns of `documents`, with n_chars brought up to date where a text changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import linededup, ngramjoin, packing, quality, secrets
from lectern.llm.queries import vocabulary
from lectern.llm.shared import materialize, table


def _recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits and the learned rules keep."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return quality.judge(quality.text_stats(rows, "_row"), rules).where("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, exactly or nearly, in an earlier one; those left without any text go."""
    done = linededup.dedup_lines(docs, n_lines=None, n_removed="_lines_gone")
    return _recount(done.where((F.col("_lines_gone") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    found = ngramjoin.join_components(docs)
    gone = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return _recount(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in training windows."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: SQL can express neither the learned rules nor the merges of the packing stage; tests use brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
