"""The corpus pipeline: quality, lines, near-duplicates, benchmark passages, packing; each stage is one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import remove_contaminated
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.packing import pack
from tessera.llm.quality import keep_good
from tessera.llm.shared import discard, materialize
from tessera.llm.similar_texts import drop_similar

#: Learned models, counters and hashes can't be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of labels.quality doesn't reject, row by row, with all their columns.

    A null text is judged as an empty one; an id that is null or repeated, ties and long texts are judged like any
    other row. Without labels every row stays. No rows: none out.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that one with a smaller id holds; n_chars follows the text.

    Every row stays, if need be with an empty text; a null text becomes an empty one. Rows with a null id keep all lines,
    and those of a repeated id are one document. Other columns stay as they are. No rows: none out.
    """
    kept = dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id: five-word shingles, similarity 0.8 or more.

    Links are found over 256-bit SimHash sketches by walks of binary tries; README tells the measured recall. Null and
    empty texts are copies of each other. Rows with a null id stay; those of a repeated id stay or go together. No rows:
    none out.
    """
    return drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, judged row by row, with all their columns.

    Null and empty texts hold nothing and stay, as do all rows where the benchmark is empty; a null or repeated id
    changes nothing. No rows: none out.
    """
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: each token of each row in exactly one. Null and empty texts are their end token alone;
    rows with a null or repeated id are packed each for itself. No rows: none out."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder, read by the next, and then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
