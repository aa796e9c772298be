"""Corpus pipeline: quality, repeated lines, near duplicates, benchmark passages, packing.

STAGES are applied to ``documents`` in order; each result is written as Parquet and read
again as the next stage's input.  All stages but the last return the columns of their input;
the last returns one row per packed piece.  Columns beyond ``doc_id`` and ``text`` are
carried along unread (``n_chars``, if there, follows the text).

NULLs, empty texts, repeated rows and empty tables are treated as the operators'
docstrings say: a text without a word does not pass the first stage, and the third decides
on rows, also where rows share a doc_id or have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineup.llm.common import boxed, importable, table, unboxed
from lineup.llm.decontamination import remove_contaminated
from lineup.llm.line_dedup import dedup_lines
from lineup.llm.near_dedup import one_per_group
from lineup.llm.packing import pack_documents
from lineup.llm.quality import classify, fit, grade_of
from lineup.session import shared_dir

SPACE = r"^[\x20\x09-\x0D]*$"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that are more likely harmful or poor than good go."""
    importable(spark)
    ratings = table(spark, sf_dir, "labels").select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    rated = classify(boxed(docs), fit(docs, ratings))
    return unboxed(rated.where("kept"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of a line in 10 or more documents only the first stays; a document
    left without any text goes."""
    out = dedup_lines(boxed(docs), min_docs=10, keep_first=True)
    out = unboxed(out.where((F.col("n_dropped") == 0) | ~F.regexp("text", F.lit(SPACE))), docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: five-word shingles, similarity 0.8; one row of each group stays."""
    importable(spark)
    return one_per_group(docs, k=5, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a 10-word window of a benchmark item go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"), n=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of at most 4096 tokens in as few sequences as possible."""
    importable(spark)
    return pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("packing", packing)]

#: The classifier and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``; the last stage's rows are the result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
