"""A training corpus from raw documents: five stages, each written as Parquet and reread.

Every stage works on all rows its predecessor kept. All but the last return the columns of
``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from reelframe.llm.common import Scratch, fresh, table
from reelframe.llm.registry import vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar rejects go; null and empty texts have no clause to reject and are scored as empty."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that loses all its words goes too, one that had none stays.

    n_chars follows the text. Null and empty texts stay as they are, repeated rows are treated
    alike, an empty table gives an empty one; extra columns may have any name.
    """
    counts, names = fresh("counts", docs.columns), docs.columns
    out = line_dedup.line_dedup(docs, report=counts)
    lost = F.col(f"{counts}.n_kept") < F.col(f"{counts}.n_lines")
    left = out.where(~F.coalesce(lost & F.col("text").rlike(r"^\s*$"), F.lit(False)))
    if "n_chars" in names:
        left = left.withColumn("n_chars", F.when(lost, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(names)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id: five-word shingles, similarity of 0.8 or more.

    Texts without words are like nothing and stay, and so do rows without doc_id; rows that share a doc_id stay together.
    """
    return jaccard.one_per_component(docs, n=5, threshold=(8, 10))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or the whole of a shorter one, go; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), 10, nameless=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' token pieces, packed into sequences of 2048; null and empty texts are their end id alone, repeated rows are packed each."""
    out = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 2048, 0)
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: No SQL: the learned grammar, SimHash groups, packing and the tokenizer have no SQL form. tests/llm/ holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each from the Parquet files of the one before.

    A stage's own scratch tables go once its result is written, and its input with them.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with Scratch.passing(spark):
            docs = scratch.save(stage(spark, before, sf_dir), name)
        scratch.drop(before)
    return docs
