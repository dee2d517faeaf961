"""A corpus pipeline of five stages: what is no language goes, copied lines go, one document of each group of near copies stays,
documents with benchmark text go, and what is left is encoded.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame. run() writes each result as Parquet, in the folder
that driver and executors share, and reads it again as the next stage's documents, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import line_variants, piece_bpe, ppm_language, prefix_groups, suffix_decontamination
from roadloom.llm.common import cut, fresh, read, small_batches, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter and whose language is clear. The trees learn from the stage's own documents."""
    small_batches(spark)
    return ppm_language.keep_known(docs, ppm_language.train(docs.where(~ppm_language.held_out())))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that copy earlier ones; n_chars follows the text."""
    small_batches(spark)
    out = line_variants.dedup_lines(docs, keep_columns=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies: five-word shingles, similarity 0.8. Of rows with
    the same id and text one stays; rows with the same id and other texts are documents of their own."""
    small_batches(spark)
    groups = prefix_groups.similar_components(docs, n=5, percent=80, keys=True)
    later, own = fresh(docs, "later"), fresh(docs, "own")
    # documents that go or of which only one row stays; the others are not moved
    marked = cut(groups.groupBy(F.col("key").alias(later)).agg(F.count("*").alias("n"), F.first("first_key").alias("first_key")).where(f"n > 1 or {later} <> first_key"))
    keyed = docs.withColumn(own, prefix_groups.row_key("doc_id", "text"))
    alone = keyed.join(marked, F.col(own) == F.col(later), "left_anti")
    one = keyed.join(marked.where(f"{later} = first_key").select(later), F.col(own) == F.col(later), "left_semi").dropDuplicates([own])
    return alone.unionByName(one).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return suffix_decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and the text that they decode to."""
    small_batches(spark)
    return piece_bpe.encode_pieces(docs, piece_bpe.default_model())


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", piece_encoding),
]

#: SQL has no way to train the trees or to run the merges; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "corpus_pipeline", name.split(" ")[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
