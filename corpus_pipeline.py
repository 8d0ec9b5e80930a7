"""The corpus pipeline: language, near duplicates, benchmark leaks, source mix, token files.

Every stage takes the documents that its predecessor kept, with all their
columns, and decides on its own input: the language model is trained and its
document frequencies are counted on what it is given, groups of near
duplicates, leaks and token budgets likewise.  SQL has no twin of the trained
model, so ORACLE_SQL is None and the tests compare with brute force.

Defined cases of all stages: an empty table gives an empty table; extra columns,
whatever their names, pass through untouched up to the last stage; rows are
never changed, only kept or left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atomloom.llm import common, decontaminate, language_id, near_dup, source_mix, token_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which one language is likelier than all others together.

    Null and empty texts and those without letters go; a null lang only takes no
    part in training, and without any label nothing is kept; rows of one doc_id
    and null doc_ids are judged each by its text.
    """
    return language_id.keep_accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, that of least doc_id.

    Documents without words or without doc_id all stay; of rows that share a
    doc_id one stays, that of the longest text.
    """
    return near_dup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a test item; null and empty texts hold none."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the largest mix at which the sources' weights hold, in tokens of operator 5's vocabulary.

    A null source is the empty source; rows of one doc_id, and null doc_ids, are
    kept or left out together; texts without tokens cost nothing.
    """
    return source_mix.select_documents(docs, count=source_mix.unigram_counts)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences and masks as Arrow streams; a null or empty text is one sequence, a null doc_id -1 in it."""
    return token_file.token_streams(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_files),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = common.cut(stage(spark, docs, sf_dir), "stage")  # else each stage would compute its predecessors again
        common.discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
