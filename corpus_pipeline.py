"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Each stage takes ``(spark, docs, sf_dir)`` and works on everything its predecessor kept. All but the
last return the columns of ``documents``.

Defined cases, those of the operators: a null or empty text is rejected by the first stage, so the
others see none; of equal texts one stays; rows that share an id are judged by their own texts; columns
of any further name are carried to the last stage; an empty table or benchmark gives an empty result or
removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillwise.llm import contamination, jaccard, line_runs, quality
from tillwise.llm.queries import token_digests
from tillwise.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines."""
    return quality.clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id holds.

    One that loses lines and keeps fewer words than the quality rules ask for goes: a near copy leaves
    the few lines that differ, which are no document. One that loses nothing stays.
    """
    return line_runs.dedup_documents(docs, min_words=quality.MIN_WORDS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return jaccard.keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in benchmark windows."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens of each document, and digests of its ids and of the text they decode to."""
    return token_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_tokens),
]

#: Tokenizing has no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
