"""The stages that make a training corpus of ``documents``; each takes what the one before it kept.

Every stage takes rows with nulls in any column, texts of any length, repeated rows and columns of any
further names, which it carries along; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apertura.llm import decontamination, lang_cnn, mixing, sharding, superminhash
from apertura.llm.shared import table, written

#: A document whose language is hardly likelier than by chance goes.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the network knows; texts that are null or have no letter go.

    The stage asks for the prediction of each row's own text, so rows that share an id are judged one by one.
    Whole texts are read; the language itself is no condition, so a null ``lang`` is as good as any.
    """
    return lang_cnn.with_language(docs).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that shares 80 hundredths of its five-word shingles: the one with the smallest id.

    Of rows with the same id and text one stays; rows without an id stay; texts without words are in no group.
    """
    return superminhash.first_of_each(docs)


def decontamination_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a benchmark item; null and wordless texts, of either table, are and hold none."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's target: a document once for every epoch that reaches it.

    A null source is a source; a text without words is not taken; repeated rows are taken one by one.
    """
    return mixing.mix_documents(docs)


def sharding_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in a uniform order, with ``shard`` and ``slot``, which replace columns of those names; rows alike are interchangeable."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination_),
    ("mixing", mixing_),
    ("sharding", sharding_),
]

#: Predictions of a network and hypergeometric draws have no SQL; tests compare the rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
