"""The corpus pipeline: language ID, quality rules, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. Between stages the rows are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import cluster, langid, mixing, neardup, packing, rules

#: A document goes where its language's posterior is below this, or it has no language at all.
LEAST_LANGUAGE_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those that no language explains better than the others."""
    out = langid.identify(cluster.as_rows(docs), langid.fit(docs), ["_row"])
    return cluster.from_rows(out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fail the base rules or score below the log-ratio threshold."""
    weights = rules.log_ratio(docs, cluster.table(spark, sf_dir, "labels"))
    return cluster.from_rows(rules.judge(cluster.as_rows(docs), weights, ["_row"]).where("kept"), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies.

    Rows that share an id but not the text are documents of their own, and rows without an
    id are compared like others; rows alike in both are copies.
    """
    return neardup.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its rate says, so that the languages' token shares meet the targets."""
    mixer, _ = mixing.fit(docs, "lang", mixing.TARGETS)
    return mixing.apply(docs, mixer)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language ID", language_stage),
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The learned stages have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cluster.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cluster.materialise(docs)
    return docs
