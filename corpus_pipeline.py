"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns
a DataFrame that is written and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, jaccard, language, mixing, packing, quality
from tidemark.llm.common import free_name, numbered, table, written

#: A document stays if some language has at least this mean probability over its bytes.
LEAST_SCORE = 0.5


def _tidy(stage):
    """The stage; what it has written on the way and its result does not read is deleted when it is done.

    Only folders of this very call are looked at, so calls may overlap and results stay readable.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with common.owned() as folders:
            out = stage(spark, docs, sf_dir)
            common.release(folders, out)
        return out

    return run


@_tidy
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted text's model their language allows."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.where(F.col(quality.names(docs)["kept"])).select(*docs.columns)


@_tidy
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts without letters or of no clear language go."""
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    seen = language.predict(docs, language.fit(docs), pred, score)
    return seen.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id.

    The rows are numbered in a written table, which alone is read from then on.
    """
    n = free_name(docs, "row_number")
    rows = numbered(docs, n)
    kept = jaccard.join(rows, row=n).where("kept").select(F.col("row").alias(n))
    return rows.join(kept, n, "left_semi").select(*docs.columns)


@_tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a repeated document is a repeated row."""
    n, c = free_name(docs, "row_number"), free_name(docs, "copies")
    rows = numbered(docs, n)
    taken = mixing.mix(rows, row=n).where("copies > 0").select(F.col("row").alias(n), F.col("copies").cast("int").alias(c))
    return rows.join(taken, n).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(c))).alias(c)).drop(c)


@_tidy
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens.

    The workers go on to other stages, so they remember few words here.
    """
    return packing.pack_documents(docs, remember=100_000)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: No SQL states a trained model's decisions or a bin's packing; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage has left is deleted once its rows are written for the next one."""
    docs = table(spark, sf_dir, "documents")
    with common.owned() as mine:
        for _, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir))
            common.release(mine, docs)
        return STAGES[-1][1](spark, docs, sf_dir)
