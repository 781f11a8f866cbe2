"""From raw documents to packed sequences: each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder
and reads again. All but the last return the columns of documents; n_chars follows the text where a stage
changes it. Empty tables pass through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import line_dedup, ngram_join, packing, pii, toxicity
from tallyspark.llm.bpe import default_vocabulary
from tallyspark.llm.common import shared_folder, table

#: Share of a source's pages above which a line is boilerplate to this pipeline; the README has what it was measured on.
LINE_RATIO = 0.01
#: Pages of a source that must have a line: near copies still stand beside each other here, and a pair of them in a
#: small source would lose all the lines that they share.
LINE_LEAST = 5


def _recount(before: DataFrame, after: DataFrame) -> DataFrame:
    """after, with n_chars as long as its text where before has such a column."""
    if "n_chars" not in before.columns:
        return after.select(*before.columns)
    kind = before.schema["n_chars"].dataType
    counted = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))
    return after.withColumn("n_chars", counted).select(*before.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model is trained on the labelled rows of the original documents."""
    model = toxicity.train(toxicity.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; documents stay."""
    return _recount(docs, line_dedup.drop_lines(docs, ratio=LINE_RATIO, least=LINE_LEAST))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, of its smallest doc_id."""
    return ngram_join.keep_first(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are masked."""
    return _recount(docs, pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and places."""
    return packing.pack(packing.pieces(docs, default_vocabulary()))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_join", drop_near_copies),
    ("pii", sanitise),
    ("packing", pack),
]

#: The classifier, the sanitising and the packing have no SQL. Tests hold what stages 1 to 4 keep and change against plain
#: Python on a small table, and stage 5's pieces against the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
