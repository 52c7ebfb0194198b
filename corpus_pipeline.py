"""From raw documents to packed training sequences: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` writes each stage's result as Parquet below the
folder that the cluster names in ``spark.checkpoint.dir`` and reads it as the next input.

Defined results, at every stage: further columns of ``documents`` are left out, whatever
their names; an empty table gives an empty one; null texts count as empty and stay null
until they are packed; null ids take part and are kept; a very long text is one text like
any other. Rows that repeat a document fare alike, until the shingle join leaves one of
them. Without labels every document is as good as any other: none is rejected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm._common import shared_folder
from tracewright.llm.best_fit_packing import pack_documents
from tracewright.llm.line_dedup import dedup_lines
from tracewright.llm.ngram_jaccard_join import one_of_each_group
from tracewright.llm.quality_classifier import score_quality, train
from tracewright.llm.queries import tokenizer_file
from tracewright.llm.secret_scan import redact_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model.constant is not None:  # one class is missing: nothing can be told apart
        return docs.select(*COLUMNS)
    return score_quality(docs.select(*COLUMNS), model).filter("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without cross-site boilerplate lines; a document that loses all it had goes."""
    done = dedup_lines(docs.select(*COLUMNS)).filter("n_removed_lines = 0 OR trim(text) != ''")
    size = F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", size).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each_group(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    done = redact_secrets(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("line dedup", lines), ("n-gram jaccard", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: A learned classifier and a tokenizer cannot be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
