"""Saved reports read back: JSON documents as variants, and their blocks as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.documents import parsed


def saved_reports(spark: SparkSession, root: str, needed: tuple[str, ...] = ("schema",)) -> DataFrame:
    """(doc_id, document) of the files below ``root`` that are reports; ``doc_id`` is the path.

    A report is a JSON object with all ``needed`` keys, whatever their values; other files are
    no error, they are left out. A file is one row and is parsed in the task that reads it.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    return reports(parsed(files), needed)


def reports(documents: DataFrame, needed: tuple[str, ...] = ("schema",)) -> DataFrame:
    """Those of ``documents`` that are objects with all ``needed`` keys."""
    kept = documents
    for key in needed:
        kept = kept.filter(F.try_variant_get("document", f"$['{key}']", "variant").isNotNull())
    return kept


def report_block(documents: DataFrame, name: str, columns: str) -> DataFrame:
    """(doc_id, columns…) of the rows in block ``name``, read with a schema like ``run_id long, idle_us long``.

    Members that a row lacks, or that do not fit their type, are null; so a report of an older
    form still reads. A report without the block has no rows.
    """
    rows = F.try_variant_get("document", f"$['{name}']", "array<variant>")
    one = documents.select("doc_id", F.explode(rows).alias("row"))
    fields = [(c.strip().split()[0], " ".join(c.strip().split()[1:])) for c in columns.split(",")]
    return one.select("doc_id", *[F.try_variant_get("row", f"$['{n}']", kind).alias(n) for n, kind in fields])
