"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each round only carries fixed-size keys, counted before they are shuffled. Texts that share
both length and prefix hash with another one go on to the full hash; they never leave the
task that reads them. Rows that repeat a document are counted, and written out again at the
end from their count, so no task sorts or holds them.

Defined results
  * null text equals the empty text; both form ordinary groups;
  * null doc_id: takes part; it is kept only where a whole group has no id;
  * repeated rows (same id, same text) count in ``group_size``; one of them is kept;
  * a very long text is hashed whole; ties cannot occur, but for repeated rows;
  * empty table: empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._common import id_text, small_enough

#: Repeats of one row are written out in parts of so many.
_REPEATS = 1 << 16


def _shared(keys: DataFrame, *by: str) -> DataFrame:
    return keys.groupBy(*by).agg(F.sum("n").alias("n")).filter("n > 1")


def shared_prefixes(keys: DataFrame) -> DataFrame:
    """(n_bytes, prefix) that survive the length and the prefix round."""
    by_prefix = keys.groupBy("n_bytes", "prefix").agg(F.count("*").alias("n"))  # partial sums first: no hot task
    lengths = _shared(by_prefix, "n_bytes").select("n_bytes")
    return by_prefix.join(lengths, "n_bytes", "left_semi").filter("n > 1").select("n_bytes", "prefix")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, salts: int = 32) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Of equal texts the row with the largest ``doc_id`` is kept. ``salts`` spreads the ids of
    a hot group when its kept id is attached to them.
    """
    full = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    rows = id_text(docs, id_col, text_col).withColumns({"n_bytes": F.octet_length("text"), "prefix": F.xxhash64(F.substring("text", 1, prefix_chars))})
    shared = shared_prefixes(rows.select("n_bytes", "prefix"))
    if small_enough(shared, 16):
        shared = F.broadcast(shared)
        alike, alone = (rows.join(shared, ["n_bytes", "prefix"], how).select("doc_id", full) for how in ("left_semi", "left_anti"))
    else:  # the hash goes through the shuffle, not the text
        hashed = rows.select("doc_id", "n_bytes", "prefix", full)
        alike, alone = (hashed.join(shared, ["n_bytes", "prefix"], how).select("doc_id", "text_sha256") for how in ("left_semi", "left_anti"))

    counted = alike.groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n"))
    groups = counted.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    named = counted.withColumn("salt", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(salts)).cast("int")).join(groups, ["text_sha256", "salt"])
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _REPEATS)))
    cut_up = named.select("*", parts.alias("part"))
    of_part = F.least(F.lit(_REPEATS), F.col("n") - F.col("part") * _REPEATS)
    each = cut_up.select("doc_id", "keep_id", "group_size", "text_sha256", "part", F.explode(F.sequence(F.lit(1).cast("long"), of_part)).alias("nth"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("part") == 0) & (F.col("nth") == 1)
    twins = each.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")
    single = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return twins.unionByName(single)
