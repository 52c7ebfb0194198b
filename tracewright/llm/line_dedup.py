"""Line dedup by distinct-site spread.

A HyperLogLog sketch of the sites of each line is built and merged by ordinary partial
aggregation. Lines whose estimate is near the threshold get an exact distinct count.
Lines on ``min_sites`` sites or more are boilerplate: they go from every document but
the first that holds them (smallest id, then line number), so no content is lost.

Where the boilerplate is small, as counted, every task gets it whole and cleans the texts
as it reads them; else ids and line numbers are joined.

Defined results: null text is empty (and stays null in ``dedup_lines``); a null source
counts as one site of its own, the empty name; blank lines are never removed; documents
with a null id come first; rows that repeat a document (same id, same text) are one document
and fare alike; of ids that are equal the text of the smaller hash comes first; a very long
text is one text like any other; an empty table gives no rows; a column ``n_removed_lines``
of the input is replaced, all others, whatever their names, are left alone. Two lines are
equal when a 64-bit and a 32-bit hash agree.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm._common import cut, map_batches, small_enough, unused

_KEY = ("h1", "h2")


def _keys(line: Column) -> tuple[Column, Column]:
    # the second one is part of a hash of another text, so that the two are independent
    return F.xxhash64(line).alias("h1"), F.shiftright(F.xxhash64(F.concat(line, F.lit("\n"))), 32).cast("int").alias("h2")


def _keys_of(line: bytes) -> tuple[int, int]:
    """The same two keys of one line."""
    h1, h2 = xxhash.xxh64_intdigest(line, 42), xxhash.xxh64_intdigest(line + b"\n", 42) >> 32
    return h1 - (h1 >> 63 << 64), h2 - (h2 >> 31 << 32)


def exploded_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(doc_id, text_hash, site, line_no, h1, h2), without blank lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return rows.filter(F.trim("line") != "").select("doc_id", "text_hash", "site", "line_no", *_keys(F.col("line")))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = 12) -> DataFrame:
    """(h1, h2, first) of the lines on ``min_sites`` sites or more; ``first`` is where one stays."""
    place = F.struct("doc_id", "line_no", "text_hash")
    spread = lines.groupBy(*_KEY).agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min(place).alias("first"))
    margin = max(1.0, min_sites * 6 * 1.04 / 2 ** (lg_k / 2))
    spread = cut(spread.withColumn("sites", F.hll_sketch_estimate("sketch")).filter(F.col("sites") >= min_sites - margin).drop("sketch"))
    near = spread.filter(F.col("sites") < min_sites + margin).select(*_KEY)
    # exact counts: (line, site) pairs are made distinct before they meet, so a hot line is no hot task
    of_near = lines.join(F.broadcast(near), list(_KEY), "left_semi") if small_enough(near, 12) else lines
    pairs = of_near.select(*_KEY, "site").distinct().join(near, list(_KEY), "left_semi")
    exact = pairs.groupBy(*_KEY).agg(F.count("*").alias("exact"))
    return spread.join(exact, list(_KEY), "left").filter(F.coalesce("exact", "sites") >= min_sites).select(*_KEY, "first")


def removed_lines(lines: DataFrame, found: DataFrame, salts: int = 32) -> DataFrame:
    """(key_id, key_hash, removed array<int>) of the documents that lose lines."""
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("text_hash", "line_no"), F.lit(salts)).cast("int"))
    hits = salted.join(found, [*_KEY, "salt"]).filter(~F.struct("doc_id", "line_no", "text_hash").eqNullSafe(F.col("first")))
    return hits.groupBy(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash")).agg(F.collect_set("line_no").alias("removed"))


def _without(text: str | None, removed: set[int]) -> str | None:
    if not text or not removed:
        return text
    return "\n".join([x for i, x in enumerate(text.split("\n")) if i not in removed])


def _cleaned(df: DataFrame, removed_of, drop: list[str], text_col: str, count_col: str) -> DataFrame:
    """``df`` less ``drop``; ``removed_of`` gives the numbers of the lines to remove for each row of a batch."""

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        removed = removed_of(batch, texts)
        kept = [i for i, n in enumerate(batch.schema.names) if n not in drop]
        arrays = [pa.array([_without(t, r) for t, r in zip(texts, removed, strict=True)], pa.string()) if batch.schema.names[i] == text_col else batch.column(i) for i in kept]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(list(map(len, removed)), pa.int64())], [*(batch.schema.names[i] for i in kept), count_col])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in drop]
    return map_batches(df, clean, ", ".join([*kinds, f"`{count_col}` long"]))


def dedup_lines(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", small: int = 40) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text_col``, and how many went in ``n_removed_lines``.

    ``small``: bytes counted for a line of boilerplate when it is decided whether all tasks get it.
    """
    docs = docs.drop("n_removed_lines")
    lines = exploded_lines(docs, id_col, text_col, site_col)
    found = cut(boilerplate(lines, min_sites))
    if small_enough(found, small):
        first = {(r["h1"], r["h2"]): (r["first"]["doc_id"], r["first"]["line_no"], r["first"]["text_hash"]) for r in found.collect()}

        def removed_of(batch: pa.RecordBatch, texts: list[str | None]) -> list[set[int]]:
            ids, out = batch.column(batch.schema.get_field_index(id_col)).to_pylist(), []
            for doc_id, text in zip(ids, texts, strict=True):
                raw, gone = (text or "").encode("utf-8", "surrogatepass"), {}
                for i, line in enumerate(raw.split(b"\n") if first else []):
                    if line.strip(b" ") and (stays := first.get(_keys_of(line))):
                        gone[i] = stays
                if any(s[:2] == (doc_id, i) for i, s in gone.items()):  # of rows with one id, the text counts as well
                    text_hash = xxhash.xxh64_intdigest(raw, 42)
                    here = text_hash - (text_hash >> 63 << 64)
                    gone = {i: s for i, s in gone.items() if s != (doc_id, i, here)}
                out.append(set(gone))
            return out

        return _cleaned(docs, removed_of, [], text_col, "n_removed_lines")
    taken = docs.columns
    key_id, key_hash, removed = (unused(n, taken) for n in ("key_id", "key_hash", "removed"))
    gone = removed_lines(lines, found).select(F.col("key_id").alias(key_id), F.col("key_hash").alias(key_hash), F.col("removed").alias(removed))
    same = F.col(id_col).eqNullSafe(F.col(key_id)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(key_hash))
    joined = docs.join(gone, same, "left")
    return _cleaned(joined, lambda batch, _: [set(r or ()) for r in batch.column(batch.schema.get_field_index(removed)).to_pylist()], [key_id, key_hash, removed], text_col, "n_removed_lines")


def line_dedup_report(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(doc_id, n_lines, n_removed, clean_sha256), one row per input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(site_col).alias("source"))
    rows = rows.withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long"))
    done = dedup_lines(rows, min_sites)
    return done.select("doc_id", "n_lines", F.col("n_removed_lines").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("clean_sha256"))
