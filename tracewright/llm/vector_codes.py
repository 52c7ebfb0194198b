"""Vector codes by product quantisation, over whole numbers and exact.

Vectors are cut into equal consecutive parts; each part has a codebook. The rows become
columnar blocks, a contiguous column a dimension, written once to the shared folder. A round
is one ``treeAggregate`` over the blocks: distances grow dimension by dimension, every part
goes to its nearest entry, ``np.add.at`` adds it to int64 tensors of sums and counts, and the
tensors merge through a tree of reducers. What reaches the driver is of the codebooks' size.

Defined results: vectors that are null or empty, or hold null or non-finite components, take no
part; nor do vectors whose length is not the commonest one that can be cut into so many parts
(ties: the shorter). Rows that repeat an id each count; seeds with equal ids go by their
components, rows without an id come last among the seeds and keep their null id. With fewer
rows than entries there are as many entries as rows. Ties go to the lower entry, entries
without rows stay. Null labels are one label. An empty table gives no rows; other columns,
whatever their names, are ignored. Squared distances must fit into 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._common import cut, slices, small_enough
from tracewright.llm._vectors import common_length, finite, narrowest, whole_numbers

#: Rows whose distances to a codebook are held at once.
AT_ONCE = 4096


def part_blocks(vectors: DataFrame, vec_col: str, dim: int) -> RDD:
    """(dim, n) arrays of whole numbers, cut in the shared folder in their narrowest form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 10_000):
                x = narrowest(np.ascontiguousarray(whole_numbers(part.column(0), dim).T))
                yield pa.RecordBatch.from_arrays([pa.array([x.dtype.itemsize], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["width", "columns"])

    blocks = cut(vectors.select(vec_col).mapInArrow(run, "width int, columns binary"))
    return blocks.rdd.map(lambda r: np.frombuffer(r["columns"], f"<i{r['width']}").reshape(dim, -1))


def nearest(columns: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry (parts, n) and squared distance (parts, n) of the columns' parts to codebooks (parts, entries, sub)."""
    parts, _, sub = codebooks.shape
    n = columns.shape[1]
    most = int(np.abs(columns).max(initial=0)) + int(np.abs(codebooks).max(initial=0))
    kind = np.int32 if sub * most * most < 1 << 31 else np.int64
    columns, codebooks = columns.astype(kind), codebooks.astype(kind)
    codes, far = np.empty((parts, n), np.int64), np.empty((parts, n), np.int64)
    for lo in range(0, n, AT_ONCE):
        hi = min(n, lo + AT_ONCE)
        for p in range(parts):
            total = np.zeros((hi - lo, codebooks.shape[1]), kind)
            for j in range(sub):
                apart = columns[p * sub + j, lo:hi, None] - codebooks[p, None, :, j]
                apart *= apart
                total += apart
            codes[p, lo:hi] = total.argmin(axis=1)  # the first of equal ones
            far[p, lo:hi] = np.take_along_axis(total, codes[p, lo:hi, None], axis=1)[:, 0]
    return codes, far


def one_round(blocks: RDD, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks with every entry at the floored mean of its parts."""
    parts, entries, sub = codebooks.shape

    def add(held: tuple[np.ndarray, np.ndarray], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = held
        codes, _ = nearest(columns, codebooks)
        for p in range(parts):
            np.add.at(sums[p], codes[p], columns[p * sub : (p + 1) * sub].T)
            np.add.at(counts[p], codes[p], 1)
        return held

    def both(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return a[0] + b[0], a[1] + b[1]

    sums, counts = blocks.treeAggregate((np.zeros((parts, entries, sub), np.int64), np.zeros((parts, entries), np.int64)), add, both)
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], codebooks)


def codebooks_of(vectors: DataFrame, dim: int, parts: int, entries: int, rounds: int, id_col: str, vec_col: str) -> np.ndarray:
    """(parts, entries, dim / parts) codebooks of ``vectors``, all of ``dim`` components."""
    seeds = vectors.select(id_col, vec_col).orderBy(F.col(id_col).asc_nulls_last(), F.transform(vec_col, lambda x: F.floor(256 * x.cast("double")))).limit(entries).collect()
    start = whole_numbers(pa.array([list(r[1]) for r in seeds], pa.list_(pa.float64())), dim)
    books = start.reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2).copy()
    blocks = part_blocks(vectors, vec_col, dim)
    for _ in range(rounds):
        books = one_round(blocks, books)
    return books


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, codebooks: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error) of vectors that all have the codebooks' length."""
    parts, _, sub = codebooks.shape
    two = np.array([f"{i:02x}" for i in range(codebooks.shape[1])], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 10_000):
                codes, far = nearest(whole_numbers(part.column("vec"), parts * sub).T, codebooks)
                code = ["".join(row) for row in two[codes.T].tolist()]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(code, pa.string()), pa.array(far.sum(axis=0), pa.int64())], ["vec_id", "label", "code", "error"])

    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", salts: int = 32) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row per usable vector; at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits a part: 1 to 256 entries")
    dim = common_length(vectors, vec_col, parts)
    kept = vectors.filter(finite(F.col(vec_col)) & (F.size(vec_col) == dim))
    if not dim:
        none = kept.select(F.col(id_col).cast("long").alias("vec_id"))
        return none.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = codebooks_of(kept, dim, parts, entries, rounds, id_col, vec_col)
    coded = cut(encode(kept, books, id_col, vec_col, label_col).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    same = coded["label"].eqNullSafe(F.col("of_label"))
    if small_enough(totals, 64):
        joined = coded.join(F.broadcast(totals), same)
    else:  # a label may hold any share of the rows: its rows are dealt over all salts
        spread = totals.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = coded.join(spread, same & (F.col("salt") == F.col("of_salt")))
    return joined.select(F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same rows by comparing every part with every entry."""
    ok = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = ""
    for r in range(rounds + 1):
        steps += f""",
        a{r} AS MATERIALIZED (SELECT k, part, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d FROM (
            SELECT k, p.part, e, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d FROM p JOIN c{r} ON c{r}.part = p.part) GROUP BY 1, 2)"""
        if r < rounds:
            steps += f""",
        m{r} AS (SELECT part, e, list(v ORDER BY i) AS c FROM (SELECT part, e, i, CAST(floor(sum(v)::DOUBLE / count(*)) AS BIGINT) AS v FROM (
            SELECT a.part, a.e, unnest(p.x) AS v, generate_subscripts(p.x, 1) AS i FROM a{r} a JOIN p ON p.k = a.k AND p.part = a.part) GROUP BY 1, 2, 3) GROUP BY 1, 2),
        c{r + 1} AS MATERIALIZED (SELECT o.part, o.e, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m ON m.part = o.part AND m.e = o.e)"""
    return f"""
        WITH dim AS (SELECT len(embedding) AS n FROM embeddings WHERE {ok} AND len(embedding) % {parts} = 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        v AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, label, n // {parts} AS sub, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings, dim WHERE {ok} AND len(embedding) = n),
        p AS MATERIALIZED (SELECT k, j AS part, v[j * sub + 1 : (j + 1) * sub] AS x FROM v, range({parts}) r(j)),
        s AS (SELECT k, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM v),
        c0 AS MATERIALIZED (SELECT part, e, x AS c FROM p JOIN s USING (k) WHERE e < {entries}){steps},
        q AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1),
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS sha FROM c{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM q JOIN v USING (k), h"""
