"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of a join up to this many bytes are broadcast, after their rows were counted.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, null texts as empty ones."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Slices of a batch hold no more than this, but for single rows that are larger.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, rows: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of at most ``rows`` rows and about ``size`` bytes; a longer row is a part of its own."""
    work = [(at, min(rows, batch.num_rows - at)) for at in range(0, batch.num_rows, rows)][::-1]
    while work:
        at, n = work.pop()
        part = batch.slice(at, n)
        if n > 1 and part.nbytes > size:
            work += [(at + n // 2, n - n // 2), (at, n // 2)]
        else:
            yield part


def map_batches(df: DataFrame, func: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 2000) -> DataFrame:
    """Apply ``func`` to slices of at most ``rows`` rows and ``SLICE_BYTES``; memory is bounded by one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                yield func(part)

    return df.mapInArrow(run, schema)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it while ``columns`` has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df``, at ``row_bytes`` a row, is below ``limit`` (counts no further than that)."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors lose nothing.

    The folder is the session's ``spark.checkpoint.dir``; see ``shared_folder``.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder, and read from there: for what a loop hands on.

    A checkpoint keeps the size that its plan was estimated at, and a join's is the product of its
    sides: over rounds of joins that number gets millions of digits. A table has its own size.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of this machine only where the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="tracewright-")
    return folder


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
