"""Registered queries over run directories written and read back, and traces merged on one clock, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.graph import shared_folder
from tracewright.plans.logs import _procs
from tracewright.sources import run_store as S
from tracewright.sources import tables as T
from tracewright.sources.tables import with_frames as frames

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(func):
        QUERIES[func.__name__] = func
        if sql:
            ORACLES[func.__name__] = sql
        return func

    return add


def _written(spark: SparkSession, d: str) -> str:
    """All runs of the tables as run directories in the shared folder; every fourth run has no context."""
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    spans = T.spans(spark, d).withColumns({"primary_resource": F.col("resources")[0], "status": F.lit("SUCCESS")})
    ends = spans.groupBy("run_id").agg(F.min("ts_us").alias("wall_start_us"), F.max("finish_us").alias("wall_end_us"))
    contexts = ends.filter("run_id % 4 <> 3").withColumn("max_jobs", F.lit(8).cast("long"))
    phases = spans.filter("task_kind = 'OTHER'").select("run_id", F.col("task_key").alias("name"), "ts_us", "dur_us")
    elements = T.run_elements(spark, d).select("run_id", "uid", "requested_target", "element_kind")
    S.write_runs(path, contexts, elements, T.run_edges(spark, d), spans, phases)
    return path


@query(frames("spans") + " SELECT CAST(run_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY run_id ORDER BY span_seq) - 1 AS nth, task_key, ts_us, dur_us, resource FROM spans")
def rd_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of all run directories, in the order of their files."""
    read = S.read_section(spark, _written(spark, d), S.TRACE, "spans", "task_key string, ts_us long, dur_us long, resources array<string>")
    return read.select("run_id", "nth", "task_key", "ts_us", "dur_us", F.col("resources")[0].alias("resource"))


@query(frames("spans", "run_edges") + " SELECT CAST(run_id AS VARCHAR) AS run_id, predecessor, successor, dependency_type FROM run_edges")
def rd_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of all run directories."""
    return S.read_section(spark, _written(spark, d), S.GRAPH, "dependencies", "predecessor string, successor string, dependency_type string").drop("nth")


@query(frames("spans") + " SELECT DISTINCT CAST(run_id AS VARCHAR) AS stamp, CASE WHEN run_id % 4 <> 3 THEN 3 ELSE 2 END::BIGINT AS n_files, run_id % 4 <> 3 AS complete FROM spans")
def rd_listing(spark: SparkSession, d: str) -> DataFrame:
    """What the store holds, and which runs are complete."""
    return S.listing(spark, _written(spark, d)).select("stamp", "n_files", "complete")


_BOTH = frames("spans", "procs") + f""", p1 AS (SELECT run_id, element_uid AS element, task_key AS name, ts_us AS start_us, dur_us FROM spans),
    p2 AS (SELECT CAST(substr(element, 2, length(element) - 5) AS BIGINT) // {T.RUN_ELEMENTS} AS run_id, 'u' || substr(element, 2, length(element) - 5) AS element, binary_name AS name, start_us - 5000000 AS start_us, CASE WHEN closed THEN end_us - 5000000 END AS end_us FROM procs WHERE event_id % 2 = 0),
    bo AS (SELECT a.run_id, a.element, a, d, b FROM (SELECT run_id, element, min(start_us) AS a, max(dur_us) AS d FROM p1 GROUP BY 1, 2) a JOIN (SELECT run_id, element, min(start_us) AS b FROM p2 GROUP BY 1, 2) b ON b.run_id = a.run_id AND b.element = a.element),
    sh AS (SELECT run_id, arg_min(a - b, (-d, element)) AS offset_us FROM bo GROUP BY 1), la AS (SELECT run_id, element, row_number() OVER (PARTITION BY run_id ORDER BY element) + 1 AS pid FROM (SELECT DISTINCT run_id, element FROM p2))"""


@query(_BOTH + """ SELECT CAST(run_id AS VARCHAR) AS run_id, start_us AS ts, 'X' AS ph, name, dur_us AS dur, 1 AS pid, element FROM p1
    UNION ALL SELECT CAST(p2.run_id AS VARCHAR), start_us + offset_us, CASE WHEN end_us IS NULL THEN 'i' ELSE 'X' END, name, end_us - start_us, la.pid, p2.element FROM p2 JOIN sh ON sh.run_id = p2.run_id JOIN la ON la.run_id = p2.run_id AND la.element = p2.element""")
def rd_merged_trace(spark: SparkSession, d: str) -> DataFrame:
    """Tasks and every second process, whose clock is five seconds behind, in one trace a run; written and read back."""
    spans = T.spans(spark, d).select("run_id", F.col("element_uid").alias("element"), F.col("task_key").alias("name"), F.col("ts_us").alias("start_us"), "dur_us")
    user = F.regexp_extract("element", r"^e(\d+)", 1).cast("long")
    late = F.lit(5_000_000)
    procs = _procs(spark, d).filter("n % 2 = 0").select(F.floor(user / T.RUN_ELEMENTS).alias("run_id"), F.concat(F.lit("u"), user).alias("element"), F.substring_index(F.substring_index("cmd", " ", 1), "/", -1).alias("name"), (F.col("start_us") - late).alias("start_us"), (F.col("end_us") - late).alias("end_us"))
    path = f"{shared_folder(spark)}/traces-{uuid.uuid4().hex}"
    S.write_rows([S.rows(S.merged_trace(spans, procs), S.MERGED, "traceEvents", ["ts", "pid"])], path)
    return S.read_section(spark, path, S.MERGED, "traceEvents", "ts long, ph string, name string, dur long, pid long, element string").drop("nth")
