"""Registered queries over build logs, with and without time stamps, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources import logs as L
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


_LOG = frames("log_tasks")
# what is closed in the order of lines, stray ends included; each end's begin waits for all ends before it
_CLOCK = """, cl AS MATERIALIZED (SELECT run_id, event_id, line_no, dur, part, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS k FROM (
        SELECT run_id, event_id, line_no, CASE WHEN part = 3 THEN dur ELSE 0 END AS dur, part FROM log_lines WHERE part IN (3, 4))),
    ev AS (SELECT run_id, line_no, sum(CASE WHEN part IN (3, 4) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM log_lines),
    kn AS MATERIALIZED (SELECT c.*, coalesce(ev.seen, 0) AS seen FROM cl c JOIN log_tasks t ON t.run_id = c.run_id AND t.event_id = c.event_id JOIN ev ON ev.run_id = c.run_id AND ev.line_no = CASE WHEN c.part = 3 THEN t.first_line ELSE c.line_no END),
    rw AS (SELECT run_id, 0::BIGINT AS k, []::BIGINT[] AS fs FROM (SELECT DISTINCT run_id FROM log_lines)
        UNION ALL SELECT r.run_id, n.k, list_append(r.fs, greatest(began, coalesce(list_max(r.fs[1:n.seen]), 0)) + n.dur) FROM rw r JOIN kn n ON n.run_id = r.run_id AND n.k = r.k + 1, (SELECT 1000000::BIGINT AS began)),
    fn AS (SELECT run_id, arg_max(fs, k) AS fs FROM rw GROUP BY 1),
    bg AS (SELECT t.*, coalesce(ev.seen, 0) AS seen, cl.k FROM log_tasks t JOIN ev ON ev.run_id = t.run_id AND ev.line_no = t.first_line LEFT JOIN cl ON cl.run_id = t.run_id AND cl.event_id = t.event_id AND cl.part = 3)"""


@query(_LOG + """ SELECT path, task_hash, element, action, 'Build' AS phase, ts_us, coalesce(close_us, max(last) OVER (PARTITION BY path)) AS finish_us, CASE WHEN close_us IS NOT NULL THEN 'SUCCESS' END AS status, close_us IS NULL AS forced
    FROM log_tasks JOIN (SELECT run_id, max(moment) AS last FROM log_lines GROUP BY 1) USING (run_id)""")
def log_wrapped_spans(spark: SparkSession, d: str) -> DataFrame:
    """Task spans of stamped build logs; tasks that are open at the end are closed there."""
    return L.wrapped_log_spans(L.build_log_events(T.build_log_lines(spark, d, True)))


@query(_LOG + _CLOCK + """, rs AS (SELECT path, task_hash, element, action, greatest(1000000, coalesce(list_max(fs[1:seen]), 0)) AS ts_us, fs[k] AS close_us, greatest(1000000, coalesce(list_max(fs), 0)) AS last FROM bg JOIN fn USING (run_id))
    SELECT path, task_hash, element, action, 'Build' AS phase, ts_us, coalesce(close_us, last) AS finish_us, CASE WHEN close_us IS NOT NULL THEN 'SUCCESS' END AS status, close_us IS NULL AS forced FROM rs""")
def log_raw_spans(spark: SparkSession, d: str) -> DataFrame:
    """Task spans of the same logs without stamps, on a clock rebuilt from elapsed times and the order of lines."""
    events = L.build_log_events(T.build_log_lines(spark, d, False))
    return L.raw_log_spans(events, events.select("path").distinct().withColumn("raw_start_us", F.lit(1_000_000).cast("long")))


@query(_LOG + """, x AS (SELECT path, element, action, ts_us, coalesce(close_us, max(last) OVER (PARTITION BY path)) AS finish_us FROM log_tasks JOIN (SELECT run_id, max(moment) AS last FROM log_lines GROUP BY 1) USING (run_id))
    SELECT path, element, min(ts_us) AS start_us, max(finish_us) AS end_us FROM x WHERE action = 'build' GROUP BY 1, 2""")
def log_element_builds(spark: SparkSession, d: str) -> DataFrame:
    """From the first begin to the last end of each element's builds."""
    return L.element_build_spans(L.wrapped_log_spans(L.build_log_events(T.build_log_lines(spark, d, True))))
