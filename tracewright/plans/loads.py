"""Registered queries over process logs read once, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import correlate as R
from tracewright.operators import graph as G
from tracewright.operators import loading as L
from tracewright.operators import processes as X
from tracewright.plans.graphs import _WITHOUT
from tracewright.plans.logs import PROCS, _procs
from tracewright.sources import tables as T
from tracewright.sources.logs import process_events

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(func):
        QUERIES[func.__name__] = func
        if sql:
            ORACLES[func.__name__] = sql
        return func

    return add


def _load(spark: SparkSession, d: str) -> DataFrame:
    """All sums over the paired processes; each third pid was seen by the second stream alone."""
    procs = X.paired(process_events(T.process_lines(spark, d)))
    return L.process_load(procs.withColumn("coverage", F.when(F.col("pid") % 3 == 0, "spine").otherwise("both")))


_PAIRED = PROCS + """, ev AS (SELECT invocation, pid, ppid, element, cmd, binary_name, start_us AS ts, 2 * event_id AS ln, 1 AS s, NULL::BIGINT AS cpu_us, NULL::BIGINT AS rss_kb FROM procs
        UNION ALL SELECT invocation, pid, ppid, element, cmd, binary_name, end_us, 2 * event_id + 1, 0, cpu_us, rss_kb FROM procs WHERE closed),
    la AS (SELECT *, lag(s) OVER w AS ps, lag(ppid) OVER w AS pp FROM ev WINDOW w AS (PARTITION BY invocation, pid ORDER BY ts, ln)),
    fl AS (SELECT *, CASE WHEN s = 1 AND (ps IS NULL OR ps = 0 OR pp <> ppid) THEN 1 ELSE 0 END AS o FROM la WHERE s = 1 OR coalesce(ps, 0) = 1),
    nu AS (SELECT *, sum(o) OVER (PARTITION BY invocation, pid ORDER BY ts, ln) AS session FROM fl),
    pr AS (SELECT invocation, pid, session, arg_min(element, (ts, ln)) AS element, arg_max(binary_name, (ts, ln)) FILTER (s = 1) AS binary_name, arg_max(cmd, (ts, ln)) FILTER (s = 1) AS cmd,
        min(ts) FILTER (s = 1) AS a, max(ts) FILTER (s = 0) AS z, max(cpu_us) AS cpu, max(rss_kb) AS rss, pid % 3 = 0 AS spine FROM nu GROUP BY invocation, pid, session)"""
_SUMS = """count(*) AS n, count(*) FILTER (z IS NULL) AS n_open, count(cpu) AS n_measured, CAST(sum(cpu) AS BIGINT) AS cpu_us, CAST(sum(z - a) AS BIGINT) AS wall_us, min(a) AS start_us, max(z) AS end_us, max(coalesce(z, a)) AS last_us,
    max(rss) AS peak_kb, max(CASE WHEN binary_name = 'make' THEN 4 END)::BIGINT AS requested_jobs, count(*) AS n_named, count(*) FILTER (spine) AS n_spine, count(*) AS n_streams"""
_ELEMENTS = f", el AS (SELECT element, {_SUMS} FROM pr GROUP BY 1)"


@query(_PAIRED + f""" SELECT CASE grouping_id(element, invocation, binary_name) WHEN 3 THEN 'element' WHEN 2 THEN 'element and binary' WHEN 5 THEN 'invocation' WHEN 6 THEN 'binary' ELSE 'all' END AS grain,
    element, invocation, binary_name AS "binary", {_SUMS} FROM pr GROUP BY GROUPING SETS ((element), (element, binary_name), (invocation), (binary_name), ())""")
def p2_load(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d)


@query(_PAIRED + _ELEMENTS + """ SELECT element, cpu_us, n_measured AS measured, n - n_measured AS unmeasured, end_us - start_us AS span_us, CASE WHEN end_us > start_us THEN round(cpu_us / (end_us - start_us), 9) END AS cpu_per_wall,
    peak_kb, requested_jobs, round((n - n_spine) / n, 9) AS opens_coverage FROM el""")
def p2_element_load(spark: SparkSession, d: str) -> DataFrame:
    return L.element_load(_load(spark, d)).withColumns({c: F.round(c, 9) for c in ("cpu_per_wall", "opens_coverage")})


@query(_PAIRED + " SELECT invocation, max(z) - min(a) AS duration_us FROM pr WHERE invocation IS NOT NULL GROUP BY 1 HAVING max(z) >= min(a)")
def p2_sandbox_durations(spark: SparkSession, d: str) -> DataFrame:
    return L.sandbox_durations(_load(spark, d))


@query(_PAIRED + """ SELECT 'binary' AS "by", binary_name AS name, count(*) AS n, round(count(*) / (SELECT count(*) FROM pr), 9) AS share FROM pr GROUP BY 2
    UNION ALL SELECT 'element', element, count(*), round(count(*) / (SELECT count(*) FROM pr), 9) FROM pr GROUP BY 2""")
def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.counts(_load(spark, d)).withColumn("share", F.round("share", 9))


@query(_PAIRED + " SELECT count(*) AS n, count(*) FILTER (z IS NULL) AS n_open, count(cpu) AS n_measured, CAST(sum(cpu) AS BIGINT) AS cpu_us, max(coalesce(z, a)) - min(a) AS wall_span_us, 1.0::DOUBLE AS recognised, count(*) FILTER (spine) AS n_spine FROM pr")
def p2_log_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.log_summary(_load(spark, d))


_EVIDENCE = _WITHOUT.format("SELECT run_id, uid, uid FROM tp WHERE nth <= 8") + ", " + T.SQL["procs"] + """, pc AS (SELECT 'u' || substr(element, 2, length(element) - 5) AS uid, *, CASE WHEN closed THEN end_us END AS z FROM procs),
    sv AS (SELECT uid, total - length AS saving, total FROM tp JOIN lz ON lz.run_id = tp.run_id AND scenario = uid WHERE nth <= 8),
    ow AS (SELECT uid, sum(cpu_us) AS cpu, CASE WHEN max(z) > min(start_us) THEN sum(cpu_us) / (max(z) - min(start_us)) END AS cpw, max(CASE WHEN binary_name = 'make' THEN 4 END) AS jobs, max(rss_kb) AS peak FROM pc GROUP BY 1),
    bn AS (SELECT uid, max(cpu) AS most, max(CASE WHEN n = 1 THEN wall END) AS single FROM (SELECT uid, binary_name, sum(cpu_us) AS cpu, count(*) AS n, sum(z - start_us) AS wall FROM pc GROUP BY 1, 2) GROUP BY 1),
    sg AS (SELECT uid, regexp_replace(regexp_replace(cmd, '/buildstream/demo/e[0-9]+\\.bst/', '<element-root>/'), '/tmp/cc[0-9]+x\\.s', '/tmp/<tmp>') AS signature, sum(coalesce(z - start_us, 0)) AS wall FROM pc GROUP BY 1, 2),
    rd AS (SELECT uid, max(worst) AS redundant FROM sg JOIN (SELECT signature, max(wall) AS worst FROM sg GROUP BY 1 HAVING count(*) > 1) USING (signature) GROUP BY 1),
    un AS (SELECT successor AS uid, count(*) AS n FROM run_edges WHERE CAST(substr(successor, 2) AS BIGINT) % 3 <> 0 GROUP BY 1),
    ga AS (SELECT sv.uid, saving, cpw, jobs, peak, most / cpu AS top, single, redundant, greatest(1000000, 0.01 * saving) AS weight FROM sv LEFT JOIN ow USING (uid) LEFT JOIN bn USING (uid) LEFT JOIN rd USING (uid)
        WHERE saving / total >= 0.05 OR (saving / total >= 0.01 AND cpw < 1.25))"""


@query(_EVIDENCE + """ SELECT uid, CASE WHEN cpw >= 1.25 THEN 'already-compute-bound' WHEN jobs = 1 THEN 'pinned-to-one-job' WHEN jobs > 1 THEN 'underachieved-requested-jobs' ELSE 'waiting-not-computing' END AS evidence, 1 AS rank FROM ga WHERE cpw IS NOT NULL
    UNION ALL SELECT uid, 'cpu-concentration', 2 FROM ga WHERE top >= 0.5 UNION ALL SELECT uid, 'serialization-point', 3 FROM ga WHERE single >= weight UNION ALL SELECT uid, 'peak-memory', 4 FROM ga WHERE peak >= 1048576
    UNION ALL SELECT uid, 'redundant-operation', 5 FROM ga WHERE redundant >= weight UNION ALL SELECT uid, 'declared-not-used', 6 FROM un""")
def cor_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What speaks for looking at an element: its saving from the graph of its run, its figures from its processes."""
    nodes, edges = T.run_elements(spark, d), T.run_edges(spark, d)
    total = G.critical_paths(nodes, edges).groupBy("run_id").agg(F.max("length_us").alias("total_us"))
    savings = G.realizable_savings(nodes, edges, 8).join(total, "run_id")
    procs = _procs(spark, d).withColumn("uid", F.concat(F.lit("u"), F.regexp_extract("element", r"^e(\d+)", 1)))
    load = L.process_load(procs.drop("element").withColumn("element", F.col("uid")))
    unused = edges.filter(F.substring("successor", 2, 20).cast("long") % 3 != 0).groupBy(F.col("successor").alias("uid")).agg(F.count("*").alias("n_unused"))
    return R.recommendations(R.element_figures(savings, load, R.worst_redundancy(procs), unused))
