"""Registered queries over tasks: preparation, aggregates and intervals, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.scalars import default_capacity
from tracewright.operators import aggregates as A
from tracewright.operators import intervals as I
from tracewright.operators import prep as P
from tracewright.sources import tables as T
from tracewright.sources.tables import with_frames as frames

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    """Register a query under its own name, with SQL for the same rows."""

    def add(func):
        QUERIES[func.__name__] = func
        if sql:
            ORACLES[func.__name__] = sql
        return func

    return add


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return P.quantised(T.spans(spark, d))


Q = "CAST(floor((2 * ({0}) + 50000) / 100000.0) AS BIGINT) * 50000"
_TASKS = f""", tasks AS (SELECT * EXCLUDE (finish_us), {Q.format("ts_us")} AS start_us, {Q.format("ts_us + dur_us")} AS finish_us FROM spans),
    done AS (SELECT run_id, element_uid AS uid, arg_max(task_key, span_seq) AS build_key, arg_max(finish_us, span_seq) AS build_finish_us
             FROM tasks WHERE task_kind = 'BUILD' GROUP BY run_id, element_uid),
    ready AS (SELECT e.run_id, e.successor AS element_uid, max(d.build_finish_us) AS after_us FROM run_edges e
              JOIN done d ON d.run_id = e.run_id AND d.uid = e.predecessor WHERE e.dependency_type <> 'runtime' GROUP BY 1, 2),
    ready_tasks AS (SELECT t.*, CASE WHEN task_kind = 'BUILD' THEN coalesce(after_us, start_us) ELSE start_us END AS ready_us
              FROM tasks t LEFT JOIN ready r USING (run_id, element_uid))"""
TASKS = frames("spans", "run_edges") + _TASKS


@query(TASKS + " SELECT run_id, span_seq, start_us, finish_us FROM tasks")
def prep_quantize(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).select("run_id", "span_seq", "start_us", "finish_us")


@query(TASKS + " SELECT run_id, task_key, ready_us FROM ready_tasks")
def prep_ready_times(spark: SparkSession, d: str) -> DataFrame:
    return P.ready_times(_tasks(spark, d), T.run_edges(spark, d)).select("run_id", "task_key", "ready_us")


@query(TASKS + """ SELECT e.run_id, e.predecessor, t.task_key, t.start_us - d.build_finish_us AS gap_us FROM run_edges e
    JOIN done d ON d.run_id = e.run_id AND d.uid = e.predecessor
    JOIN tasks t ON t.run_id = e.run_id AND t.element_uid = e.successor AND t.task_kind = 'BUILD'
    WHERE e.dependency_type <> 'runtime' AND d.build_finish_us > t.start_us""")
def prep_ordering_violations(spark: SparkSession, d: str) -> DataFrame:
    return P.ordering_violations(_tasks(spark, d), T.run_edges(spark, d))


@query(TASKS + """ SELECT run_id, task_key, greatest(start_us, ready_us) AS start_us, finish_us FROM ready_tasks
    WHERE greatest(start_us, ready_us) <= finish_us""")
def prep_clamp(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = P.clamped(P.ready_times(_tasks(spark, d), T.run_edges(spark, d)))
    return kept.select("run_id", "task_key", "start_us", "finish_us")


@query(TASKS + """ SELECT run_id, task_key, 'clamp_negative_duration' AS type, finish_us - greatest(start_us, ready_us) AS gap_us
    FROM ready_tasks WHERE greatest(start_us, ready_us) > finish_us""")
def prep_clamp_violations(spark: SparkSession, d: str) -> DataFrame:
    return P.clamped(P.ready_times(_tasks(spark, d), T.run_edges(spark, d)))[1]


@query(TASKS + """, p AS (SELECT b.run_id, b.task_key, f.task_key AS pred_key FROM tasks b JOIN tasks f USING (run_id, element_uid)
        WHERE b.task_kind = 'BUILD' AND f.task_kind = 'FETCH'
        UNION ALL SELECT b.run_id, b.task_key, d.build_key FROM tasks b JOIN run_edges e ON e.run_id = b.run_id AND e.successor = b.element_uid
        JOIN done d ON d.run_id = e.run_id AND d.uid = e.predecessor WHERE b.task_kind = 'BUILD' AND e.dependency_type <> 'runtime')
    SELECT run_id, task_key, count(*) AS n_deps, min(pred_key) AS first_dep FROM p GROUP BY run_id, task_key""")
def prep_task_dependencies(spark: SparkSession, d: str) -> DataFrame:
    deps = P.task_dependencies(_tasks(spark, d), T.run_edges(spark, d))
    return deps.groupBy("run_id", "task_key").agg(F.count("*").alias("n_deps"), F.min("pred_key").alias("first_dep"))


@query(frames("spans") + " SELECT run_id, task_key, attempt, ts_us FROM spans")
def prep_attempts(spark: SparkSession, d: str) -> DataFrame:
    return T.spans(spark, d).select("run_id", "task_key", "attempt", "ts_us")


@query(frames("spans") + """ SELECT run_id, element_uid, task_kind, count(*) AS n_superseded, CAST(sum(dur_us) AS BIGINT) AS wasted_us FROM (
    SELECT *, max(attempt) OVER (PARTITION BY run_id, element_uid, task_kind) AS last FROM spans) WHERE attempt < last GROUP BY 1, 2, 3""")
def prep_retry(spark: SparkSession, d: str) -> DataFrame:
    return P.superseded(T.spans(spark, d)).groupBy("run_id", "element_uid", "task_kind").agg(F.count("*").alias("n_superseded"), F.sum("dur_us").alias("wasted_us"))


@query(frames("spans") + " SELECT run_id, task_key, lag(task_key) OVER (PARTITION BY run_id, element_uid, task_kind ORDER BY attempt) AS retry_of FROM spans")
def prep_retry_predecessor(spark: SparkSession, d: str) -> DataFrame:
    return P.retry_predecessors(T.spans(spark, d)).select("run_id", "task_key", "retry_of")


@query(frames("spans") + """, r AS (SELECT *, CASE task_kind WHEN 'TRACK' THEN 0 WHEN 'PULL' THEN 1 WHEN 'FETCH' THEN 1 WHEN 'BUILD' THEN 2 END AS k FROM spans)
    SELECT a.run_id, a.task_key, arg_max(b.task_key, (b.k, b.finish_us, b.task_key)) AS intra_pred FROM r a
    LEFT JOIN r b ON a.run_id = b.run_id AND a.element_uid = b.element_uid AND a.attempt = b.attempt AND b.k < a.k
    GROUP BY a.run_id, a.task_key""")
def prep_intra_predecessor(spark: SparkSession, d: str) -> DataFrame:
    return P.element_predecessors(T.spans(spark, d)).select("run_id", "task_key", "intra_pred")


@query(frames("spans") + " SELECT run_id, element_uid, max(dur_us) AS dur_max_us, CAST(sum(dur_us) AS BIGINT) AS dur_sum_us FROM spans GROUP BY 1, 2")
def agg_element_durations(spark: SparkSession, d: str) -> DataFrame:
    return A.element_durations(T.spans(spark, d))


@query(frames("spans") + """ SELECT run_id, element_uid, coalesce(max(dur_us) FILTER (task_kind = 'FETCH'), 0) AS head_us,
    coalesce(max(dur_us) FILTER (task_kind <> 'FETCH'), 0) AS work_us FROM spans GROUP BY 1, 2""")
def agg_stage_durations(spark: SparkSession, d: str) -> DataFrame:
    return A.stage_durations(T.spans(spark, d))


@query(frames("spans") + " SELECT run_id, min(ts_us) AS start_us, max(finish_us) AS end_us, max(finish_us) - min(ts_us) AS horizon_us FROM spans GROUP BY 1")
def agg_horizon(spark: SparkSession, d: str) -> DataFrame:
    return I.horizon(T.spans(spark, d))


@query(frames("spans") + " SELECT run_id, resource, CAST(sum(dur_us) AS BIGINT) AS work_us FROM spans GROUP BY 1, 2")
def agg_resource_work(spark: SparkSession, d: str) -> DataFrame:
    return A.resource_work(T.spans(spark, d))


@query(frames("spans") + """, w AS (SELECT run_id, resource, CAST(sum(dur_us) AS BIGINT) AS work_us FROM spans GROUP BY 1, 2)
    SELECT run_id, max(work_us // CASE resource WHEN 'PROCESS' THEN 4 WHEN 'DOWNLOAD' THEN 2 ELSE 1 END) FILTER (resource <> 'OTHER') AS capacity_bound_us,
    max(work_us) FILTER (resource = 'OTHER') AS serial_bound_us FROM w GROUP BY 1""")
def agg_capacity_bounds(spark: SparkSession, d: str) -> DataFrame:
    null = F.lit(None).cast("long")
    return A.capacity_bound(A.resource_work(T.spans(spark, d)), default_capacity(F.col("resource"), null, null), ("OTHER",))


@query(frames("run_elements") + """ SELECT element_kind AS kind, count(*) AS n, CAST(sum(dur_sum_us) AS BIGINT) AS total_us, round(avg(dur_sum_us), 3) AS mean_us
    FROM run_elements GROUP BY 1""")
def agg_kind_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.kind_summary(T.run_elements(spark, d)).withColumn("mean_us", F.round("mean_us", 3))


@query(frames("spans") + """ SELECT run_id, round(sum(dur_us) / ((max(finish_us) - min(ts_us)) * 4.0), 9) AS occupancy_ratio FROM spans GROUP BY 1""")
def agg_occupancy_ratio(spark: SparkSession, d: str) -> DataFrame:
    builders = 4
    total = F.sum("dur_us") / ((F.max("finish_us") - F.min("ts_us")) * F.lit(builders))
    return T.spans(spark, d).groupBy("run_id").agg(F.round(total, 9).alias("occupancy_ratio"))


@query(frames("spans") + """, g AS (SELECT run_id, element_uid, task_kind, count(*) AS n, avg(dur_us) AS mean_us, stddev_pop(dur_us) AS sd, list_sort(list(dur_us)) AS s
        FROM spans GROUP BY 1, 2, 3)
    SELECT run_id, element_uid, task_kind, n, round(mean_us, 3) AS mean_us, s[least(CAST(floor(n * 0.5) AS BIGINT) + 1, n)] AS p50_us,
    s[least(CAST(floor(n * 0.75) AS BIGINT) + 1, n)] AS p75_us, s[least(CAST(floor(n * 0.95) AS BIGINT) + 1, n)] AS p95_us,
    round(sd / mean_us, 6) AS cv, sd / mean_us > 0.3 AS unstable FROM g""")
def agg_variability(spark: SparkSession, d: str) -> DataFrame:
    return A.variability(T.spans(spark, d)).withColumns({"mean_us": F.round("mean_us", 3), "cv": F.round("cv", 6)})


@query(frames("spans") + """, m AS (SELECT run_id, count(*) AS n, median(dur_us) AS median, min(dur_us) AS lowest, max(dur_us) AS highest FROM spans GROUP BY 1),
    o AS (SELECT s.run_id, abs(dur_us - median) AS off FROM spans s JOIN m USING (run_id)),
    a AS (SELECT run_id, median(off) AS mad FROM o GROUP BY 1),
    x AS (SELECT o.run_id, count(*) FILTER (off > 3.0 * 1.4826 * mad) AS n_outside FROM o JOIN a USING (run_id) GROUP BY 1)
    SELECT run_id, n, median, lowest, highest, mad, n_outside, round(3.0 * 1.4826 * mad, 3) AS half_width FROM m JOIN a USING (run_id) JOIN x USING (run_id)""")
def agg_mad_band(spark: SparkSession, d: str) -> DataFrame:
    return A.mad_band(T.spans(spark, d), ["run_id"], "dur_us").withColumn("half_width", F.round("half_width", 3))


_MONTHS = "m AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(round(sum(o_totalprice)) AS BIGINT) AS total FROM orders GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month) AS pos FROM m)"


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """Runs over time: one total for each month of each order priority."""
    from pyspark.sql import Window

    m = T.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.trunc("o_orderdate", "month").alias("month")).agg(F.round(F.sum("o_totalprice")).cast("long").alias("total"))
    return m.withColumn("pos", F.row_number().over(Window.partitionBy("series").orderBy("month")))


@query(f"WITH {_MONTHS} SELECT series, round(regr_slope(total, pos), 4) AS slope FROM n GROUP BY 1")
def agg_slope(spark: SparkSession, d: str) -> DataFrame:
    return A.slope(monthly(spark, d), ["series"], "pos", "total").withColumn("slope", F.round("slope", 4))


@query(f"WITH {_MONTHS}, z AS (SELECT series, month, total, (total - avg(total) OVER w) / stddev_samp(total) OVER w AS z FROM n WINDOW w AS (PARTITION BY series)) SELECT series, month, total, round(z, 6) AS z FROM z WHERE abs(z) > 2")
def agg_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return A.anomalies(monthly(spark, d), ["series"], "total").select("series", "month", "total", F.round("z", 6).alias("z"))


@query(f"""WITH {_MONTHS}, b AS (SELECT x.series, x.pos, x.total, list(y.total) FILTER (y.total IS NOT NULL) AS h FROM n x LEFT JOIN n y ON x.series = y.series AND y.pos < x.pos GROUP BY 1, 2, 3),
    c AS (SELECT *, list_median(h) AS middle FROM b),
    e AS (SELECT *, greatest(3.0 * 1.4826 * list_median(list_transform(h, lambda v: abs(v - middle))), 0.01 * middle) AS half FROM c)
    SELECT series, pos::INT AS pos, total, CASE WHEN h IS NULL OR len(h) < 3 THEN 'too-few' WHEN total > middle + half THEN 'above' WHEN total < middle - half THEN 'below' ELSE 'inside' END AS verdict FROM e""")
def agg_trailing_band(spark: SparkSession, d: str) -> DataFrame:
    return A.trailing_band(monthly(spark, d), ["series"], "pos", "total").select("series", "pos", "total", "verdict")


@query(f"""WITH {_MONTHS}, b AS (SELECT series, pos, total, coalesce(list(total) FILTER (total IS NOT NULL) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []) AS h FROM n),
    c AS (SELECT *, list_median(h) AS middle FROM b),
    e AS (SELECT *, greatest(3.0 * 1.4826 * list_median(list_transform(h, lambda v: abs(v - middle))), 0.01 * middle) AS half FROM c)
    SELECT series, pos::INT AS pos, total, CASE WHEN len(h) < 3 THEN 'too-few' WHEN total > middle + half THEN 'above' WHEN total < middle - half THEN 'below' ELSE 'inside' END AS verdict FROM e""")
def agg_rolling_band(spark: SparkSession, d: str) -> DataFrame:
    """Each month against the band of the eight before it."""
    return A.rolling_band(monthly(spark, d), ["series"], "pos", "total", 8).select("series", "pos", "total", "verdict")


@query("WITH q AS (SELECT o_orderpriority AS run_id, count(*) FILTER (o_orderstatus = 'F') AS processed, count(*) FILTER (o_orderstatus <> 'F') AS skipped FROM orders GROUP BY 1) SELECT run_id, processed AS built, skipped AS cached, round(skipped / (processed + skipped), 9) AS hit_ratio FROM q")
def agg_cache_accounting(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("o_orderstatus") == "F"
    q = T.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run_id")).agg(F.count_if(f).alias("processed"), F.count_if(~f).alias("skipped"))
    return A.cache_accounting(q).withColumn("hit_ratio", F.round("hit_ratio", 9))


_SLICES = """, b AS (SELECT run_id, ts_us AS t, 1 AS d FROM spans WHERE dur_us > 0 UNION ALL SELECT run_id, finish_us, -1 FROM spans WHERE dur_us > 0),
    st AS (SELECT run_id, t, sum(d) AS d FROM b GROUP BY 1, 2),
    sw AS (SELECT run_id, t AS start_us, lead(t) OVER w AS end_us, CAST(sum(d) OVER (PARTITION BY run_id ORDER BY t) AS BIGINT) AS n_active FROM st WINDOW w AS (PARTITION BY run_id ORDER BY t)),
    sl AS (SELECT * FROM sw WHERE n_active > 0 AND end_us IS NOT NULL)"""
SLICES = frames("spans") + _SLICES


@query(SLICES + " SELECT run_id, start_us, end_us, n_active FROM sl")
def iv_segments(spark: SparkSession, d: str) -> DataFrame:
    return I.slices(T.spans(spark, d), bucket_us=_DAY)


@query(SLICES + """ SELECT run_id, horizon_us, CAST(sum(end_us - start_us) AS BIGINT) AS busy_us, CAST(sum((end_us - start_us) * n_active) AS BIGINT) AS area_us, max(n_active) AS peak,
    CAST(horizon_us - sum(end_us - start_us) AS BIGINT) AS idle_us FROM sl JOIN (SELECT run_id, max(finish_us) - min(ts_us) AS horizon_us FROM spans GROUP BY 1) USING (run_id) GROUP BY run_id, horizon_us""")
def iv_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return I.occupancy(T.spans(spark, d))


@query(frames("spans") + """, b AS (SELECT run_id, resource, ts_us AS t, 1 AS d FROM spans WHERE dur_us > 0 UNION ALL SELECT run_id, resource, finish_us, -1 FROM spans WHERE dur_us > 0),
    st AS (SELECT run_id, resource, t, sum(d) AS d FROM b GROUP BY 1, 2, 3),
    sw AS (SELECT run_id, resource, lead(t) OVER w - t AS width, CAST(sum(d) OVER (PARTITION BY run_id, resource ORDER BY t) AS BIGINT) AS n FROM st WINDOW w AS (PARTITION BY run_id, resource ORDER BY t))
    SELECT run_id, resource, CAST(sum(width * n) AS BIGINT) AS area_us, max(n) AS peak FROM sw WHERE n > 0 AND width IS NOT NULL GROUP BY 1, 2""")
def iv_resource_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return I.resource_occupancy(T.spans(spark, d))


@query(SLICES + """ SELECT s.run_id, s.task_key, round(sum((l.end_us - l.start_us) / l.n_active), 3) AS share_us FROM sl l
    JOIN spans s ON s.run_id = l.run_id AND s.ts_us < l.end_us AND l.start_us < s.finish_us GROUP BY 1, 2""")
def iv_wallclock_share(spark: SparkSession, d: str) -> DataFrame:
    return I.wall_clock_shares(T.spans(spark, d)).withColumn("share_us", F.round("share_us", 3))


@query(TASKS + """, b AS (SELECT run_id, ready_us AS t, 1 AS d FROM ready_tasks UNION ALL SELECT run_id, start_us, -1 FROM ready_tasks),
    st AS (SELECT run_id, t, sum(d) AS d FROM b GROUP BY 1, 2)
    SELECT run_id, t AS at_us, CAST(sum(d) OVER (PARTITION BY run_id ORDER BY t) AS BIGINT) AS depth FROM st""")
def iv_ready_depth(spark: SparkSession, d: str) -> DataFrame:
    return I.queue_depth(P.ready_times(_tasks(spark, d), T.run_edges(spark, d)))


@query(frames("spans") + """ SELECT a.run_id, a.task_key, b.task_key AS phase_key, least(a.finish_us, b.finish_us) - greatest(a.ts_us, b.ts_us) AS overlap_us
    FROM spans a JOIN spans b ON a.run_id = b.run_id AND a.task_kind = 'BUILD' AND b.task_kind = 'TRACK' AND a.ts_us < b.finish_us AND b.ts_us < a.finish_us""")
def iv_phase_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = T.spans(spark, d)
    a = s.filter("task_kind = 'BUILD'").select("run_id", "task_key", F.col("ts_us").alias("a0"), F.col("finish_us").alias("a1"))
    b = s.filter("task_kind = 'TRACK'").select("run_id", F.col("task_key").alias("phase_key"), F.col("ts_us").alias("b0"), F.col("finish_us").alias("b1"))
    return I.overlap_join(a, b, ["run_id"], ("a0", "a1"), ("b0", "b1"), 600_000_000).select("run_id", "task_key", "phase_key", (F.least("a1", "b1") - F.greatest("a0", "b0")).alias("overlap_us"))


@query(frames("spans") + """, x AS (SELECT run_id, min(ts_us) FILTER (task_kind = 'BUILD') AS first_build_us, max(finish_us) FILTER (task_kind = 'FETCH') AS last_fetch_us FROM spans GROUP BY 1)
    SELECT run_id, first_build_us, last_fetch_us, greatest(0, last_fetch_us - first_build_us) AS overlap_us FROM x""")
def iv_fetch_build_overlap(spark: SparkSession, d: str) -> DataFrame:
    return I.fetch_build_overlap(T.spans(spark, d))


_WAIT, _DAY = 1_800_000_000, 86_400_000_000


@query(frames("spans") + f""", w AS (SELECT run_id, resource, task_key, ts_us - {_WAIT} AS w0, ts_us AS w1 FROM spans),
    h AS (SELECT w.run_id, w.resource, w.task_key, greatest(w0, s.ts_us) AS a, least(w1, s.finish_us) AS z FROM w JOIN spans s ON s.run_id = w.run_id AND s.resource = w.resource
          AND s.task_key <> w.task_key AND s.ts_us < w.w1 AND w.w0 < s.finish_us WHERE least(w1, s.finish_us) > greatest(w0, s.ts_us)),
    b AS (SELECT run_id, resource, task_key, a AS t, 1 AS d FROM h UNION ALL SELECT run_id, resource, task_key, z, -1 FROM h),
    st AS (SELECT run_id, resource, task_key, t, sum(d) AS d FROM b GROUP BY 1, 2, 3, 4),
    sw AS (SELECT run_id, resource, task_key, lead(t) OVER w2 - t AS width, sum(d) OVER (PARTITION BY run_id, resource, task_key ORDER BY t) AS n FROM st WINDOW w2 AS (PARTITION BY run_id, resource, task_key ORDER BY t))
    SELECT run_id, resource, task_key, CAST(sum(width) AS BIGINT) AS saturated_us FROM sw WHERE n >= 1 AND width IS NOT NULL GROUP BY 1, 2, 3""")
def iv_saturation(spark: SparkSession, d: str) -> DataFrame:
    s = T.spans(spark, d).withColumn("resource", F.col("resources")[0])
    waits = s.select("run_id", "resource", "task_key", (F.col("ts_us") - _WAIT).alias("w0"), F.col("ts_us").alias("w1"))
    holders = s.select("run_id", "resource", F.col("task_key").alias("holder_key"), F.col("ts_us").alias("h0"), F.col("finish_us").alias("h1"))
    return I.saturation(waits, holders, F.lit(1), 1_800_000_000)


_ISLANDS = """, f AS (SELECT *, CASE WHEN ts_us > max(finish_us) OVER (PARTITION BY run_id ORDER BY ts_us, finish_us, span_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS o FROM spans),
    g AS (SELECT *, sum(o) OVER (PARTITION BY run_id ORDER BY ts_us, finish_us, span_seq) AS island FROM f),
    m AS (SELECT run_id, min(ts_us) AS start_us, max(finish_us) AS end_us, count(*) AS n FROM g GROUP BY run_id, island)"""


@query(frames("spans") + _ISLANDS + " SELECT run_id, start_us, end_us, n FROM m")
def iv_islands(spark: SparkSession, d: str) -> DataFrame:
    return I.merged(T.spans(spark, d))


@query(frames("spans") + _ISLANDS + """ SELECT * FROM (SELECT run_id, end_us AS start_us, lead(start_us) OVER (PARTITION BY run_id ORDER BY m.start_us) AS end_us FROM m) WHERE end_us IS NOT NULL""")
def iv_gaps(spark: SparkSession, d: str) -> DataFrame:
    return I.gaps(T.spans(spark, d))


@query(frames("spans") + _ISLANDS + """ SELECT run_id, start_us, end_us, 'BUSY' AS category FROM m UNION ALL
    SELECT * FROM (SELECT run_id, end_us, lead(m.start_us) OVER (PARTITION BY run_id ORDER BY m.start_us) AS e, 'IDLE' FROM m) WHERE e IS NOT NULL""")
def iv_timeline(spark: SparkSession, d: str) -> DataFrame:
    return I.filled_timeline(T.spans(spark, d))
