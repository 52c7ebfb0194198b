"""Registered queries over process logs, element logs, runs compared, both planes joined, and scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import aggregates as A
from tracewright.operators import compare as C
from tracewright.operators import correlate as R
from tracewright.operators import element_logs as E
from tracewright.operators import processes as X
from tracewright.sources import tables as T
from tracewright.sources.logs import process_events
from tracewright.sources.tables import with_frames as frames

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(func):
        QUERIES[func.__name__] = func
        if sql:
            ORACLES[func.__name__] = sql
        return func

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return process_events(T.process_lines(spark, d))


def _procs(spark: SparkSession, d: str) -> DataFrame:
    """One record per START line with the END line of the same process, straight from the parsed log."""
    e = _events(spark, d)
    starts = e.filter("event = 'START'").select(F.expr("line_no div 2").alias("n"), "element", "invocation", F.coalesce("invocation", "element").alias("scope"), "pid", "ppid", "cmd", F.col("ts_us").alias("start_us"))
    ends = e.filter("event = 'END'").select(F.expr("line_no div 2").alias("n"), F.col("ts_us").alias("end_us"), "cpu_us", "rss_kb")
    return starts.join(ends, "n", "left")


PROCS = frames("procs")


@query(PROCS + """ SELECT 2 * event_id AS line_no, 'START' AS event, pid, ppid, start_us AS ts_us, element, invocation, NULL::BIGINT AS cpu_us, NULL::BIGINT AS rss_kb, cmd FROM procs
    UNION ALL SELECT 2 * event_id + 1, 'END', pid, ppid, end_us, element, invocation, cpu_us, rss_kb, cmd FROM procs WHERE closed""")
def p2_parse(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("line_no", "event", "pid", "ppid", "ts_us", "element", "invocation", "cpu_us", "rss_kb", "cmd")


@query(PROCS + """, ev AS (SELECT invocation AS scope, pid, ppid, start_us AS ts, 2 * event_id AS ln, 1 AS s FROM procs UNION ALL SELECT invocation, pid, ppid, end_us, 2 * event_id + 1, 0 FROM procs WHERE closed),
    l AS (SELECT *, lag(s) OVER w AS ps, lag(ppid) OVER w AS pp FROM ev WINDOW w AS (PARTITION BY scope, pid ORDER BY ts, ln)),
    f AS (SELECT *, CASE WHEN s = 1 AND (ps IS NULL OR ps = 0 OR pp <> ppid) THEN 1 ELSE 0 END AS o FROM l WHERE s = 1 OR coalesce(ps, 0) = 1),
    g AS (SELECT *, sum(o) OVER (PARTITION BY scope, pid ORDER BY ts, ln) AS session FROM f)
    SELECT scope, pid, CAST(session AS BIGINT) AS session, min(ts) FILTER (s = 1) AS start_us, max(ts) FILTER (s = 0) AS end_us, count(*) FILTER (s = 1) AS exec_chain FROM g GROUP BY 1, 2, 3""")
def p2_pair(spark: SparkSession, d: str) -> DataFrame:
    return X.paired(_events(spark, d)).select("scope", "pid", F.col("session").cast("long"), "start_us", "end_us", "exec_chain")


@query(PROCS + """, ev AS (SELECT invocation AS scope, pid, start_us AS ts, 2 * event_id AS ln, 1 AS s FROM procs WHERE event_id % 29 <> 0 UNION ALL SELECT invocation, pid, end_us, 2 * event_id + 1, 0 FROM procs WHERE closed),
    l AS (SELECT *, lag(s) OVER (PARTITION BY scope, pid ORDER BY ts, ln) AS ps FROM ev) SELECT scope, count(*) AS n_unmatched FROM l WHERE s = 0 AND coalesce(ps, 0) = 0 GROUP BY 1""")
def p2_unmatched_ends(spark: SparkSession, d: str) -> DataFrame:
    return X.unmatched_ends(_events(spark, d).filter("event <> 'START' OR line_no % 58 <> 0"))


@query()
def p2_merge_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Two streams of one log, the second half a second late and without every fifth record."""
    p = _procs(spark, d)
    hook = p.filter("n % 7 <> 0").select("scope", "pid", "start_us", "cpu_us")
    spine = p.filter("n % 5 <> 0").select("scope", "pid", (F.col("start_us") + 500_000).alias("start_us"), F.lit(1000).cast("long").alias("cpu_us"))
    return X.merged_streams(hook, spine)


@query(frames("spans", "procs") + """, i AS (SELECT invocation || '-' || event_id AS invocation, start_us AS at_us FROM procs), b AS (SELECT element_uid AS element, ts_us AS b0, finish_us AS b1 FROM spans WHERE task_kind = 'BUILD'),
    n AS (SELECT invocation, count(*) AS n, min(element) AS element FROM i JOIN b ON at_us >= b0 AND at_us < b1 GROUP BY 1)
    SELECT i.invocation, CASE WHEN n = 1 THEN element END AS element, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS verdict FROM i LEFT JOIN n USING (invocation)""")
def p2_point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    at = _procs(spark, d).select(F.concat_ws("-", "invocation", "n").alias("invocation"), F.col("start_us").alias("at_us"))
    builds = T.spans(spark, d).filter("task_kind = 'BUILD'").select(F.col("element_uid").alias("element"), F.col("ts_us").alias("b0"), F.col("finish_us").alias("b1"))
    return X.correlated(at, builds)


@query(PROCS + """ SELECT element, CAST(sum(cpu_us) AS BIGINT) AS cpu_us, count(cpu_us) AS measured, count(*) - count(cpu_us) AS unmeasured,
    max(end_us) FILTER (closed) - min(start_us) AS span_us, round(sum(cpu_us) / (max(end_us) FILTER (closed) - min(start_us)), 9) AS cpu_per_wall FROM procs GROUP BY 1""")
def p2_cpu(spark: SparkSession, d: str) -> DataFrame:
    return X.cpu_times(_procs(spark, d)).withColumn("cpu_per_wall", F.round("cpu_per_wall", 9))


@query(PROCS + " SELECT element, max(rss_kb) AS peak_kb FROM procs GROUP BY 1")
def p2_rss(spark: SparkSession, d: str) -> DataFrame:
    return X.peak_memory(_procs(spark, d)).select("element", "peak_kb")


@query(PROCS + """, g AS (SELECT element, binary_name AS "binary", count(*) AS n, coalesce(CAST(sum(cpu_us) AS BIGINT), 0) AS cpu_us FROM procs GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY element ORDER BY cpu_us DESC, "binary") AS nth FROM g)
    SELECT element, "binary" AS binary_name, n, cpu_us, CASE WHEN "binary" = 'ld' THEN 'work' ELSE 'orchestration' END AS class, nth::INT AS rank FROM r WHERE nth <= 3""")
def p2_binary_topk(spark: SparkSession, d: str) -> DataFrame:
    return X.binary_costs(_procs(spark, d), 3).withColumnRenamed("binary", "binary_name")


@query(PROCS + """, s AS (SELECT *, regexp_replace(regexp_replace(cmd, '/buildstream/demo/e[0-9]+\\.bst/', '<element-root>/'), '/tmp/cc[0-9]+x\\.s', '/tmp/<tmp>') AS signature, CASE WHEN closed THEN end_us - start_us ELSE 0 END AS wall FROM procs)
    SELECT signature, count(DISTINCT element) AS n_elements, count(*) AS n, CAST(sum(wall) AS BIGINT) AS wall_us, arg_max(element, (wall, element)) AS worst_element FROM s GROUP BY 1 HAVING count(DISTINCT element) >= 2""")
def p2_redundant(spark: SparkSession, d: str) -> DataFrame:
    return X.redundant_operations(_procs(spark, d))


@query(PROCS + """, b AS (SELECT element, start_us AS t, 1 AS d FROM procs WHERE closed AND end_us > start_us UNION ALL SELECT element, end_us, -1 FROM procs WHERE closed AND end_us > start_us),
    st AS (SELECT element, t, sum(d) AS d FROM b GROUP BY 1, 2), sw AS (SELECT element, lead(t) OVER w - t AS width, CAST(sum(d) OVER (PARTITION BY element ORDER BY t) AS BIGINT) AS n FROM st WINDOW w AS (PARTITION BY element ORDER BY t)),
    a AS (SELECT element, max(n) AS peak, CAST(sum(width * n) AS BIGINT) AS area_us, CAST(sum(width) AS BIGINT) AS busy_us FROM sw WHERE n > 0 AND width IS NOT NULL GROUP BY 1),
    j AS (SELECT element, max(CASE WHEN binary_name = 'make' THEN 4 END)::BIGINT AS requested_jobs FROM procs GROUP BY 1)
    SELECT element, peak, area_us, busy_us, requested_jobs, coalesce(requested_jobs = 1, false) AS pinned_to_one_job, coalesce(area_us / busy_us < 0.5 * requested_jobs, false) AS underachieved FROM a LEFT JOIN j USING (element)""")
def p2_parallelism(spark: SparkSession, d: str) -> DataFrame:
    return X.parallelism(_procs(spark, d))


@query("""WITH declared AS (SELECT DISTINCT 'o' || l_orderkey AS element, 'p' || l_partkey AS dependency FROM lineitem), staged AS (SELECT DISTINCT 'p' || l_partkey AS dependency, 's' || l_suppkey AS path FROM lineitem),
    opens AS (SELECT DISTINCT 'o' || l_orderkey AS element, 's' || l_suppkey AS path FROM lineitem WHERE l_returnflag = 'R'), coverage AS (SELECT DISTINCT 'o' || o_orderkey AS element FROM orders WHERE o_orderstatus = 'F'),
    st AS (SELECT dependency, count(*) AS n FROM staged GROUP BY 1), us AS (SELECT element, dependency, count(*) AS n FROM declared JOIN staged USING (dependency) JOIN opens USING (element, path) GROUP BY 1, 2)
    SELECT d.element, d.dependency, coalesce(st.n, 0) AS n_staged, coalesce(us.n, 0) AS n_used, CASE WHEN us.n > 0 THEN 'used' WHEN c.element IS NULL THEN 'uncovered' WHEN coalesce(st.n, 0) < 2 THEN 'aggregating' ELSE 'unused' END AS verdict
    FROM declared d LEFT JOIN st USING (dependency) LEFT JOIN us ON us.element = d.element AND us.dependency = d.dependency LEFT JOIN coverage c ON c.element = d.element""")
def p2_declared_used(spark: SparkSession, d: str) -> DataFrame:
    li, o = T.read(spark, d, "lineitem"), T.read(spark, d, "orders")
    name = lambda p, c: F.concat(F.lit(p), c)
    declared = li.select(name("o", "l_orderkey").alias("element"), name("p", "l_partkey").alias("dependency")).distinct()
    staged = li.select(name("p", "l_partkey").alias("dependency"), name("s", "l_suppkey").alias("path")).distinct()
    opens = li.filter("l_returnflag = 'R'").select(name("o", "l_orderkey").alias("element"), name("s", "l_suppkey").alias("path"))
    coverage = o.filter("o_orderstatus = 'F'").select(name("o", "o_orderkey").alias("element")).distinct()
    return X.declared_versus_used(declared, staged, opens, coverage)


@query(PROCS + """, k AS (SELECT invocation AS scope, pid, ppid, element, cpu_us, binary_name = 'cmake' AS own FROM procs),
    u AS (SELECT DISTINCT scope, pid FROM k WHERE own UNION SELECT k.scope, k.pid FROM u JOIN k ON k.scope = u.scope AND k.ppid = u.pid)
    SELECT element, CAST(sum(cpu_us) FILTER (u.pid IS NOT NULL) AS BIGINT) AS configure_cpu_us, CAST(sum(cpu_us) FILTER (u.pid IS NULL) AS BIGINT) AS other_cpu_us
    FROM k LEFT JOIN u ON u.scope = k.scope AND u.pid = k.pid GROUP BY 1""")
def p2_configure(spark: SparkSession, d: str) -> DataFrame:
    return X.configure_split(_procs(spark, d))


@query(PROCS + ", g AS (SELECT element, count(*) AS n FROM procs GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, 1.0::DOUBLE AS recognised, arg_max(element, (n, element)) AS largest, round(max(n) / sum(n), 9) AS largest_share FROM g")
def p2_attribution(spark: SparkSession, d: str) -> DataFrame:
    return X.attribution_reliability(_procs(spark, d)).withColumn("largest_share", F.round("largest_share", 9))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    """Element logs from orders: three phases of each, sized by its price and keys."""
    o = T.read(spark, d, "orders")
    us = lambda c: c.cast("long") * 1_000_000
    phase = lambda n, c: F.struct(F.lit(n).alias("name"), us(c).alias("duration_us"), F.lit("SUCCESS").alias("outcome"))
    run, stage, cache = F.floor(F.col("o_totalprice") / 1000), F.col("o_orderkey") % 50, F.col("o_custkey") % 30
    return o.select(F.concat(F.lit("l"), "o_orderkey").alias("path"), F.concat(F.lit("e"), "o_custkey").alias("element"), F.lit("demo").alias("project"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("started_us"), F.concat(F.lit("k"), (F.col("o_orderkey") % 3).cast("string")).alias("cache_key"), us(run + stage + cache).alias("total_us"), F.when(F.col("o_orderstatus") == "P", "FAILURE").otherwise("SUCCESS").alias("outcome"), F.array(phase("Running commands", run), phase("Staging dependencies at: /x", stage), phase("Caching artifact", cache)).alias("phases"))


_LOGS = """WITH logs AS (SELECT 'l' || o_orderkey AS path, 'e' || o_custkey AS element, epoch_us(o_orderdate) AS started_us, 'k' || (o_orderkey % 3) AS cache_key, o_orderstatus = 'P' AS failed,
    CAST(floor(o_totalprice / 1000) AS BIGINT) * 1000000 AS run, (o_orderkey % 50) * 1000000 AS stage, (o_custkey % 30) * 1000000 AS cache FROM orders),
    ph AS (SELECT path, element, 'Running commands' AS name, run AS us, run + stage + cache AS total FROM logs UNION ALL SELECT path, element, 'Staging dependencies at: /x', stage, run + stage + cache FROM logs UNION ALL SELECT path, element, 'Caching artifact', cache, run + stage + cache FROM logs)"""


@query(_LOGS + """ SELECT CASE WHEN name LIKE 'Staging%' THEN 'Staging dependencies' ELSE name END AS family, count(*) AS n, CAST(sum(us) AS BIGINT) AS total_us, count(DISTINCT element) AS n_elements,
    name = 'Running commands' AS is_work FROM ph GROUP BY 1, 5""")
def p3_tax(spark: SparkSession, d: str) -> DataFrame:
    return E.sandbox_tax(_logs(spark, d))


@query(_LOGS + " SELECT path, name, us AS duration_us, round(us / total, 9) AS share FROM ph WHERE total > 0 AND us / total >= 0.05")
def p3_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return E.phase_breakdown(_logs(spark, d)).withColumn("share", F.round("share", 9))


@query("SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS command, count(DISTINCT conv_id) AS n_elements, count(*) AS n FROM (SELECT conv_id, string_split(text, ' ')[1] AS text FROM conversations) WHERE trim(text) <> '' GROUP BY 1 HAVING count(DISTINCT conv_id) >= 3")
def p3_repeated(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "conversations").select(F.col("conv_id").alias("element"), F.split("text", " ")[0].alias("command"))
    return E.repeated_commands(c)


@query(_LOGS + ", l AS (SELECT *, lag(cache_key) OVER (PARTITION BY element ORDER BY started_us, path) AS previous_key FROM logs) SELECT path, element, previous_key, cache_key <> previous_key AS changed FROM l")
def p3_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return E.consecutive_builds(_logs(spark, d)).select("path", "element", "previous_key", "changed")


@query(_LOGS + """, w AS (SELECT element, min(started_us) + 31536000000000 AS t0, min(started_us) + 94608000000000 AS t1 FROM logs GROUP BY 1),
    j AS (SELECT w.element, arg_max(cache_key, (started_us, path)) FILTER (started_us <= t0) AS old_key, arg_max(cache_key, (started_us, path)) FILTER (started_us > t0 AND started_us <= t1) AS new_key FROM w JOIN logs USING (element) GROUP BY 1)
    SELECT element, old_key, new_key, old_key <> new_key AS changed FROM j""")
def p3_key_asof(spark: SparkSession, d: str) -> DataFrame:
    logs = _logs(spark, d)
    t = F.min("started_us")
    windows = logs.groupBy("element").agg((t + 31_536_000_000_000).alias("t0"), (t + 94_608_000_000_000).alias("t1")).withColumn("window_id", F.col("element"))
    return E.key_changed_between(logs, windows).select("element", "old_key", "new_key", "changed")


@query(_LOGS + ", l AS (SELECT *, lag(cache_key) OVER (PARTITION BY element ORDER BY started_us, path) AS p FROM logs) SELECT element, count(*) AS n_builds, count(*) FILTER (failed) AS n_failed, CAST(sum(run + stage + cache) AS BIGINT) AS total_us, count(*) FILTER (cache_key <> p) AS n_changed FROM l GROUP BY 1")
def p3_developer_tax(spark: SparkSession, d: str) -> DataFrame:
    return E.developer_tax(_logs(spark, d))


@query(_LOGS + " SELECT 'demo' AS project, count(*) AS n_logs, count(DISTINCT element) AS n_elements, min(started_us) AS first_us, max(started_us) AS last_us FROM logs")
def p3_log_tree(spark: SparkSession, d: str) -> DataFrame:
    return E.log_tree_summary(_logs(spark, d))


def _snapshot(spark: SparkSession, d: str, year: int) -> DataFrame:
    o = T.read(spark, d, "orders").filter(F.year("o_orderdate") == year)
    key = F.concat(F.lit("k"), (F.max("o_orderkey") % 4).cast("string"))
    return o.groupBy(F.concat(F.lit("e"), "o_custkey").alias("uid")).agg(F.when(F.max("o_orderkey") % 11 != 0, key).alias("cache_key"), (F.count("*") > 1).alias("built"))


_SNAP = """WITH snap AS (SELECT year(o_orderdate) AS y, 'e' || o_custkey AS uid, CASE WHEN max(o_orderkey) % 11 <> 0 THEN 'k' || (max(o_orderkey) % 4) END AS cache_key, count(*) > 1 AS built FROM orders GROUP BY 1, 2),
    b AS (SELECT * FROM snap WHERE y = 1997), c AS (SELECT * FROM snap WHERE y = 1998)"""


@query(_SNAP + """ SELECT coalesce(b.uid, c.uid) AS uid, CASE WHEN b.uid IS NULL THEN 'added' WHEN c.uid IS NULL THEN 'removed' WHEN b.cache_key IS NULL OR c.cache_key IS NULL THEN 'unknown' WHEN b.cache_key = c.cache_key THEN 'same' ELSE 'changed' END AS status
    FROM b FULL JOIN c ON b.uid = c.uid""")
def cmp_added_removed(spark: SparkSession, d: str) -> DataFrame:
    return C.element_differences(_snapshot(spark, d, 1997), _snapshot(spark, d, 1998))


@query(_SNAP + " SELECT c.uid, b.cache_key AS base_key, b.built AS base_built, c.cache_key, c.built, b.cache_key = c.cache_key AND c.built AND NOT b.built AS churned FROM b JOIN c ON b.uid = c.uid WHERE b.cache_key IS NOT NULL AND c.cache_key IS NOT NULL")
def cmp_churn(spark: SparkSession, d: str) -> DataFrame:
    return C.cache_churn(_snapshot(spark, d, 1997), _snapshot(spark, d, 1998))


_COLD = """, h AS (SELECT *, 'k' || (span_seq % 500) AS cache_key FROM spans WHERE span_seq % 4 < 3), n AS (SELECT *, 'k' || (span_seq % 701) AS cache_key FROM spans WHERE span_seq % 4 = 3),
    a AS (SELECT cache_key, task_kind, CAST(floor(median(dur_us)) AS BIGINT) AS x FROM h GROUP BY 1, 2), b AS (SELECT element_uid, task_kind, CAST(floor(median(dur_us)) AS BIGINT) AS x FROM h GROUP BY 1, 2), c AS (SELECT task_kind, CAST(floor(median(dur_us)) AS BIGINT) AS x FROM h GROUP BY 1)"""


@query(frames("spans") + _COLD + """ SELECT n.task_key, coalesce(a.x, b.x, c.x) AS cold_us, CASE WHEN a.x IS NOT NULL THEN 'key' WHEN b.x IS NOT NULL THEN 'element' WHEN c.x IS NOT NULL THEN 'kind' END AS tier
    FROM n LEFT JOIN a USING (cache_key, task_kind) LEFT JOIN b ON b.element_uid = n.element_uid AND b.task_kind = n.task_kind LEFT JOIN c ON c.task_kind = n.task_kind""")
def cmp_cold_tiers(spark: SparkSession, d: str) -> DataFrame:
    s = T.spans(spark, d)
    key = lambda m: F.concat(F.lit("k"), (F.col("span_seq") % m).cast("string"))
    history, now = s.filter("span_seq % 4 < 3").withColumn("cache_key", key(500)), s.filter("span_seq % 4 = 3").withColumn("cache_key", key(701))
    return C.cold_durations(now, history).select("task_key", "cold_us", "tier")


@query(frames("spans") + _COLD + " SELECT task_key, cache_key FROM n WHERE task_kind = 'BUILD' AND cache_key IN (SELECT cache_key FROM h WHERE task_kind = 'BUILD')")
def cmp_rebuild_semi(spark: SparkSession, d: str) -> DataFrame:
    from tracewright.operators.prep import rebuilt

    s = T.spans(spark, d)
    key = lambda m: F.concat(F.lit("k"), (F.col("span_seq") % m).cast("string"))
    return rebuilt(s.filter("span_seq % 4 = 3").withColumn("cache_key", key(701)), s.filter("span_seq % 4 < 3").withColumn("cache_key", key(500))).select("task_key", "cache_key")


_MONTHLY = """WITH m AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate) AS mon, CAST(round(sum(o_totalprice)) AS BIGINT) AS total FROM orders GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY mon DESC) AS k FROM m)"""


@query(_MONTHLY + """, p AS (SELECT series, max(total) FILTER (k = 3) AS base_us, max(total) FILTER (k = 2) AS candidate_us, list(total) FILTER (k BETWEEN 3 AND 14) AS h FROM n GROUP BY 1),
    q AS (SELECT *, list_median(h) AS mid FROM p), r AS (SELECT *, greatest(3.0 * 1.4826 * list_median(list_transform(h, lambda x: abs(x - mid))), 0.01 * base_us) AS half FROM q)
    SELECT series, base_us, candidate_us, candidate_us - base_us AS delta_us, CASE WHEN abs(candidate_us - mid) <= half THEN 'unchanged'
    WHEN candidate_us >= list_min(h) AND candidate_us <= list_max(h) AND (list_min(h) < mid - half OR list_max(h) > mid + half) THEN 'within_observed_range' WHEN candidate_us < mid THEN 'improved' ELSE 'regressed' END AS verdict FROM r""")
def cmp_band_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The last but one month of each series against the one before, in the band of a year."""
    from pyspark.sql import Window

    m = T.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.trunc("o_orderdate", "month").alias("mon")).agg(F.round(F.sum("o_totalprice")).cast("long").alias("total"))
    n = m.withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("mon"))))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("total")))
    pairs = n.groupBy("series").agg(at(3).alias("base_us"), at(2).alias("candidate_us"), F.collect_list(F.when(F.col("k").between(3, 14), F.col("total"))).alias("history")).withColumn("incomplete", F.lit(None).cast("string"))
    return C.verdicts(pairs).select("series", "base_us", "candidate_us", "delta_us", "verdict")


@query(frames("spans") + """, b AS (SELECT task_kind AS category, CAST(sum(dur_us) AS BIGINT) AS x FROM spans WHERE attempt % 2 = 0 GROUP BY 1), c AS (SELECT task_kind AS category, CAST(sum(dur_us) AS BIGINT) AS x FROM spans WHERE attempt % 2 = 1 GROUP BY 1)
    SELECT category, b.x AS base_us, c.x AS candidate_us, round(100 * c.x / (SELECT sum(x) FROM c) - 100 * b.x / (SELECT sum(x) FROM b), 6) AS points FROM b FULL JOIN c USING (category)""")
def cmp_deltas(spark: SparkSession, d: str) -> DataFrame:
    s = T.spans(spark, d).withColumnRenamed("task_kind", "category")
    return C.category_deltas(s.filter("attempt % 2 = 0"), s.filter("attempt % 2 = 1")).withColumn("points", F.round("points", 6))


@query(frames("spans") + " SELECT round(sum(dur_us) FILTER (task_kind = 'BUILD') / sum(dur_us), 9) AS marginal_efficiency FROM spans")
def cmp_marginal(spark: SparkSession, d: str) -> DataFrame:
    s = T.spans(spark, d).select("dur_us", (F.col("task_kind") == "BUILD").alias("on_path"))
    return C.marginal_efficiency(s).withColumn("marginal_efficiency", F.round("marginal_efficiency", 9))


@query(_MONTHLY + """, p AS (SELECT series AS run_id, max(total) FILTER (k = 3) AS b, max(total) FILTER (k = 2) AS c FROM n GROUP BY 1)
    SELECT run_id, 'regression' AS gate, CASE WHEN 100 * (c - b) / b > 5 THEN 'FAIL' ELSE 'pass' END AS state FROM p UNION ALL SELECT run_id, 'efficiency', 'not requested' FROM p""")
def cmp_gates(spark: SparkSession, d: str) -> DataFrame:
    v = cmp_band_verdict(spark, d).select(F.col("series").alias("run_id"), "base_us", "candidate_us", F.lit(None).cast("double").alias("efficiency"))
    return C.gate_rows(v, 5.0, None)


@query("SELECT 'o_custkey' AS field, count(DISTINCT o_custkey) AS n_values FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders")
def cmp_homogeneity(spark: SparkSession, d: str) -> DataFrame:
    return C.homogeneity(T.read(spark, d, "orders"), ["o_custkey", "o_orderstatus"])


@query("""WITH a AS (SELECT 'n' || c_nationkey AS uid, count(*) AS n1 FROM customer GROUP BY 1), b AS (SELECT 'n' || s_nationkey AS uid, count(*) AS n2 FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
    SELECT coalesce(a.uid, b.uid) AS uid, n1, n2, CASE WHEN a.uid IS NULL THEN 'processes-only' WHEN b.uid IS NULL THEN 'run-only' ELSE 'both' END AS presence FROM a FULL JOIN b ON a.uid = b.uid""")
def cor_full_outer(spark: SparkSession, d: str) -> DataFrame:
    a = T.read(spark, d, "customer").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("uid")).agg(F.count("*").alias("n1"))
    b = T.read(spark, d, "supplier").filter("s_acctbal > 0").groupBy(F.concat(F.lit("n"), "s_nationkey").alias("uid")).agg(F.count("*").alias("n2"))
    return R.joined_elements(a, b)


@query(PROCS + """, p AS (SELECT invocation, element, max(rss_kb) AS peak FROM procs GROUP BY 1, 2)
    SELECT invocation, element, peak, row_number() OVER w::INT AS together, CAST(sum(peak) OVER (PARTITION BY invocation ORDER BY peak DESC, element) AS BIGINT) AS sum_kb,
    sum(peak) OVER (PARTITION BY invocation ORDER BY peak DESC, element) <= 16384 AS fits FROM p WHERE peak IS NOT NULL WINDOW w AS (PARTITION BY invocation ORDER BY peak DESC, element)""".replace("row_number() OVER w::INT", "CAST(row_number() OVER w AS INT)"))
def cor_memory_envelope(spark: SparkSession, d: str) -> DataFrame:
    p = _procs(spark, d).groupBy("invocation", "element").agg(F.max("rss_kb").alias("peak")).filter("peak IS NOT NULL")
    return A.memory_envelope(p, ["invocation"], "peak", "element", 16_384)


@query("""WITH l AS (SELECT o_orderpriority AS series, 'graph' AS name, count(DISTINCT o_custkey) AS allows FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 'cpu', count(*) // 3 FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 'memory', CAST(floor(sum(o_totalprice) / 1000000) AS BIGINT) FROM orders GROUP BY 1)
    SELECT series, arg_min(name, (allows, name)) AS name, min(allows) AS allows FROM l GROUP BY 1""")
def cor_binding_constraint(spark: SparkSession, d: str) -> DataFrame:
    g = T.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"))
    one = g.agg(F.count_distinct("o_custkey").alias("graph"), F.expr("count(*) div 3").alias("cpu"), F.floor(F.sum("o_totalprice") / 1_000_000).alias("memory"))
    return R.binding_constraint(one.unpivot(["series"], ["graph", "cpu", "memory"], "name", "allows"), ["series"])


@query(r"""SELECT page_id, regexp_replace(regexp_replace(lower(split_part(r, '/', 1)) || CASE WHEN contains(r, '/') THEN substr(r, strpos(r, '/')) ELSE '' END, '/+$', ''), '\.git$', '') AS identity
    FROM (SELECT page_id, regexp_replace(trim(url), '^https?://', '') AS r FROM pages)""")
def sc_url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "pages").select("page_id", S.normalise_url(F.col("url")).alias("identity"))


@query(PROCS + """ SELECT event_id, '/usr/bin/' || CASE binary_name WHEN 'make' THEN 'make -j4' WHEN 'sh' THEN 'sh -c' ELSE binary_name END || ' <element-root>/x' || (event_id % 13) || '.c' || CASE binary_name WHEN 'cc' THEN ' -o /tmp/<tmp>' ELSE '' END AS signature FROM procs""")
def sc_cmd_signature(spark: SparkSession, d: str) -> DataFrame:
    return _procs(spark, d).select(F.col("n").alias("event_id"), S.command_signature(F.col("cmd")).alias("signature"))


@query(frames("spans") + " SELECT run_id, task_key, dur_us FROM spans WHERE dur_us >= 60000000 AND contains(lower(task_key), 'build')")
def sc_threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    return T.spans(spark, d).filter(S.passes_threshold(F.col("dur_us"), ">= 1 min") & S.contains_text([F.col("task_key")], "Build")).select("run_id", "task_key", "dur_us")


@query("""SELECT o_orderkey AS id, CASE WHEN o_totalprice / 500000 >= 0.8 THEN 'high' WHEN o_totalprice / 500000 >= 0.5 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 1 THEN 'full' ELSE 'incremental' END AS mode FROM orders""")
def sc_bands(spark: SparkSession, d: str) -> DataFrame:
    cached = F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderkey") % 3 - 1)
    return T.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.confidence_band(F.col("o_totalprice") / 500_000).alias("confidence"), S.run_mode(cached).alias("mode"))


@query("""SELECT o_orderkey AS run_id, unnest(list_filter([CASE WHEN o_custkey % 20 > 16 THEN 'cpu_budget_exceeds_host_capacity' END, CASE WHEN (o_orderkey % 40) * j > 128 THEN 'resource_oversubscription' END,
    CASE WHEN (o_orderkey % 40) * j < 16 THEN 'resource_undersubscription' END, CASE WHEN o_orderkey % 40 > 16 THEN 'dispatch_oversubscription' END, CASE WHEN (o_orderkey % 40) * j * 512 > 65536 THEN 'memory_oversubscription' END], lambda x: x IS NOT NULL)) AS type
    FROM (SELECT *, CASE WHEN o_custkey % 9 = 0 THEN 8 ELSE o_custkey % 9 END AS j FROM orders)""")
def sc_capacity_violations(spark: SparkSession, d: str) -> DataFrame:
    n = lambda v: F.lit(v).cast("long")
    runs = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 40).alias("builders"), (F.col("o_custkey") % 9).alias("jobs"), n(16).alias("cores"), (F.col("o_custkey") % 20).alias("cpu_budget"), n(65_536).alias("memory_budget_mb"), n(512).alias("job_mb"), n(None).alias("wall_us"), n(None).alias("horizon_us"))
    return R.capacity_violations(runs)


@query("""SELECT o_orderpriority AS run_id, 'certified-headroom' AS id, 'medium' AS severity FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 'efficiency-score', 'info' FROM orders GROUP BY 1
    UNION ALL SELECT o_orderpriority, 'cache-hit-ratio', CASE WHEN avg(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) < 0.2 THEN 'high' WHEN avg(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) < 0.5 THEN 'medium' ELSE 'info' END FROM orders GROUP BY 1
    UNION ALL SELECT o_orderpriority, 'run-mode-incremental', 'info' FROM orders GROUP BY 1""")
def cor_findings(spark: SparkSession, d: str) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    g = T.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run_id")).agg(F.avg((F.col("o_orderstatus") != "F").cast("int")).alias("hit_ratio"))
    runs = g.select("run_id", null("string").alias("incomplete"), null("long").alias("failed_us"), F.lit("incremental").alias("run_mode"), "hit_ratio", null("double").alias("transfer_share"), null("double").alias("confidence"), null("string").alias("wait_category"), null("double").alias("wait_share"), F.lit(5).alias("headroom_us"), F.lit(0.9).alias("efficiency"))
    return R.run_findings(runs).select("run_id", "id", "severity")


# --- the query library over slices and tracks ------------------------------------------


def _views(spark: SparkSession, d: str) -> None:
    s = T.spans(spark, d)
    s.select(F.col("span_seq").alias("id"), F.concat_ws("-", "run_id", "task_kind").alias("track_id"), F.col("task_key").alias("name"), F.col("ts_us").alias("ts"), F.col("dur_us").alias("dur")).createOrReplaceTempView("slice")
    s.select(F.concat_ws("-", "run_id", "task_kind").alias("id"), F.concat(F.lit("run "), "run_id", F.lit(" "), F.lower("task_kind")).alias("name")).distinct().createOrReplaceTempView("track")


_SLICE = frames("spans") + ", slice AS (SELECT span_seq AS id, run_id || '-' || task_kind AS track_id, task_key AS name, ts_us AS ts, dur_us AS dur FROM spans), track AS (SELECT DISTINCT run_id || '-' || task_kind AS id, 'run ' || run_id || ' ' || lower(task_kind) AS name FROM spans) "

#: One text for both engines.
LIBRARY = {
    "sql_element_time": "SELECT t.name AS track, CAST(sum(s.dur) AS BIGINT) AS total_us, count(*) AS n FROM slice s JOIN track t ON s.track_id = t.id GROUP BY t.name",
    "sql_process_storm": "SELECT t.name AS track, count(*) AS n, min(s.dur) AS shortest_us FROM slice s JOIN track t ON s.track_id = t.id WHERE s.dur < 5000000 GROUP BY t.name",
    "sql_stalls": "SELECT id, track_id, lead(ts) OVER (PARTITION BY track_id ORDER BY ts, id) - (ts + dur) AS stall_us FROM slice",
    "sql_element_commands": "SELECT s.name, s.ts, s.dur FROM slice s JOIN track t ON s.track_id = t.id WHERE t.name LIKE '%build'",
    "sql_sandbox_tax": "SELECT p.id, p.dur - coalesce(CAST(sum(c.dur) AS BIGINT), 0) AS own_us FROM slice p LEFT JOIN slice c ON c.track_id = p.track_id AND c.id <> p.id AND c.ts >= p.ts AND c.ts + c.dur <= p.ts + p.dur GROUP BY p.id, p.dur",
    "sql_dependency_wait": "SELECT track_id, CAST(sum(gap) AS BIGINT) AS wait_us FROM (SELECT track_id, lead(ts) OVER (PARTITION BY track_id ORDER BY ts, id) - (ts + dur) AS gap FROM slice) g WHERE gap > 0 GROUP BY track_id",
}


def _library(text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        _views(spark, d)
        return spark.sql(text)

    return run


for _name, _text in LIBRARY.items():
    QUERIES[_name], ORACLES[_name] = _library(_text), _SLICE + _text
