"""Registered queries over structure, floors, violations and findings of runs, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import aggregates as A
from tracewright.operators import compare as C
from tracewright.operators import graph as G
from tracewright.operators import intervals as I
from tracewright.operators import kernels as K
from tracewright.operators import processes as X
from tracewright.operators import structure as S
from tracewright.plans.graphs import _CLOSURE, _LONGEST, RUN
from tracewright.plans.logs import PROCS, _procs
from tracewright.plans.tasks import _MONTHS, monthly
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


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return T.run_elements(spark, d), T.run_edges(spark, d)


@query(RUN + _CLOSURE + """, x AS (SELECT *, CASE WHEN CAST(substr(uid, 2) AS BIGINT) % 5 = 0 THEN 1 WHEN CAST(substr(uid, 2) AS BIGINT) % 5 = 1 THEN NULL ELSE 8 END AS mj, CAST(substr(uid, 2) AS BIGINT) % 11 = 3 AS np FROM run_elements),
    u AS (SELECT run_id, max(mj) AS typ, avg(dur_us) FILTER (dur_us > 0) AS m FROM x GROUP BY 1), dn AS (SELECT run_id, ancestor AS uid, count(*) AS n FROM reach GROUP BY 1, 2)
    SELECT x.run_id, x.uid, coalesce(mj, 1)::BIGINT AS max_jobs, typ::BIGINT AS typical_max_jobs, dur_us, dn.n AS n_down FROM x JOIN u USING (run_id) JOIN dn ON dn.run_id = x.run_id AND dn.uid = x.uid WHERE typ > 1 AND (np OR mj < typ) AND dur_us >= 1.2 * m""")
def st_serialization_points(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _run(spark, d)
    n = F.substring("uid", 2, 20).cast("long")
    jobs = F.when(n % 5 == 0, 1).when(n % 5 == 1, None).otherwise(8).cast("long")
    elements = nodes.withColumns({"max_jobs": jobs, "notparallel": n % 11 == 3})
    return S.serialization_points(elements, G.node_metrics(nodes, edges).select("run_id", "uid", "n_down"), 1.2)


@query(_LONGEST + _CLOSURE + """, tg AS (SELECT run_id, uid FROM run_elements WHERE requested_target), nd AS (SELECT run_id, uid FROM tg UNION SELECT r.run_id, r.ancestor FROM reach r JOIN tg ON tg.run_id = r.run_id AND tg.uid = r.uid),
    dn AS (SELECT run_id, ancestor AS uid, count(*) AS n FROM reach GROUP BY 1, 2)
    SELECT c.run_id, c.uid, dn.n IS NULL AS is_leaf, CAST(substr(c.uid, 2) AS BIGINT) % 4 = 1 AS on_blame_chain, slack_us = 0 AS on_critical_path, nd.uid IS NOT NULL OR c.run_id NOT IN (SELECT run_id FROM tg) AS is_reachable,
    dn.n IS NULL AND NOT (nd.uid IS NOT NULL OR c.run_id NOT IN (SELECT run_id FROM tg)) AS is_deferrable FROM cpm c LEFT JOIN dn ON dn.run_id = c.run_id AND dn.uid = c.uid LEFT JOIN nd ON nd.run_id = c.run_id AND nd.uid = c.uid""")
def st_leaf_analysis(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _run(spark, d)
    targets = nodes.filter("requested_target").select("run_id", "uid")
    above = G.closure_pairs(nodes, edges).join(targets, ["run_id", "uid"], "left_semi").select("run_id", F.col("ancestor").alias("uid"))
    chained = nodes.filter(F.substring("uid", 2, 20).cast("long") % 4 == 1)
    return S.leaf_analysis(G.node_metrics(nodes, edges), targets.unionByName(above), chained)


@query()
def st_batch_savings(spark: SparkSession, d: str) -> DataFrame:
    return S.batch_savings(*_run(spark, d), candidates=8)


@query(_LONGEST + """, wk AS (SELECT run_id, resource, sum(dur_us) AS work FROM spans GROUP BY 1, 2), cp AS (SELECT run_id, max(CASE resource WHEN 'PROCESS' THEN work // 4 WHEN 'DOWNLOAD' THEN work // 2 END) AS cap FROM wk GROUP BY 1),
    hz AS (SELECT run_id, max(finish_us) - min(ts_us) AS h, max(dur_us) AS longest FROM spans GROUP BY 1)
    SELECT run_id, total AS path_us, CAST(cap AS BIGINT) AS capacity_us, CAST(greatest(total, cap) AS BIGINT) AS lower_us, longest AS longest_us, h AS horizon_us, CAST(greatest(0, h - greatest(total, cap)) AS BIGINT) AS headroom_us, round(greatest(total, cap) / h, 9) AS efficiency
    FROM tot JOIN cp USING (run_id) JOIN hz USING (run_id)""")
def st_floors(spark: SparkSession, d: str) -> DataFrame:
    s = T.spans(spark, d)
    longest = s.groupBy("run_id").agg(F.max("dur_us").alias("longest_us"))
    return S.floors(I.horizon(s), K.path_lengths(*_run(spark, d)), K.resource_work(s), {"PROCESS": 4, "DOWNLOAD": 2}, longest).withColumn("efficiency", F.round("efficiency", 9))


@query(RUN + """, hi AS (SELECT element_uid, task_kind, CAST(floor(median(dur_us)) AS BIGINT) AS x FROM spans WHERE span_seq % 4 < 3 GROUP BY 1, 2), hk AS (SELECT task_kind, CAST(floor(median(dur_us)) AS BIGINT) AS x FROM spans WHERE span_seq % 4 < 3 GROUP BY 1),
    nw AS (SELECT s.run_id, s.element_uid AS uid, max(coalesce(hi.x, hk.x)) AS cold FROM spans s LEFT JOIN hi USING (element_uid, task_kind) LEFT JOIN hk ON hk.task_kind = s.task_kind WHERE span_seq % 4 = 3 GROUP BY 1, 2),
    k AS (SELECT e.run_id, e.uid, coalesce(cold, 0) AS d, cold IS NULL AS gone FROM run_elements e LEFT JOIN nw ON nw.run_id = e.run_id AND nw.uid = e.uid),
    w AS (SELECT run_id, uid, 0 AS hops, d AS f FROM k UNION SELECT w.run_id, e.successor, w.hops + 1, w.f + k.d FROM w JOIN run_edges e ON e.run_id = w.run_id AND e.predecessor = w.uid JOIN k ON k.run_id = e.run_id AND k.uid = e.successor)
    SELECT w.run_id, max(f) AS cold_path_us, any_value(n) AS n_unavailable, any_value(n) > 0 AS partial FROM w JOIN (SELECT run_id, count(*) FILTER (gone) AS n FROM k GROUP BY 1) g ON g.run_id = w.run_id GROUP BY 1""")
def st_cold_floor(spark: SparkSession, d: str) -> DataFrame:
    s = T.spans(spark, d).withColumn("cache_key", F.lit(None).cast("string"))
    cold = C.cold_durations(s.filter("span_seq % 4 = 3"), s.filter("span_seq % 4 < 3"))
    return S.cold_floor(*_run(spark, d), cold, allow_partial=True)


@query(_LONGEST + " SELECT e.successor AS element, e.predecessor AS dependency FROM run_edges e JOIN cpm a ON a.uid = e.successor JOIN cpm b ON b.uid = e.predecessor WHERE a.slack_us = 0 AND b.slack_us = 0 AND CAST(substr(e.successor, 2) AS BIGINT) % 3 <> 0")
def st_unread_gating_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _run(spark, d)
    unused = edges.filter(F.substring("successor", 2, 20).cast("long") % 3 != 0).select(F.col("successor").alias("element"), F.col("predecessor").alias("dependency"))
    return S.unread_gating_edges(unused, G.node_metrics(nodes, edges).filter("on_path"))


@query(frames("spans") + """, p AS (SELECT run_id, count(*) AS n, sum(dur_us) AS t FROM spans WHERE task_kind = 'OTHER' GROUP BY 1), h AS (SELECT run_id, max(finish_us) - min(ts_us) AS h FROM spans GROUP BY 1)
    SELECT run_id, n AS n_phases, CAST(t AS BIGINT) AS total_us, round(t / h, 9) AS fraction FROM p JOIN h USING (run_id)""")
def st_pipeline_overhead(spark: SparkSession, d: str) -> DataFrame:
    s = T.spans(spark, d)
    phases = s.filter("task_kind = 'OTHER'").select("run_id", F.col("dur_us").alias("elapsed_us"))
    return S.pipeline_overhead(phases, I.horizon(s)).withColumn("fraction", F.round("fraction", 9))


@query(frames("spans") + " SELECT run_id, min(dur_us) AS shortest_us, count(*) AS n_tasks, count(*) FILTER (1000000 / dur_us > 0.05) AS n_material FROM spans WHERE dur_us > 0 GROUP BY 1")
def st_timestamp_agreement(spark: SparkSession, d: str) -> DataFrame:
    return S.timestamp_agreement(T.spans(spark, d), 1_000_000)


_RESOLVED = "CASE CAST(substr(invocation, 2) AS BIGINT) % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'ambiguous' END"


@query(PROCS + f" SELECT CASE WHEN {_RESOLVED} = 'resolved' THEN 'lib-' || invocation ELSE element END AS element, count(*) AS n FROM procs GROUP BY 1")
def p2_relabel(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("invocation", 2, 9).cast("long") % 3
    known = _procs(spark, d).select("invocation").distinct().filter(n < 2)
    named = known.select("invocation", F.concat(F.lit("lib-"), "invocation").alias("element"), F.when(n == 0, "resolved").otherwise("ambiguous").alias("verdict"))
    return S.relabelled(_procs(spark, d), named).groupBy("element").agg(F.count("*").alias("n"))


def reported(orders: DataFrame) -> DataFrame:
    """(element, configure_us): summed as decimals, since a sum of doubles falls short of a whole number or not by the order of its rows."""
    exact = F.sum(F.col("o_totalprice").cast("decimal(28,10)"))
    return orders.filter("o_orderstatus = 'F'").groupBy(F.concat(F.lit("e"), "o_custkey", F.lit(".bst")).alias("element")).agg(F.floor(exact).cast("long").alias("configure_us"))


@query(PROCS + """, k AS (SELECT invocation AS scope, pid, ppid, element, cpu_us, binary_name = 'cmake' AS own FROM procs),
    u AS (SELECT DISTINCT scope, pid FROM k WHERE own UNION SELECT k.scope, k.pid FROM u JOIN k ON k.scope = u.scope AND k.ppid = u.pid),
    c AS (SELECT element, CAST(sum(cpu_us) FILTER (u.pid IS NOT NULL) AS BIGINT) AS x FROM k LEFT JOIN u ON u.scope = k.scope AND u.pid = k.pid GROUP BY 1),
    r AS (SELECT 'e' || o_custkey || '.bst' AS element, CAST(floor(sum(o_totalprice)) AS BIGINT) AS y FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT c.element, c.x AS configure_cpu_us, r.y AS configure_us, coalesce(c.x > 0, false) AND coalesce(r.y, 0) = 0 AS self_report_missing FROM c LEFT JOIN r USING (element)""")
def cor_configure_views(spark: SparkSession, d: str) -> DataFrame:
    return S.configure_views(X.configure_split(_procs(spark, d)), reported(T.read(spark, d, "orders")))


@query("""SELECT o_orderkey AS run_id, unnest(list_filter([CASE WHEN o_orderkey % 5 > 3 THEN 'build_failed' END, CASE WHEN o_orderkey % 7 = 1 THEN 'attribution_reconciliation' END, CASE WHEN o_custkey % 50 < o_orderkey % 30 THEN 'floor_below_longest_task' END,
    CASE WHEN o_custkey % 4 = 3 THEN 'hard_gate_failed' END], lambda x: x IS NOT NULL)) AS type FROM orders""")
def sc_run_violations(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    runs = T.read(spark, d, "orders").select(k.alias("run_id"), F.when(k % 5 > 3, 2).alias("n_failed"), F.when(k % 7 == 1, -4).otherwise(0).alias("reconciliation_gap_us"), (c % 50).alias("lower_us"), (k % 30).alias("longest_us"), F.when(c % 4 == 3, 1).otherwise(0).alias("hard_gates_failed"))
    return S.run_violations(runs)


@query("""WITH p AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS v FROM orders)
    SELECT k AS pair, CASE WHEN k % 9 = 0 OR k % 10 = 0 THEN 'incomplete' WHEN k % 11 = 0 THEN 'no_duration' WHEN c % 20 < 0.5 * 20 THEN 'different_graph' WHEN k % 2 <> c % 2 THEN 'different_mode' END AS refusal,
    CASE k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'unknown' ELSE 'normal' END AS confidence FROM p""")
def cmp_comparability(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mode = lambda x: F.when(x % 2 == 0, "full").otherwise("incremental")
    pairs = T.read(spark, d, "orders").select(
        k.alias("pair"), F.when(k % 9 == 0, "failed").alias("base_incomplete"), F.when(k % 10 == 0, "suspended").alias("incomplete"), F.lit(10).alias("base_us"), F.when(k % 11 != 0, 12).alias("candidate_us"),
        (c % 20).alias("n_shared"), F.lit(20).alias("n_union"), mode(k).alias("base_mode"), mode(c).alias("mode"), F.when(k % 3 == 0, "different").when(k % 3 == 1, "unknown").otherwise("same").alias("same_host"))
    return S.comparability(pairs).select("pair", "refusal", "confidence")


@query("""WITH f AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 100 >= 90 AS chained, o_custkey % 200 < 1 AS bound FROM orders),
    r AS (SELECT k, unnest(list_filter([CASE WHEN (chained OR bound) AND k % 3 > 0 AND k % 100 > 0 THEN {'id': 'time-concentration', 's': 'high', 'n': 0} END, CASE WHEN (chained OR bound) AND k % 3 > 0 AND k % 100 > 0 AND c % 10 >= 5 THEN {'id': 'mesh-graph', 's': 'info', 'n': 1} END,
        CASE WHEN NOT chained AND c % 3 > 0 THEN {'id': 'blast-radius-ranking', 's': 'medium', 'n': 2} END, CASE WHEN c % 4 > 0 THEN {'id': 'joint-saving', 's': 'high', 'n': 3} END, CASE WHEN k % 6 > 1 THEN {'id': 'optimization-horizon', 's': 'high', 'n': 4} END,
        CASE WHEN k % 5 > 0 THEN {'id': 'latent-heavies', 's': 'medium', 'n': 5} END, CASE WHEN k % 4 > 0 THEN {'id': 'memory-envelope', 's': CASE WHEN k % 4 = 1 THEN 'high' WHEN c % 6 = 5 THEN 'medium' ELSE 'info' END, 'n': 6} END,
        CASE WHEN c % 8 > 0 THEN {'id': 'capacity-recommendation', 's': CASE WHEN c % 8 > 4 THEN 'medium' WHEN c % 8 < 4 THEN 'high' ELSE 'info' END, 'n': 7} END, CASE WHEN k % 10 > 0 AND c % 10 < 9 THEN {'id': 'criticality', 's': 'info', 'n': 8} END,
        CASE WHEN c % 9 > 6 THEN {'id': 'shared-source-blast', 's': 'medium', 'n': 9} END], lambda x: x IS NOT NULL)) AS x FROM f)
    SELECT k AS run_id, x.id AS id, x.s AS severity, x.n AS sequence FROM r""")
def cor_outlook(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    runs = T.read(spark, d, "orders").select(
        k.alias("run_id"), F.lit(100).alias("total_us"), (k % 100).alias("path_us"), ((c % 200) * 1.0).alias("largest_wait_us"), (k % 3).alias("n_heavy"), ((c % 10) / 10).alias("zero_slack_share"), F.when(c % 4 > 0, c % 4).alias("joint_us"),
        (k % 6).alias("n_steps"), F.nullif(k % 5, F.lit(0).cast("long")).alias("n_latent"), (c % 3).alias("n_blast"), ((k % 10) / 10).alias("criticality_max"), ((c % 10) / 9).alias("criticality_min"), F.lit(4).cast("long").alias("builders"),
        F.when(k % 4 > 0, k % 4 > 1).alias("fits"), (c % 6).alias("first_not_fitting"), F.when(c % 8 > 0, c % 8).alias("recommended"), F.greatest(F.lit(0), c % 9 - 6).alias("n_shared_sources"))
    return S.outlook(runs)


@query("""WITH i AS (SELECT o_custkey % 20 AS project, o_orderkey % 7 = 0 AS one, CAST(floor(o_totalprice) AS BIGINT) + o_orderkey % 13 AS us FROM orders),
    s AS (SELECT project, count(*) FILTER (NOT one) AS n, coalesce(sum(us) FILTER (NOT one), 0) AS a, coalesce(sum(us) FILTER (one), 0) AS b FROM i GROUP BY 1)
    SELECT project, n AS n_individual, CAST(a AS BIGINT) AS individual_us, CAST(b AS BIGINT) AS consolidated_us, CAST(a - b AS BIGINT) AS savings_us, round((a - b) / a, 9) AS fraction FROM s""")
def st_checkout_savings(spark: SparkSession, d: str) -> DataFrame:
    o = T.read(spark, d, "orders").select((F.col("o_custkey") % 20).alias("project"), (F.col("o_orderkey") % 7 == 0).alias("consolidated"), (F.col("o_orderkey") % 13).alias("overhead_us"), F.floor("o_totalprice").alias("elements_us"))
    return S.checkout_savings(o).withColumn("fraction", F.round("fraction", 9))


@query(f"""WITH {_MONTHS}, mc AS (SELECT *, pos % 4 <> 1 AS complete FROM n), b AS (SELECT x.series, x.pos, x.total, x.complete, list(y.total) FILTER (y.total IS NOT NULL) AS h FROM mc x LEFT JOIN mc y ON x.series = y.series AND y.pos < x.pos AND y.complete GROUP BY 1, 2, 3, 4),
    c AS (SELECT *, list_median(h) AS middle FROM b), e AS (SELECT *, greatest(3.0 * 1.4826 * list_median(list_transform(h, lambda v: abs(v - middle))), 0.01 * middle) AS half FROM c)
    SELECT series, pos::INT AS pos, CASE WHEN NOT complete THEN NULL WHEN h IS NULL OR len(h) < 3 THEN 'too-few' WHEN total > middle + half THEN 'above' WHEN total < middle - half THEN 'below' ELSE 'inside' END AS verdict FROM e""")
def cmp_store_verdicts(spark: SparkSession, d: str) -> DataFrame:
    months = monthly(spark, d).withColumn("complete", F.col("pos") % 4 != 1)
    return S.store_verdicts(months, ["series"], "pos", "total").select("series", "pos", "verdict")


@query("""WITH p AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(1000 + o_custkey % 60 AS BIGINT) AS v FROM orders)
    SELECT k AS pair, CASE WHEN k % 9 = 0 THEN 'incomplete' WHEN k % 11 = 0 THEN 'no_duration' WHEN c % 20 < 10 THEN 'different_graph' WHEN k % 2 <> c % 2 THEN 'different_mode' END AS refusal,
    CASE WHEN k % 9 = 0 OR k % 11 = 0 OR c % 20 < 10 OR k % 2 <> c % 2 THEN 'not_comparable' WHEN abs(v - 1000) <= 10 THEN 'unchanged' ELSE 'regressed' END AS verdict FROM p""")
def cmp_runs(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mode = lambda x: F.when(x % 2 == 0, "full").otherwise("incremental")
    pairs = T.read(spark, d, "orders").select(
        k.alias("pair"), F.when(k % 9 == 0, "failed").alias("base_incomplete"), F.lit(None).cast("string").alias("incomplete"), F.lit(1000).cast("long").alias("base_us"), F.when(k % 11 != 0, 1000 + c % 60).alias("candidate_us"), F.array().cast("array<long>").alias("history"),
        (c % 20).alias("n_shared"), F.lit(20).alias("n_union"), mode(k).alias("base_mode"), mode(c).alias("mode"), F.lit("same").alias("same_host"))
    return S.compared(pairs).select("pair", "refusal", "verdict")


@query(_LONGEST + _CLOSURE + """, lv(run_id, uid, level) AS (SELECT run_id, uid, 0 FROM run_elements UNION SELECT l.run_id, e.successor, l.level + 1 FROM lv l JOIN run_edges e ON e.run_id = l.run_id AND e.predecessor = l.uid),
    le AS (SELECT run_id, uid, max(level) AS level FROM lv GROUP BY 1, 2), dn AS (SELECT run_id, ancestor AS uid, count(*) AS n FROM reach GROUP BY 1, 2), up AS (SELECT run_id, uid, count(*) AS n FROM reach GROUP BY 1, 2),
    i AS (SELECT run_id, successor AS uid, count(*) AS n FROM run_edges GROUP BY 1, 2), o AS (SELECT run_id, predecessor AS uid, count(*) AS n FROM run_edges GROUP BY 1, 2)
    SELECT c.run_id, c.uid, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, le.level::BIGINT AS level, finish_us, slack_us, coalesce(up.n, 0) AS n_up, coalesce(dn.n, 0) AS n_down, slack_us = 0 AS on_path
    FROM cpm c JOIN le ON le.run_id = c.run_id AND le.uid = c.uid LEFT JOIN dn ON dn.run_id = c.run_id AND dn.uid = c.uid LEFT JOIN up ON up.run_id = c.run_id AND up.uid = c.uid LEFT JOIN i ON i.run_id = c.run_id AND i.uid = c.uid LEFT JOIN o ON o.run_id = c.run_id AND o.uid = c.uid""")
def g_bundle(spark: SparkSession, d: str) -> DataFrame:
    return S.graph_bundle(*_run(spark, d))


@query(RUN + """, sd AS (SELECT run_id, element_uid AS uid, coalesce(max(dur_us) FILTER (task_kind = 'FETCH'), 0) AS head, coalesce(max(dur_us) FILTER (task_kind <> 'FETCH'), 0) AS work FROM spans GROUP BY 1, 2),
    w AS (SELECT run_id, uid, 0 AS hops, head + work AS f FROM sd UNION SELECT w.run_id, e.successor, w.hops + 1, w.f + s.work FROM w JOIN run_edges e ON e.run_id = w.run_id AND e.predecessor = w.uid JOIN sd s ON s.run_id = e.run_id AND s.uid = e.successor)
    SELECT run_id, CAST(max(f) AS BIGINT) AS length_us FROM w GROUP BY 1""")
def g_two_stage_path(spark: SparkSession, d: str) -> DataFrame:
    stages = A.stage_durations(T.spans(spark, d)).withColumnRenamed("element_uid", "uid")
    return S.two_stage_paths(stages, T.run_edges(spark, d))


@query(_LONGEST + """, wk AS (SELECT run_id, resource, sum(dur_us) AS work FROM spans GROUP BY 1, 2), sc AS (SELECT * FROM (VALUES ('few', 'PROCESS', 1), ('few', 'DOWNLOAD', 1), ('many', 'PROCESS', 8), ('many', 'OTHER', 4)) v(scenario, resource, c)),
    nd AS (SELECT run_id, scenario, resource, ceil(work / c) AS need FROM wk JOIN sc USING (resource)), pr AS (SELECT run_id, scenario, max(need) AS need, arg_min(resource, (-need, resource)) AS tightest, sum(need) AS every FROM nd GROUP BY 1, 2)
    SELECT run_id, scenario, CAST(greatest(total, need) AS BIGINT) AS lower_us, CAST(total + every AS BIGINT) AS upper_us, CASE WHEN need > total THEN tightest END AS bound_by FROM tot JOIN pr USING (run_id)""")
def k_scenarios(spark: SparkSession, d: str) -> DataFrame:
    scenarios = {"few": {"PROCESS": 1, "DOWNLOAD": 1}, "many": {"PROCESS": 8, "OTHER": 4}}
    return K.scenario_bounds(K.path_lengths(*_run(spark, d)), K.resource_work(T.spans(spark, d)), scenarios)
