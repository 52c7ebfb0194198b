"""Registered queries from the figures of each run to its findings, violations and comparisons, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import assembly as A
from tracewright.operators import prep as P
from tracewright.operators.graph import shared_cut
from tracewright.plans.graphs import _CHAIN, _CLOSURE, _LONGEST, _WITHOUT, RUN, TASKS
from tracewright.plans.tasks import _TASKS
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


CAPACITIES = {"PROCESS": 2, "DOWNLOAD": 1}

_JOINT = _WITHOUT[len(_LONGEST) :].format("SELECT run_id, 'all', uid FROM tp WHERE nth <= 3")
_FIGURES = (
    frames("spans", "run_elements", "run_edges")
    + _TASKS
    + _CHAIN[len(TASKS) :].format(2, 1, 3)
    + _LONGEST[len(RUN) :]
    + _JOINT
    + _CLOSURE
    + """,
    hz AS (SELECT run_id, max(finish_us) - min(start_us) AS h, max(finish_us - start_us) AS longest, sum(finish_us - start_us) AS took,
        count(*) FILTER (task_kind = 'OTHER') AS n_failed, coalesce(sum(finish_us - start_us) FILTER (task_kind = 'OTHER'), 0) AS failed, count(*) FILTER (task_kind = 'PULL') AS pulled,
        count(*) FILTER (task_kind = 'BUILD') AS built, coalesce(sum(finish_us - start_us) FILTER (task_kind IN ('PULL', 'PUSH')), 0) AS moved FROM tasks GROUP BY 1),
    -- what the chain covers: each instant of its tasks and waits once
    ci AS (SELECT run_id, least(start_us, CASE WHEN gap_us < start_us THEN gap_us ELSE start_us END) AS a, finish_us AS z FROM oc),
    cf AS (SELECT *, CASE WHEN a > max(z) OVER (PARTITION BY run_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS o FROM ci),
    cn AS (SELECT *, sum(o) OVER (PARTITION BY run_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS i FROM cf), cv AS (SELECT run_id, sum(w) AS covered FROM (SELECT run_id, max(z) - min(a) AS w FROM cn GROUP BY run_id, i) GROUP BY 1),
    ws AS (SELECT run_id, category, sum(us) AS us FROM wt GROUP BY 1, 2), wa AS (SELECT run_id, sum(us) AS every FROM ws GROUP BY 1),
    wm AS (SELECT run_id, arg_min(category, (-us, category)) AS category, max(us) AS us FROM ws WHERE category <> 'EXECUTION_ON_CHAIN' GROUP BY 1),
    nd AS (SELECT run_id, ancestor AS uid, count(*) AS n FROM reach GROUP BY 1, 2), sz AS (SELECT run_id, count(*) AS n, sum(dur_us) AS s FROM run_elements GROUP BY 1),
    gr AS (SELECT c.run_id, any_value(total) AS path, any_value(sz.n) AS n_elements, count(*) FILTER (slack_us = 0 AND dur_us >= 0.05 * total) AS n_heavy, avg(CASE WHEN slack_us = 0 THEN 1 ELSE 0 END) AS zero,
        count(*) FILTER (sz.n > 1 AND coalesce(nd.n, 0) >= 0.5 * (sz.n - 1)) AS n_blast, least(5, count(*) FILTER (slack_us > 0 AND dur_us >= 0.01 * s)) AS n_latent FROM cpm c JOIN sz ON sz.run_id = c.run_id LEFT JOIN nd ON nd.run_id = c.run_id AND nd.uid = c.uid GROUP BY 1),
    fw AS (SELECT run_id, max((w // CASE resource WHEN 'PROCESS' THEN 2 ELSE 1 END)) AS cap FROM (SELECT run_id, resource, sum(finish_us - start_us) AS w FROM tasks WHERE resource IN ('PROCESS', 'DOWNLOAD') GROUP BY 1, 2) GROUP BY 1),
    fig AS (SELECT hz.run_id, h AS horizon_us, path AS path_us, greatest(path, coalesce(cap, 0)) AS lower_us, longest AS longest_us, n_elements, n_heavy, zero AS zero_slack_share, n_blast, n_latent, total - length AS joint_us,
        wm.category AS wait_category, coalesce(wm.us, 0) AS largest_wait_us, h - covered AS idle_us, h - every - (h - covered) AS reconciliation_gap_us, n_failed, failed AS failed_us, pulled AS n_cached,
        CASE WHEN pulled + built > 0 THEN pulled / (pulled + built) END AS hit_ratio, moved / took AS transfer_share, CASE WHEN pulled > 0 THEN 'incremental' ELSE 'full' END AS run_mode,
        CASE WHEN n_failed > 0 THEN 'failed' WHEN hz.run_id % 4 = 3 THEN 'interrupted' END AS incomplete, 4 + hz.run_id % 3 AS cores, least(1 - (h - covered) / h, CASE WHEN h < greatest(path, coalesce(cap, 0)) THEN 0.5 ELSE 1.0 END, CASE WHEN hz.run_id % 5 = 4 THEN 0.75 ELSE 1.0 END) AS confidence
        FROM hz JOIN gr USING (run_id) JOIN cv USING (run_id) JOIN wa USING (run_id) LEFT JOIN wm USING (run_id) LEFT JOIN fw USING (run_id) JOIN (SELECT lz.run_id, length, total FROM lz JOIN tot USING (run_id)) j USING (run_id))"""
)


def _given(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Figures of each run, and the elements of the runs."""
    spans, edges, nodes = shared_cut(P.quantised(T.spans(spark, d))), shared_cut(T.run_edges(spark, d)), shared_cut(T.run_elements(spark, d))
    tasks = P.ready_times(spans, edges).withColumn("failed", F.col("task_kind") == "OTHER")
    run = F.col("run_id")
    context = nodes.select("run_id").distinct().select(
        "run_id", F.lit(3).alias("builders"), F.lit(2).alias("jobs"), (4 + run % 3).alias("cores"), F.lit(5).alias("cpu_budget"), F.lit(8_000).alias("memory_budget_mb"), (1_000 + 200 * (run % 4)).alias("job_mb"),
        F.lit(None).cast("long").alias("wall_us"), F.lit(1).alias("n_hashes"), (run % 5 == 4).alias("hashes_missing"), (run % 4 == 3).alias("interrupted"), F.lit(0.0).alias("suspended_s"))
    return shared_cut(A.run_figures(tasks, P.task_dependencies(spans, edges), nodes, edges, CAPACITIES, 3, context)), nodes


_SHOWN = ("run_id", "horizon_us", "path_us", "lower_us", "longest_us", "n_elements", "n_heavy", "zero_slack_share", "n_blast", "n_latent", "joint_us", "wait_category", "largest_wait_us", "idle_us", "reconciliation_gap_us", "n_failed", "failed_us", "n_cached", "hit_ratio", "transfer_share", "run_mode", "incomplete", "confidence")
_ROUNDED = ("zero_slack_share", "hit_ratio", "transfer_share", "confidence")
_WHOLE = ("lower_us", "largest_wait_us", "idle_us", "reconciliation_gap_us", "failed_us", "joint_us")


@query(_FIGURES + " SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in _ROUNDED else f"CAST({c} AS BIGINT) AS {c}" if c in _WHOLE else c for c in _SHOWN) + " FROM fig")
def run_figures(spark: SparkSession, d: str) -> DataFrame:
    """Occupancy, floors, blame, graph and cache figures of each run in one row."""
    return _given(spark, d)[0].select(*[F.round(c, 6).alias(c) if c in _ROUNDED else F.col(c) for c in _SHOWN])


@query(_FIGURES + """, sv AS (SELECT run_id, unnest(list_filter([
        CASE WHEN incomplete IS NOT NULL THEN {'id': 'build-failed', 's': 'critical', 'n': 0} END, CASE WHEN failed_us > 0 THEN {'id': 'failed-task-time', 's': 'medium', 'n': 1} END,
        CASE WHEN run_mode = 'incremental' THEN {'id': 'run-mode-incremental', 's': 'info', 'n': 2} END,
        CASE WHEN hit_ratio IS NOT NULL THEN {'id': 'cache-hit-ratio', 's': CASE WHEN run_mode = 'full' THEN 'info' WHEN hit_ratio < 0.2 THEN 'high' WHEN hit_ratio < 0.5 THEN 'medium' ELSE 'info' END, 'n': 3} END,
        CASE WHEN transfer_share >= 0.1 THEN {'id': 'cache-transfer-cost', 's': 'medium', 'n': 4} END,
        {'id': 'confidence', 's': CASE WHEN confidence >= 0.8 THEN 'info' WHEN confidence >= 0.5 THEN 'medium' ELSE 'high' END, 'n': 5},
        CASE WHEN largest_wait_us / horizon_us < 0.01 THEN {'id': 'execution-bound', 's': 'high', 'n': 6} ELSE {'id': 'wait-category', 's': 'high', 'n': 7} END,
        CASE WHEN horizon_us > lower_us THEN {'id': 'certified-headroom', 's': 'medium', 'n': 8} END, {'id': 'efficiency-score', 's': 'info', 'n': 9},
        CASE WHEN (path_us >= 0.9 * horizon_us OR largest_wait_us < 0.01 * horizon_us) AND n_heavy > 0 AND path_us > 0 THEN {'id': 'time-concentration', 's': 'high', 'n': 100} END,
        CASE WHEN (path_us >= 0.9 * horizon_us OR largest_wait_us < 0.01 * horizon_us) AND n_heavy > 0 AND path_us > 0 AND zero_slack_share >= 0.5 THEN {'id': 'mesh-graph', 's': 'info', 'n': 101} END,
        CASE WHEN path_us < 0.9 * horizon_us AND n_blast > 0 THEN {'id': 'blast-radius-ranking', 's': 'medium', 'n': 102} END, CASE WHEN joint_us > 0 AND horizon_us > 0 THEN {'id': 'joint-saving', 's': 'high', 'n': 103} END,
        CASE WHEN n_latent > 0 THEN {'id': 'latent-heavies', 's': 'medium', 'n': 105} END], lambda x: x IS NOT NULL)) AS x FROM fig)
    SELECT run_id, x.id AS id, x.s AS severity, x.n AS sequence FROM sv""")
def run_all_findings(spark: SparkSession, d: str) -> DataFrame:
    """What each run's figures find."""
    return A.findings(_given(spark, d)[0])


@query(_FIGURES + """ SELECT run_id, unnest(list_filter([CASE WHEN n_failed > 0 THEN 'build_failed' END, CASE WHEN reconciliation_gap_us <> 0 THEN 'attribution_reconciliation' END, CASE WHEN lower_us < longest_us THEN 'floor_below_longest_task' END,
    CASE WHEN lower_us / horizon_us > 1 THEN 'hard_gate_failed' END, CASE WHEN 5 > cores THEN 'cpu_budget_exceeds_host_capacity' END, CASE WHEN 6 > 8.0 * cores THEN 'resource_oversubscription' END, CASE WHEN 6 < cores THEN 'resource_undersubscription' END,
    CASE WHEN 3 > cores THEN 'dispatch_oversubscription' END, CASE WHEN 6 * (1000 + 200 * (run_id % 4)) > 8000 THEN 'memory_oversubscription' END], lambda x: x IS NOT NULL)) AS type FROM fig""")
def run_all_violations(spark: SparkSession, d: str) -> DataFrame:
    """Which rules each run breaks."""
    return A.violations(_given(spark, d)[0])


@query(_FIGURES + """, pr AS (SELECT b.*, c.run_id AS other, c.horizon_us AS ch, c.lower_us AS cl, c.incomplete AS ci, c.run_mode AS cm FROM fig b JOIN fig c ON c.run_id = b.run_id + 1)
    SELECT run_id AS base_id, other AS run_id, CASE WHEN incomplete IS NOT NULL OR ci IS NOT NULL THEN 'incomplete' ELSE 'different_graph' END AS refusal, CASE WHEN run_id % 2 = 0 THEN 'normal' ELSE 'low' END AS confidence, NULL::BIGINT AS delta_us, NULL::DOUBLE AS efficiency_delta FROM pr""")
def run_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Each run against the one before: they share no element, which the comparison refuses."""
    figures, nodes = _given(spark, d)
    ids = figures.select(F.col("run_id").alias("base_id"))
    pairs = ids.join(figures.select((F.col("run_id") - 1).alias("base_id"), "run_id"), "base_id").select("base_id", "run_id", F.when(F.col("base_id") % 2 == 0, "same").otherwise("different").alias("same_host"))
    return A.comparisons(figures, nodes, pairs)
