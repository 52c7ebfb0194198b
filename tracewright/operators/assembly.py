"""From the operators to one row of figures a run, and from that row to findings, violations and comparisons.

Nothing is measured here: occupancy, floors, blame, graph figures and cache accounts come from
their operators and meet by run. Figures that were not recorded are null and find nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import incomplete_reason, run_mode
from tracewright.operators import blame as B
from tracewright.operators import correlate as C
from tracewright.operators import graph as G
from tracewright.operators import intervals as I
from tracewright.operators import kernels as K
from tracewright.operators import structure as S
from tracewright.operators.graph import shared_cut

#: Share of the path from which an element of it is heavy, and of the other elements that feel a change of one from which that one is in the ranking.
HEAVY, WIDE = 0.05, 0.5


def blame_figures(attributed: DataFrame, tasks: DataFrame) -> DataFrame:
    """(run_id, wait_category, largest_wait_us, idle_us, reconciliation_gap_us)."""
    waits = attributed.filter(F.col("category").isin(*B.WAITS))
    most = waits.groupBy("run_id").agg(F.min_by(F.struct("category", "dur_us"), F.struct(-F.col("dur_us"), "category")).alias("w"))
    idle = attributed.filter("category = 'IDLE'").select("run_id", F.col("dur_us").alias("idle_us"))
    gap = B.reconciliation(attributed, tasks).select("run_id", F.col("gap_us").alias("reconciliation_gap_us"))
    out = gap.join(most, "run_id", "left").join(idle, "run_id", "left")
    return out.select("run_id", F.col("w.category").alias("wait_category"), F.coalesce("w.dur_us", F.lit(0)).alias("largest_wait_us"), F.coalesce("idle_us", F.lit(0)).alias("idle_us"), "reconciliation_gap_us")


def graph_figures(nodes: DataFrame, edges: DataFrame, members: int = 3) -> DataFrame:
    """(run_id, path_us, n_elements, n_heavy, zero_slack_share, n_blast, n_latent, joint_us)."""
    each = shared_cut(G.node_metrics(nodes, edges).join(nodes.select("run_id", "uid", "dur_us"), ["run_id", "uid"]))
    sizes = each.groupBy("run_id").agg(F.max("finish_us").alias("path_us"), F.count("*").alias("n_elements"))
    heavy = F.col("on_path") & (F.col("dur_us") >= HEAVY * F.col("path_us"))
    wide = (F.col("n_elements") > 1) & (F.col("n_down") >= WIDE * (F.col("n_elements") - 1))
    per = each.join(sizes, "run_id").groupBy("run_id", "path_us", "n_elements").agg(F.count_if(heavy).alias("n_heavy"), F.avg((F.col("slack_us") == 0).cast("int")).alias("zero_slack_share"), F.count_if(wide).alias("n_blast"))
    latent = G.latent_heavies(nodes, edges).groupBy("run_id").agg(F.count("*").alias("n_latent"))
    joint = G.joint_saving(nodes, edges, members).select("run_id", F.col("saving_us").alias("joint_us"))
    return per.join(latent, "run_id", "left").join(joint, "run_id", "left").na.fill(0, ["n_latent"])


def cache_figures(tasks: DataFrame) -> DataFrame:
    """(run_id, n_failed, failed_us, n_cached, hit_ratio, transfer_share) from the kinds of the tasks."""
    kind = F.col("task_kind")
    took = F.col("finish_us") - F.col("start_us")
    cached, built = F.count_if(kind == "PULL"), F.count_if(kind == "BUILD")
    return tasks.groupBy("run_id").agg(
        F.count_if("failed").alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("failed"), took)), F.lit(0)).alias("failed_us"),
        cached.alias("n_cached"),
        F.when(cached + built > 0, cached / (cached + built)).alias("hit_ratio"),
        F.when(F.sum(took) > 0, F.coalesce(F.sum(F.when(kind.isin("PULL", "PUSH"), took)), F.lit(0)) / F.sum(took)).alias("transfer_share"),
    )


def coverage(nodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """(run_id, coverage): share of the graph's elements that have a task."""
    seen = tasks.select("run_id", F.col("element_uid").alias("uid"), F.lit(1).alias("seen")).distinct()
    return nodes.select("run_id", "uid").join(seen, ["run_id", "uid"], "left").groupBy("run_id").agg(F.avg(F.coalesce("seen", F.lit(0))).alias("coverage"))


def run_figures(tasks: DataFrame, deps: DataFrame, nodes: DataFrame, edges: DataFrame, capacities: dict[str, int], max_jobs: int | None, context: DataFrame) -> DataFrame:
    """One row of figures for each run.

    tasks: as for ``blame``, with ``failed``; context: (run_id, builders, jobs, cores, cpu_budget,
    memory_budget_mb, job_mb, wall_us, n_hashes, hashes_missing, interrupted, suspended_s).
    """
    tasks = shared_cut(tasks)
    horizons = I.horizon(tasks, "start_us", "finish_us").select("run_id", "horizon_us")
    graph = shared_cut(graph_figures(nodes, edges))
    blame = blame_figures(shared_cut(B.attribution(tasks, deps, capacities, max_jobs)), tasks)
    timed = tasks.withColumn("dur_us", F.col("finish_us") - F.col("start_us"))
    longest = timed.groupBy("run_id").agg(F.max("dur_us").alias("longest_us"))
    floors = S.floors(horizons, graph.select("run_id", "path_us"), K.resource_work(timed), capacities, longest).drop("path_us")
    row = floors.join(graph, "run_id").join(blame, "run_id").join(cache_figures(tasks), "run_id").join(coverage(nodes, tasks), "run_id").join(context, "run_id", "left")
    row = row.withColumns(
        {
            "total_us": F.col("horizon_us"),
            "t_c_us": F.col("horizon_us"),
            "penalised_us": F.col("idle_us"),
            "wait_share": F.when(F.col("horizon_us") > 0, F.col("largest_wait_us") / F.col("horizon_us")),
            "run_mode": run_mode(F.col("n_cached")),
            "incomplete": incomplete_reason(F.col("n_failed"), F.col("interrupted"), F.col("suspended_s")),
            "hard_gates_failed": F.when(F.col("efficiency") > 1, 1).otherwise(0),
        }
    )
    return C.confidence(row)


#: Figures that a run may lack, with their kinds; findings on them are made where they are given.
_OPTIONAL = {"n_steps": "long", "criticality_max": "double", "criticality_min": "double", "fits": "boolean", "first_not_fitting": "long", "recommended": "long", "n_shared_sources": "long"}


def findings(figures: DataFrame) -> DataFrame:
    """(run_id, id, severity, sequence) of all rules, in the order in which they are shown."""
    full = figures.withColumns({c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in figures.columns})
    state = C.run_findings(full).select("run_id", "id", "severity", "sequence")
    return state.unionByName(S.outlook(full).withColumn("sequence", F.col("sequence") + 100))


def violations(figures: DataFrame) -> DataFrame:
    """(run_id, type) of the rules on the run itself and on its declared capacities."""
    return S.run_violations(figures).unionByName(C.capacity_violations(figures))


def comparisons(figures: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(base_id, run_id, refusal, confidence, delta_us, efficiency_delta) of each pair (base_id, run_id, same_host)."""
    uids = nodes.select("run_id", F.col("uid")).distinct()
    sizes = uids.groupBy("run_id").agg(F.count("*").alias("n"))
    both = pairs.join(uids, "run_id").join(uids.withColumnRenamed("run_id", "base_id"), ["base_id", "uid"]).groupBy("base_id", "run_id").agg(F.count("*").alias("n_shared"))
    own = figures.select("run_id", "incomplete", F.col("horizon_us").alias("candidate_us"), F.col("run_mode").alias("mode"), "efficiency").join(sizes, "run_id")
    base = figures.select(F.col("run_id").alias("base_id"), F.col("incomplete").alias("base_incomplete"), F.col("horizon_us").alias("base_us"), F.col("run_mode").alias("base_mode"), F.col("efficiency").alias("base_efficiency")).join(sizes.select(F.col("run_id").alias("base_id"), F.col("n").alias("base_n")), "base_id")
    joined = pairs.join(both, ["base_id", "run_id"], "left").join(own, "run_id").join(base, "base_id").na.fill(0, ["n_shared"]).withColumn("n_union", F.col("n") + F.col("base_n") - F.col("n_shared"))
    judged = S.comparability(joined)
    shown = lambda c: F.when(F.col("refusal").isNull(), c)
    return judged.select("base_id", "run_id", "refusal", "confidence", shown(F.col("candidate_us") - F.col("base_us")).alias("delta_us"), shown(F.col("efficiency") - F.col("base_efficiency")).alias("efficiency_delta"))
