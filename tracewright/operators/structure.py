"""Structure of a run and its bounds: pinned elements, leaves, batches, floors, cold floor, edges that gate for nothing, overheads, violations, comparability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.aggregates import trailing_band
from tracewright.operators.compare import verdicts
from tracewright.operators.graph import Dag, degrees, node_metrics, over_runs


def serialization_points(elements: DataFrame, downstream: DataFrame, multiple: float = 2.0) -> DataFrame:
    """(run_id, uid, max_jobs, typical_max_jobs, dur_us, n_down): long elements held to fewer jobs than is usual in their run, on which others wait.

    elements: (run_id, uid, dur_us, max_jobs, notparallel), nulls mean not known; downstream:
    (run_id, uid, n_down). Long: ``multiple`` of the mean duration above zero. Where the
    whole run works with one job, none is an outlier.
    """
    usual = elements.groupBy("run_id").agg(F.max("max_jobs").alias("typical_max_jobs"), F.avg(F.when(F.col("dur_us") > 0, F.col("dur_us"))).alias("mean_us")).filter("typical_max_jobs > 1")
    pinned = F.coalesce("notparallel", F.lit(False)) | F.coalesce(F.col("max_jobs") < F.col("typical_max_jobs"), F.lit(False))
    held = elements.join(usual, "run_id").filter(pinned & (F.col("dur_us") >= multiple * F.col("mean_us"))).join(downstream, ["run_id", "uid"]).filter("n_down > 0")
    return held.select("run_id", "uid", F.coalesce("max_jobs", F.lit(1)).alias("max_jobs"), "typical_max_jobs", "dur_us", "n_down")


def leaf_analysis(metrics: DataFrame, reachable: DataFrame, on_chain: DataFrame) -> DataFrame:
    """(run_id, uid, is_leaf, on_blame_chain, on_critical_path, is_reachable, is_deferrable) of every element.

    metrics: (run_id, uid, n_down, on_path); reachable: (run_id, uid) that a requested target
    needs, the target included; on_chain: (run_id, uid). Without any requested target in a
    run, all its elements count as reachable.
    """
    asked = reachable.select("run_id").distinct().withColumn("asked", F.lit(True))
    flag = lambda df, name: df.select("run_id", "uid").distinct().withColumn(name, F.lit(True))
    j = metrics.join(asked, "run_id", "left").join(flag(reachable, "reached"), ["run_id", "uid"], "left").join(flag(on_chain, "chained"), ["run_id", "uid"], "left")
    leaf, reached = F.col("n_down") == 0, F.coalesce("reached", F.col("asked").isNull())
    return j.select("run_id", "uid", leaf.alias("is_leaf"), F.coalesce("chained", F.lit(False)).alias("on_blame_chain"), F.col("on_path").alias("on_critical_path"), reached.alias("is_reachable"), (leaf & ~reached).alias("is_deferrable"))


def batch_savings(nodes: DataFrame, edges: DataFrame, candidates: int = 5) -> DataFrame:
    """(run_id, batch, members, combined_us, singles_us): what groups without paths between their members save of the longest path.

    The longest elements go first-fit into groups; groups of one, and those that save
    nothing together, are left out.
    """

    def rows(dag: Dag, given: dict) -> list[tuple]:
        dur, down, bit = given["dur_us"], dag.masks(), {u: 1 << i for i, u in enumerate(dag.uids)}
        total, groups, out = dag.length(dur), [], []
        for u in sorted(dag.uids, key=lambda u: (-dur[u], u))[:candidates]:
            home = next((g for g in groups if all(not (down[u] & bit[x] or down[x] & bit[u]) for x in g)), None)
            groups.append([u]) if home is None else home.append(u)
        for i, g in enumerate(groups):
            saved = total - dag.length({**dur, **dict.fromkeys(g, 0)})
            if len(g) > 1 and saved > 0:
                out.append((i, ",".join(g), saved, sum(total - dag.length({**dur, u: 0}) for u in g)))
        return out

    return over_runs(nodes, edges, rows, "batch long, members string, combined_us long, singles_us long")


def floors(horizons: DataFrame, paths: DataFrame, work: DataFrame, capacities: dict[str, int], longest: DataFrame) -> DataFrame:
    """(run_id, path_us, capacity_us, lower_us, longest_us, horizon_us, headroom_us, efficiency) of each run.

    paths: (run_id, path_us); work: (run_id, resource, work_us); longest: (run_id, longest_us).
    ``lower_us`` is certified by the graph and by the work of the resources with a capacity.
    """
    limits = F.create_map(*[x for k, v in capacities.items() for x in (F.lit(k), F.lit(v))])
    own = work.withColumn("limit", F.try_element_at(limits, F.col("resource"))).filter("limit IS NOT NULL")
    cap = own.groupBy("run_id").agg(F.max(F.expr("work_us div limit")).alias("capacity_us"))
    j = horizons.select("run_id", "horizon_us").join(paths, "run_id").join(cap, "run_id", "left").join(longest, "run_id")
    lower = F.greatest("path_us", F.coalesce("capacity_us", F.lit(0)))
    out = j.withColumn("lower_us", lower)
    return out.select("run_id", "path_us", "capacity_us", "lower_us", "longest_us", "horizon_us", F.greatest(F.lit(0), F.col("horizon_us") - F.col("lower_us")).alias("headroom_us"), F.when(F.col("horizon_us") > 0, F.col("lower_us") / F.col("horizon_us")).alias("efficiency"))


def cold_floor(nodes: DataFrame, edges: DataFrame, cold: DataFrame, allow_partial: bool = False) -> DataFrame:
    """(run_id, cold_path_us, n_unavailable, partial): the longest path if nothing had come from a cache.

    cold: (run_id, element_uid, cold_us) of tasks. An element takes as long as its longest
    task; one without tasks, or with a task of unknown duration, is unavailable. The path is
    withheld (null) where elements are unavailable, unless ``allow_partial`` counts them 0.
    """
    per = cold.groupBy("run_id", F.col("element_uid").alias("uid")).agg(F.max("cold_us").alias("cold_us"), F.count_if(F.col("cold_us").isNull()).alias("unknown"))
    known = nodes.select("run_id", "uid").join(per, ["run_id", "uid"], "left")
    known = known.withColumn("available", F.coalesce(F.col("unknown") == 0, F.lit(False)))
    timed = known.select("run_id", "uid", F.when(F.col("available"), F.col("cold_us")).otherwise(0).alias("dur_us"))
    paths = over_runs(timed, edges, lambda dag, given: [(dag.length(given["dur_us"]),)], "cold_path_us long")
    missing = known.groupBy("run_id").agg(F.count_if(~F.col("available")).alias("n_unavailable"))
    out = paths.join(missing, "run_id")
    shown = F.when((F.col("n_unavailable") == 0) | F.lit(allow_partial), F.col("cold_path_us"))
    return out.select("run_id", shown.alias("cold_path_us"), "n_unavailable", (F.lit(allow_partial) & (F.col("n_unavailable") > 0)).alias("partial"))


def unread_gating_edges(unused: DataFrame, on_path: DataFrame) -> DataFrame:
    """(element, dependency): declared and never read (``unused``), while both hold up the run: on_path (uid)."""
    ends = on_path.select("uid").distinct()
    first = unused.join(ends.withColumnRenamed("uid", "element"), "element", "left_semi")
    return first.join(ends.withColumnRenamed("uid", "dependency"), "dependency", "left_semi").select("element", "dependency")


def pipeline_overhead(phases: DataFrame, horizons: DataFrame) -> DataFrame:
    """(run_id, n_phases, total_us, fraction): time of the phases of the pipeline as a whole; of no element."""
    sums = phases.groupBy("run_id").agg(F.count("*").alias("n_phases"), F.sum("elapsed_us").alias("total_us"))
    return sums.join(horizons.select("run_id", "horizon_us"), "run_id", "left").select("run_id", "n_phases", "total_us", F.when(F.col("horizon_us") > 0, F.col("total_us") / F.col("horizon_us")).alias("fraction"))


def timestamp_agreement(spans: DataFrame, resolution_us: int, material: float = 0.05) -> DataFrame:
    """(run_id, shortest_us, n_tasks, n_material): tasks so short that the clock's resolution is a good part of them."""
    real = spans.filter("dur_us > 0")
    return real.groupBy("run_id").agg(F.min("dur_us").alias("shortest_us"), F.count("*").alias("n_tasks"), F.count_if(F.lit(resolution_us) / F.col("dur_us") > material).alias("n_material"))


def relabelled(procs: DataFrame, correlation: DataFrame) -> DataFrame:
    """``procs`` with the element that a correlation (invocation, element, verdict) resolved, their own one otherwise."""
    known = correlation.filter("verdict = 'resolved'").select("invocation", F.col("element").alias("resolved"))
    return procs.join(known, "invocation", "left").withColumn("element", F.coalesce("resolved", "element")).drop("resolved")


def configure_views(traced: DataFrame, reported: DataFrame) -> DataFrame:
    """Configure time as traced (element, configure_cpu_us) beside what the build tool reports (element, configure_us).

    Clocks differ: they are shown together and never summed. ``self_report_missing`` marks
    elements with a traced configure step that report none.
    """
    j = traced.join(reported, "element", "left")
    silent = F.coalesce(F.col("configure_cpu_us") > 0, F.lit(False)) & (F.coalesce("configure_us", F.lit(0)) == 0)
    return j.select("element", "configure_cpu_us", "configure_us", silent.alias("self_report_missing"))


def checkout_savings(invocations: DataFrame) -> DataFrame:
    """(project, n_individual, individual_us, consolidated_us, savings_us, fraction): many checkouts against one of the same elements.

    invocations: (project, consolidated boolean, overhead_us, elements_us). Each invocation
    pays its own overhead; whether one large one is cheaper is for the figures to say.
    """
    total = F.coalesce("overhead_us", F.lit(0)) + F.coalesce("elements_us", F.lit(0))
    of = lambda one: F.coalesce(F.sum(F.when(F.col("consolidated") == one, total)), F.lit(0))
    sums = invocations.groupBy("project").agg(F.count_if(~F.col("consolidated")).alias("n_individual"), of(False).alias("individual_us"), of(True).alias("consolidated_us"))
    saved = F.col("individual_us") - F.col("consolidated_us")
    return sums.withColumns({"savings_us": saved, "fraction": F.when(F.col("individual_us") != 0, saved / F.col("individual_us"))})


def store_verdicts(snapshots: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Each snapshot against the band of the complete ones before it: inside, below, above, too-few, or null where it is incomplete itself."""
    counted = snapshots.withColumn("counted", F.when(F.col("complete"), F.col(value)))
    judged = trailing_band(counted, by, order, "counted")
    return judged.withColumn("verdict", F.when(F.col("complete"), F.col("verdict"))).drop("counted", "middle", "mad")


def compared(pairs: DataFrame) -> DataFrame:
    """``pairs`` with refusal, confidence and verdict: a refused pair is not comparable whatever its figures. See ``comparability`` and ``verdicts``."""
    judged = verdicts(comparability(pairs))
    return judged.withColumn("verdict", F.when(F.col("refusal").isNotNull(), "not_comparable").otherwise(F.col("verdict")))


def graph_bundle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, uid, in_degree, out_degree, level, finish_us, slack_us, n_up, n_down, on_path): all figures of every element together."""
    degree = degrees(nodes, edges, ["run_id"])
    return node_metrics(nodes, edges).drop("down_us").join(degree, ["run_id", "uid"])


def two_stage_paths(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, length_us): longest path where an element's fetch (``head_us``) may run beside its predecessors and only its ``work_us`` waits for them."""
    return over_runs(stages, edges, lambda dag, given: [(dag.length(given["work_us"], given["head_us"]),)], "length_us long", ("work_us", "head_us"))


def run_violations(runs: DataFrame) -> DataFrame:
    """(run_id, type) from one row of figures; nulls violate nothing. Needs n_failed, reconciliation_gap_us, lower_us, longest_us, hard_gates_failed."""
    c = F.col
    rules = [
        ("build_failed", c("n_failed") > 0),
        ("attribution_reconciliation", c("reconciliation_gap_us") != 0),
        ("floor_below_longest_task", c("lower_us") < c("longest_us")),
        ("hard_gate_failed", c("hard_gates_failed") > 0),
    ]
    types = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules]))
    return runs.select("run_id", F.explode(types).alias("type"))


def comparability(pairs: DataFrame, least_shared: float = 0.5) -> DataFrame:
    """(…, refusal, confidence): why two runs cannot be compared, or null; and how far a comparison goes.

    Needs base_incomplete, incomplete, base_us, candidate_us, n_shared, n_union,
    base_mode, mode, same_host. In order: an incomplete run, a missing duration, graphs that
    share less than ``least_shared`` of their elements, different modes. Another host makes
    the confidence low.
    """
    c = F.col
    first = (
        F.when(c("base_incomplete").isNotNull() | c("incomplete").isNotNull(), "incomplete")
        .when(c("base_us").isNull() | c("candidate_us").isNull(), "no_duration")
        .when(c("n_shared") < least_shared * c("n_union"), "different_graph")
        .when(c("base_mode") != c("mode"), "different_mode")
    )
    low = F.when(c("same_host") == "different", "low").when(c("same_host") == "unknown", "unknown").otherwise("normal")
    return pairs.withColumns({"refusal": first, "confidence": low})


def outlook(runs: DataFrame) -> DataFrame:
    """(run_id, id, severity) of the findings on what to do next, from one row of figures; nulls find nothing.

    Needs total_us, path_us, largest_wait_us, n_heavy, zero_slack_share, joint_us, n_steps, n_latent, n_blast,
    criticality_max, criticality_min, builders, fits, first_not_fitting, recommended, n_shared_sources.
    """
    c = F.col
    chained: Column = c("path_us") >= 0.9 * c("total_us")
    bound = c("largest_wait_us") < 0.01 * c("total_us")
    shown = (chained | bound) & (c("n_heavy") > 0) & (c("path_us") > 0)
    rules = [
        ("time-concentration", F.lit("high"), shown),
        ("mesh-graph", F.lit("info"), shown & (c("zero_slack_share") >= 0.5)),
        ("blast-radius-ranking", F.lit("medium"), ~chained & (c("n_blast") > 0)),
        ("joint-saving", F.lit("high"), (c("joint_us") > 0) & (c("total_us") > 0)),
        ("optimization-horizon", F.lit("high"), c("n_steps") > 1),
        ("latent-heavies", F.lit("medium"), c("n_latent") > 0),
        ("memory-envelope", F.when(~c("fits"), "high").when(c("first_not_fitting") == c("builders") + 1, "medium").otherwise("info"), c("fits").isNotNull()),
        ("capacity-recommendation", F.when(c("recommended") > c("builders"), "medium").when(c("recommended") < c("builders"), "high").otherwise("info"), c("recommended").isNotNull()),
        ("criticality", F.lit("info"), (c("criticality_max") > 0) & (c("criticality_min") < 1)),
        ("shared-source-blast", F.lit("medium"), c("n_shared_sources") > 0),
    ]
    each = F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(name).alias("id"), level.alias("severity"), F.lit(n).alias("sequence"))) for n, (name, level, on) in enumerate(rules)]))
    return runs.select("run_id", F.explode(each).alias("f")).select("run_id", "f.id", "f.severity", "f.sequence")
