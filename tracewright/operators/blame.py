"""Where the time of a run went: the chain of blame back from its last task, and what each wait on it was.

A task is held up by what it depends on (built predecessors and its own fetches), by the
kind before it in its element, and by its attempt before. Of those that finished before it
started, the last one is to blame. The chain comes from pointer jumping over these pointers,
in as many rounds as the chain's length has binary digits; only the waits on the chain, few
rows, meet the sweeps of resources and of the whole run.

Categories of a run add up to its horizon: ``EXECUTION_ON_CHAIN``, the waits below, and
``IDLE``, which no task on the chain covers. With the wall clock, ``HEAD`` and ``TAIL`` join
them (``with_wall_clock``). Defined differences: one chain a run, from the task that
finishes last (smaller key on ties); predecessors that finish after the task has started
are ordering violations, and not to blame for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import intervals as I
from tracewright.operators import prep as P
from tracewright.operators.graph import shared_cut

WAITS = ("RESOURCE_WAIT", "SCHEDULER_WAIT", "RETRY_WAIT", "DEPENDENCY_WAIT")


def blamed(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(run_id, task_key, pred_key, gap_us): whom each task is held up by, and from when on it waits for no one.

    tasks: with element_uid, task_kind, phase, attempt, start_us, finish_us, ready_us;
    deps: (run_id, task_key, pred_key). ``gap_us`` is null where there is no wait.
    """
    intra = P.element_predecessors(tasks).filter("intra_pred IS NOT NULL").select("run_id", "task_key", F.col("intra_pred").alias("pred_key"), F.lit("intra").alias("by"))
    retry = P.retry_predecessors(tasks).filter("retry_of IS NOT NULL").select("run_id", "task_key", F.col("retry_of").alias("pred_key"), F.lit("retry").alias("by"))
    every = deps.select("run_id", "task_key", "pred_key", F.lit("dep").alias("by")).unionByName(intra).unionByName(retry)
    ends = tasks.select("run_id", F.col("task_key").alias("pred_key"), F.col("finish_us").alias("pred_finish_us"))
    own = tasks.select("run_id", "task_key", "start_us", "ready_us")
    met = every.join(ends, ["run_id", "pred_key"]).join(own, ["run_id", "task_key"])
    before = F.col("pred_finish_us") <= F.col("start_us")
    last = F.min_by(F.struct("pred_key", "pred_finish_us"), F.when(before, F.struct(-F.col("pred_finish_us"), "pred_key"))).alias("last")
    at = lambda by: F.max(F.when(F.col("by") == by, F.col("pred_finish_us")))
    per = met.groupBy("run_id", "task_key").agg(last, at("intra").alias("intra_us"), at("retry").alias("retry_us"), F.max(F.when(before, 1)).alias("some"))
    ready = F.greatest("ready_us", F.coalesce("intra_us", "ready_us"))
    # an attempt that was ready all along waits for the attempt before it
    since = F.when(F.col("retry_us").isNull(), ready).when(ready < F.col("start_us"), F.greatest(ready, "retry_us")).otherwise(F.col("retry_us"))
    joined = own.join(per, ["run_id", "task_key"], "left").withColumn("pred_key", F.when(F.col("some") == 1, F.col("last.pred_key")))
    gap = F.greatest(since, F.when(F.col("some") == 1, F.col("last.pred_finish_us")))
    return joined.select("run_id", "task_key", "pred_key", F.when(gap < F.col("start_us"), gap).alias("gap_us"), F.col("retry_us").isNotNull().alias("is_retry"))


def chain(tasks: DataFrame, pointers: DataFrame) -> DataFrame:
    """(run_id, task_key) on the chain of each run, from its last task back; by pointer jumping over materialised ``pointers``.

    A round takes three doublings in one plan: what is reached, then as far again, and so on.
    It is over when each run has reached a task without a pointer.
    """
    keys = ["run_id", "task_key"]
    first = pointers.select("run_id", "task_key", "pred_key")
    jump = first.filter("pred_key IS NOT NULL")
    reached = tasks.groupBy("run_id").agg(F.min_by("task_key", F.struct(-F.col("finish_us"), "task_key")).alias("task_key"))

    def twice(j: DataFrame) -> DataFrame:
        further = j.select("run_id", F.col("task_key").alias("pred_key"), F.col("pred_key").alias("further"))
        return j.join(further, ["run_id", "pred_key"]).select("run_id", "task_key", F.col("further").alias("pred_key"))

    while True:
        hops = [jump, twice(jump)]
        hops.append(twice(hops[1]))
        for hop in hops:
            reached = reached.unionByName(reached.join(hop, keys).select("run_id", F.col("pred_key").alias("task_key")))
        reached = shared_cut(reached)
        ends = reached.join(first, keys, "left").agg(F.count(F.when(F.col("pred_key").isNull(), 1)), F.countDistinct("run_id")).first()
        if ends[0] == ends[1]:
            return reached
        jump = shared_cut(twice(hops[2]))


def classified_gaps(gaps: DataFrame, tasks: DataFrame, capacities: dict[str, int], max_jobs: int | None, width: int = 600_000_000) -> DataFrame:
    """(run_id, task_key, category, dur_us): what each wait (run_id, task_key, g0, g1, resources, is_retry) was.

    From its start on, a wait alternates between stretches in which a resource that the task
    needs is taken as far as its capacity goes (``RESOURCE_WAIT``) and others, which are
    ``SCHEDULER_WAIT`` where fewer than ``max_jobs`` tasks run at some time in them. The first
    one that is neither, and all behind it, are ``RETRY_WAIT`` or ``DEPENDENCY_WAIT``. A
    resource without a known capacity is never full.
    """
    keys = ["run_id", "task_key"]
    gaps = shared_cut(gaps)
    limits = [x for k, v in capacities.items() for x in (F.lit(k), F.lit(v))]
    limit = F.create_map(*limits) if limits else F.create_map().cast("map<string,int>")
    waits = gaps.select(*keys, "g0", "g1", F.explode(F.array_distinct("resources")).alias("resource")).withColumn("limit", F.try_element_at(limit, F.col("resource"))).filter("limit IS NOT NULL")
    taken = tasks.select("run_id", F.explode("resources").alias("resource"), F.col("task_key").alias("holder"), F.col("start_us").alias("h0"), F.col("finish_us").alias("h1"))
    held = I.overlap_join(waits, taken, ["run_id", "resource"], ("g0", "g1"), ("h0", "h1"), width).filter("holder <> task_key")
    clipped = held.select(*keys, "resource", "limit", F.greatest("g0", "h0").alias("ts_us"), F.least("g1", "h1").alias("finish_us"))
    full = I.slices(clipped, (*keys, "resource", "limit")).filter(F.col("n_active") >= F.col("limit"))
    busy = shared_cut(I.merged(full, tuple(keys), "start_us", "end_us", None).select(*keys, "start_us", "end_us"))
    edges = gaps.select(*keys, F.col("g0").alias("start_us"), F.col("g0").alias("end_us")).unionByName(busy).unionByName(gaps.select(*keys, F.col("g1").alias("start_us"), F.col("g1").alias("end_us")))
    after = F.lead("start_us").over(Window.partitionBy(*keys).orderBy("start_us", "end_us"))
    free = edges.select(*keys, F.col("end_us").alias("f0"), after.alias("f1")).filter("f1 > f0")
    running = I.slices(tasks, ("run_id",), "start_us", "finish_us", I.AUTO).select("run_id", F.col("start_us").alias("s0"), F.col("end_us").alias("s1"), "n_active")
    seen = I.overlap_join(free, running, ["run_id"], ("f0", "f1"), ("s0", "s1"), width).groupBy(*keys, "f0").agg(F.sum(F.least("f1", "s1") - F.greatest("f0", "s0")).alias("covered"), F.min("n_active").alias("least"))
    room = F.lit(False) if max_jobs is None else (F.coalesce("covered", F.lit(0)) < F.col("f1") - F.col("f0")) | (F.col("least") < max_jobs)
    open_ = free.join(seen, [*keys, "f0"], "left").select(*keys, F.col("f0").alias("start_us"), F.col("f1").alias("end_us"), F.when(room, "SCHEDULER_WAIT").alias("category"))
    parts = busy.withColumn("category", F.lit("RESOURCE_WAIT")).unionByName(open_)
    so_far = Window.partitionBy(*keys).orderBy("start_us").rowsBetween(Window.unboundedPreceding, 0)
    lost = F.max(F.col("category").isNull()).over(so_far)
    rest = F.when(F.col("is_retry"), "RETRY_WAIT").otherwise("DEPENDENCY_WAIT")
    named = parts.join(gaps.select(*keys, "is_retry"), keys).withColumn("category", F.when(lost, rest).otherwise(F.col("category")))
    return named.groupBy(*keys, "category").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("dur_us"))


def _chain_parts(tasks: DataFrame, deps: DataFrame, capacities: dict[str, int], max_jobs: int | None) -> tuple[DataFrame, DataFrame]:
    """The tasks on the chain of each run with their pointers, and execution and waits of each."""
    # used again and again below
    tasks = shared_cut(tasks.select("run_id", "task_key", "element_uid", "task_kind", "phase", "attempt", "start_us", "finish_us", "ready_us", "resources"))
    pointers = shared_cut(blamed(tasks, deps))
    on = shared_cut(chain(tasks, pointers).join(pointers, ["run_id", "task_key"]).join(tasks.select("run_id", "task_key", "start_us", "finish_us", "resources"), ["run_id", "task_key"]))
    work = on.select("run_id", "task_key", F.lit("EXECUTION_ON_CHAIN").alias("category"), (F.col("finish_us") - F.col("start_us")).alias("dur_us"))
    gaps = on.filter("gap_us IS NOT NULL").select("run_id", "task_key", F.col("gap_us").alias("g0"), F.col("start_us").alias("g1"), "resources", "is_retry")
    return on, work.unionByName(classified_gaps(gaps, tasks, capacities, max_jobs)).filter("dur_us > 0")


def chain_waits(tasks: DataFrame, deps: DataFrame, capacities: dict[str, int], max_jobs: int | None) -> DataFrame:
    """(run_id, task_key, category, dur_us) of every task on the chain of its run: execution and waits."""
    return _chain_parts(tasks, deps, capacities, max_jobs)[1]


def attribution(tasks: DataFrame, deps: DataFrame, capacities: dict[str, int], max_jobs: int | None) -> DataFrame:
    """(run_id, category, dur_us) of each run.

    ``IDLE`` is what the union of the chain's tasks and waits leaves of the horizon, not what the
    other categories leave: they add up only if the classes of the waits neither overlap nor
    leave anything out, which ``reconciliation`` checks.
    """
    on, spent = _chain_parts(tasks, deps, capacities, max_jobs)
    sums = spent.groupBy("run_id", "category").agg(F.sum("dur_us").alias("dur_us"))
    held = on.select("run_id", F.coalesce("gap_us", "start_us").alias("ts_us"), "finish_us")
    covered = I.merged(held, bucket_us=None).groupBy("run_id").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("covered_us"))
    idle = I.horizon(tasks, "start_us", "finish_us").join(covered, "run_id", "left").select("run_id", F.lit("IDLE").alias("category"), (F.col("horizon_us") - F.coalesce("covered_us", F.lit(0))).alias("dur_us"))
    return sums.unionByName(idle.filter("dur_us > 0"))


def with_wall_clock(attributed: DataFrame, tasks: DataFrame, wall: DataFrame) -> DataFrame:
    """``attributed`` with ``HEAD`` and ``TAIL``, adding up to the wall clock (run_id, wall_start_us, wall_end_us)."""
    ends = I.horizon(tasks, "start_us", "finish_us").join(wall, "run_id")
    head = ends.select("run_id", F.lit("HEAD").alias("category"), F.greatest(F.lit(0), F.col("start_us") - F.col("wall_start_us")).alias("dur_us"))
    tail = ends.select("run_id", F.lit("TAIL").alias("category"), F.greatest(F.lit(0), F.col("wall_end_us") - F.col("end_us")).alias("dur_us"))
    return attributed.unionByName(head.unionByName(tail).filter("dur_us > 0"))


def reconciliation(attributed: DataFrame, tasks: DataFrame) -> DataFrame:
    """(run_id, horizon_us, attributed_us, gap_us): runs whose categories do not add up have a gap other than 0."""
    sums = attributed.filter("category NOT IN ('HEAD', 'TAIL')").groupBy("run_id").agg(F.sum("dur_us").alias("attributed_us"))
    out = I.horizon(tasks, "start_us", "finish_us").join(sums, "run_id", "left").na.fill(0, ["attributed_us"])
    return out.select("run_id", "horizon_us", "attributed_us", (F.col("horizon_us") - F.col("attributed_us")).alias("gap_us"))
