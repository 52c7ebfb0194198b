"""From raw spans to tasks: quantised times, readiness, violations, dependencies, attempts.

Every frame carries ``run_id``; see ``sources`` for the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.scalars import quantise


def quantised(spans: DataFrame, epsilon: int = 50_000) -> DataFrame:
    """``spans`` with start_us and finish_us, both rounded on their own."""
    return spans.withColumns({"start_us": quantise(F.col("ts_us"), epsilon), "finish_us": quantise(F.col("ts_us") + F.col("dur_us"), epsilon)})


def build_finishes(tasks: DataFrame) -> DataFrame:
    """(run_id, uid, build_key, build_finish_us): of several builds of an element the last in input order counts."""
    last = F.max_by(F.struct("finish_us", "task_key"), "span_seq").alias("x")
    return tasks.filter("task_kind = 'BUILD'").groupBy("run_id", F.col("element_uid").alias("uid")).agg(last).select("run_id", "uid", F.col("x.task_key").alias("build_key"), F.col("x.finish_us").alias("build_finish_us"))


def ready_times(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """``tasks`` with ready_us: a build is ready when its last non-runtime predecessor was built, others at their start."""
    done = build_finishes(tasks).select("run_id", F.col("uid").alias("predecessor"), "build_finish_us")
    ready = edges.filter("dependency_type <> 'runtime'").join(done, ["run_id", "predecessor"]).groupBy("run_id", F.col("successor").alias("element_uid")).agg(F.max("build_finish_us").alias("after_us"))
    joined = tasks.join(ready, ["run_id", "element_uid"], "left")
    own = F.when((F.col("task_kind") == "BUILD") & F.col("after_us").isNotNull(), F.col("after_us")).otherwise(F.col("start_us"))
    return joined.withColumn("ready_us", own).drop("after_us")


def ordering_violations(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Builds that start before a predecessor is built: (run_id, predecessor, task_key, gap_us), the gap negative."""
    done = build_finishes(tasks).select("run_id", F.col("uid").alias("predecessor"), "build_finish_us")
    starts = tasks.filter("task_kind = 'BUILD'").select("run_id", F.col("element_uid").alias("successor"), "task_key", "start_us")
    pairs = edges.filter("dependency_type <> 'runtime'").join(done, ["run_id", "predecessor"]).join(starts, ["run_id", "successor"])
    return pairs.filter("build_finish_us > start_us").select("run_id", "predecessor", "task_key", (F.col("start_us") - F.col("build_finish_us")).alias("gap_us"))


def clamped(ready: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks whose start is not before they were ready, and violations for those that would end before they start."""
    moved = ready.withColumn("start_us", F.greatest("start_us", "ready_us"))
    return moved.filter("start_us <= finish_us"), moved.filter("start_us > finish_us").select("run_id", "task_key", F.lit("clamp_negative_duration").alias("type"), (F.col("finish_us") - F.col("start_us")).alias("gap_us"))


def task_dependencies(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, task_key, pred_key): a build waits for its element's fetches and its predecessors' builds."""
    builds = tasks.filter("task_kind = 'BUILD'").select("run_id", "element_uid", "task_key")
    fetches = tasks.filter("task_kind = 'FETCH'").select("run_id", "element_uid", F.col("task_key").alias("pred_key"))
    done = build_finishes(tasks).select("run_id", F.col("uid").alias("predecessor"), F.col("build_key").alias("pred_key"))
    before = edges.filter("dependency_type <> 'runtime'").join(done, ["run_id", "predecessor"]).select("run_id", F.col("successor").alias("element_uid"), "pred_key")
    return builds.join(fetches.unionByName(before), ["run_id", "element_uid"]).select("run_id", "task_key", "pred_key")


def superseded(spans: DataFrame) -> DataFrame:
    """Retried spans: not the last attempt of their element, kind and phase."""
    w = Window.partitionBy("run_id", "element_uid", "task_kind", "phase")
    return spans.withColumn("last_attempt", F.max("attempt").over(w)).filter("attempt < last_attempt")


def retry_predecessors(spans: DataFrame) -> DataFrame:
    w = Window.partitionBy("run_id", "element_uid", "task_kind", "phase").orderBy("attempt")
    return spans.withColumn("retry_of", F.lag("task_key").over(w))


#: The order of the kinds within an element.
KIND_ORDER = {"TRACK": 0, "PULL": 1, "FETCH": 1, "BUILD": 2, "PUSH": 3}


def element_predecessors(spans: DataFrame) -> DataFrame:
    """``spans`` with intra_pred: the latest task of a lower kind of the same element and attempt."""
    rank = F.create_map(*[x for k, v in KIND_ORDER.items() for x in (F.lit(k), F.lit(v))])
    ranked = spans.withColumn("kind_rank", F.element_at(rank, F.col("task_kind")))
    w = Window.partitionBy("run_id", "element_uid", "attempt").orderBy("kind_rank").rangeBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.when(F.col("kind_rank").isNotNull(), F.struct("kind_rank", "finish_us", "task_key"))).over(w)
    return ranked.withColumn("intra_pred", F.when(F.col("kind_rank").isNotNull(), latest["task_key"])).drop("kind_rank")


def rebuilt(spans: DataFrame, history: DataFrame) -> DataFrame:
    """Builds whose cache key was built before."""
    return spans.filter("task_kind = 'BUILD'").join(history.filter("task_kind = 'BUILD' AND cache_key IS NOT NULL").select("cache_key").distinct(), "cache_key", "left_semi")
