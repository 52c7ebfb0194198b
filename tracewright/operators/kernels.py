"""What a run could have taken: makespan bounds by capacity, and criticality by sampling.

No schedule is played through. Under any list schedule a run takes at least its longest
path and at least the work of each resource divided by its capacity, and at most their sum
(the last task of the path never waits while a slot is free): both bounds come from plain
aggregates, at any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.graph import Dag, over_runs


def path_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, path_us): longest path of each run."""
    return over_runs(nodes, edges, lambda dag, given: [(dag.length(given["dur_us"]),)], "path_us long")


def resource_work(tasks: DataFrame) -> DataFrame:
    """(run_id, resource, work_us)."""
    return tasks.select("run_id", "dur_us", F.explode("resources").alias("resource")).groupBy("run_id", "resource").agg(F.sum("dur_us").alias("work_us"))


def makespan_bounds(paths: DataFrame, work: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(run_id, lower_us, upper_us, bound_by): bounds on the makespan, and what sets the lower one.

    Resources without a declared capacity bound nothing; ``bound_by`` is null where no
    resource takes longer than the path.
    """
    limits = work.sparkSession.createDataFrame(list(capacities.items()), "resource string, capacity long")
    each = work.join(F.broadcast(limits), "resource").withColumn("need_us", F.ceil(F.col("work_us") / F.col("capacity")))
    per = each.groupBy("run_id").agg(F.max("need_us").alias("need_us"), F.min_by("resource", F.struct(-F.col("need_us"), "resource")).alias("tightest"), F.sum("need_us").alias("sum_us"))
    out = paths.join(per, "run_id", "left")
    need = F.coalesce("need_us", F.lit(0))
    return out.select("run_id", F.greatest("path_us", need).alias("lower_us"), (F.col("path_us") + F.coalesce("sum_us", F.lit(0))).alias("upper_us"), F.when(need > F.col("path_us"), F.col("tightest")).alias("bound_by"))


def scenario_bounds(paths: DataFrame, work: DataFrame, scenarios: dict[str, dict[str, int]]) -> DataFrame:
    """(run_id, scenario, lower_us, upper_us, bound_by): the bounds under each of a few sets of capacities."""
    out = None
    for name, capacities in sorted(scenarios.items()):
        one = makespan_bounds(paths, work, capacities).withColumn("scenario", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("run_id", "scenario", "lower_us", "upper_us", "bound_by")


def capacity_sweep(paths: DataFrame, work: DataFrame, resource: str, lowest: int, highest: int, knee: float = 0.05) -> DataFrame:
    """(run_id, capacity, lower_us, improvement, is_knee): lower bound at each capacity of one resource; the knee is the last one that still gains."""
    own = paths.join(work.filter(F.col("resource") == resource).select("run_id", "work_us"), "run_id", "left")
    steps = own.select("*", F.explode(F.sequence(F.lit(lowest).cast("long"), F.lit(highest).cast("long"))).alias("capacity"))
    lower = F.greatest("path_us", F.ceil(F.coalesce("work_us", F.lit(0)) / F.col("capacity")))
    w = Window.partitionBy("run_id").orderBy("capacity")
    swept = steps.select("run_id", "capacity", lower.alias("lower_us")).withColumn("before_us", F.lag("lower_us").over(w))
    gained = swept.withColumn("improvement", F.when(F.col("before_us") > 0, (F.col("before_us") - F.col("lower_us")) / F.col("before_us")))
    last = F.max(F.when(F.col("improvement") >= knee, F.col("capacity"))).over(Window.partitionBy("run_id"))
    return gained.withColumn("is_knee", F.col("capacity") == F.coalesce(last, F.lit(lowest))).select("run_id", "capacity", "lower_us", "improvement", "is_knee")


def sampled(durations: np.ndarray, sample: int, spread: float, seed: int) -> np.ndarray:
    """The durations of one sample, each off by up to ``spread``; the same in whichever block the sample is."""
    return (durations * np.random.default_rng([seed, sample]).uniform(1 - spread, 1 + spread, len(durations))).astype(np.int64)


def on_longest(dag: Dag, durations: np.ndarray) -> np.ndarray:
    """How often each element of ``dag.uids`` is on the longest path, over rows of durations; level by level, all rows at once."""
    place = {u: i for i, u in enumerate(dag.uids)}
    before = [np.array([place[p] for p in dag.before[u]], np.int64) for u in dag.uids]
    ends = np.zeros_like(durations)
    for u in dag.order:
        i = place[u]
        ends[:, i] = durations[:, i] + (ends[:, before[i]].max(axis=1) if len(before[i]) else 0)
    sinks = np.array([place[u] for u in dag.uids if not dag.after[u]], np.int64)
    hits, rows = np.zeros(len(dag.uids), np.int64), np.arange(len(durations))
    at = sinks[ends[:, sinks].argmax(axis=1)]  # the first of equal ones has the smaller uid
    while len(rows):
        np.add.at(hits, at, 1)
        goes_on = np.array([len(before[i]) > 0 for i in at.tolist()])
        rows, at = rows[goes_on], at[goes_on]
        for i in np.unique(at).tolist():
            own = at == i
            at[own] = -1 - before[i][ends[np.ix_(rows[own], before[i])].argmax(axis=1)]  # marked, so that no later element takes it again
        at = -1 - at
    return hits


def criticality(nodes: DataFrame, edges: DataFrame, samples: int = 200, spread: float = 0.1, seed: int = 42, block: int = 50) -> DataFrame:
    """(run_id, uid, probability): share of samples with perturbed durations whose longest path holds the element.

    A task takes ``block`` samples of a run; every sample has a stream of its own, so the
    probabilities are the same however the samples are dealt.
    """
    blocks = -(-samples // block)

    def one(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        dag = Dag(n["uid"].tolist(), list(zip(e["predecessor"], e["successor"], strict=True)))
        given = dict(zip(n["uid"], n["dur_us"].tolist(), strict=True))
        durations = np.array([given[u] for u in dag.uids], np.float64)
        rows = np.stack([sampled(durations, s, spread, seed) for s in range(int(key[1]) * block, min(samples, int(key[1]) * block + block))])
        return pd.DataFrame({"run_id": key[0], "uid": dag.uids, "hits": on_longest(dag, rows)})

    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    left = nodes.select("run_id", "uid", "dur_us", every).groupBy("run_id", "block")
    right = edges.select("run_id", "predecessor", "successor", every).groupBy("run_id", "block")
    # edges of a run without elements, if any, have nothing to count
    counted = left.cogroup(right).applyInPandas(lambda key, n, e: one(key, n, e) if len(n) else pd.DataFrame({"run_id": [], "uid": [], "hits": []}), "run_id long, uid string, hits long")
    return counted.groupBy("run_id", "uid").agg((F.sum("hits") / samples).alias("probability"))
