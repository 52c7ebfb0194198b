"""Process-log analytics: pairing, stream merge, correlation, CPU, memory, redundancy, opened files."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.scalars import binary_class, binary_name, command_signature, is_configure_root, requested_jobs
from tracewright.operators.graph import shared_cut
from tracewright.operators.intervals import point_join, slices

KEY = ("scope", "pid", "src")


def paired(events: DataFrame) -> DataFrame:
    """One record per process from START and END events, by sessions of one pid.

    A START right after a START of the same parent continues the process (exec), one of
    another parent means the pid was used again; an END closes. Processes without an END
    stay open. Ends without a start are dropped here and counted by ``unmatched_ends``.
    """
    scoped = events.withColumn("scope", F.coalesce("invocation", "element"))
    w = Window.partitionBy(*KEY).orderBy("ts_us", "line_no")
    prev, prev_ppid, is_start = F.lag("event").over(w), F.lag("ppid").over(w), F.col("event") == "START"
    opens = is_start & (prev.isNull() | (prev == "END") | (prev_ppid != F.col("ppid")))
    flagged = scoped.withColumns({"opens": F.when(opens, 1).otherwise(0), "after_end": F.coalesce(prev == "END", F.lit(True)) & ~is_start})
    numbered = flagged.filter("NOT after_end").withColumn("session", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    starts = lambda c: F.when(is_start, c)
    ends = lambda c: F.when(~is_start, c)
    order = F.struct("ts_us", "line_no")
    return numbered.groupBy(*KEY, "session").agg(
        F.min_by("element", order).alias("element"),
        F.max_by("ppid", F.when(is_start, order)).alias("ppid"),
        F.min_by("invocation", order).alias("invocation"),
        F.min(starts(F.col("ts_us"))).alias("start_us"),
        F.max(ends(F.col("ts_us"))).alias("end_us"),
        F.max_by("cmd", F.when(is_start, order)).alias("cmd"),
        F.count_if(is_start).alias("exec_chain"),
        F.max(ends(F.col("cpu_us"))).alias("cpu_us"),
        F.max(ends(F.col("rss_kb"))).alias("rss_kb"),
        F.max(ends(F.col("exit_status"))).alias("exit_status"),
    ).withColumn("open", F.col("end_us").isNull())


def unmatched_ends(events: DataFrame) -> DataFrame:
    scoped = events.withColumn("scope", F.coalesce("invocation", "element"))
    prev = F.lag("event").over(Window.partitionBy(*KEY).orderBy("ts_us", "line_no"))
    return scoped.withColumn("prev", prev).filter("event = 'END' AND (prev IS NULL OR prev = 'END')").groupBy("scope").agg(F.count("*").alias("n_unmatched"))


def merged_streams(hook: DataFrame, spine: DataFrame, tolerance_us: int = 1_000_000) -> DataFrame:
    """Records of two streams joined one to one: same scope and pid, nearest start within the tolerance.

    Spine records choose in order of their start; the hook's CPU time wins where both know it.
    Left-over records of both sides stay, with their coverage. Inputs: (scope, pid, start_us, cpu_us).
    """

    def one(key, h: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        h, s = h.sort_values("start_us", ignore_index=True), s.sort_values("start_us", ignore_index=True)
        free, places, rows = h["start_us"].tolist(), list(range(len(h))), []
        for t, cpu in zip(s["start_us"], s["cpu_us"], strict=True):
            right = bisect_left(free, t)
            near = [bisect_left(free, free[right - 1])] if right else []  # the first of equal starts
            near += [right] if right < len(free) else []
            at = min(near, key=lambda i: (abs(free[i] - t), free[i]), default=None)
            if at is not None and abs(free[at] - t) <= tolerance_us:
                start, own = free.pop(at), h["cpu_us"][places.pop(at)]
                rows.append((*key, start, t, cpu if pd.isna(own) else own, "both"))
            else:
                rows.append((*key, None, t, cpu, "spine"))
        rows += [(*key, start, None, h["cpu_us"][i], "hook") for start, i in zip(free, places, strict=True)]
        return pd.DataFrame(rows, columns=["scope", "pid", "hook_us", "spine_us", "cpu_us", "coverage"]).astype({"hook_us": "Int64", "spine_us": "Int64", "cpu_us": "Int64"})

    side = lambda df, x: df.select("scope", "pid", F.col("start_us").alias(f"{x}_us"), F.col("cpu_us").alias(f"{x}_cpu"))
    h, s = side(hook, "hook"), side(spine, "spine")
    reach = s.withColumns({"s0": F.col("spine_us") - tolerance_us, "s1": F.col("spine_us") + tolerance_us + 1})
    pairs = point_join(h, reach, ["scope", "pid"], "hook_us", ("s0", "s1"), 4 * tolerance_us).drop("s0", "s1")
    several = lambda c: F.count("*").over(Window.partitionBy("scope", "pid", c)) > 1
    contested = pairs.withColumn("c", several("hook_us") | several("spine_us")).filter("c").select("scope", "pid").distinct()
    # nearly all records meet one partner at most: only the processes where some do not are matched one by one
    own = lambda df: df.join(contested, ["scope", "pid"], "left_anti")
    null = F.lit(None).cast("long")
    plain = own(pairs).select("scope", "pid", "hook_us", "spine_us", F.coalesce("hook_cpu", "spine_cpu").alias("cpu_us"), F.lit("both").alias("coverage"))
    lone_h = own(h).join(pairs.select("scope", "pid", "hook_us"), ["scope", "pid", "hook_us"], "left_anti").select("scope", "pid", "hook_us", null.alias("spine_us"), F.col("hook_cpu").alias("cpu_us"), F.lit("hook").alias("coverage"))
    lone_s = own(s).join(pairs.select("scope", "pid", "spine_us"), ["scope", "pid", "spine_us"], "left_anti").select("scope", "pid", null.alias("hook_us"), "spine_us", F.col("spine_cpu").alias("cpu_us"), F.lit("spine").alias("coverage"))
    named = lambda df, x: df.join(contested, ["scope", "pid"], "left_semi").select(F.col("scope").alias(f"{x}_scope"), F.col("pid").alias(f"{x}_pid"), F.col("start_us").alias("start_us"), F.col("cpu_us").alias("cpu_us"))
    matched = named(hook, "h").groupBy("h_scope", "h_pid").cogroup(named(spine, "s").groupBy("s_scope", "s_pid")).applyInPandas(one, "scope string, pid long, hook_us long, spine_us long, cpu_us long, coverage string")
    return plain.unionByName(lone_h).unionByName(lone_s).unionByName(matched)


def correlated(invocations: DataFrame, builds: DataFrame, width: int = 600_000_000) -> DataFrame:
    """(invocation, element, verdict): the build that was running when a sandbox started.

    Exactly one is ``resolved``, several are ``ambiguous`` (no element), none ``unmatched``.
    invocations: (invocation, at_us); builds: (element, b0, b1).
    """
    hits = point_join(invocations.withColumn("one", F.lit(1)), builds.withColumn("one", F.lit(1)), ["one"], "at_us", ("b0", "b1"), width)
    n = hits.groupBy("invocation").agg(F.count("*").alias("n"), F.min("element").alias("element"))
    verdict = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return invocations.join(n, "invocation", "left").select("invocation", F.when(F.col("n") == 1, F.col("element")).alias("element"), verdict.alias("verdict"))


def cpu_times(procs: DataFrame) -> DataFrame:
    """Per element: CPU time of measured processes, how many were and were not, and CPU per wall time."""
    span = F.max("end_us") - F.min("start_us")
    return procs.groupBy("element").agg(F.sum("cpu_us").alias("cpu_us"), F.count("cpu_us").alias("measured"), F.count_if(F.col("cpu_us").isNull()).alias("unmeasured"), span.alias("span_us"), F.when(span > 0, F.sum("cpu_us") / span).alias("cpu_per_wall"))


def peak_memory(procs: DataFrame) -> DataFrame:
    """Largest process of each element; peaks are never summed."""
    return procs.groupBy("element").agg(F.max("rss_kb").alias("peak_kb"), F.max_by("cmd", F.struct("rss_kb", "start_us")).alias("cmd"))


def binary_costs(procs: DataFrame, top: int = 5) -> DataFrame:
    """The programs of each element that cost most CPU time."""
    g = procs.withColumn("binary", binary_name(F.col("cmd"))).groupBy("element", "binary").agg(F.count("*").alias("n"), F.coalesce(F.sum("cpu_us"), F.lit(0)).alias("cpu_us"))
    nth = F.row_number().over(Window.partitionBy("element").orderBy(F.desc("cpu_us"), "binary"))
    return g.withColumns({"class": binary_class(F.col("binary")), "rank": nth}).filter(F.col("rank") <= top)


def redundant_operations(procs: DataFrame, least_elements: int = 2) -> DataFrame:
    """Commands that several elements run, apart from what differs between runs."""
    wall = F.coalesce(F.col("end_us") - F.col("start_us"), F.lit(0))
    g = procs.withColumns({"signature": command_signature(F.col("cmd")), "wall_us": wall}).groupBy("signature")
    return g.agg(F.count_distinct("element").alias("n_elements"), F.count("*").alias("n"), F.sum("wall_us").alias("wall_us"), F.max_by("element", F.struct("wall_us", "element")).alias("worst_element")).filter(F.col("n_elements") >= least_elements)


def parallelism(procs: DataFrame) -> DataFrame:
    """Per element: most processes at once, mean, and the jobs that its make asked for."""
    cut = slices(procs.filter("end_us IS NOT NULL"), ("element",), "start_us", "end_us")
    width = F.col("end_us") - F.col("start_us")
    g = cut.groupBy("element").agg(F.max("n_active").alias("peak"), F.sum(width * F.col("n_active")).alias("area_us"), F.sum(width).alias("busy_us"))
    asked = procs.groupBy("element").agg(F.max(requested_jobs(F.col("cmd"))).alias("requested_jobs"))
    out = g.join(asked, "element", "left")
    return out.withColumns({"pinned_to_one_job": F.coalesce(F.col("requested_jobs") == 1, F.lit(False)), "underachieved": F.coalesce(F.col("area_us") / F.col("busy_us") < 0.5 * F.col("requested_jobs"), F.lit(False))})


def attribution_reliability(procs: DataFrame) -> DataFrame:
    """Share of processes whose element is known by name, and the largest element's share."""
    g = procs.groupBy("element").agg(F.count("*").alias("n"), F.coalesce(F.first("element").endswith(".bst"), F.lit(False)).alias("known"))
    return g.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)) / F.sum("n")).alias("recognised"), F.max_by("element", F.struct("n", "element")).alias("largest"), (F.max("n") / F.sum("n")).alias("largest_share"))


def configure_split(procs: DataFrame) -> DataFrame:
    """CPU time below configure steps and elsewhere; a process is below one if any ancestor is.

    The process tree (ppid to pid in one scope) is walked downward from the roots, one small job per level.
    """
    keyed = shared_cut(procs.withColumn("own", is_configure_root(F.col("cmd"))).select("scope", "pid", "ppid", "element", "cpu_us", "own"))
    under = keyed.filter("own").select("scope", "pid").distinct()
    frontier = under
    while True:
        step = keyed.join(frontier.withColumnRenamed("pid", "ppid"), ["scope", "ppid"], "left_semi").select("scope", "pid").distinct().join(under, ["scope", "pid"], "left_anti")
        frontier = shared_cut(step)
        if frontier.limit(1).count() == 0:
            break
        under = shared_cut(under.unionByName(frontier))
    marked = keyed.join(under.withColumn("below", F.lit(True)), ["scope", "pid"], "left")
    below = F.coalesce("below", F.lit(False))
    return marked.groupBy("element").agg(F.sum(F.when(below, F.col("cpu_us"))).alias("configure_cpu_us"), F.sum(F.when(~below, F.col("cpu_us"))).alias("other_cpu_us"))


def declared_versus_used(declared: DataFrame, staged: DataFrame, opens: DataFrame, coverage: DataFrame, least_files: int = 2) -> DataFrame:
    """(element, dependency, n_staged, n_used, verdict) of each declared dependency.

    declared: (element, dependency); staged: (dependency, path); opens: (element, path);
    coverage: (element) whose opened files were recorded in full.
    """
    files = staged.groupBy("dependency").agg(F.count("*").alias("n_staged"))
    read = declared.join(staged, "dependency").join(opens.distinct(), ["element", "path"]).groupBy("element", "dependency").agg(F.count("*").alias("n_used"))
    seen = coverage.select("element", F.lit(True).alias("covered"))
    out = declared.join(files, "dependency", "left").join(read, ["element", "dependency"], "left").join(seen, "element", "left").na.fill(0, ["n_staged", "n_used"])
    verdict = F.when(F.col("n_used") > 0, "used").when(F.col("covered").isNull(), "uncovered").when(F.col("n_staged") < least_files, "aggregating").otherwise("unused")
    return out.select("element", "dependency", "n_staged", "n_used", verdict.alias("verdict"))


def stream_coverage(merged: DataFrame) -> DataFrame:
    return merged.groupBy("coverage").agg(F.count("*").alias("n"), F.sum("cpu_us").alias("cpu_us"))
