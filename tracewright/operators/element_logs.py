"""Element-log analytics: what staging and caching cost beside the work, repetition, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.scalars import is_empty_command, phase_family, tidy_command

#: Fixed value: the phase family that is the work itself.
WORK_PHASE = "Running commands"


def sandbox_tax(logs: DataFrame) -> DataFrame:
    """(family, n, total_us): time of each phase family over all logs; all but the work is toll."""
    p = logs.select("element", F.explode("phases").alias("p")).filter("p.duration_us IS NOT NULL")
    return p.groupBy(phase_family(F.col("p.name")).alias("family")).agg(F.count("*").alias("n"), F.sum("p.duration_us").alias("total_us"), F.count_distinct("element").alias("n_elements")).withColumn("is_work", F.col("family") == WORK_PHASE)


def phase_breakdown(logs: DataFrame, least_share: float = 0.05) -> DataFrame:
    """(path, name, duration_us, share) of the phases that take a good part of their log's total."""
    p = logs.filter("total_us > 0").select("path", "total_us", F.explode("phases").alias("p"))
    return p.select("path", "p.name", "p.duration_us", (F.col("p.duration_us") / F.col("total_us")).alias("share")).filter(F.col("share") >= least_share)


def configure_tax(logs: DataFrame) -> DataFrame:
    return logs.select("element", F.explode("self_timed").alias("s")).groupBy("element").agg(F.sum("s.duration_us").alias("configure_us"))


def repeated_commands(commands: DataFrame, least_elements: int = 3) -> DataFrame:
    """Commands that many elements run; (element, command)."""
    tidy = commands.select("element", tidy_command(F.col("command")).alias("command")).filter(~is_empty_command(F.col("command")))
    return tidy.groupBy("command").agg(F.count_distinct("element").alias("n_elements"), F.count("*").alias("n")).filter(F.col("n_elements") >= least_elements)


def consecutive_builds(history: DataFrame) -> DataFrame:
    """``history`` (element, started_us, path, cache_key) with the previous key and whether it changed."""
    w = Window.partitionBy("element").orderBy("started_us", "path")
    before = history.withColumn("previous_key", F.lag("cache_key").over(w))
    return before.withColumn("changed", F.when(F.col("previous_key").isNotNull(), ~F.col("cache_key").eqNullSafe(F.col("previous_key"))))


def key_changed_between(history: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, element, changed): whether the last key in (t0, t1] differs from the last one up to t0.

    Null where either is missing. windows: (window_id, element, t0, t1).
    """
    j = windows.join(history, "element")
    at = F.struct("started_us", "path")
    old = F.max_by("cache_key", F.when(F.col("started_us") <= F.col("t0"), at))
    new = F.max_by("cache_key", F.when((F.col("started_us") > F.col("t0")) & (F.col("started_us") <= F.col("t1")), at))
    return j.groupBy("window_id", "element").agg(old.alias("old_key"), new.alias("new_key")).withColumn("changed", F.col("old_key") != F.col("new_key"))


def developer_tax(history: DataFrame) -> DataFrame:
    """Per element: builds, failures, total time, and how many builds had a new key."""
    h = consecutive_builds(history)
    return h.groupBy("element").agg(F.count("*").alias("n_builds"), F.count_if(F.col("outcome") == "FAILURE").alias("n_failed"), F.sum("total_us").alias("total_us"), F.count_if("changed").alias("n_changed"))


def log_tree_summary(logs: DataFrame) -> DataFrame:
    return logs.groupBy("project").agg(F.count("*").alias("n_logs"), F.count_distinct("element").alias("n_elements"), F.min("started_us").alias("first_us"), F.max("started_us").alias("last_us"))
