"""Aggregates over tasks and runs: durations, resource work, floors, bands, trends."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_TO_SIGMA = 1.4826


def element_durations(spans: DataFrame) -> DataFrame:
    return spans.groupBy("run_id", "element_uid").agg(F.max("dur_us").alias("dur_max_us"), F.sum("dur_us").alias("dur_sum_us"))


def stage_durations(spans: DataFrame) -> DataFrame:
    """Longest fetch (head) and longest other task (work) of each element."""
    of = lambda fetch: F.coalesce(F.max(F.when((F.col("task_kind") == "FETCH") == fetch, F.col("dur_us"))), F.lit(0))
    return spans.groupBy("run_id", "element_uid").agg(of(True).alias("head_us"), of(False).alias("work_us"))


def resource_work(spans: DataFrame) -> DataFrame:
    return spans.select("run_id", "dur_us", F.explode("resources").alias("resource")).groupBy("run_id", "resource").agg(F.sum("dur_us").alias("work_us"))


def capacity_bound(work: DataFrame, capacity: Column, exclusive: tuple[str, ...] = ()) -> DataFrame:
    """Largest work div capacity over shared resources, and largest work of an exclusive one."""
    shared = ~F.col("resource").isin(*exclusive) if exclusive else F.lit(True)
    each = work.withColumn("capacity", capacity)
    return each.groupBy("run_id").agg(F.max(F.when(shared, F.expr("work_us div capacity"))).alias("capacity_bound_us"), F.max(F.when(~shared, F.col("work_us"))).alias("serial_bound_us"))


def kind_summary(elements: DataFrame, duration: str = "dur_sum_us") -> DataFrame:
    return elements.groupBy(F.coalesce("element_kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"), F.sum(duration).alias("total_us"), F.avg(duration).alias("mean_us"))


def variability(spans: DataFrame, warn: float = 0.3) -> DataFrame:
    """Mean, nearest-rank percentiles and coefficient of variation of each element's durations."""
    at = lambda q: F.element_at(F.col("sorted"), F.least(F.floor(F.col("n") * q) + 1, F.col("n")).cast("int"))
    g = spans.groupBy("run_id", "element_uid", "task_kind").agg(F.count("*").alias("n"), F.avg("dur_us").alias("mean_us"), F.stddev_pop("dur_us").alias("sigma_us"), F.array_sort(F.collect_list("dur_us")).alias("sorted"))
    cv = F.when(F.col("mean_us") > 0, F.col("sigma_us") / F.col("mean_us"))
    return g.select("run_id", "element_uid", "task_kind", "n", "mean_us", at(0.5).alias("p50_us"), at(0.75).alias("p75_us"), at(0.95).alias("p95_us"), cv.alias("cv"), F.coalesce(cv > warn, F.lit(False)).alias("unstable"))


def mad_band(values: DataFrame, by: list[str], value: str, k: float = 3.0, least: int = 3) -> DataFrame:
    """Median, scaled median absolute deviation, and how many values lie outside ``k`` of them."""
    middle = values.groupBy(*by).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    off = values.join(middle, by).withColumn("off", F.abs(F.col(value) - F.col("median")))
    mad = off.groupBy(*by).agg(F.median("off").alias("mad"))
    half = F.lit(k * MAD_TO_SIGMA) * F.col("mad")
    outside = off.join(mad, by).groupBy(*by).agg(F.count_if(F.col("off") > half).alias("n_outside"))
    return middle.join(mad, by).join(outside, by).filter(F.col("n") >= least).withColumn("half_width", half)


def slope(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope, 0 where it is not defined."""
    return points.groupBy(*by).agg(F.coalesce(F.regr_slope(F.col(y), F.col(x)), F.lit(0.0)).alias("slope"))


def anomalies(points: DataFrame, by: list[str], value: str, z: float = 2.0) -> DataFrame:
    """Rows further than ``z`` sample deviations from the mean of their group."""
    w = Window.partitionBy(*by)
    scored = points.withColumns({"mean": F.avg(value).over(w), "sigma": F.stddev_samp(value).over(w)})
    return scored.withColumn("z", F.when(F.col("sigma") > 0, (F.col(value) - F.col("mean")) / F.col("sigma"))).filter(F.abs("z") > z)


def rolling_band(runs: DataFrame, by: list[str], order: str, value: str, rows: int = 20, k: float = 3.0, least: int = 3, floor: float = 0.01) -> DataFrame:
    """Each run against the band of the ``rows`` runs before it: inside, below, above, or too few.

    A window of bounded rows: a series of any length streams through, and holds no more than
    these rows at a time. Missing values count for nothing and are never outside.
    """
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(-rows, -1)
    held = runs.withColumn("held", F.collect_list(value).over(before))
    middle = held.withColumn("middle", _median(F.col("held")))
    spread = middle.withColumn("mad", _median(F.transform("held", lambda x: F.abs(x - F.col("middle")))))
    half = F.greatest(k * MAD_TO_SIGMA * F.col("mad"), floor * F.col("middle"))
    off = F.col(value) - F.col("middle")
    verdict = F.when(F.size("held") < least, "too-few").when(off > half, "above").when(off < -half, "below").otherwise("inside")
    return spread.withColumn("verdict", verdict).drop("held")


def trailing_band(runs: DataFrame, by: list[str], order: str, value: str, k: float = 3.0, least: int = 3, floor: float = 0.01) -> DataFrame:
    """Each run against the band of all runs before it in its series: inside, below, above, or too few.

    One pass over each series in order; the values so far are kept sorted, so medians are read off.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        held: list = []
        middles, mads, verdicts = [], [], []
        for x in pdf[value].tolist():
            n = len(held)
            middle = (held[(n - 1) // 2] + held[n // 2]) / 2 if n else None
            mad = _deviation(held, middle) if n else None
            half = max(k * MAD_TO_SIGMA * mad, floor * middle) if n else None
            missing = x is None or x != x
            verdicts.append("too-few" if n < least else "inside" if missing or middle - half <= x <= middle + half else "above" if x > middle else "below")
            middles.append(middle)
            mads.append(mad)
            if not missing:
                insort(held, x)
        return pdf.assign(middle=pd.Series(middles, dtype="float64"), mad=pd.Series(mads, dtype="float64"), verdict=verdicts)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    return runs.groupBy(*by).applyInPandas(one, f"{kinds}, middle double, mad double, verdict string")


def _deviation(held: list, middle: float) -> float:
    """Median distance from ``middle`` of sorted values, by walking outward from it."""
    n, right = len(held), bisect_left(held, middle)
    left, near = right - 1, []
    while len(near) < n // 2 + 1:
        if right == n or (left >= 0 and middle - held[left] <= held[right] - middle):
            near.append(middle - held[left])
            left -= 1
        else:
            near.append(held[right] - middle)
            right += 1
    return near[-1] if n % 2 else (near[-1] + near[-2]) / 2


def _median(xs: Column) -> Column:
    s, n = F.array_sort(xs), F.size(xs)
    low = F.get(s, F.floor((n - 1) / 2).cast("int"))
    high = F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2.0)


def floors(longest: DataFrame, bounds: DataFrame, horizons: DataFrame) -> DataFrame:
    """Lower bound of a run's time, what is above it, and the efficiency."""
    b = horizons.join(longest, "run_id").join(bounds, "run_id")
    lower = F.greatest("t_inf_us", "capacity_bound_us", "serial_bound_us")
    return b.withColumn("lower_us", lower).withColumns({"headroom_us": F.greatest(F.lit(0), F.col("horizon_us") - F.col("lower_us")), "efficiency": F.when(F.col("horizon_us") > 0, F.col("lower_us") / F.col("horizon_us"))})


def cache_accounting(queue: DataFrame) -> DataFrame:
    """Hit ratio of each run from (run_id, processed, skipped); null where nothing was looked up."""
    total = F.sum("processed") + F.sum("skipped")
    return queue.groupBy("run_id").agg(F.sum("processed").alias("built"), F.sum("skipped").alias("cached"), F.when(total > 0, F.sum("skipped") / total).alias("hit_ratio"))


def memory_envelope(peaks: DataFrame, by: list[str], peak: str, name: str, host_kb: int) -> DataFrame:
    """How many of the largest elements fit together: running sums of descending peaks against the host."""
    w = Window.partitionBy(*by).orderBy(F.desc(peak), name)
    return peaks.withColumns({"together": F.row_number().over(w), "sum_kb": F.sum(peak).over(w.rowsBetween(Window.unboundedPreceding, 0))}).withColumn("fits", F.col("sum_kb") <= host_kb)
