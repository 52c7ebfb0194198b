"""Interval analytics: sweeps, occupancy, shares, queues and overlap joins.

Intervals are half-open, in integer microseconds. Sweeps are windows over the sorted
boundaries of one run. Overlap joins put intervals into bins of a chosen width, meet in
the bin of the later start, and so neither repeat a pair nor compare all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of one run that are swept in one task; more are swept in stretches of time.
LONG_RUN = 200_000
#: Look at the rows before choosing: the default of every sweep.
AUTO = -1


def stretch_us(tasks: DataFrame, by: tuple[str, ...], start: str, finish: str) -> int | None:
    """Width of the stretches for the fullest of all sweeps, or None where each fits a task; from one row a sweep."""
    sizes = tasks.groupBy(*by).agg(F.count("*").alias("n"), (F.max(finish) - F.min(start)).alias("long_us"))
    most = sizes.agg(F.max("n"), F.max(F.when(F.col("n") > LONG_RUN, F.floor(F.col("long_us") * LONG_RUN / F.col("n"))))).first()
    return max(1, int(most[1])) if most[1] is not None else None


def _chosen(bucket_us: int | None, tasks: DataFrame, by: tuple[str, ...], start: str, finish: str) -> int | None:
    return stretch_us(tasks, by, start, finish) if bucket_us == AUTO else bucket_us


def running_sums(steps: DataFrame, by: tuple[str, ...], at: str, bucket_us: int | None) -> DataFrame:
    """``steps`` (by…, ``at``, d), one row an instant, with the sum ``total`` of d up to each and the ``next_us`` instant.

    With a width, each stretch of time adds to what the stretches before it leave, which comes
    from one small row a stretch; so a long sweep is many tasks. Keys must not be null then.
    """
    if bucket_us is None:
        w = Window.partitionBy(*by).orderBy(at)
        return steps.withColumns({"total": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "next_us": F.lead(at).over(w)})
    keys = [*by, "stretch"]
    steps = steps.withColumn("stretch", F.floor(F.col(at) / bucket_us))
    w, over = Window.partitionBy(*keys).orderBy(at), Window.partitionBy(*by).orderBy("stretch")
    sums = steps.groupBy(*keys).agg(F.sum("d").alias("own"), F.min(at).alias("first_us"))
    sums = sums.select(*keys, F.coalesce(F.sum("own").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("first_us").over(over).alias("later_us"))
    local = steps.withColumns({"here": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "near_us": F.lead(at).over(w)})
    return local.join(sums, keys).withColumns({"total": F.col("before") + F.col("here"), "next_us": F.coalesce("near_us", "later_us")}).drop("stretch", "here", "near_us", "before", "later_us")


def slices(tasks: DataFrame, by: tuple[str, ...] = ("run_id",), start: str = "ts_us", finish: str = "finish_us", bucket_us: int | None = None) -> DataFrame:
    """(by…, start_us, end_us, n_active): positive-width slices between neighbouring boundaries with work in them.

    ``bucket_us``: None for one sweep a key, a width for stretches of time, ``AUTO`` to count first.
    """
    real = tasks.filter(F.col(finish) > F.col(start))
    ends = real.select(*by, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(finish).alias("t"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*by, F.col("e.t").alias("start_us")).agg(F.sum("e.d").alias("d"))
    swept = running_sums(steps, by, "start_us", _chosen(bucket_us, tasks, by, start, finish))
    return swept.filter("total > 0 AND next_us IS NOT NULL").select(*by, "start_us", F.col("next_us").alias("end_us"), F.col("total").alias("n_active"))


def horizon(tasks: DataFrame, start: str = "ts_us", finish: str = "finish_us") -> DataFrame:
    return tasks.groupBy("run_id").agg(F.min(start).alias("start_us"), F.max(finish).alias("end_us")).withColumn("horizon_us", F.col("end_us") - F.col("start_us"))


def occupancy(tasks: DataFrame, bucket_us: int | None = AUTO) -> DataFrame:
    """(run_id, horizon_us, busy_us, idle_us, area_us, peak): per run, from its slices."""
    width = F.col("end_us") - F.col("start_us")
    sums = slices(tasks, bucket_us=bucket_us).groupBy("run_id").agg(F.sum(width).alias("busy_us"), F.sum(width * F.col("n_active")).alias("area_us"), F.max("n_active").alias("peak"))
    return horizon(tasks).select("run_id", "horizon_us").join(sums, "run_id").withColumn("idle_us", F.col("horizon_us") - F.col("busy_us"))


def resource_occupancy(tasks: DataFrame, bucket_us: int | None = AUTO) -> DataFrame:
    """(run_id, resource, area_us, peak) of each resource."""
    each = tasks.select("run_id", "ts_us", "finish_us", F.explode("resources").alias("resource"))
    cut = slices(each, ("run_id", "resource"), bucket_us=bucket_us)
    return cut.groupBy("run_id", "resource").agg(F.sum((F.col("end_us") - F.col("start_us")) * F.col("n_active")).alias("area_us"), F.max("n_active").alias("peak"))


def merged(tasks: DataFrame, by: tuple[str, ...] = ("run_id",), start: str = "ts_us", finish: str = "finish_us", bucket_us: int | None = AUTO) -> DataFrame:
    """(by…, start_us, end_us, n): unions of overlapping or touching intervals.

    In stretches of time, by the start: the latest finish so far is the later one of the
    stretch's own and of all stretches before it, a maximum over one small row a stretch; the
    islands are numbered by a sum in the same two steps.
    """
    width = _chosen(bucket_us, tasks, by, start, finish)
    flag = lambda before: F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if width is None:
        w = Window.partitionBy(*by).orderBy(start, finish)
        flagged = tasks.withColumn("opens", flag(F.max(finish).over(past(w))))
        numbered = flagged.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        keys = [*by, "stretch"]
        dealt = tasks.withColumn("stretch", F.floor(F.col(start) / width))
        w, over = Window.partitionBy(*keys).orderBy(start, finish), Window.partitionBy(*by).orderBy("stretch")
        carried = dealt.groupBy(*keys).agg(F.max(finish).alias("own")).select(*keys, F.max("own").over(past(over)).alias("carried"))
        flagged = dealt.withColumn("local", F.max(finish).over(past(w))).join(carried, keys).withColumn("opens", flag(F.greatest("local", "carried")))
        totals = flagged.groupBy(*keys).agg(F.sum("opens").alias("own")).select(*keys, F.coalesce(F.sum("own").over(past(over)), F.lit(0)).alias("before"))
        numbered = flagged.withColumn("here", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(totals, keys).withColumn("island", F.col("before") + F.col("here"))
    return numbered.groupBy(*by, "island").agg(F.min(start).alias("start_us"), F.max(finish).alias("end_us"), F.count("*").alias("n")).drop("island")


def gaps(tasks: DataFrame, bucket_us: int | None = AUTO) -> DataFrame:
    """(run_id, start_us, end_us) without any task, between the first start and the last finish."""
    width = _chosen(bucket_us, tasks, ("run_id",), "ts_us", "finish_us")
    return _between(merged(tasks, bucket_us=width), width)


def _between(islands: DataFrame, width: int | None) -> DataFrame:
    """(run_id, start_us, end_us) between neighbouring islands."""
    after = running_sums(islands.select("run_id", F.col("start_us").alias("at_us"), "end_us", F.lit(0).alias("d")), ("run_id",), "at_us", width)
    return after.select("run_id", F.col("end_us").alias("start_us"), F.col("next_us").alias("end_us")).filter("end_us IS NOT NULL")


def binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """``df`` once for each bin that its interval touches."""
    last = F.greatest(F.col(end) - 1, F.col(start))
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], l_span: tuple[str, str], r_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs with equal ``by`` whose half-open intervals overlap, each once.

    Columns of the two sides must differ but for ``by``. ``width`` should be about the
    length of a long interval: a longer one is only repeated, never lost. Sides are merged:
    estimates do not count the bins, so that a few long intervals would pass as a side to broadcast.
    """
    a, b = binned(left, *l_span, width), binned(right, *r_span, width)
    later = F.greatest(F.col(l_span[0]), F.col(r_span[0]))
    meets = (F.col(l_span[0]) < F.col(r_span[1])) & (F.col(r_span[0]) < F.col(l_span[1]))
    return a.join(b.hint("merge"), [*by, "bin"]).filter(meets & (F.col("bin") == F.floor(later / width))).drop("bin")


def point_join(points: DataFrame, spans: DataFrame, by: list[str], at: str, span: tuple[str, str], width: int) -> DataFrame:
    """Pairs where a point lies in a half-open interval."""
    p = points.withColumn("bin", F.floor(F.col(at) / width))
    return p.join(binned(spans, *span, width).hint("merge"), [*by, "bin"]).filter((F.col(at) >= F.col(span[0])) & (F.col(at) < F.col(span[1]))).drop("bin")


def wall_clock_shares(tasks: DataFrame, width: int = 600_000_000, bucket_us: int | None = AUTO) -> DataFrame:
    """(run_id, task_key, share_us): each slice split equally among its active tasks."""
    cut = slices(tasks, bucket_us=bucket_us).withColumnsRenamed({"start_us": "s0", "end_us": "s1"})
    own = tasks.select("run_id", "task_key", "ts_us", "finish_us")
    pairs = overlap_join(cut, own, ["run_id"], ("s0", "s1"), ("ts_us", "finish_us"), width)
    return pairs.groupBy("run_id", "task_key").agg(F.sum((F.col("s1") - F.col("s0")) / F.col("n_active")).alias("share_us"))


def queue_depth(tasks: DataFrame, bucket_us: int | None = AUTO) -> DataFrame:
    """(run_id, at_us, depth): tasks that were ready but not started, after each change."""
    moves = tasks.select("run_id", F.explode(F.array(F.struct(F.col("ready_us").alias("t"), F.lit(1).alias("d")), F.struct(F.col("start_us").alias("t"), F.lit(-1).alias("d")))).alias("e"))
    steps = moves.groupBy("run_id", F.col("e.t").alias("at_us")).agg(F.sum("e.d").alias("d"))
    width = _chosen(bucket_us, tasks, ("run_id",), "ready_us", "start_us")
    return running_sums(steps, ("run_id",), "at_us", width).select("run_id", "at_us", F.col("total").alias("depth"))


def saturation(waits: DataFrame, holders: DataFrame, capacity: Column, width: int = 600_000_000) -> DataFrame:
    """(run_id, resource, task_key, saturated_us): how long others held all slots while a task waited.

    waits: (run_id, resource, task_key, w0, w1); holders: (run_id, resource, holder_key, h0, h1).
    """
    held = overlap_join(waits, holders, ["run_id", "resource"], ("w0", "w1"), ("h0", "h1"), width).filter("holder_key <> task_key")
    clipped = held.select("run_id", "resource", "task_key", F.greatest("w0", "h0").alias("ts_us"), F.least("w1", "h1").alias("finish_us"))
    cut = slices(clipped, ("run_id", "resource", "task_key")).filter(F.col("n_active") >= capacity)
    return cut.groupBy("run_id", "resource", "task_key").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("saturated_us"))


def fetch_build_overlap(tasks: DataFrame) -> DataFrame:
    """(run_id, overlap_us): time between the first build's start and the last fetch's finish, if any."""
    first = F.min(F.when(F.col("task_kind") == "BUILD", F.col("ts_us")))
    last = F.max(F.when(F.col("task_kind") == "FETCH", F.col("finish_us")))
    return tasks.groupBy("run_id").agg(first.alias("first_build_us"), last.alias("last_fetch_us")).withColumn("overlap_us", F.greatest(F.lit(0), F.col("last_fetch_us") - F.col("first_build_us")))


def filled_timeline(tasks: DataFrame, bucket_us: int | None = AUTO) -> DataFrame:
    """(run_id, start_us, end_us, category): busy stretches and the idle ones between them."""
    width = _chosen(bucket_us, tasks, ("run_id",), "ts_us", "finish_us")
    busy = merged(tasks, bucket_us=width).select("run_id", "start_us", "end_us")
    return busy.withColumn("category", F.lit("BUSY")).unionByName(_between(busy, width).withColumn("category", F.lit("IDLE")))
