"""All figures of a process log from a single pass over its processes.

The separate operators of ``processes`` scan once each. Here processes are summed by element,
sandbox and program first (on the map side, so that one hot element shuffles a row a task and
program), and every other figure is a grouping set over these sums.

procs: (element, invocation, cmd, start_us, end_us, cpu_us, rss_kb), and ``coverage`` (hook, spine
or both) where two streams were merged. Nulls mean not recorded; peaks are never summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tracewright.functions.scalars import binary_class, binary_name, is_element_name, requested_jobs

#: Grains of the result by the number that GROUPING_ID gives them (element, invocation, binary).
GRAINS = {0b011: "element", 0b010: "element and binary", 0b101: "invocation", 0b110: "binary", 0b111: "all"}


def _grain(number: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for code, name in GRAINS.items():
        out = out.when(number == code, name)
    return out


def process_load(procs: DataFrame, watch: Observation | None = None) -> DataFrame:
    """(grain, element, invocation, binary, n, n_open, n_measured, cpu_us, wall_us, start_us, end_us, last_us, peak_kb, requested_jobs, n_named, n_spine, n_streams).

    One row for each element, element and program, sandbox, program, and one for all; none without processes. ``wall_us``
    sums closed processes, ``end_us`` is the last end, ``last_us`` also counts starts of open ones.
    ``watch`` reports counters while the pass runs; a task that runs again after a lost executor
    may count twice there, never in the row for all.
    """
    stream = F.col("coverage") if "coverage" in procs.columns else F.lit(None).cast("string")
    rows = procs.withColumn("stream", stream)
    if watch is not None:
        rows = rows.observe(watch, F.count(F.lit(1)).alias("n"), F.count_if(F.col("end_us").isNull()).alias("n_open"), F.count("cpu_us").alias("n_measured"), F.count_if(F.col("stream") == "spine").alias("n_spine"))
    keyed = rows.select("element", "invocation", binary_name(F.col("cmd")).alias("binary"), "start_us", "end_us", "cpu_us", "rss_kb", "stream", requested_jobs(F.col("cmd")).alias("jobs"), F.coalesce(is_element_name(F.col("element")), F.lit(False)).alias("named"))
    sums = keyed.groupBy("element", "invocation", "binary").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("end_us").isNull()).alias("n_open"),
        F.count("cpu_us").alias("n_measured"),
        F.sum("cpu_us").alias("cpu_us"),
        F.sum(F.col("end_us") - F.col("start_us")).alias("wall_us"),
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.max(F.coalesce("end_us", "start_us")).alias("last_us"),
        F.max("rss_kb").alias("peak_kb"),
        F.max("jobs").alias("requested_jobs"),
        F.count_if("named").alias("n_named"),
        F.count_if(F.col("stream") == "spine").alias("n_spine"),
        F.count("stream").alias("n_streams"),
    )
    added, least, most = ("n", "n_open", "n_measured", "cpu_us", "wall_us", "n_named", "n_spine", "n_streams"), ("start_us",), ("end_us", "last_us", "peak_kb", "requested_jobs")
    sets = [[F.col("element")], [F.col("element"), F.col("binary")], [F.col("invocation")], [F.col("binary")], []]
    cube = sums.groupingSets(sets, "element", "invocation", "binary").agg(
        F.grouping_id().alias("number"),
        *[F.sum(c).alias(c) for c in added],
        *[F.min(c).alias(c) for c in least],
        *[F.max(c).alias(c) for c in most],
    )
    named = cube.withColumn("grain", _grain(F.col("number")))
    return named.select("grain", "element", "invocation", "binary", "n", "n_open", "n_measured", "cpu_us", "wall_us", "start_us", "end_us", "last_us", "peak_kb", "requested_jobs", "n_named", "n_spine", "n_streams")


def element_load(load: DataFrame) -> DataFrame:
    """(element, cpu_us, measured, unmeasured, span_us, cpu_per_wall, peak_kb, requested_jobs, opens_coverage) of each element.

    ``opens_coverage`` is the share of processes that the hook saw; null where only one stream
    was recorded, as nothing tells then what it missed.
    """
    span = F.col("end_us") - F.col("start_us")
    seen = F.when(F.col("n_streams") > 0, (F.col("n") - F.col("n_spine")) / F.col("n"))
    return load.filter("grain = 'element'").select("element", "cpu_us", F.col("n_measured").alias("measured"), (F.col("n") - F.col("n_measured")).alias("unmeasured"), span.alias("span_us"), F.when(span > 0, F.col("cpu_us") / span).alias("cpu_per_wall"), "peak_kb", "requested_jobs", seen.alias("opens_coverage"))


def sandbox_durations(load: DataFrame) -> DataFrame:
    """(invocation, duration_us): from the first start to the last end in each sandbox that has both, in this order."""
    span = F.col("end_us") - F.col("start_us")
    return load.filter("grain = 'invocation' AND invocation IS NOT NULL").filter(span >= 0).select("invocation", span.alias("duration_us"))


def program_costs(load: DataFrame, top: int = 5) -> DataFrame:
    """(element, binary, n, cpu_us, class, rank): the programs of each element that cost most CPU time."""
    rows = load.filter("grain = 'element and binary'").select("element", "binary", "n", F.coalesce("cpu_us", F.lit(0)).alias("cpu_us"))
    nth = F.row_number().over(Window.partitionBy("element").orderBy(F.desc("cpu_us"), "binary"))
    return rows.withColumns({"class": binary_class(F.col("binary")), "rank": nth}).filter(F.col("rank") <= top)


def counts(load: DataFrame) -> DataFrame:
    """(by, name, n, share): processes of each program and of each element, and their share of all."""
    total = load.filter("grain = 'all'").select(F.col("n").alias("total"))
    one = lambda grain: load.filter(F.col("grain") == grain).select(F.lit(grain).alias("by"), F.col(grain).alias("name"), "n")
    both = one("binary").unionByName(one("element"))
    return both.crossJoin(F.broadcast(total)).select("by", "name", "n", (F.col("n") / F.col("total")).alias("share"))


def log_summary(load: DataFrame) -> DataFrame:
    """(n, n_open, n_measured, cpu_us, wall_span_us, recognised, n_spine): one row for the whole log, of zeros and nulls if it is empty."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_open", "n_measured", "n_spine")]
    whole = load.filter("grain = 'all'").agg(*sums, F.sum("cpu_us").alias("cpu_us"), F.sum(F.col("last_us") - F.col("start_us")).alias("wall_span_us"), F.sum("n_named").alias("named"))
    return whole.select("n", "n_open", "n_measured", "cpu_us", "wall_span_us", F.when(F.col("n") > 0, F.col("named") / F.col("n")).alias("recognised"), "n_spine")
