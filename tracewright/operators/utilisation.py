"""Where the CPU capacity of a run went, and what a changed source would rebuild."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.graph import closure_pairs
from tracewright.operators.intervals import horizon


def buckets(tasks: DataFrame) -> DataFrame:
    """(run_id, bucket, dur_us): slot time that was useful, retried or rebuilt. Needs ``retried`` and ``rebuilt``."""
    bucket = F.when(F.col("retried"), "WASTED_RETRY").when(F.col("rebuilt"), "WASTED_REBUILD").otherwise("USEFUL")
    return tasks.groupBy("run_id", bucket.alias("bucket")).agg(F.sum("dur_us").alias("dur_us"))


def _steps(tasks: DataFrame, start: str, end: str, running: int, pending: int) -> DataFrame:
    ends = F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))
    return tasks.filter(F.col(end) > F.col(start)).select("run_id", F.explode(ends).alias("e")).select("run_id", F.col("e.t").alias("t"), (F.col("e.d") * running).alias("r"), (F.col("e.d") * pending).alias("p"))


def accounting(tasks: DataFrame, cpus: int) -> DataFrame:
    """(run_id, capacity_us, used_us, idle_us, underparallel_us, no_tasks_us).

    Idle slots count as underparallel while some task was ready and waited; tasks need
    start_us, finish_us, ready_us and dur_us.
    """
    steps = _steps(tasks, "start_us", "finish_us", 1, 0).unionAll(_steps(tasks, "ready_us", "start_us", 0, 1))
    summed = steps.groupBy("run_id", "t").agg(F.sum("r").alias("r"), F.sum("p").alias("p"))
    w = Window.partitionBy("run_id").orderBy("t")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = summed.select("run_id", (F.lead("t").over(w) - F.col("t")).alias("width"), F.sum("r").over(so_far).alias("running"), F.sum("p").over(so_far).alias("waiting"))
    free = F.greatest(F.lit(0), F.lit(cpus) - F.col("running")) * F.col("width")
    waited = swept.groupBy("run_id").agg(F.coalesce(F.sum(F.when(F.col("waiting") > 0, free)), F.lit(0)).alias("waited_us"))
    used = tasks.groupBy("run_id").agg(F.sum("dur_us").alias("used_us"))
    out = horizon(tasks, "start_us", "finish_us").join(used, "run_id").join(waited, "run_id").withColumn("capacity_us", F.col("horizon_us") * cpus)
    out = out.withColumn("idle_us", F.greatest(F.lit(0), F.col("capacity_us") - F.col("used_us")))
    under = F.least("waited_us", "idle_us")
    return out.select("run_id", "capacity_us", "used_us", "idle_us", under.alias("underparallel_us"), (F.col("idle_us") - under).alias("no_tasks_us"))


def resource_blast(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(run_id, kind, identity, n_own, n_hit, hit_us): what a change of each source rebuilds, its users and all after them.

    sources: (run_id, uid, kind, identity).
    """
    own = sources.select("run_id", "uid", "kind", "identity").distinct()
    after = own.join(closure_pairs(nodes, edges).withColumnRenamed("uid", "hit").withColumnRenamed("ancestor", "uid"), ["run_id", "uid"]).select("run_id", "kind", "identity", F.col("hit").alias("uid"))
    hit = own.select("run_id", "kind", "identity", "uid").unionByName(after).distinct().join(nodes.select("run_id", "uid", "dur_us"), ["run_id", "uid"])
    users = own.groupBy("run_id", "kind", "identity").agg(F.count("*").alias("n_own"))
    return hit.groupBy("run_id", "kind", "identity").agg(F.count("*").alias("n_hit"), F.sum("dur_us").alias("hit_us")).join(users, ["run_id", "kind", "identity"])


def shared_source_headline(blast: DataFrame, elements: DataFrame, share: float = 0.5) -> DataFrame:
    """The widest source of each run whose change hits at least ``share`` of its elements."""
    total = elements.groupBy("run_id").agg(F.count("*").alias("total"))
    wide = blast.join(total, "run_id").filter(F.col("n_hit") >= share * F.col("total"))
    first = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("hit_us"), F.desc("n_hit"), "identity"))
    return wide.withColumn("nth", first).filter("nth = 1").drop("nth", "total")


def elements_of(sources: DataFrame, target: str, project_files: bool = True) -> DataFrame:
    """(run_id, uid) that a target means: a repository address, a path (content-keyed prefix), or an element."""
    from tracewright.functions.scalars import normalise_url

    one = sources.sparkSession.range(1).select(normalise_url(F.lit(target)).alias("wanted"))
    by_url = sources.join(F.broadcast(one), F.col("identity") == F.col("wanted")).select("run_id", "uid")
    path = target.strip().removeprefix("./").rstrip("/")
    inside = (F.col("identity") == path) | F.col("identity").startswith(f"{path}/") | F.lit(path).startswith(F.concat("identity", F.lit("/")))
    by_path = sources.filter((F.col("keying") == "content") & inside).select("run_id", "uid") if project_files else by_url.limit(0)
    by_name = sources.filter(F.col("uid") == target).select("run_id", "uid")
    return by_url.unionByName(by_path).unionByName(by_name).distinct()


def _tidy(path):
    """A path without leading ``./`` and ``/``, trailing and doubled slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(path), "/+", "/"), r"^(\./)+", ""), r"^/|/$", "")


def _prefixes(path):
    """The path itself and every directory above it, the project's root (empty) included."""
    parts = F.split(path, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), every))


def resolve_targets(targets: DataFrame, sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run_id, target, resolved_as, uid): the elements that each target means in each run.

    targets: (target); sources: (run_id, uid, kind, keying, identity). A target that is spelled as
    an identity means just its sources. Else it may be a repository address, a path (it lies in
    a directory that a content-keyed source stages, or holds one) or an element's name; the first of
    these that fits any element of the run holds. Paths meet through their exploded directories,
    so no target is compared with every source.
    """
    from tracewright.functions.scalars import normalise_url

    t = F.col("target")
    asked = targets.select("target").filter(F.trim("target") != "").distinct()
    own = sources.select("run_id", "uid", "kind", "keying", "identity").distinct()
    content = own.filter((F.col("keying") == "content") & ~F.coalesce(F.col("identity").rlike(r"^(/|\.\.)"), F.lit(True)))
    root = content.select("run_id", "uid", _tidy(F.regexp_replace("identity", r"^[^/]*\.bst:", "")).alias("root")).withColumn("root", F.when(F.col("root") == ".", "").otherwise(F.col("root")))
    at_root = root.filter("root = ''").select("run_id").distinct().withColumn("at_root", F.lit(True))

    exact = asked.join(own, F.col("identity") == t).select("run_id", "target", "uid", F.when(F.col("keying") == "ref", "url").otherwise("path").alias("resolved_as"), "kind")
    kinds = exact.groupBy("run_id", "target").agg(F.min("kind").alias("kind"))
    exact = exact.join(kinds, ["run_id", "target", "kind"]).select("run_id", "target", "uid", "resolved_as", F.lit(0).alias("turn"))

    url = t.contains("://") | t.startswith("git@") | t.endswith(".git")
    name = t.endswith(".bst")
    shaped = asked.select("target", url.alias("is_url"), t.contains("/").alias("is_path"), name.alias("is_element"))
    plain = ~F.col("is_url") & ~F.col("is_path") & ~F.col("is_element")
    by_url = shaped.filter(F.col("is_url") | plain).withColumn("identity", normalise_url(t)).join(own.filter("keying = 'ref'"), "identity").select("run_id", "target", "uid", F.lit("url").alias("resolved_as"), F.lit(1).alias("turn"))
    paths = shaped.withColumn("path", _tidy(t)).filter(~F.col("path").startswith(".."))
    inside = paths.select("target", "is_path", F.explode(_prefixes(F.col("path"))).alias("root")).join(root, "root").select("run_id", "target", "uid", "is_path")
    around = paths.join(root.select("run_id", "uid", F.explode(_prefixes(F.col("root"))).alias("path")).filter("path != ''"), "path").select("run_id", "target", "uid", "is_path")
    # a bare name is a path only where something stages the whole project
    by_path = inside.unionByName(around).join(at_root, "run_id", "left").filter(F.col("is_path") | F.col("at_root")).select("run_id", "target", "uid", F.lit("path").alias("resolved_as"), F.lit(2).alias("turn"))
    by_name = shaped.filter(F.col("is_element") | plain).join(nodes.select("run_id", "uid"), F.col("uid") == t).select("run_id", "target", "uid", F.lit("element").alias("resolved_as"), F.lit(3).alias("turn"))
    every = exact.unionByName(by_url).unionByName(by_path).unionByName(by_name).distinct()
    first = every.groupBy("run_id", "target").agg(F.min("turn").alias("turn"))
    return every.join(first, ["run_id", "target", "turn"]).select("run_id", "target", "resolved_as", "uid").distinct()


def target_blast(resolved: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, target, resolved_as, n_direct, n_hit, hit_us): what a change of each resolved target rebuilds."""
    own = resolved.select("run_id", "uid", F.col("resolved_as").alias("kind"), F.col("target").alias("identity"))
    out = resource_blast(nodes, edges, own)
    return out.select("run_id", F.col("identity").alias("target"), F.col("kind").alias("resolved_as"), F.col("n_own").alias("n_direct"), "n_hit", "hit_us")


def calibration(history: DataFrame) -> DataFrame:
    """(element_uid, capacity, mean_us): whole-microsecond mean duration of each element at each measured capacity."""
    return history.groupBy("element_uid", "capacity").agg(F.floor(F.avg("dur_us")).alias("mean_us"))


def calibrated(points: DataFrame, capacity: Column | int) -> DataFrame:
    """(element_uid, dur_us, extrapolated): durations at a capacity, linear between neighbours and flat beyond them."""
    at = F.lit(capacity) if isinstance(capacity, int) else capacity
    low = F.max(F.when(F.col("capacity") <= at, F.struct("capacity", "mean_us")))
    high = F.min(F.when(F.col("capacity") >= at, F.struct("capacity", "mean_us")))
    g = points.groupBy("element_uid").agg(low.alias("lo"), high.alias("hi"))
    between = F.bround(F.col("lo.mean_us") + (F.col("hi.mean_us") - F.col("lo.mean_us")) * (at - F.col("lo.capacity")) / (F.col("hi.capacity") - F.col("lo.capacity"))).cast("long")
    edge = F.col("lo").isNull() | F.col("hi").isNull()
    value = F.when(edge, F.coalesce("lo.mean_us", "hi.mean_us")).when(F.col("lo.capacity") == F.col("hi.capacity"), F.col("lo.mean_us")).otherwise(between)
    return g.select("element_uid", value.alias("dur_us"), edge.alias("extrapolated"))
