"""Both planes together: run elements beside their processes, memory, capacity, evidence, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import command_signature
from tracewright.operators.loading import element_load


def joined_elements(plane1: DataFrame, plane2: DataFrame) -> DataFrame:
    """Full outer join on uid, with where each row comes from."""
    where = F.when(F.col("in1").isNull(), "processes-only").when(F.col("in2").isNull(), "run-only").otherwise("both")
    j = plane1.withColumn("in1", F.lit(1)).join(plane2.withColumn("in2", F.lit(1)), "uid", "full_outer")
    return j.withColumn("presence", where).drop("in1", "in2")


def binding_constraint(limits: DataFrame, by: list[str]) -> DataFrame:
    """The constraint that allows least, ties by name; (by…, name, allows)."""
    return limits.groupBy(*by).agg(F.min(F.struct("allows", "name")).alias("m")).select(*by, F.col("m.name").alias("name"), F.col("m.allows").alias("allows"))


#: Evidence, and its ranks; the four that speak of parallelism exclude each other and share one.
RANKS = (1, 1, 1, 1, 2, 3, 4, 5, 6)
EVIDENCE = ("pinned-to-one-job", "underachieved-requested-jobs", "waiting-not-computing", "already-compute-bound", "cpu-concentration", "serialization-point", "peak-memory", "redundant-operation", "declared-not-used")


def recommendations(elements: DataFrame, busy_cores: float = 1.25, least_share: float = 0.05, cheap_share: float = 0.01, memory_kb: int = 1024 * 1024) -> DataFrame:
    """(uid, evidence, rank) of elements worth a look; needs saving_us, total_us, cpu_per_wall, requested_jobs,
    pinned, top_binary_share, single_wall_us, peak_kb, redundant_us, n_unused. Nulls prove nothing."""
    share = F.col("saving_us") / F.col("total_us")
    gate = F.coalesce((share >= least_share) | ((share >= cheap_share) & (F.col("cpu_per_wall") < busy_cores)), F.lit(False))
    idle = F.col("cpu_per_wall") < busy_cores
    weight = F.greatest(F.lit(1_000_000), 0.01 * F.col("saving_us"))
    first = F.when(F.col("cpu_per_wall").isNull(), None).when(idle & F.col("pinned"), EVIDENCE[0]).when(idle & (F.col("requested_jobs") > 1), EVIDENCE[1]).when(idle, EVIDENCE[2]).otherwise(EVIDENCE[3])

    def on(condition: Column, name: str) -> Column:
        return F.when(gate & F.coalesce(condition, F.lit(False)), F.lit(name))

    found = F.array_compact(F.array(F.when(gate, first), on(F.col("top_binary_share") >= 0.5, EVIDENCE[4]), on(F.col("single_wall_us") >= weight, EVIDENCE[5]), on(F.col("peak_kb") >= memory_kb, EVIDENCE[6]), on(F.col("redundant_us") >= weight, EVIDENCE[7]), F.when(F.col("n_unused") > 0, EVIDENCE[8])))
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in zip(EVIDENCE, RANKS, strict=True) for x in pair]), F.col("evidence"))
    return elements.select("uid", F.explode(found).alias("evidence")).withColumn("rank", rank)


def worst_redundancy(procs: DataFrame) -> DataFrame:
    """(uid, redundant_us): of the commands that an element shares with others, the most that one of them costs one element.

    procs: (uid, cmd, start_us, end_us). Summed by command and element first; a command that all
    elements run is one row an element, not one a process.
    """
    wall = F.coalesce(F.col("end_us") - F.col("start_us"), F.lit(0))
    own = procs.filter("uid IS NOT NULL").groupBy(command_signature(F.col("cmd")).alias("signature"), "uid").agg(F.sum(wall).alias("wall_us"))
    shared = own.groupBy("signature").agg(F.count("*").alias("n"), F.max("wall_us").alias("worst_us")).filter("n > 1")
    return own.join(shared, "signature").groupBy("uid").agg(F.max("worst_us").alias("redundant_us"))


def element_figures(savings: DataFrame, load: DataFrame, redundancy: DataFrame, unused: DataFrame) -> DataFrame:
    """One row for each element that any input knows, with all that ``recommendations`` asks for; nulls mean not known.

    savings: (uid, saving_us, total_us); load: of ``loading.process_load`` over processes named
    like the elements; redundancy: of ``worst_redundancy``; unused: (uid, n_unused).
    """
    programs = load.filter("grain = 'element and binary'").groupBy(F.col("element").alias("uid")).agg(F.max("cpu_us").alias("most_us"), F.max(F.when(F.col("n") == 1, F.col("wall_us"))).alias("single_wall_us"))
    own = element_load(load).select(F.col("element").alias("uid"), "cpu_us", "cpu_per_wall", "requested_jobs", "peak_kb", (F.col("requested_jobs") == 1).alias("pinned"))
    cpu = own.join(programs, "uid").withColumn("top_binary_share", F.when(F.col("cpu_us") > 0, F.col("most_us") / F.col("cpu_us"))).drop("cpu_us", "most_us")
    return savings.select("uid", "saving_us", "total_us").join(cpu, "uid", "full_outer").join(redundancy, "uid", "full_outer").join(unused, "uid", "full_outer")


def merge_candidates(elements: DataFrame, edges: DataFrame, toll_share: float = 0.5, least_toll_us: int = 1_000_000) -> DataFrame:
    """Groups of elements with the same dependencies whose toll outweighs their work; elements: (uid, work_us, toll_us)."""
    sets = edges.groupBy(F.col("successor").alias("uid")).agg(F.concat_ws(",", F.array_sort(F.collect_set("predecessor"))).alias("parents"))
    g = elements.join(sets, "uid").groupBy("parents").agg(F.concat_ws(",", F.array_sort(F.collect_list("uid"))).alias("members"), F.count("*").alias("n"), F.sum("work_us").alias("work_us"), F.sum("toll_us").alias("toll_us"))
    return g.filter((F.col("n") >= 2) & (F.col("toll_us") >= least_toll_us) & (F.col("toll_us") >= toll_share * (F.col("toll_us") + F.col("work_us"))))


def split_candidates(elements: DataFrame, share: float = 0.10, cores: float = 2.0) -> DataFrame:
    """Elements that hold a good part of the path and keep several cores busy."""
    return elements.filter((F.col("dur_us") >= share * F.col("total_us")) & (F.col("cpu_per_wall") >= cores) & F.col("on_path"))


def finding(rows: DataFrame, identity: str, severity: Column | str, title: Column, condition: Column, evidence: list[str]) -> DataFrame:
    """One finding for each row that meets ``condition``, with its evidence as JSON."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.filter(F.coalesce(condition, F.lit(False))).select("run_id", F.lit(identity).alias("id"), level.alias("severity"), title.alias("title"), F.to_json(F.struct(*evidence)).alias("evidence"))


def run_findings(runs: DataFrame) -> DataFrame:
    """Findings of each run from one row of figures (nulls mean not known): incomplete, failed_us, run_mode,
    hit_ratio, transfer_share, confidence, wait_category, wait_share, headroom_us, efficiency, n_path_heavy."""
    c = F.col
    rules = [
        ("build-failed", "critical", F.concat(F.lit("the run is incomplete: "), "incomplete"), c("incomplete").isNotNull(), ["incomplete"]),
        ("failed-task-time", "medium", F.lit("time went into failed tasks"), c("failed_us") > 0, ["failed_us"]),
        ("run-mode-incremental", "info", F.lit("part of the run came from a cache"), c("run_mode") == "incremental", ["run_mode"]),
        ("cache-hit-ratio", F.when(c("run_mode") == "full", "info").when(c("hit_ratio") < 0.2, "high").when(c("hit_ratio") < 0.5, "medium").otherwise("info"), F.lit("share of elements found in the cache"), c("hit_ratio").isNotNull(), ["hit_ratio"]),
        ("cache-transfer-cost", "medium", F.lit("cache transfers take a good part of the time"), c("transfer_share") >= 0.1, ["transfer_share"]),
        ("confidence", F.when(c("confidence") >= 0.8, "info").when(c("confidence") >= 0.5, "medium").otherwise("high"), F.lit("how far the analysis can be trusted"), c("confidence").isNotNull(), ["confidence"]),
        ("execution-bound", "high", F.lit("waiting is negligible"), c("wait_share") < 0.01, ["wait_share"]),
        ("wait-category", "high", F.concat(F.lit("largest wait: "), "wait_category"), c("wait_share") >= 0.01, ["wait_category", "wait_share"]),
        ("certified-headroom", "medium", F.lit("the run could be shorter than it is"), c("headroom_us") > 0, ["headroom_us"]),
        ("efficiency-score", "info", F.lit("lower bound as a share of the time"), c("efficiency").isNotNull(), ["efficiency"]),
    ]
    out = None
    for n, (identity, severity, title, condition, evidence) in enumerate(rules):
        one = finding(runs, identity, severity, title, condition, evidence).withColumn("sequence", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def confidence(runs: DataFrame) -> DataFrame:
    """Least of four scores: provenance, coverage, model, attribution. Needs n_hashes, hashes_missing, coverage,
    t_c_us, lower_us, penalised_us, horizon_us."""
    provenance = F.when(F.col("n_hashes") > 1, 0.0).when(F.col("hashes_missing"), 0.75).otherwise(1.0)
    model = F.when(F.col("t_c_us") < F.col("lower_us"), 0.5).otherwise(1.0)
    attribution = F.when(F.col("horizon_us") > 0, 1 - F.col("penalised_us") / F.col("horizon_us")).otherwise(0.0)
    return runs.withColumn("confidence", F.least(provenance, F.col("coverage"), model, attribution))


def capacity_violations(runs: DataFrame, ratio: float = 8.0) -> DataFrame:
    """Violations of the declared capacities. Needs builders, jobs, cores, cpu_budget, memory_budget_mb, job_mb, wall_us, horizon_us."""
    c = F.col
    jobs = F.when(c("jobs") == 0, F.least(c("cores"), F.lit(8))).otherwise(c("jobs"))
    rules = [
        ("cpu_budget_exceeds_host_capacity", c("cpu_budget") > c("cores")),
        ("resource_oversubscription", c("builders") * jobs > ratio * c("cores")),
        ("resource_undersubscription", c("builders") * jobs < c("cores")),
        ("dispatch_oversubscription", c("builders") > c("cores")),
        ("memory_oversubscription", c("builders") * jobs * c("job_mb") > c("memory_budget_mb")),
        ("wall_clock_containment", c("wall_us") < c("horizon_us")),
    ]
    types = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules]))
    return runs.select("run_id", F.explode(types).alias("type"))
