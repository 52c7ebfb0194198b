"""Run directories (JSON) as canonical frames; every frame carries the directory as ``run_id``.

A directory holds ``run-context.json`` (or ``run_context.json``), ``graph.json`` and
``trace.json``. Missing optional values stay null: not recorded is neither zero nor success.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.scalars import resource_name

EDGE = "struct<predecessor:string,successor:string,dependency_type:string>"
GRAPH = f"elements array<struct<uid:string,key:string,cache_key:string,requested_target:boolean,element_kind:string,max_jobs:bigint,notparallel:boolean,dependencies:array<string>>>, dependencies array<{EDGE}>, run_identity_hash string"
TRACE = """spans array<struct<task_key:string,ts_us:bigint,dur_us:bigint,resources:array<string>,primary_resource:string,status:string>>,
    tasks array<struct<key:string,element_uid:string,kind:string,phase:string,attempt:bigint,start_us:bigint,start_time_us:bigint,duration_us:bigint,finish_us:bigint,resource_profile:map<string,string>,status:string>>,
    traceEvents array<struct<ph:string,name:string,ts:bigint,dur:bigint>>,
    phases array<struct<name:string,ts_us:bigint,dur_us:bigint>>, run_identity_hash string"""
CONTEXT = """trace_epsilon_us bigint, wall_clock struct<start_us:bigint,end_us:bigint>, host string, resource_capacities map<string,bigint>,
    max_jobs bigint, host_cpu_count bigint, cpu_budget bigint, memory_budget_mb bigint, exclusive_resources array<string>,
    cpu_accounting struct<effective_cpus:double,cgroup_quota_us:bigint,cgroup_period_us:bigint>,
    build_outcome struct<failed_count:bigint,interrupted:boolean,suspended:struct<suspended_seconds:double>>,
    pipeline_overhead array<struct<phase:string,elapsed_us:bigint>>, run_identity_hash string,
    host_manifest struct<cpu_model:string,cpu_count:bigint,memory_mb:bigint>"""


def _documents(spark: SparkSession, root: str, names: str, schema: str) -> DataFrame:
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", names).json(root)
    return df.withColumn("run_id", F.element_at(F.split(F.input_file_name(), "/"), -2))


def run_contexts(spark: SparkSession, root: str) -> DataFrame:
    df = _documents(spark, root, "run[-_]context.json", CONTEXT)
    flat = df.withColumns({"trace_epsilon_us": F.coalesce("trace_epsilon_us", F.lit(50_000)), "wall_start_us": F.col("wall_clock.start_us"), "wall_end_us": F.col("wall_clock.end_us")})
    return flat.drop("wall_clock")


def graphs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Elements, and edges from the list at the top or, inside elements, as build edges."""
    df = _documents(spark, root, "graph.json", GRAPH)
    e = df.select("run_id", "run_identity_hash", F.explode("elements").alias("e"))
    uid = F.coalesce("e.uid", "e.key")
    elements = e.select("run_id", F.when(uid.isNull(), F.raise_error(F.lit("an element has neither uid nor key"))).otherwise(uid).alias("uid"), "e.cache_key", F.coalesce("e.requested_target", F.lit(False)).alias("requested_target"), "e.element_kind", "e.max_jobs", "e.notparallel", "run_identity_hash")
    listed = df.select("run_id", F.explode("dependencies").alias("d")).select("run_id", "d.predecessor", "d.successor", F.coalesce("d.dependency_type", F.lit("build")).alias("dependency_type"))
    inline = e.select("run_id", F.explode("e.dependencies").alias("predecessor"), uid.alias("successor"), F.lit("build").alias("dependency_type"))
    return elements, listed.unionByName(inline).distinct()


def _key_parts(key: Column) -> dict[str, Column]:
    p = F.split(key, r"\|")
    ok = F.size(p) == 4
    return {"element_uid": F.when(ok, p[0]).otherwise(key), "task_kind": F.when(ok, p[1]).otherwise("OTHER"), "phase": F.when(ok, p[2]).otherwise("EXECUTION"), "attempt": F.when(ok, p[3].try_cast("long")).otherwise(1)}


def traces(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Spans from any of the three forms (spans, tasks, trace events), and phases."""
    df = _documents(spark, root, "trace.json", TRACE)
    s = df.select("run_id", F.posexplode("spans").alias("span_seq", "s"))
    native = s.select("run_id", F.col("span_seq").cast("long"), F.col("s.task_key").alias("task_key"), *[c.alias(n) for n, c in _key_parts(F.col("s.task_key")).items()], "s.ts_us", "s.dur_us", F.coalesce("s.resources", F.array().cast("array<string>")).alias("resources"), "s.primary_resource", "s.status")
    t = df.select("run_id", F.posexplode("tasks").alias("span_seq", "t")).filter("t.key IS NOT NULL OR t.element_uid IS NOT NULL")
    start = F.coalesce("t.start_us", "t.start_time_us")
    built = F.concat_ws("|", "t.element_uid", F.coalesce("t.kind", F.lit("OTHER")), F.coalesce("t.phase", F.lit("EXECUTION")), F.coalesce("t.attempt", F.lit(1)))
    key = F.coalesce("t.key", built)
    lenient = t.select("run_id", F.col("span_seq").cast("long"), key.alias("task_key"), *[c.alias(n) for n, c in _key_parts(key).items()], start.alias("ts_us"), F.coalesce("t.duration_us", F.col("t.finish_us") - start).alias("dur_us"), F.coalesce(F.map_keys("t.resource_profile"), F.array().cast("array<string>")).alias("resources"), F.lit(None).cast("string").alias("primary_resource"), "t.status")
    x = df.select("run_id", F.posexplode("traceEvents").alias("span_seq", "x"))
    chrome = x.filter("x.ph = 'X'").select("run_id", F.col("span_seq").cast("long"), F.col("x.name").alias("task_key"), *[c.alias(n) for n, c in _key_parts(F.col("x.name")).items()], F.col("x.ts").alias("ts_us"), F.col("x.dur").alias("dur_us"), F.array().cast("array<string>").alias("resources"), F.lit(None).cast("string").alias("primary_resource"), F.lit(None).cast("string").alias("status"))
    spans = native.unionByName(lenient).unionByName(chrome).withColumn("resources", F.transform("resources", resource_name)).withColumn("finish_us", F.col("ts_us") + F.col("dur_us"))
    spans = spans.withColumn("primary_resource", F.when(F.col("primary_resource").isNotNull(), resource_name(F.col("primary_resource"))))
    phases = df.select("run_id", F.explode("phases").alias("p")).select("run_id", "p.name", "p.ts_us", "p.dur_us").unionByName(x.filter("x.ph = 'P'").select("run_id", "x.name", F.col("x.ts").alias("ts_us"), F.col("x.dur").alias("dur_us")))
    return spans, phases


def identity_mismatches(contexts: DataFrame, elements: DataFrame, root: str) -> DataFrame:
    """Runs whose documents carry different identity hashes."""
    t = _documents(contexts.sparkSession, root, "trace.json", TRACE).select("run_id", F.col("run_identity_hash").alias("h"))
    every = contexts.select("run_id", F.col("run_identity_hash").alias("h")).unionByName(elements.select("run_id", F.col("run_identity_hash").alias("h"))).unionByName(t)
    return every.groupBy("run_id").agg(F.count_distinct("h").alias("n")).filter("n > 1").select("run_id", F.lit("run_identity_mismatch").alias("type"))


def source_inventory(spark: SparkSession, path: str, schema_name: str = "sources/v1") -> DataFrame:
    """(uid, kind, identity, declared, keying, staged_at) of an inventory document of the named schema."""
    df = spark.read.schema("schema string, elements map<string,array<struct<kind:string,identity:string,declared:string,keying:string,staged_at:string>>>").option("multiLine", True).json(path)
    return df.filter(F.col("schema") == schema_name).select(F.explode("elements").alias("uid", "s")).select("uid", F.explode("s").alias("x")).select("uid", "x.*")


def resolve_run(runs: DataFrame, reference: str) -> DataFrame:
    """The run (stamp) that ``@last``, ``@prev``, an exact name or a unique prefix means; no row if none or several do."""
    newest = runs.select("stamp").distinct().orderBy(F.desc("stamp"))
    if reference == "@last":
        return newest.limit(1)
    if reference == "@prev":
        return newest.limit(2).orderBy("stamp").limit(1) if newest.limit(2).count() == 2 else newest.limit(0)
    exact = newest.filter(F.col("stamp") == reference)
    if exact.count():
        return exact
    found = newest.filter(F.col("stamp").startswith(reference))
    return found if found.count() == 1 else found.limit(0)
