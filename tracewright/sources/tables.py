"""Canonical frames from the star-schema tables, so that operators can be checked in SQL.

Each adapter has a twin in ``SQL``: the same frame as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.scalars import mapped

#: How event types stand for task kinds, and task kinds for resources.
KINDS = {"view": "FETCH", "purchase": "BUILD", "click": "TRACK", "signup": "PULL", "error": "OTHER"}
KIND_RESOURCE = {"FETCH": "DOWNLOAD", "PULL": "DOWNLOAD", "BUILD": "PROCESS", "TRACK": "PROCESS", "PUSH": "UPLOAD"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Elements of one run: more data make more runs, not larger ones.
RUN_ELEMENTS = 40


def run_of(user: str) -> Column:
    return F.floor(F.col(user) / RUN_ELEMENTS)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task span per event; users stand for elements, ``RUN_ELEMENTS`` neighbours for a run."""
    e = read(spark, sf_dir, "events")
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1
    kind = mapped(F.col("event_type"), KINDS, "OTHER")
    out = e.select(
        run_of("user_id").alias("run_id"),
        F.concat(F.lit("u"), "user_id").alias("element_uid"),
        kind.alias("task_kind"),
        nth.cast("long").alias("attempt"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.round(F.col("value") * 1_000_000).cast("long").alias("dur_us"),
        F.col("event_id").alias("span_seq"),
    )
    resource = mapped(F.col("task_kind"), KIND_RESOURCE, "OTHER")
    return out.withColumn("phase", F.col("task_kind")).withColumn("task_key", F.concat_ws("|", "element_uid", "task_kind", "phase", "attempt")).withColumn("resources", F.array(resource)).withColumn("finish_us", F.col("ts_us") + F.col("dur_us"))


def run_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each run over the elements of ``spans``: each depends on the second and the third before it, two on the one before."""
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    pairs = [users.select(F.col("user_id").alias("p"), (F.col("user_id") + step).alias("s")) for step in (2, 3)]
    # the eighth element of a run comes after all before it and before all after it
    pairs.append(users.filter((F.col("user_id") % RUN_ELEMENTS).isin(6, 7)).select(F.col("user_id").alias("p"), (F.col("user_id") + 1).alias("s")))
    both = pairs[0].unionAll(pairs[1]).unionAll(pairs[2]).join(users.select(F.col("user_id").alias("s")), "s").filter(run_of("p") == run_of("s"))
    kind = F.when(F.col("p") % 20 == 8, "runtime").otherwise("build")
    return both.select(run_of("p").alias("run_id"), F.concat(F.lit("u"), "p").alias("predecessor"), F.concat(F.lit("u"), "s").alias("successor"), kind.alias("dependency_type"))


def run_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of each run with their longest and summed span, a kind and a request flag."""
    s = spans(spark, sf_dir).groupBy("run_id", "element_uid").agg(F.max("dur_us").alias("dur_us"), F.sum("dur_us").alias("dur_sum_us"))
    n = F.substring("element_uid", 2, 20).cast("long")
    return s.select("run_id", F.col("element_uid").alias("uid"), "dur_us", "dur_sum_us", (n % 10 == 0).alias("requested_target"), F.when(n % 7 == 0, "stack").otherwise("manual").alias("element_kind"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide four-layer graph: supplier, part, order, customer."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    uid = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    kind = F.when((F.col("l_orderkey") + F.col("l_partkey")) % 20 == 0, "runtime").otherwise("build")
    a = li.select(uid("s", "l_suppkey").alias("predecessor"), uid("p", "l_partkey").alias("successor"), F.lit("build").alias("dependency_type")).distinct()
    b = li.select(uid("p", "l_partkey").alias("predecessor"), uid("o", "l_orderkey").alias("successor"), kind.alias("dependency_type")).distinct()
    c = o.select(uid("o", "o_orderkey").alias("predecessor"), uid("c", "o_custkey").alias("successor"), F.lit("build").alias("dependency_type")).distinct()
    return a.unionAll(b).unionAll(c)


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: F.abs(F.round(F.col(c) * 100)).cast("long").alias("dur_us")
    parts = [("supplier", "s", "s_suppkey", "s_acctbal"), ("part", "p", "p_partkey", "p_retailprice"), ("orders", "o", "o_orderkey", "o_totalprice"), ("customer", "c", "c_custkey", "c_acctbal")]
    frames = [read(spark, sf_dir, t).select(F.concat(F.lit(x), F.col(k)).alias("uid"), cents(v)) for t, x, k, v in parts]
    return frames[0].unionAll(frames[1]).unionAll(frames[2]).unionAll(frames[3])


def nation_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one wide run a nation: what its customers' orders are made of, and who supplies that."""
    lines, orders, customers = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c)).alias(prefix)
    bought = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", F.col("c_nationkey").cast("long").alias("run_id"))
    rows = lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).select("run_id", named("s", "l_suppkey"), named("p", "l_partkey"), named("o", "o_orderkey"), named("c", "o_custkey"))
    pair = lambda a, b: F.struct(F.col(a).alias("predecessor"), F.col(b).alias("successor"))
    edges = rows.select("run_id", F.inline(F.array(pair("s", "p"), pair("p", "o"), pair("o", "c")))).distinct()
    own = edges.select("run_id", F.explode(F.array("predecessor", "successor")).alias("uid")).distinct()
    return own.join(supply_nodes(spark, sf_dir), "uid").select("run_id", "uid", "dur_us"), edges


def process_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A process log as text lines: every event starts a process, most end it, some never do."""
    e = read(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    stamp = lambda x: F.concat(F.floor(x / 1_000_000).cast("string"), F.lit("."), F.lpad((x % 1_000_000).cast("string"), 6, "0"))
    pid, ppid = (F.col("event_id") % 997 + 2).cast("string"), (F.col("user_id") % 5 + 1).cast("string")
    head = lambda word, at: F.concat(F.lit(f"{word} pid="), pid, F.lit(" ppid="), ppid, F.lit(" ts="), stamp(at), F.lit(" element=e"), F.col("user_id"), F.lit(".bst inv=i"), F.col("user_id") % 8)
    root = F.concat(F.lit("/buildstream/demo/e"), F.col("user_id"), F.lit(".bst/"))
    temp = F.when(F.col("event_type") == "view", F.concat(F.lit(" -o /tmp/cc"), F.col("event_id"), F.lit("x.s"))).otherwise("")
    cmd = F.concat(F.lit(" cmd=/usr/bin/"), mapped(F.col("event_type"), {"view": "cc", "purchase": "make -j4", "click": "sh -c", "signup": "cmake"}, "ld"), F.lit(" "), root, F.lit("x"), F.col("event_id") % 13, F.lit(".c"), temp)
    end = us + F.round(F.col("value") * 1_000_000).cast("long")
    usage = F.concat(F.lit(" utime="), stamp(F.round(F.col("value") * 500_000).cast("long")), F.lit(" stime=0.100000 maxrss_kb="), (F.col("event_id") % 4096).cast("string"))
    starts = e.select((2 * F.col("event_id")).alias("line_no"), F.concat(head("START", us), cmd).alias("value"))
    ends = e.filter("event_id % 11 != 0").select((2 * F.col("event_id") + 1).alias("line_no"), F.concat(head("END", end), F.when(F.col("event_id") % 3 != 0, usage).otherwise(""), cmd).alias("value"))
    return starts.unionAll(ends)


def build_log_lines(spark: SparkSession, sf_dir: str, wrapped: bool) -> DataFrame:
    """(path, line_no, value): a build log for each run of ``spans``, with or without time stamps.

    Every event begins a task and all but each eleventh end it; each third has a phase within,
    each thirteenth an end too many.
    """
    e = read(spark, sf_dir, "events")
    us, dur = F.unix_micros(F.col("ts").cast("timestamp")), F.round(F.col("value") * 1_000).cast("long") * 1_000
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    clock = lambda x: F.concat(two(F.floor(x / 3_600_000_000)), F.lit(":"), two(F.floor(x / 60_000_000) % 60), F.lit(":"), two(F.floor(x / 1_000_000) % 60), F.lit("."), F.lpad((x % 1_000_000).cast("string"), 6, "0"))
    n, zero = F.col("event_id"), F.lit(0).cast("long")
    line = lambda at, part, elapsed, word, text: F.struct(at.alias("at"), F.lit(part).alias("part"), elapsed.alias("elapsed"), F.lit(word).alias("word"), F.lit(text).alias("text"))
    start, end = F.floor(us / 1_000) * 1_000, F.floor(us / 1_000) * 1_000 + dur
    lines = F.array_compact(
        F.array(
            line(start, 0, zero, "START", "Build"),
            F.when(n % 3 == 0, line(start, 1, zero, "START", "Staging")),
            F.when(n % 3 == 0, line(end, 2, dur, "SUCCESS", "Staging")),
            F.when(n % 11 != 0, line(end, 3, dur, "SUCCESS", "Build")),
            F.when((n % 13 == 0) & (n % 11 != 0), line(end, 4, zero, "SKIPPED", "Build")),
        )
    )
    kind = mapped(F.col("event_type"), {"view": "fetch", "purchase": "build", "click": "track", "signup": "pull"}, "push")
    rows = e.select(run_of("user_id").alias("run_id"), n, "user_id", kind.alias("kind"), F.inline(lines))
    no = F.row_number().over(Window.partitionBy("run_id").orderBy("at", "event_id", "part"))
    body = F.concat(F.lit("["), clock(F.col("elapsed")), F.lit("]["), F.lpad(F.hex("event_id"), 8, "0"), F.lit("][ "), F.rpad(F.col("kind"), 5, " ").substr(F.lit(1), F.length("kind")), F.lit(":e"), F.col("user_id"), F.lit(".bst ] "), F.col("word"), F.lit(" "), F.col("text"))
    stamp = F.concat(F.lit("[log]["), F.date_format(F.timestamp_micros(F.col("at")), "yyyy-MM-dd HH:mm:ss,SSS"), F.lit("] STDERR: "))
    return rows.select(F.concat(F.lit("run"), "run_id").alias("path"), no.cast("long").alias("line_no"), (F.concat(stamp, body) if wrapped else body).alias("value"))


_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " ELSE 'OTHER' END"
_RESOURCE_SQL = "CASE task_kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND_RESOURCE.items()) + " ELSE 'OTHER' END"

SQL = {
    "spans": f"""spans AS (SELECT *, {_RESOURCE_SQL} AS resource, ts_us + dur_us AS finish_us,
        element_uid || '|' || task_kind || '|' || task_kind || '|' || attempt AS task_key FROM (
        SELECT user_id // {RUN_ELEMENTS} AS run_id, 'u' || user_id AS element_uid, {_KIND_SQL} AS task_kind,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS attempt,
        epoch_us(ts) AS ts_us, CAST(round(value * 1000000) AS BIGINT) AS dur_us, event_id AS span_seq FROM events))""",
    "run_edges": f"""users AS (SELECT DISTINCT user_id FROM events),
        run_edges AS (SELECT a.user_id // {RUN_ELEMENTS} AS run_id, 'u' || a.user_id AS predecessor, 'u' || b.user_id AS successor,
        CASE WHEN a.user_id % 20 = 8 THEN 'runtime' ELSE 'build' END AS dependency_type
        FROM users a JOIN users b ON (b.user_id IN (a.user_id + 2, a.user_id + 3) OR (a.user_id % {RUN_ELEMENTS} IN (6, 7) AND b.user_id = a.user_id + 1)) AND a.user_id // {RUN_ELEMENTS} = b.user_id // {RUN_ELEMENTS})""",
    "run_elements": """run_elements AS (SELECT run_id, element_uid AS uid, max(dur_us) AS dur_us, CAST(sum(dur_us) AS BIGINT) AS dur_sum_us,
        CAST(substr(element_uid, 2) AS BIGINT) % 10 = 0 AS requested_target,
        CASE WHEN CAST(substr(element_uid, 2) AS BIGINT) % 7 = 0 THEN 'stack' ELSE 'manual' END AS element_kind
        FROM spans GROUP BY run_id, element_uid)""",
    "supply_edges": """supply_edges AS (SELECT DISTINCT 's' || l_suppkey AS predecessor, 'p' || l_partkey AS successor, 'build' AS dependency_type FROM lineitem
        UNION ALL SELECT DISTINCT 'p' || l_partkey, 'o' || l_orderkey, CASE WHEN (l_orderkey + l_partkey) % 20 = 0 THEN 'runtime' ELSE 'build' END FROM lineitem
        UNION ALL SELECT DISTINCT 'o' || o_orderkey, 'c' || o_custkey, 'build' FROM orders)""",
    "supply_nodes": """supply_nodes AS (SELECT 's' || s_suppkey AS uid, CAST(abs(round(s_acctbal * 100)) AS BIGINT) AS dur_us FROM supplier
        UNION ALL SELECT 'p' || p_partkey, CAST(abs(round(p_retailprice * 100)) AS BIGINT) FROM part
        UNION ALL SELECT 'o' || o_orderkey, CAST(abs(round(o_totalprice * 100)) AS BIGINT) FROM orders
        UNION ALL SELECT 'c' || c_custkey, CAST(abs(round(c_acctbal * 100)) AS BIGINT) FROM customer)""",
    "log_tasks": f"""log_lines AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY moment, event_id, part) AS line_no FROM (
        SELECT user_id // {RUN_ELEMENTS} AS run_id, event_id, user_id, event_type, s + CASE WHEN part IN (0, 1) THEN 0 ELSE dur END AS moment, part, dur FROM (
            SELECT *, epoch_us(ts) // 1000 * 1000 AS s, CAST(round(value * 1000) AS BIGINT) * 1000 AS dur FROM events), range(0, 5) r(part)
        WHERE part = 0 OR (part IN (1, 2) AND event_id % 3 = 0) OR (part = 3 AND event_id % 11 <> 0) OR (part = 4 AND event_id % 13 = 0 AND event_id % 11 <> 0))),
        log_tasks AS (SELECT 'run' || a.run_id AS path, a.run_id, a.event_id, lpad(printf('%X', a.event_id), 8, '0') AS task_hash, 'e' || a.user_id || '.bst' AS element,
        CASE a.event_type WHEN 'view' THEN 'fetch' WHEN 'purchase' THEN 'build' WHEN 'click' THEN 'track' WHEN 'signup' THEN 'pull' ELSE 'push' END AS action,
        a.moment AS ts_us, z.moment AS close_us, a.line_no AS first_line, z.line_no AS last_line, a.dur
        FROM log_lines a LEFT JOIN log_lines z ON z.run_id = a.run_id AND z.event_id = a.event_id AND z.part = 3 WHERE a.part = 0)""",
    "procs": """procs AS (SELECT event_id, 'e' || user_id || '.bst' AS element, 'i' || (user_id % 8) AS invocation, event_id % 997 + 2 AS pid, user_id % 5 + 1 AS ppid,
        epoch_us(ts) AS start_us, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS end_us, event_id % 11 <> 0 AS closed,
        CASE WHEN event_id % 3 <> 0 AND event_id % 11 <> 0 THEN CAST(round(value * 500000) AS BIGINT) + 100000 END AS cpu_us,
        CASE WHEN event_id % 3 <> 0 AND event_id % 11 <> 0 THEN event_id % 4096 END AS rss_kb,
        CASE event_type WHEN 'view' THEN 'cc' WHEN 'purchase' THEN 'make' WHEN 'click' THEN 'sh' WHEN 'signup' THEN 'cmake' ELSE 'ld' END AS binary_name,
        '/usr/bin/' || CASE event_type WHEN 'view' THEN 'cc' WHEN 'purchase' THEN 'make -j4' WHEN 'click' THEN 'sh -c' WHEN 'signup' THEN 'cmake' ELSE 'ld' END || ' /buildstream/demo/e' || user_id || '.bst/x' || (event_id % 13) || '.c' || CASE event_type WHEN 'view' THEN ' -o /tmp/cc' || event_id || 'x.s' ELSE '' END AS cmd
        FROM events)""",
}


def with_frames(*names: str) -> str:
    """``WITH RECURSIVE`` over the named frames (those they need included)."""
    needed = []
    for n in names:
        for x in (["spans"] if n == "run_elements" else []) + [n]:
            if x not in needed:
                needed.append(x)
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in needed)
