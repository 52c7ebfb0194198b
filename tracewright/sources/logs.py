"""Text logs as frames: process logs, opened files, element logs and build logs."""

from __future__ import annotations

import re
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.scalars import elapsed_us


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of text files; a file is one row first, so lines keep their order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))


def process_events(lines: DataFrame) -> DataFrame:
    """START and END records of a process log, from (line_no, value); other lines and malformed ones are skipped.

    CPU time is known only where both user and system time are there.
    """
    v = F.col("value")
    event = F.regexp_extract(v, r"^(START|END) ", 1)
    head = F.regexp_replace(v, r" cmd=.*$", "")
    field = lambda name: F.nullif(F.regexp_extract(head, rf" {name}=(\S+)", 1), F.lit(""))
    cpu = lambda u, s: F.round((field(u).cast("double") + field(s).cast("double")) * 1_000_000).cast("long")
    out = lines.filter(v.rlike(r"^(START|END) pid=\d+ ppid=\d+ ts=\d+(\.\d+)? ")).select(
        "line_no",
        event.alias("event"),
        field("pid").cast("long").alias("pid"),
        field("ppid").cast("long").alias("ppid"),
        F.round(field("ts").cast("decimal(20,6)") * 1_000_000).cast("long").alias("ts_us"),
        field("element").alias("element"),
        F.nullif(field("inv"), F.lit("none")).alias("invocation"),
        F.coalesce(field("src"), F.lit("hook")).alias("src"),
        field("exit").alias("exit_status"),
        cpu("utime", "stime").alias("cpu_us"),
        cpu("cutime", "cstime").alias("children_cpu_us"),
        field("maxrss_kb").cast("long").alias("rss_kb"),
        field("cmaxrss_kb").cast("long").alias("children_rss_kb"),
        F.regexp_extract(v, r" cmd=(.*)$", 1).alias("cmd"),
    )
    return out


def opened_files(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(element, pid, path) and (element, pid, unique, dropped) of the OPENS blocks of a log.

    ``lines`` is (path, line_no, value), one log per path. A block ends after its number of lines, or early at a record.
    """
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_head, is_record = F.col("value").startswith("OPENS "), F.col("value").rlike(r"^(START|END) ")
    mark = F.when(is_head, F.struct("line_no", "value")).when(is_record, F.struct("line_no", F.lit("").alias("value")))
    blocks = lines.withColumn("head", F.last(mark, ignorenulls=True).over(w)).filter(F.col("head.value").startswith("OPENS "))
    field = lambda name: F.regexp_extract("head.value", rf" {name}=(\S+)", 1)
    named = blocks.select("path", (F.col("line_no") - F.col("head.line_no")).alias("at"), field("element").alias("element"), field("pid").cast("long").alias("pid"), field("unique").cast("long").alias("unique"), field("dropped").cast("long").alias("dropped"), "value")
    files = named.filter("at > 0 AND at <= unique AND value <> ''").select("element", "pid", F.col("value").alias("path")).distinct()
    windows = named.filter("at = 0").groupBy("element", "pid").agg(F.max("unique").alias("unique"), F.max("dropped").alias("dropped"))
    return files, windows


_STAMP = re.compile(r"(\d{1,2})-(\d{1,2})-(\d{4}) at (\d{1,2}):(\d{2}):(\d{2})")
_PHASE = re.compile(r"\[(\d+:\d{2}:\d{2}|--:--:--)\].*?\[\s*\w+:([^\]]+)\]\s+(START|SUCCESS|FAILURE)\s+(.*)$")
_NAME = re.compile(r"([^/]+)/([^/]+)/([0-9a-f]+)-(\w+)\.(\d{8}-\d{6})\.log$")
_TIMED = re.compile(r"^(?:-- )?(\w[\w ]*?) done \((\d+(?:\.\d+)?)s\)")


def _element_log(path: str, text: str) -> tuple | None:
    m = _NAME.search(path)
    if not m:
        return None
    project, element, key, action, _ = m.groups()
    s = _STAMP.search(text.split("\n", 1)[0])
    started = int(datetime(int(s[3]), int(s[2]), int(s[1]), int(s[4]), int(s[5]), int(s[6]), tzinfo=UTC).timestamp() * 1_000_000) if s else None
    phases, commands, timed, total, outcome = [], [], [], None, None
    for line in text.split("\n"):
        if p := _PHASE.search(line):
            if p[3] == "START":
                continue
            took = None if p[1].startswith("-") else (int(p[1][:-6]) * 3600 + int(p[1][-5:-3]) * 60 + int(p[1][-2:])) * 1_000_000
            phases.append((p[4].strip(), took, p[3]))
        elif line.startswith(("+ ", "    + ")):
            commands.append(" ".join(line.strip()[2:].split()))
        elif t := _TIMED.search(line.strip()):
            timed.append((t[1], int(round(float(t[2]) * 1_000_000))))
    if phases:  # the enclosing activity ends last
        total, outcome = phases[-1][1], phases[-1][2]
        phases = phases[:-1]
    return path, project, element, key, action, started, total, outcome, phases, commands, timed


ELEMENT_LOG_SCHEMA = "path string, project string, element string, cache_key string, action string, started_us long, total_us long, outcome string, phases array<struct<name:string,duration_us:bigint,outcome:string>>, commands array<string>, self_timed array<struct<what:string,duration_us:bigint>>"


def element_logs(spark: SparkSession, root: str) -> DataFrame:
    """One row per element log below ``root``; files of another name are skipped."""
    files = spark.read.text(f"{root}", wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")

    def parse(batches):
        for pdf in batches:
            rows = [r for r in map(_element_log, pdf["path"], pdf["value"]) if r]
            if rows:
                yield pd.DataFrame(rows, columns=["path", "project", "element", "cache_key", "action", "started_us", "total_us", "outcome", "phases", "commands", "self_timed"]).astype({"started_us": "Int64", "total_us": "Int64"})

    return files.mapInPandas(parse, ELEMENT_LOG_SCHEMA)


_BUILD_LINE = r"\[([^\]]*)\]\[([^\]]+)\]\[\s*(\w+):([^\]]+)\]\s+(START|SUCCESS|FAILURE|FAIL|CACHED|SKIPPED|SKIP)\s+(.*)"


def build_log_events(lines: DataFrame) -> DataFrame:
    """Task messages of a wrapped build log: (path, line_no, at_us, elapsed_us, task_hash, action, element, status, message)."""
    part = lambda i: F.regexp_extract("value", _BUILD_LINE, i)
    stamp = F.regexp_extract("value", r"^\[[^\]]*\]\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})\]", 1)
    at = F.unix_micros(F.to_timestamp(F.nullif(stamp, F.lit("")), "yyyy-MM-dd HH:mm:ss,SSS"))
    body = lines.withColumn("value", F.regexp_replace("value", r"^\[[^\]]*\]\[\d{4}-\d{2}-\d{2} [^\]]*\]\s+\w+:\s+", ""))
    stamped = lines.select("path", "line_no", at.alias("at_us"))
    return body.filter(part(5) != "").join(stamped, ["path", "line_no"]).select("path", "line_no", "at_us", elapsed_us(part(1)).alias("elapsed_us"), part(2).alias("task_hash"), part(3).alias("action"), part(4).alias("element"), part(5).alias("status"), part(6).alias("message"))


def task_boundaries(events: DataFrame) -> DataFrame:
    """``events`` that count for the clock, with ``opens``, ``closes`` and ``start_line``.

    Of a task's messages only the outermost begin and end count; how deep one is comes from a
    running sum that never falls below zero. An end without a begin closes nothing but is kept.
    Messages of the whole invocation (``main`` without a hash) nest as they are and all stay.
    """
    main = (F.col("action") == "main") & (F.trim("task_hash") == "")
    w = Window.partitionBy("path", "task_hash").orderBy("line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    tasks = events.filter(~main).withColumn("sum", F.sum(F.when(F.col("status") == "START", 1).otherwise(-1)).over(so_far))
    tasks = tasks.withColumn("depth", F.col("sum") - F.least(F.min("sum").over(so_far), F.lit(0)))
    opens = (F.col("status") == "START") & (F.col("depth") == 1)
    outer = tasks.withColumn("opens", opens).withColumn("closes", (F.col("status") != "START") & (F.col("depth") == 0))
    began = F.last(F.when(F.col("opens"), F.struct("line_no", "message")), ignorenulls=True).over(so_far)
    outer = outer.withColumn("began", began).filter("opens OR closes")
    # a begin belongs to the first end after it; an end whose begin has one already is stray
    first = F.row_number().over(Window.partitionBy("path", "task_hash", "began.line_no", "closes").orderBy("line_no")) == 1
    own = F.when(F.col("began").isNotNull() & first, F.col("began.line_no"))
    kept = outer.withColumn("start_line", own).select(*events.columns, "opens", "closes", "start_line", F.lit(False).alias("is_main"))
    whole = events.filter(main).select("*", (F.col("status") == "START").alias("opens"), (F.col("status") != "START").alias("closes"), F.lit(None).cast("long").alias("start_line"), F.lit(True).alias("is_main"))
    return kept.unionByName(whole)


def raw_clock(boundaries: DataFrame, starts: DataFrame) -> DataFrame:
    """``boundaries`` of logs without time stamps, with ``at_us``; starts: (path, raw_start_us).

    A task begins at the latest time known so far and ends its own elapsed time later, which may
    move the time known. That depends on the order of the lines: one pass over the boundaries of
    a file, which holds one number for each open task.
    """
    cols = ["path", "line_no", "start_line", "elapsed_us", "opens", "is_main"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        now, began, stack, out = int(pdf["raw_start_us"].iloc[0]), {}, [], []
        for line, start, elapsed, opens, is_main in pdf[cols[1:]].itertuples(index=False, name=None):
            if opens:
                at = now
                began[line] = now
                if is_main:
                    stack.append(now)
            else:
                anchor = (stack.pop() if stack else now) if is_main else now if pd.isna(start) else began.pop(int(start))
                at = anchor + int(elapsed)
                now = max(now, at)
            out.append(at)
        return pd.DataFrame({"path": pdf["path"], "line_no": pdf["line_no"], "at_us": out})

    known = boundaries.filter("elapsed_us IS NOT NULL").join(starts, "path")
    clock = known.select(*cols, "raw_start_us").groupBy("path").applyInPandas(one, "path string, line_no long, at_us long")
    return boundaries.drop("at_us").join(clock, ["path", "line_no"])


def log_spans(timed: DataFrame, ends: DataFrame) -> DataFrame:
    """(path, task_hash, element, action, phase, ts_us, finish_us, status, forced) from timed ``task_boundaries``.

    ends: (path, end_us). A task that is open at the end of its invocation is closed there,
    ``forced`` and without a status.
    """
    tasks = timed.filter("NOT is_main")
    begins = tasks.filter("opens").select("path", "task_hash", F.trim("element").alias("element"), "action", F.trim("message").alias("phase"), F.col("line_no").alias("start_line"), F.col("at_us").alias("ts_us"))
    closed = tasks.filter("closes AND start_line IS NOT NULL").select("path", "start_line", F.col("at_us").alias("close_us"), "status")
    both = begins.join(closed, ["path", "start_line"], "left").join(ends, "path", "left")
    return both.select("path", "task_hash", "element", "action", "phase", "ts_us", F.coalesce("close_us", "end_us").alias("finish_us"), "status", F.col("status").isNull().alias("forced"))


def wrapped_log_spans(events: DataFrame) -> DataFrame:
    """``log_spans`` of ``build_log_events`` with time stamps; an invocation ends with its last message."""
    return log_spans(task_boundaries(events), events.groupBy("path").agg(F.max("at_us").alias("end_us")))


def raw_log_spans(events: DataFrame, starts: DataFrame) -> DataFrame:
    """``log_spans`` of ``build_log_events`` without time stamps; an invocation ends with the last time known."""
    timed = raw_clock(task_boundaries(events.filter("elapsed_us IS NOT NULL")), starts)
    return log_spans(timed, timed.groupBy("path").agg(F.max("at_us").alias("end_us")))


def element_build_spans(spans: DataFrame) -> DataFrame:
    """(path, element, start_us, end_us): from the first begin to the last end of each element's build tasks."""
    return spans.filter("action = 'build'").groupBy("path", "element").agg(F.min("ts_us").alias("start_us"), F.max("finish_us").alias("end_us"))


def failed_elements(events: DataFrame) -> DataFrame:
    """(path, element) with a failed task, from ``build_log_events``."""
    return events.filter("status IN ('FAILURE', 'FAIL')").select("path", "element").distinct()


def invocation_wall_clock(events: DataFrame, name: str = "bst-invocation") -> DataFrame:
    """(path, wall_start_us, wall_end_us): first begin and last end of the whole invocation, from (path, ph, name, ts_us); null where not recorded."""
    own = F.col("name") == name
    return events.groupBy("path").agg(F.min(F.when(own & (F.col("ph") == "B"), F.col("ts_us"))).alias("wall_start_us"), F.max(F.when(own & (F.col("ph") == "E"), F.col("ts_us"))).alias("wall_end_us"))


INVOCATION_SCHEMA = "invocation_id string, started_at double, dir_tag string, spine_traced boolean"


def sandbox_invocations(spark: SparkSession, path: str) -> DataFrame:
    """(invocation, at_us, dir_tag, spine_traced) from JSON lines; lines without an id or a time are skipped."""
    rows = spark.read.schema(INVOCATION_SCHEMA).json(path)
    return rows.filter("invocation_id IS NOT NULL AND started_at IS NOT NULL").select(F.col("invocation_id").alias("invocation"), F.round(F.col("started_at") * 1_000_000).cast("long").alias("at_us"), "dir_tag", "spine_traced")


def paired_spans(events: DataFrame) -> DataFrame:
    """Begin and end events paired innermost first: (lane, name, ts_us, dur_us, attempt) from (lane, seq, ph, name, ts_us).

    The depth of an event is a running sum; the n-th begin of a depth meets its n-th end.
    """
    w = Window.partitionBy("lane").orderBy("ts_us", "seq")
    depth = F.sum(F.when(F.col("ph") == "B", 1).otherwise(-1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = events.filter(F.col("ph").isin("B", "E")).withColumn("depth", depth + F.when(F.col("ph") == "E", 1).otherwise(0))
    nth = placed.withColumn("nth", F.row_number().over(Window.partitionBy("lane", "depth", "ph").orderBy("ts_us", "seq")))
    b, e = nth.filter("ph = 'B'").drop("ph"), nth.filter("ph = 'E'").select("lane", "depth", "nth", F.col("ts_us").alias("end_us"))
    spans = b.join(e, ["lane", "depth", "nth"]).select("lane", "name", "ts_us", (F.col("end_us") - F.col("ts_us")).alias("dur_us"), "seq")
    return spans.withColumn("attempt", F.row_number().over(Window.partitionBy("name").orderBy("ts_us", "seq")) - 1).drop("seq")


def show_records(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements and edges from record-separated listings, (value): name, key, kind, target flag, build and runtime dependencies, flags.

    Records without seven fields are skipped; the first of a name wins; runtime edges are those not also build edges.
    """
    records = text.select(F.posexplode(F.split("value", "\x1e")).alias("at", "r")).select("at", F.split("r", "\x1f").alias("f")).filter(F.size("f") == 7)
    first = records.withColumn("n", F.row_number().over(Window.partitionBy(F.trim(F.col("f")[0])).orderBy("at"))).filter("n = 1")
    names = lambda i: F.filter(F.transform(F.split(F.col("f")[i], r"[\n,]"), lambda x: F.trim(F.regexp_replace(x, r"^\s*-\s*", ""))), lambda x: ~x.isin("", "[]"))
    elements = first.select(F.trim(F.col("f")[0]).alias("uid"), F.nullif(F.trim(F.col("f")[1]), F.lit("")).alias("cache_key"), F.trim(F.col("f")[2]).alias("element_kind"), (F.trim(F.col("f")[3]) == "true").alias("requested_target"))
    build = first.select(F.explode(names(4)).alias("predecessor"), F.trim(F.col("f")[0]).alias("successor"))
    runtime = first.select(F.explode(names(5)).alias("predecessor"), F.trim(F.col("f")[0]).alias("successor")).join(build, ["predecessor", "successor"], "left_anti")
    return elements, build.withColumn("dependency_type", F.lit("build")).unionByName(runtime.withColumn("dependency_type", F.lit("runtime")))
