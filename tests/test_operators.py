"""Operators on tiny literal inputs: golden run, topologies, parsers, replay, pairing, bands."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import aggregates as A
from tracewright.operators import blame as B
from tracewright.operators import compare as C
from tracewright.operators import graph as G
from tracewright.operators import intervals as I
from tracewright.operators import kernels as K
from tracewright.operators import prep as P
from tracewright.operators import processes as X
from tracewright.operators import structure as ST
from tracewright.sinks import reports
from tracewright.sources import logs as L
from tracewright.sources import run_dirs as R


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.fixture
def bakery(tmp_path):
    """A run of five elements: dough waits for flour and yeast, bread and rolls for dough; a cleaning phase overlaps."""
    run = tmp_path / "monday"
    run.mkdir()
    edges = [("flour", "dough"), ("yeast", "dough"), ("dough", "bread"), ("dough", "rolls")]
    (run / "graph.json").write_text(json.dumps({"elements": [{"uid": u, "cache_key": f"k-{u}", "requested_target": u == "bread"} for u in ("flour", "yeast", "dough", "bread", "rolls")], "dependencies": [{"predecessor": p, "successor": s, "dependency_type": "build"} for p, s in edges], "run_identity_hash": "b1"}))
    span = lambda u, k, t, d, r: {"task_key": f"{u}|{k}|{k}|0", "ts_us": t, "dur_us": d, "resources": [r], "primary_resource": r}
    spans = [span("flour", "BUILD", 1000, 3000, "PROCESS"), span("yeast", "BUILD", 1000, 7000, "CPU"), span("yeast", "FETCH", 0, 1000, "FETCH"), span("dough", "BUILD", 9000, 10000, "PROCESS"), span("bread", "BUILD", 19000, 20000, "PROCESS"), span("rolls", "BUILD", 21000, 4000, "CPU")]
    (run / "trace.json").write_text(json.dumps({"spans": spans, "phases": [{"name": "cleaning", "ts_us": 30000, "dur_us": 5000}], "run_identity_hash": "b1"}))
    (run / "run-context.json").write_text(json.dumps({"trace_epsilon_us": 1000, "wall_clock": {"start_us": 0, "end_us": 45000}, "resource_capacities": {"PROCESS": 3, "DOWNLOAD": 2}, "max_jobs": 3, "run_identity_hash": "b1"}))
    return str(tmp_path)


def test_run_directory(spark, bakery):
    spans, phases = R.traces(spark, bakery)
    elements, edges = R.graphs(spark, bakery)
    context = R.run_contexts(spark, bakery).first()
    assert (context.wall_start_us, context.wall_end_us, context.resource_capacities["PROCESS"]) == (0, 45000, 3)
    assert phases.count() == 1 and {r.primary_resource for r in spans.collect()} == {"PROCESS", "DOWNLOAD"}
    # busy 0 to 8000, 9000 to 39000; 45000 of work; flour and yeast at once
    o = I.occupancy(spans).first()
    assert (o.horizon_us, o.busy_us, o.area_us, o.peak, o.idle_us) == (39000, 38000, 45000, 2, 1000)
    shares = {r.task_key: r.share_us for r in I.wall_clock_shares(spans).collect()}
    assert shares == {"yeast|FETCH|FETCH|0": 1000, "flour|BUILD|BUILD|0": 1500, "yeast|BUILD|BUILD|0": 5500, "dough|BUILD|BUILD|0": 10000, "bread|BUILD|BUILD|0": 18000, "rolls|BUILD|BUILD|0": 2000}
    dur = spans.groupBy("run_id", "element_uid").agg(F.max("dur_us").alias("dur_us"))
    nodes = elements.join(dur.withColumnRenamed("element_uid", "uid"), ["run_id", "uid"]).withColumn("run_id", F.lit(1).cast("long"))
    metrics = {r.uid: r for r in G.node_metrics(nodes, edges.withColumn("run_id", F.lit(1).cast("long"))).collect()}
    assert metrics["bread"].finish_us == 37000 and metrics["flour"].slack_us == 4000 and metrics["rolls"].slack_us == 16000
    tasks = P.quantised(spans, 1000).withColumn("run_id", F.lit(1).cast("long"))
    one_run = edges.withColumn("run_id", F.lit(1).cast("long"))
    blame = {r.category: r.dur_us for r in B.attribution(P.ready_times(tasks, one_run), P.task_dependencies(tasks, one_run), {"PROCESS": 3, "DOWNLOAD": 2}, 3).collect()}
    # bread 20000, dough 10000 after a slot was free for 1000, yeast 7000 and its fetch 1000
    assert blame == {"EXECUTION_ON_CHAIN": 38000, "SCHEDULER_WAIT": 1000}
    assert R.identity_mismatches(R.run_contexts(spark, bakery), elements, bakery).count() == 0


def test_lenient_documents(spark, tmp_path):
    run = tmp_path / "r"
    run.mkdir()
    (run / "graph.json").write_text(json.dumps({"elements": [{"key": "a"}, {"key": "b", "dependencies": ["a"]}]}))
    (run / "trace.json").write_text(json.dumps({"tasks": [{"element_uid": "a", "kind": "BUILD", "start_us": 1, "finish_us": 5, "resource_profile": {"cpu": 1}}, {"kind": "BUILD"}], "traceEvents": [{"ph": "X", "name": "odd", "ts": 3, "dur": 4}, {"ph": "P", "name": "phase", "ts": 1, "dur": 2}]}))
    spans = {r.task_key: r for r in R.traces(spark, str(tmp_path))[0].collect()}
    assert spans["a|BUILD|EXECUTION|1"].dur_us == 4 and spans["a|BUILD|EXECUTION|1"].resources == ["PROCESS"]
    assert spans["odd"].task_kind == "OTHER" and len(spans) == 2
    assert [(r.predecessor, r.successor) for r in R.graphs(spark, str(tmp_path))[1].collect()] == [("a", "b")]


def test_quantise_rounds_ties_up_also_before_the_epoch(spark):
    df = spark.createDataFrame([(125,), (-125,), (0,), (-1,)], "t long")
    assert [r.q for r in df.select(S.quantise(F.col("t"), 50).alias("q")).collect()] == [150, -100, 0, 0]


@pytest.mark.parametrize(("url", "want"), [("ftp://H.org/a.git", "ftp://H.org/a.git"), ("git+https://H.org/a/b.git", "h.org/a/b"), ("HTTPS://u@H.org/a:b/c", "h.org/a:b/c"), ("H.org:22/x", "h.org:22/x"), ("https://user@Host.org/a/b.git/", "host.org/a/b"), ("git@Host.org:a/b.git", "host.org/a/b"), ("ssh://host:22/x", "host:22/x"), ("odd+scheme://X/Y", "odd+scheme://X/Y"), ("HTTP://H.org", "h.org")])
def test_urls(spark, url, want):
    assert one(spark, S.normalise_url(F.col("u")), u=url) == want


def test_commands(spark):
    signature = lambda c: one(spark, S.command_signature(F.col("c")), c=c)
    assert signature("cc /buildstream/proj/lib.bst/src/x.c -o /tmp/ccAb12.s 42") == "cc <element-root>/src/x.c -o /tmp/<tmp> 42"
    assert signature("cmake CMakeFiles/cmTC_0aF9.dir TryCompile-q1W2 /tmp/ab/x") == "cmake CMakeFiles/cmTC_<id>.dir TryCompile-<id> /tmp/ab/x"
    kind = lambda b: one(spark, S.binary_class(F.col("b")), b=b)
    assert [kind(b) for b in ("cc1plus", "ld.gold", "gcc", "c++", "tar", "install", "uname")] == ["work", "work", "orchestration", "orchestration", "unclassified", "unclassified", "orchestration"]
    keyed = lambda k: one(spark, S.keying_of(F.col("k")), k=k)
    assert [keyed(k) for k in ("git_tag", "workspace", "ostree", "patch_queue")] == ["ref", "content", "unknown", "unknown"]
    leaves = lambda p: one(spark, S.unkeyable_path(F.col("p")), p=p)
    assert [leaves(p) for p in ("/etc/x", "a/../../b", "./..", "a/../b", "a/..b")] == [True, True, True, False, False]
    assert one(spark, S.is_command_block(F.lit(7), F.lit(2), F.col("c")), c="/bin/ash -c x") is True
    assert one(spark, S.binary_name(F.col("c")), c="") == "(unknown)"
    assert one(spark, S.binary_name(F.col("c")), c="/usr/bin/cc x.c") == "cc"
    assert one(spark, S.requested_jobs(F.col("c")), c="make -j8 all") == 8
    assert one(spark, S.requested_jobs(F.col("c")), c="cc -j8") is None
    assert one(spark, S.is_configure_root(F.col("c")), c="sh -c CC=x cmake -S .") is True
    assert one(spark, S.is_configure_root(F.col("c")), c="cmake --build .") is False
    assert one(spark, S.elapsed_us(F.col("c")), c="01:00:01.5") == 3_601_500_000
    assert one(spark, S.elapsed_us(F.col("c")), c="--:--:--") is None


def test_thresholds(spark):
    df = spark.createDataFrame([(1,), (5_000_000,), (None,)], "d long")
    count = lambda t: df.filter(S.passes_threshold(F.col("d"), t)).count()
    assert (count(">= 5 s"), count("< 1 ms"), count("5 s"), count("rubbish"), count("> 10 parsecs")) == (1, 1, 1, 3, 3)


@pytest.mark.parametrize("seed", range(3))
def test_overlap_join_is_complete_and_unique(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [(i, rng.randint(0, 2), s := rng.randint(-500, 500), s + rng.randint(0, 200)) for i in range(n)]
    a, b = make(60), make(60)
    left = spark.createDataFrame(a, "x long, k long, a0 long, a1 long")
    right = spark.createDataFrame(b, "y long, k long, b0 long, b1 long")
    got = sorted((r.x, r.y) for r in I.overlap_join(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), 37).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] < q[3] and q[2] < p[3])


def test_few_long_intervals_are_not_broadcast(spark):
    """Two short tables of intervals over 100,000 bins each: by size before the bins either would be broadcast."""
    left, right = spark.range(1).selectExpr("id AS k", "id AS a0", "id + 100000 AS a1"), spark.range(1).selectExpr("id AS k", "id + 5 AS b0", "id + 99000 AS b1")
    points = spark.range(1).selectExpr("id AS k", "id + 7 AS at")
    for df in (I.overlap_join(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), 1), I.point_join(points, right, ["k"], "at", ("b0", "b1"), 1)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 1


@pytest.mark.parametrize("bucket", (7, 50, 10_000))
def test_sweeps_in_stretches_are_the_same(spark, bucket):
    rng = random.Random(bucket)
    rows = [(rng.randint(0, 2), s := rng.randint(-300, 300), s + rng.choice((0, 1, 5, 200))) for _ in range(120)]
    tasks = spark.createDataFrame(rows, "run_id long, ts_us long, finish_us long")
    whole = sorted(map(tuple, I.slices(tasks).collect()))
    assert sorted(map(tuple, I.slices(tasks, bucket_us=bucket).collect())) == whole and len(whole) > 50


def test_bands_of_a_series_against_plain_medians(spark):
    from statistics import median

    rng = random.Random(3)
    rows = [(s, i, rng.choice((10, 11, 12, 100, rng.randint(0, 40)))) for s in "ab" for i in range(60)]
    got = {(r.k, r.at): r for r in A.trailing_band(spark.createDataFrame(rows, "k string, at long, v long"), ["k"], "at", "v").collect()}
    for s, i, v in rows:
        held = [x for t, j, x in rows if t == s and j < i]
        if len(held) < 3:
            assert got[s, i].verdict == "too-few"
            continue
        m = median(held)
        mad = median(abs(x - m) for x in held)
        half = max(3 * A.MAD_TO_SIGMA * mad, 0.01 * m)
        assert (got[s, i].middle, got[s, i].mad) == (m, mad)
        assert got[s, i].verdict == ("above" if v > m + half else "below" if v < m - half else "inside")


def test_savings_against_brute_force(spark):
    """Longest paths of random graphs with elements taken out, by walking every path."""
    rng = random.Random(5)
    uids = [f"n{i}" for i in range(9)]
    edges = sorted({(uids[i], uids[j]) for i in range(9) for j in rng.sample(range(9), 3) if i < j})
    dur = {u: rng.randint(1, 60) for u in uids}
    nodes = spark.createDataFrame([(1, u, d) for u, d in dur.items()], "run_id long, uid string, dur_us long")
    e = spark.createDataFrame([(1, *x) for x in edges], "run_id long, predecessor string, successor string")

    def longest(gone=()):
        walk = lambda u: (0 if u in gone else dur[u]) + max((walk(s) for p, s in edges if p == u), default=0)
        return max(map(walk, uids))

    total = longest()
    for r in G.realizable_savings(nodes, e).collect():
        assert r.saving_us == total - longest([r.uid])
    joint = G.joint_saving(nodes, e).first()
    members = joint.members.split(",")
    assert joint.saving_us == total - longest(members) and joint.single_us == sum(total - longest([u]) for u in members)
    gone, left = [], total
    for r in G.optimization_horizon(nodes, e).orderBy("step").collect():
        gone.append(r.uid)
        assert r.saving_us == left - longest(gone) and r.left_us == longest(gone)
        left = r.left_us
    below = lambda u: {s for p, s in edges if p == u} | {x for p, s in edges if p == u for x in below(s)}
    for r in ST.batch_savings(nodes, e, candidates=6).collect():
        own = r.members.split(",")
        assert r.combined_us == total - longest(own) > 0 and r.singles_us == sum(total - longest([u]) for u in own)
        assert all(y not in below(x) for x in own for y in own)
    for r in G.independent_batches(nodes, e).collect():
        assert all(y not in below(x) for x in r.members.split(",") for y in r.members.split(","))
    chain = G.serial_chains(nodes, e).first()
    at, n = chain.start, 1
    while len(nxt := [s for p, s in edges if p == at]) == 1:
        at, n = nxt[0], n + 1
    assert chain.n == n
    shares = {r.uid: r.probability for r in K.criticality(nodes, e, samples=50).collect()}
    assert all(0 <= x <= 1 for x in shares.values()) and max(shares.values()) > 0.5
    assert {r.uid: r.probability for r in K.criticality(nodes, e, samples=3, spread=0.0).collect()} == {u: float(u in G.Dag(uids, edges).path(dur)) for u in uids}


def test_build_log_outcomes_and_invocations(spark, tmp_path):
    events = spark.createDataFrame([("p", "a.bst", "FAILURE"), ("p", "a.bst", "FAILURE"), ("p", "b.bst", "SUCCESS"), ("q", "c.bst", "FAIL")], "path string, element string, status string")
    assert sorted(map(tuple, L.failed_elements(events).collect())) == [("p", "a.bst"), ("q", "c.bst")]
    marks = spark.createDataFrame([("p", "B", "bst-invocation", 5), ("p", "E", "bst-invocation", 90), ("p", "B", "x", 1), ("q", "B", "x", 2)], "path string, ph string, name string, ts_us long")
    assert sorted(map(tuple, L.invocation_wall_clock(marks).collect())) == [("p", 5, 90), ("q", None, None)]
    (tmp_path / "i.jsonl").write_text('{"invocation_id": "i1", "started_at": 1.5, "dir_tag": "t", "spine_traced": true}\n{"started_at": 2}\nnot json\n')
    assert [tuple(r) for r in L.sandbox_invocations(spark, str(tmp_path / "i.jsonl")).collect()] == [("i1", 1_500_000, "t", True)]


def test_waits_of_every_kind(spark):
    """One slot of a resource, two jobs at most; worked out by hand."""
    # a 0-10 runs, then b (needs a) is ready at 10 and starts at 40: 10-20 the slot is taken by x, 20-30 one task runs, 30-40 it is taken by y
    rows = [("a", "BUILD", 0, 0, 10, "P", 0), ("b", "BUILD", 0, 40, 50, "P", 10), ("x", "BUILD", 0, 10, 20, "P", 10), ("y", "BUILD", 0, 30, 40, "P", 30), ("z", "BUILD", 0, 20, 30, "Q", 20)]
    make = lambda rows: spark.createDataFrame([(1, f"{u}|{k}|{n}", u, k, k, n, s, f, [r], ready) for u, k, n, s, f, r, ready in rows], "run_id long, task_key string, element_uid string, task_kind string, phase string, attempt long, start_us long, finish_us long, resources array<string>, ready_us long")
    deps = spark.createDataFrame([(1, "b|BUILD|0", "a|BUILD|0")], "run_id long, task_key string, pred_key string")
    got = lambda tasks, jobs: {r.category: r.dur_us for r in B.attribution(tasks, deps, {"P": 1}, jobs).collect()}
    assert got(make(rows), 2) == {"EXECUTION_ON_CHAIN": 20, "RESOURCE_WAIT": 20, "SCHEDULER_WAIT": 10}
    # with one job at most nobody could have started it at 20, and what comes after is not looked at
    assert got(make(rows), 1) == {"EXECUTION_ON_CHAIN": 20, "RESOURCE_WAIT": 10, "DEPENDENCY_WAIT": 20}
    # a second attempt waits for the first one; without a known number of jobs that is its retry
    again = [("a", "BUILD", 0, 0, 10, "P", 0), ("a", "BUILD", 1, 25, 30, "P", 25)]
    none = deps.limit(0)
    assert {r.category: r.dur_us for r in B.attribution(make(again), none, {"P": 1}, None).collect()} == {"EXECUTION_ON_CHAIN": 15, "RETRY_WAIT": 15}
    full = B.with_wall_clock(B.attribution(make(again), none, {"P": 1}, None), make(again), spark.createDataFrame([(1, -5, 37)], "run_id long, wall_start_us long, wall_end_us long"))
    assert {r.category: r.dur_us for r in full.collect()} == {"EXECUTION_ON_CHAIN": 15, "RETRY_WAIT": 15, "HEAD": 5, "TAIL": 7}
    assert [tuple(r) for r in B.reconciliation(full, make(again)).collect()] == [(1, 30, 30, 0)]


def test_rebuild_set_refuses_unknown_cuts(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "uid string")
    edges = spark.createDataFrame([("a", "b", "build"), ("b", "c", "runtime")], "predecessor string, successor string, dependency_type string")
    assert sorted(r.uid for r in G.rebuild_set(nodes.filter("uid = 'a'"), nodes, edges).collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="nowhere"):
        G.rebuild_set(spark.createDataFrame([("nowhere",)], "uid string"), nodes, edges)


def test_cycles_and_dangling_edges_differ(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 1)], "uid string, dur_us long")
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "predecessor string, successor string")
    with pytest.raises(G.CycleError):
        G.longest_paths(nodes, loop)
    assert G.dangling(nodes, spark.createDataFrame([("a", "zz")], "predecessor string, successor string"), []).count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_frontier_and_grouped_forms_agree(spark, seed):
    rng = random.Random(seed)
    uids = [f"n{i:02}" for i in range(25)]
    edges = sorted({(uids[i], uids[j]) for i in range(25) for j in rng.sample(range(25), 3) if i < j})
    nodes = spark.createDataFrame([(1, u, rng.randint(1, 50)) for u in uids], "run_id long, uid string, dur_us long")
    e = spark.createDataFrame([(1, *x) for x in edges], "run_id long, predecessor string, successor string")
    loop = {r.uid: (r.level, r.finish_us) for r in G.longest_paths(nodes, e).collect()}
    grouped = {r.uid: (r.level, r.finish_us, r.n_down) for r in G.node_metrics(nodes, e).collect()}
    assert loop == {u: x[:2] for u, x in grouped.items()}
    reached = {r.origin: r.n for r in G.reach(nodes, e).groupBy("origin").agg(F.count("*").alias("n")).collect()}
    assert reached == {u: x[2] for u, x in grouped.items() if x[2]}


@pytest.mark.parametrize(("width", "united"), ((61_440, 4096), (6, 4096), (6, 1)))
def test_reach_is_counted_without_pairs(spark, monkeypatch, width, united):
    """Elements reached over several lengths, a loop and a repeated edge; starts in one slice or several, sets united in one step or two."""
    monkeypatch.setattr(G, "SLICE", width)
    monkeypatch.setattr(G, "UNITED", united)
    rng = random.Random(width)
    pairs = [(f"n{i}", f"n{j}") for i in range(14) for j in rng.sample(range(14), 2) if i < j] + [("n1", "n2"), ("n1", "n2"), ("x", "y"), ("y", "x")]
    edges = spark.createDataFrame(pairs, "predecessor string, successor string")
    starts = spark.createDataFrame([(f"n{i}",) for i in range(0, 16, 2)] + [("x",), ("x",)], "uid string")
    want = {(r.origin, r["count"]) for r in G.reach(starts, edges).groupBy("origin").count().collect()}
    assert {(r.origin, r.n) for r in G.reach_sizes(starts, edges).collect()} == want


def test_shuffles_of_a_written_table_are_dropped(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    cut = G.shared_cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert files() <= before and cut.count() == 7


def test_dag_diamond():
    dag = G.Dag(list("abcd"), [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    dur = {"a": 1, "b": 5, "c": 5, "d": 1}
    assert dag.path(dur) == ["a", "b", "d"] and dag.length(dur) == 7
    assert dag.named(dag.dominators()["d"]) == ["a", "d"]
    assert dag.finishes({"a": 1, "b": 1, "c": 0, "d": 0}, {"b": 10})["b"] == 11  # a fetch runs beside its predecessor


def test_process_log(spark):
    text = "\n".join(["START pid=2 ppid=1 ts=1.0 element=a.bst cmd=/bin/sh", "junk", "OPENS pid=2 element=a.bst inv=none unique=3 dropped=1", "/usr/include/x.h", "/usr/include/y.h", "START pid=2 ppid=1 ts=1.5 element=a.bst cmd=/usr/bin/cc x.c", "END pid=2 ppid=1 ts=2.0 element=a.bst utime=0.5 stime=0.1 maxrss_kb=1024 cmd=/usr/bin/cc x.c", "START pid=3 ppid=2 ts=2.5 element=a.bst cmd=ld", "START pid=3 ppid=9 ts=3.5 element=a.bst cmd=as", "END pid=4 ppid=2 ts=4.0 element=a.bst cmd=ar"])
    lines = spark.createDataFrame([("p", i, v) for i, v in enumerate(text.split("\n"))], "path string, line_no long, value string")
    events = L.process_events(lines)
    procs = sorted((r.pid, r.start_us, r.end_us, r.exec_chain, r.cmd, r.cpu_us) for r in X.paired(events).collect() if r.pid == 2)
    assert procs == [(2, 1_000_000, 2_000_000, 2, "/usr/bin/cc x.c", 600_000)]
    assert sorted(r.open for r in X.paired(events).filter("pid = 3").collect()) == [True, True]
    assert X.unmatched_ends(events).first().n_unmatched == 1
    files, windows = L.opened_files(lines)
    assert sorted(r.path for r in files.collect()) == ["/usr/include/x.h", "/usr/include/y.h"] and windows.first().dropped == 1


def test_nearest_merge_is_one_to_one(spark):
    hook = spark.createDataFrame([("s", 1, 1_000_000, None), ("s", 1, 1_600_000, 7), ("s", 2, 0, 5)], "scope string, pid long, start_us long, cpu_us long")
    spine = spark.createDataFrame([("s", 1, 1_500_000, 3), ("s", 1, 1_700_000, 4), ("s", 2, 9_000_000, 6), ("t", 1, 1, 1)], "scope string, pid long, start_us long, cpu_us long")
    got = sorted((r.scope, r.pid, r.hook_us, r.spine_us, r.cpu_us, r.coverage) for r in X.merged_streams(hook, spine).filter("coverage = 'both'").collect())
    assert got == [("s", 1, 1_000_000, 1_700_000, 4, "both"), ("s", 1, 1_600_000, 1_500_000, 7, "both")]
    assert X.merged_streams(hook, spine).count() == 5


def test_nearest_merge_against_plain_search(spark):
    rng = random.Random(7)
    side = lambda n, x: [("s", p, rng.randint(0, 60) * 100_000, rng.choice((None, x))) for p in (1, 2, 3) for _ in range(n)]
    hook, spine = side(15, 1), side(12, 2)
    want = []
    for p in (1, 2, 3):
        free = sorted(h[2] for h in hook if h[1] == p)
        for t in sorted(x[2] for x in spine if x[1] == p):
            near = min(free, key=lambda h: (abs(h - t), h), default=None)
            if near is not None and abs(near - t) <= 1_000_000:
                free.remove(near)
                want.append((p, near, t))
            else:
                want.append((p, None, t))
        want += [(p, h, None) for h in free]
    frame = lambda rows: spark.createDataFrame(rows, "scope string, pid long, start_us long, cpu_us long")
    order = lambda r: tuple(-1 if x is None else x for x in r)
    got = [(r.pid, r.hook_us, r.spine_us) for r in X.merged_streams(frame(hook), frame(spine)).collect()]
    assert sorted(got, key=order) == sorted(want, key=order)


def test_element_log(spark, tmp_path):
    folder = tmp_path / "proj" / "el"
    folder.mkdir(parents=True)
    (folder / "84331b67-build.20260818-115322.log").write_text("Tool 2.7.0 - Tuesday, 18-08-2026 at 11:53:22\n[00:00:02][84331b67][   build:el.bst] SUCCESS Staging dependencies\n+ make -j4   all\n-- Configuring done (0.8s)\n[00:00:14][84331b67][   build:el.bst] SUCCESS Running commands\n[00:00:17][84331b67][   build:el.bst] SUCCESS Build\n")
    r = L.element_logs(spark, str(tmp_path)).first()
    assert (r.project, r.element, r.cache_key, r.action, r.total_us, r.outcome) == ("proj", "el", "84331b67", "build", 17_000_000, "SUCCESS")
    assert [(p.name, p.duration_us) for p in r.phases] == [("Staging dependencies", 2_000_000), ("Running commands", 14_000_000)]
    assert r.commands == ["make -j4 all"] and [(t.what, t.duration_us) for t in r.self_timed] == [("Configuring", 800_000)]


def test_build_log_pairs_and_show_records(spark):
    lines = spark.createDataFrame([("f", 0, "[wrapper][2026-08-13 09:00:00,000] INFO: [00:00:00][9febc285][   track:a.bst] START Tracking"), ("f", 1, "noise")], "path string, line_no long, value string")
    e = L.build_log_events(lines).first()
    assert (e.task_hash, e.action, e.element, e.status, e.message, e.elapsed_us) == ("9febc285", "track", "a.bst", "START", "Tracking", 0)
    events = spark.createDataFrame([("l", 0, "B", "x", 0), ("l", 1, "B", "y", 1), ("l", 2, "E", "y", 3), ("l", 3, "E", "x", 9), ("l", 4, "B", "x", 10), ("l", 5, "E", "x", 11)], "lane string, seq long, ph string, name string, ts_us long")
    assert sorted((r.name, r.ts_us, r.dur_us, r.attempt) for r in L.paired_spans(events).collect()) == [("x", 0, 9, 0), ("x", 10, 1, 1), ("y", 1, 2, 0)]
    record = "\x1f".join(["a", "k1", "manual", "true", "- b\n- c", "- c\n- d", "{}"])
    elements, edges = L.show_records(spark.createDataFrame([(record + "\x1e" + record + "\x1ebroken",)], "value string"))
    assert elements.count() == 1 and sorted((r.predecessor, r.dependency_type) for r in edges.collect()) == [("b", "build"), ("c", "build"), ("d", "runtime")]


def test_bands_and_verdicts(spark):
    rows = [(100, 100, [100, 101, 99], None), (100, 150, [100, 101, 99], None), (100, 60, [], None), (100, 100, [], "failed"), (100, None, [], None)]
    got = [r.verdict for r in C.verdicts(spark.createDataFrame(rows, "base_us long, candidate_us long, history array<long>, incomplete string")).collect()]
    assert got == ["unchanged", "regressed", "improved", "not_comparable", "not_comparable"]
    points = spark.createDataFrame([("s", i, v) for i, v in enumerate([10, 10, 10, 10, 50])], "k string, at long, v long")
    assert A.trailing_band(points, ["k"], "at", "v").orderBy("at").collect()[-1].verdict == "above"
    assert A.slope(points.filter("at = 0"), ["k"], "at", "v").first().slope == 0.0


def test_reports(spark):
    df = spark.createDataFrame([(1, "EXECUTION_ON_CHAIN", 75), (1, "IDLE", 25)], "run_id long, category string, dur_us long")
    doc = json.loads(reports.run_documents({"attribution": df, "unwanted": df}, sections=["attribution"]).first().document)
    assert doc["schema"] == "analyze/v1" and len(doc["attribution"]) == 2 and "unwanted" not in doc
    told = json.loads(reports.published_schema({"attribution": df}))
    assert told["schema"] == "analyze/v1" and [f["name"] for f in told["blocks"]["attribution"]["fields"]] == ["run_id", "category", "dur_us"]
    assert {r.category: r.percent for r in reports.attribution_csv(df).collect()} == {"EXECUTION_ON_CHAIN": 75.0, "IDLE": 25.0}
    store = spark.createDataFrame([(f"2026-0{i}", i == 2) for i in range(1, 7)], "stamp string, complete boolean")
    assert sorted(r.stamp for r in reports.prune(store, 3).collect()) == ["2026-01", "2026-03"]
    assert R.resolve_run(store, "@prev").first().stamp == "2026-05" and R.resolve_run(store, "2026").count() == 0


def test_streaming_pairs(spark, tmp_path):
    from tracewright.sources.tables import process_lines
    from tracewright.streaming.pairing import paired_stream

    lines = process_lines(spark, "/root/testdata/sf0.001")
    events = L.process_events(lines)
    events.write.parquet(str(tmp_path / "in"))
    stream = paired_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("paired_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    closed = spark.table("paired_out").filter("state = 'closed'").count()
    assert closed == X.paired(events).filter("NOT open").count() > 0


@pytest.mark.parametrize("seed", range(2))
def test_islands_in_stretches(spark, seed):
    """Any width of stretches gives what one sweep gives."""
    rng = random.Random(seed)
    rows = [(i % 2, rng.randint(0, 400), rng.choice((0, 1, 3, 9, 60))) for i in range(90)]
    tasks = spark.createDataFrame([(r, a, a + n) for r, a, n in rows], "run_id long, ts_us long, finish_us long").cache()
    queue = tasks.selectExpr("run_id", "ts_us AS ready_us", "finish_us AS start_us")
    plain = [sorted(map(tuple, f(*a, bucket_us=None).collect())) for f, a in ((I.merged, (tasks,)), (I.gaps, (tasks,)), (I.filled_timeline, (tasks,)), (I.queue_depth, (queue,)))]
    for width in (1, 7, 50, 10**6):
        assert [sorted(map(tuple, f(*a, bucket_us=width).collect())) for f, a in ((I.merged, (tasks,)), (I.gaps, (tasks,)), (I.filled_timeline, (tasks,)), (I.queue_depth, (queue,)))] == plain
    tasks.unpersist()


def test_long_runs_are_counted(spark, monkeypatch):
    tasks = spark.range(1000).selectExpr("id % 4 AS run_id", "id * 10 AS ts_us", "id * 10 + 15 AS finish_us")
    assert I.stretch_us(tasks, ("run_id",), "ts_us", "finish_us") is None
    before = sorted(map(tuple, I.occupancy(tasks).collect()))
    monkeypatch.setattr(I, "LONG_RUN", 50)
    width = I.stretch_us(tasks, ("run_id",), "ts_us", "finish_us")
    assert 1500 <= width <= 2500
    assert sorted(map(tuple, I.occupancy(tasks).collect())) == before
    assert I.stretch_us(tasks.limit(0), ("run_id",), "ts_us", "finish_us") is None


def test_a_gap_in_the_classes_shows(spark):
    """The categories do not add up where one is left out: idle time does not take the rest."""
    t = [(0, "a|BUILD|BUILD|0", "a", "BUILD", "BUILD", 0, 0, 10, 0, ["PROCESS"]), (0, "b|BUILD|BUILD|0", "b", "BUILD", "BUILD", 0, 14, 20, 0, ["PROCESS"])]
    tasks = spark.createDataFrame(t, "run_id long, task_key string, element_uid string, task_kind string, phase string, attempt long, start_us long, finish_us long, ready_us long, resources array<string>")
    deps = spark.createDataFrame([(0, "b|BUILD|BUILD|0", "a|BUILD|BUILD|0")], "run_id long, task_key string, pred_key string")
    parts = B.attribution(tasks, deps, {"PROCESS": 1}, 1)
    assert B.reconciliation(parts, tasks).first().gap_us == 0
    assert B.reconciliation(parts.filter("category = 'EXECUTION_ON_CHAIN'"), tasks).first().gap_us == 4


def test_runs_that_share_elements_are_compared(spark):
    from tracewright.operators import assembly as Y

    figures = spark.createDataFrame([(0, None, 100, "full", 0.5), (1, None, 80, "full", 0.75), (2, "failed", 50, "full", 0.5), (3, None, 60, "full", 0.5)], "run_id long, incomplete string, horizon_us long, run_mode string, efficiency double")
    nodes = spark.createDataFrame([(r, u) for r, us in ((0, "abcd"), (1, "abce"), (2, "abcd"), (3, "wxyz")) for u in us], "run_id long, uid string")
    pairs = spark.createDataFrame([(0, 1, "same"), (0, 2, "same"), (0, 3, "unknown")], "base_id long, run_id long, same_host string")
    got = {r.run_id: (r.refusal, r.confidence, r.delta_us, r.efficiency_delta) for r in Y.comparisons(figures, nodes, pairs).collect()}
    assert got == {1: (None, "normal", -20, 0.25), 2: ("incomplete", "normal", None, None), 3: ("different_graph", "unknown", None, None)}


def test_targets_of_every_shape(spark):
    from tracewright.operators import utilisation as V

    sources = spark.createDataFrame(
        [(0, "lib.bst", "git", "ref", "host.org/lib"), (0, "app.bst", "local", "content", "files/app"), (0, "sub.bst", "local", "content", "sub.bst:files/sub/deep"), (0, "odd.bst", "local", "content", "../outside"), (0, "abs.bst", "local", "content", "/abs"), (0, "lib2.bst", "pip", "ref", "host.org/lib"), (1, "all.bst", "local", "content", ".")],
        "run_id long, uid string, kind string, keying string, identity string",
    )
    nodes = spark.createDataFrame([(0, u) for u in ("lib.bst", "lib2.bst", "app.bst", "sub.bst", "odd.bst", "abs.bst")] + [(1, "all.bst"), (1, "README.md")], "run_id long, uid string")
    asked = ["https://me@Host.org/lib.git", "host.org/lib", "./files/app/main.c", "files/application", "files", "files/sub/", "app.bst", "README.md", "nowhere", "../outside/x", "/abs/x", " "]
    got: dict = {}
    for r in V.resolve_targets(spark.createDataFrame([(a,) for a in [*asked, "app.bst"]], "target string"), sources, nodes).collect():
        got.setdefault((r.run_id, r.target), []).append((r.resolved_as, r.uid))
    want = {
        (0, "https://me@Host.org/lib.git"): [("url", "lib.bst"), ("url", "lib2.bst")],
        (0, "host.org/lib"): [("url", "lib.bst")],  # as the report prints it: one kind of source
        (0, "./files/app/main.c"): [("path", "app.bst")],
        (0, "files"): [],
        (0, "files/sub/"): [("path", "sub.bst")],
        (0, "app.bst"): [("element", "app.bst")],
    }
    for key, rows in want.items():
        assert sorted(got.get(key, [])) == rows, key
    # where something stages the whole project, names are paths as well
    assert all(got[1, t] == [("path", "all.bst")] for t in ("README.md", "nowhere", "files/application", "app.bst"))
    assert not {(0, t) for t in ("files/application", "nowhere", "../outside/x", " ")} & set(got)


def test_criticality_against_each_sample(spark):
    """The same whatever the blocks are, and as if each sample were walked alone."""
    import numpy as np

    from tracewright.operators import kernels as K

    rng = random.Random(3)
    nodes = [(r, f"n{i:02}", rng.choice((10, 10, 20, 30, rng.randint(1, 60)))) for r in (0, 1) for i in range(12)]
    edges = [(r, f"n{i:02}", f"n{j:02}") for r in (0, 1) for j in range(12) for i in range(j) if rng.random() < 0.2]
    n, e = spark.createDataFrame(nodes, "run_id long, uid string, dur_us long"), spark.createDataFrame(edges, "run_id long, predecessor string, successor string")
    got = [{(x.run_id, x.uid): x.probability for x in K.criticality(n, e, 40, 0.3, 7, block).collect()} for block in (40, 5, 7)]
    want = {}
    for r in (0, 1):
        dag, dur = G.Dag([u for q, u, _ in nodes if q == r], [(a, b) for q, a, b in edges if q == r]), {u: d for q, u, d in nodes if q == r}
        held = dict.fromkeys(dag.uids, 0)
        for s in range(40):
            now = K.sampled(np.array([dur[u] for u in dag.uids], float), s, 0.3, 7)
            for u in dag.path(dict(zip(dag.uids, now.tolist(), strict=True))):
                held[u] += 1
        want |= {(r, u): h / 40 for u, h in held.items()}
    assert got[0] == got[1] == got[2] == want
    assert K.criticality(n.limit(0), e.limit(0)).count() == 0


def test_serial_chains(spark):
    n = spark.createDataFrame([(0, u, 1) for u in "abcdefg"], "run_id long, uid string, dur_us long")
    e = spark.createDataFrame([(0, "a", "b"), (0, "b", "c"), (0, "c", "d"), (0, "c", "e"), (0, "f", "g")], "run_id long, predecessor string, successor string")
    assert [(r.run_id, r.start, r.n) for r in G.serial_chains(n, e).collect()] == [(0, "a", 3)]


def test_rolling_band_against_each_window(spark):
    from statistics import median

    rng = random.Random(8)
    rows = [(s, i, None if rng.random() < 0.1 else float(rng.choice((100, 101, 99, 140, rng.randint(50, 200))))) for s in "ab" for i in range(40)]
    got = {(r.series, r.pos): r.verdict for r in A.rolling_band(spark.createDataFrame(rows, "series string, pos long, total double"), ["series"], "pos", "total", 6).collect()}
    for s, i, x in rows:
        held = [v for t, j, v in rows if t == s and i - 6 <= j < i and v is not None]
        if len(held) < 3:
            assert got[s, i] == "too-few"
            continue
        middle = median(held)
        half = max(3.0 * A.MAD_TO_SIGMA * median(abs(v - middle) for v in held), 0.01 * middle)
        assert got[s, i] == ("inside" if x is None or abs(x - middle) <= half else "above" if x > middle else "below")


def test_reported_times_do_not_depend_on_the_order_of_rows(spark):
    from tracewright.plans.structures import reported

    rows = [(7, "F", 0.1)] * 10 + [(7, "O", 5.0)] + [(8, "F", 2.999)]
    told = lambda r: {x.element: x.configure_us for x in reported(spark.createDataFrame(r, "o_custkey long, o_orderstatus string, o_totalprice double")).collect()}
    assert told(rows) == told(rows[::-1]) == {"e7.bst": 1, "e8.bst": 2}  # ten times 0.1 in doubles is less than 1
