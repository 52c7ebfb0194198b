"""One pass over a process log against the operators that scan once each."""

import pytest
from conftest import rows_of
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tracewright.operators import loading as L
from tracewright.operators import processes as X

SCHEMA = "element string, invocation string, cmd string, start_us long, end_us long, cpu_us long, rss_kb long, coverage string"
ROWS = [
    ("a.bst", "i1", "/usr/bin/make -j4", 10, 90, 5, 100, "both"),
    ("a.bst", "i1", "/usr/bin/cc -c x.c", 20, 60, 30, 900, "both"),
    ("a.bst", "i1", "/usr/bin/cc -c x.c", 20, 60, 30, 900, "both"),
    ("a.bst", "i2", "/usr/bin/ld x.o", 70, None, None, None, "spine"),
    ("b.bst", "i2", "/usr/bin/make -j8 all", 5, 300, None, 7, "hook"),
    ("tmp", None, "", 400, None, None, None, "spine"),
    (None, "i3", "/bin/sh -c true", 500, None, None, None, "both"),
]


@pytest.fixture(scope="module")
def procs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("procs") / "p")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def test_equal_to_separate_operators(procs):
    load = L.process_load(procs)
    want = X.cpu_times(procs).join(X.peak_memory(procs).select(F.col("element").alias("e"), "peak_kb"), F.col("element").eqNullSafe(F.col("e"))).drop("e")
    assert rows_of(L.element_load(load).select(want.columns)) == rows_of(want)
    assert rows_of(L.program_costs(load, 2)) == rows_of(X.binary_costs(procs, 2))
    jobs = {r["element"]: r["requested_jobs"] for r in L.element_load(load).collect()}
    assert jobs == {"a.bst": 4, "b.bst": 8, "tmp": None, None: None}


def test_one_scan_and_counters(procs):
    watch = Observation("load")
    load = L.process_load(procs, watch)
    assert load._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    rows = load.collect()
    assert watch.get == {"n": 7, "n_open": 3, "n_measured": 3, "n_spine": 2}
    (whole,) = [r for r in rows if r["grain"] == "all"]
    assert {k: whole[k] for k in watch.get} == watch.get
    assert sum(r["n"] for r in rows if r["grain"] == "invocation") == 7


def test_coverage_durations_and_summary(procs):
    load = L.process_load(procs)
    seen = {r["element"]: r["opens_coverage"] for r in L.element_load(load).collect()}
    assert seen == {"a.bst": 0.75, "b.bst": 1.0, "tmp": 0.0, None: 1.0}
    assert {r["opens_coverage"] for r in L.element_load(L.process_load(procs.drop("coverage"))).collect()} == {None}
    assert {tuple(r) for r in L.sandbox_durations(load).collect()} == {("i1", 80), ("i2", 295)}
    (row,) = L.log_summary(load).collect()
    assert (row["n"], row["wall_span_us"], row["n_spine"], round(row["recognised"], 6)) == (7, 495, 2, round(5 / 7, 6))
    assert {(r["by"], r["name"]): r["n"] for r in L.counts(load).collect()}[("binary", "cc")] == 2


def test_no_process(procs):
    load = L.process_load(procs.limit(0))
    assert load.count() == 0 and L.counts(load).count() == 0
    (row,) = L.log_summary(load).collect()
    assert (row["n"], row["cpu_us"], row["wall_span_us"], row["recognised"]) == (0, None, None, None)


def test_evidence_of_elements(spark):
    """Each rule fires for what it names, nothing for elements of no worth, and unused dependencies always."""
    from tracewright.operators import correlate as R

    s = 1_000_000
    procs = spark.createDataFrame(
        [
            ("pin", "/usr/bin/make -j1", 0, 100 * s, 20 * s, 10),
            ("ask", "/usr/bin/make -j8", 0, 100 * s, 20 * s, 2 * 1024 * 1024),
            ("ask", "/usr/bin/ld /buildstream/p/ask.bst/o", 0, 3 * s, 1 * s, 5),
            ("busy", "/usr/bin/cc a", 0, 10 * s, 20 * s, 5),
            ("busy", "/usr/bin/cc b", 0, 10 * s, 20 * s, 5),
            ("cheap", "/usr/bin/cc c", 0, 10 * s, 1 * s, 5),
            ("none", "/usr/bin/ld /buildstream/p/none.bst/o", 0, 9 * s, 1 * s, 2 * 1024 * 1024),
        ],
        "uid string, cmd string, start_us long, end_us long, cpu_us long, rss_kb long",
    ).withColumns({"invocation": F.lit("i"), "element": F.col("uid")})
    savings = spark.createDataFrame([(u, w * s, 1000 * s) for u, w in (("pin", 60), ("ask", 60), ("busy", 60), ("cheap", 20), ("none", 1), ("dark", 70))], "uid string, saving_us long, total_us long")
    unused = spark.createDataFrame([("none", 2), ("far", 1)], "uid string, n_unused long")
    assert {(r["uid"], r["redundant_us"]) for r in R.worst_redundancy(procs).collect()} == {("ask", 9 * s), ("none", 9 * s)}
    rows = {(r["uid"], r["evidence"], r["rank"]) for r in R.recommendations(R.element_figures(savings, L.process_load(procs), R.worst_redundancy(procs), unused)).collect()}
    assert rows == {
        ("pin", "pinned-to-one-job", 1), ("pin", "cpu-concentration", 2), ("pin", "serialization-point", 3),
        ("ask", "underachieved-requested-jobs", 1), ("ask", "cpu-concentration", 2), ("ask", "serialization-point", 3), ("ask", "peak-memory", 4), ("ask", "redundant-operation", 5),
        ("busy", "already-compute-bound", 1), ("busy", "cpu-concentration", 2),
        ("cheap", "waiting-not-computing", 1), ("cheap", "cpu-concentration", 2), ("cheap", "serialization-point", 3),
        ("none", "declared-not-used", 6), ("far", "declared-not-used", 6),
    }
