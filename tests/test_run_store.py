"""Run directories written and read back: by the data source, and by the readers of single files."""

import json

import pytest
from conftest import rows_of

from tracewright.sources import run_dirs as R
from tracewright.sources import run_store as S

SPAN = "run_id string, span_seq long, task_key string, ts_us long, dur_us long, resources array<string>, primary_resource string, status string"


@pytest.fixture()
def frames(spark):
    contexts = spark.createDataFrame([("r1", 5, 90, 4), ("r2", None, None, None)], "run_id string, wall_start_us long, wall_end_us long, max_jobs long")
    elements = spark.createDataFrame([("r1", "a", True, "stack"), ("r1", 'b"]', False, None), ("r2", "c\n{", True, "manual")], "run_id string, uid string, requested_target boolean, element_kind string")
    edges = spark.createDataFrame([("r1", "a", 'b"]', "build")], "run_id string, predecessor string, successor string, dependency_type string")
    spans = spark.createDataFrame([("r1", i, f"a|BUILD|x|{i}", 10 * i, i or None, ["PROCESS"], None, "SUCCESS" if i % 2 else None) for i in range(12)] + [("r2", 0, "c|FETCH|x|1", 3, 4, [], "DOWNLOAD", None)], SPAN)
    phases = spark.createDataFrame([("r1", "load", 1, 2)], "run_id string, name string, ts_us long, dur_us long")
    return contexts, elements, edges, spans, phases


def test_written_runs_read_back(spark, frames, tmp_path):
    contexts, elements, edges, spans, phases = frames
    root = str(tmp_path / "runs")
    S.write_runs(root, *frames)
    back, parts = R.traces(spark, root)
    assert rows_of(back.select(spans.columns)) == rows_of(spans) and rows_of(parts) == rows_of(phases)
    nodes, links = R.graphs(spark, root)
    assert rows_of(nodes.select(elements.columns)) == rows_of(elements) and rows_of(links) == rows_of(edges)
    assert rows_of(R.run_contexts(spark, root).select(contexts.columns)) == rows_of(contexts)
    listed = S.read_section(spark, root, S.TRACE, "spans", SPAN.replace("run_id string, ", ""))
    assert rows_of(listed.select(spans.columns)) == rows_of(spans)
    assert [r["nth"] for r in listed.filter("run_id = 'r1'").orderBy("span_seq").collect()] == list(range(12))
    assert {(r["stamp"], r["n_files"], r["complete"]) for r in S.listing(spark, root).collect()} == {("r1", 3, True), ("r2", 3, True)}
    assert json.loads((tmp_path / "runs" / "r2" / "graph.json").read_text())["elements"][0]["uid"] == "c\n{"
    assert not [p for p in (tmp_path / "runs").iterdir() if p.name.startswith(".")]


def test_other_layouts_and_empty_stores(spark, tmp_path):
    (tmp_path / "r9").mkdir()
    (tmp_path / "r9" / "trace.json").write_text(json.dumps({"spans": [{"task_key": "k", "ts_us": 1}, {"task_key": "l"}], "run_identity_hash": "h"}, indent=2))
    rows = [tuple(r) for r in S.read_rows(spark, str(tmp_path)).orderBy("section", "nth").collect()]
    assert [r[:4] for r in rows] == [("r9", "trace.json", "", 0), ("r9", "trace.json", "spans", 0), ("r9", "trace.json", "spans", 1)]
    assert json.loads(rows[0][4]) == {"run_identity_hash": "h"}
    (tmp_path / "none").mkdir()
    assert S.read_rows(spark, str(tmp_path / "none")).count() == 0


def test_writes_that_must_not_happen(spark, frames, tmp_path):
    root = str(tmp_path / "runs")
    part = S.rows(frames[3], S.TRACE, "spans", ["span_seq"])
    S.write_rows([part], root)
    before = (tmp_path / "runs" / "r1" / "trace.json").read_text()
    with pytest.raises(Exception, match="trace.json"):
        S.write_rows([part], root, overwrite=False)
    outside = spark.createDataFrame([("../out", 1)], "run_id string, x long")
    with pytest.raises(Exception, match="no name for a run directory"):
        S.write_rows([S.rows(outside, S.TRACE, "spans", ["x"])], root)
    assert (tmp_path / "runs" / "r1" / "trace.json").read_text() == before
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == ["r1", "r2"]


def test_two_clocks_in_one_trace(spark):
    spans = spark.createDataFrame([("r", "a", "A", 1000, 50), ("r", "b", "B", 2000, 500), ("r", "b", "B2", 1900, 1), ("s", "a", "A", 7, 1)], "run_id string, element string, name string, start_us long, dur_us long")
    procs = spark.createDataFrame([("r", "b", "cc", 30, 40), ("r", "b", "ld", 50, None), ("r", "zz", "sh", 20, 21), ("s", "b", "cc", 1, 2)], "run_id string, element string, name string, start_us long, end_us long")
    assert [tuple(r) for r in S.clock_offsets(spans, procs).collect()] == [("r", "b", 1870)]
    second = {tuple(r) for r in S.merged_trace(spans, procs).filter("pid > 1").collect()}
    assert second == {("r", 1900, "X", "cc", 10, 2, "b"), ("r", 1920, "i", "ld", None, 2, "b"), ("r", 1890, "X", "sh", 1, 3, "zz")}
    assert S.merged_trace(spans, procs).filter("pid = 1").count() == 4
