"""Documents as variants against plain recursion over the same JSON."""

import json
import random

from tracewright.operators import documents as D
from tracewright.sinks.reports import run_documents
from tracewright.sources import saved_reports as R

SCHEMA = "doc_id long, value string"


def _random(rng, depth=0):
    pick = rng.random()
    if depth > 3 or pick < 0.45:
        return rng.choice([0, 1, 2, -5, 1.5, True, False, None, "", "x", 'q"\\', "ä\n"])
    if pick < 0.75:
        return {rng.choice("abcd") + ("" if rng.random() < 0.8 else " k"): _random(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [_random(rng, depth + 1) for _ in range(rng.randrange(4))]


def _changed(rng, v):
    if rng.random() < 0.12:
        return _random(rng, 2)
    if isinstance(v, dict):
        return {k: _changed(rng, x) for k, x in v.items() if rng.random() < 0.9}
    if isinstance(v, list):
        return [_changed(rng, x) for x in v]
    return v


def _under(path, key):
    return f"{path}[{key}]" if isinstance(key, int) else f"{path}.{key}" if path else key


def _leaves(v, path=""):
    if isinstance(v, dict | list) and v:
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            yield from _leaves(x, _under(path, k))
        return
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
    yield path, kind, v if isinstance(v, str) else json.dumps(v)


def _kind(v):
    return "number" if type(v) in (int, float) else type(v)


def _differences(a, b, path=""):
    if isinstance(a, dict) and isinstance(b, dict):
        for k in a.keys() | b.keys():
            if k not in a or k not in b:
                yield _under(path, k), "missing in first" if k not in a else "missing in second"
            else:
                yield from _differences(a[k], b[k], _under(path, k))
    elif isinstance(a, list) and isinstance(b, list):
        if len(a) != len(b):
            yield path, "length"
        else:
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                yield from _differences(x, y, _under(path, i))
    elif _kind(a) != _kind(b) or a != b:
        yield path, "value"


def test_flatten_and_difference_of_random_documents(spark):
    rng = random.Random(11)
    first = {i: {k: _random(rng, 1) for k in "uvwxy"} if i % 4 else _random(rng) for i in range(60)}
    second = {i: _changed(rng, v) for i, v in first.items() if i != 7} | {99: {"only": 1}}
    frame = lambda docs: D.parsed(spark.createDataFrame([(i, json.dumps(v)) for i, v in docs.items()] + [(1000, "no json"), (1001, None)], SCHEMA))
    a, b = frame(first), frame(second)
    got = sorted(tuple(r) for r in D.flattened(a).collect())
    assert got == sorted((i, *leaf) for i, v in first.items() for leaf in _leaves(v))
    want = {(i, p, w) for i, v in first.items() if i in second for p, w in _differences(v, second[i])} | {(7, "", "missing in second"), (99, "", "missing in first")}
    rows = [tuple(r) for r in D.difference(a, b).select("doc_id", "path", "what").collect()]
    assert len(want) > 20 and {w for _, _, w in want} == {"value", "length", "missing in first", "missing in second"}
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_numbers_are_compared_by_value(spark):
    side = lambda text: D.parsed(spark.createDataFrame([(0, text)], SCHEMA))
    assert D.difference(side('{"a": [1, 2.50]}'), side('{"a": [1.0, 2.5]}')).count() == 0
    (row,) = D.difference(side('{"a": 1}'), side('{"a": "1"}')).collect()
    assert (row["first"], row["second"]) == ("1", '"1"')


def test_saved_reports_are_read_back(spark, tmp_path):
    block = spark.createDataFrame([(1, "a", 5, 0.5), (1, "b", None, 1.25), (2, "c", 7, None)], "run_id long, name string, n long, share double")
    for row in run_documents({"rows": block}).collect():
        (tmp_path / f"r{row['run_id']}.json").write_text(row["document"])
    (tmp_path / "log.txt").write_text("Not a report {")
    (tmp_path / "other.json").write_text('{"rows": []}')
    (tmp_path / "list.json").write_text("[1]")
    reports = R.saved_reports(spark, str(tmp_path))
    assert reports.count() == 2
    rows = {tuple(r)[1:] for r in R.report_block(reports, "rows", "name string, n long, share double, later string").collect()}
    assert rows == {("a", 5, 0.5, None), ("b", None, 1.25, None), ("c", 7, None, None)}
    assert R.report_block(reports, "elsewhere", "name string").count() == 0
