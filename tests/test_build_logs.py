"""Build logs with and without time stamps against a clock that goes line by line."""

import random

import pytest

from tracewright.sources import logs as L

EVENTS = "path string, line_no long, at_us long, elapsed_us long, task_hash string, action string, element string, status string, message string"


def random_log(seed, lines=60):
    rng = random.Random(seed)
    out = []
    for n in range(lines):
        main = rng.random() < 0.15
        h, action = ("  ", "main") if main else (f"h{rng.randint(0, 4)}", "build")
        elapsed = None if rng.random() < 0.05 else rng.randint(0, 50)
        out.append(("log", n, None, elapsed, h, action, f"e{h}.bst", rng.choice(("START", "START", "SUCCESS", "FAILURE", "SKIPPED")), "m"))
    return out


def line_by_line(log, now):
    """(task_hash, start, end or None) of every task, and the last time known of what was kept."""
    depth, anchor, stack, tasks, open_, last = {}, {}, [], [], {}, None
    for _, n, _, elapsed, h, action, _, status, _ in log:
        if elapsed is None:
            continue
        if action == "main":
            if status == "START":
                at = now
                stack.append(now)
            else:
                at = (stack.pop() if stack else now) + elapsed
                now = max(now, at)
        elif status == "START":
            depth[h] = depth.get(h, 0) + 1
            if depth[h] > 1:
                continue
            at = anchor[h] = now
            open_[h] = [h, at, None]
            tasks.append(open_[h])
        else:
            had = depth.get(h, 0)
            depth[h] = max(0, had - 1)
            if depth[h]:
                continue
            at = (anchor.pop(h) if had else now) + elapsed
            now = max(now, at)
            if had:
                open_.pop(h)[2] = at
        last = at if last is None else max(last, at)
    return tasks, last


@pytest.mark.parametrize("seed", range(4))
def test_raw_clock_against_line_by_line(spark, seed):
    log = random_log(seed)
    starts = spark.createDataFrame([("log", 1000)], "path string, raw_start_us long")
    tasks, last = line_by_line(log, 1000)
    got = sorted((r.task_hash, r.ts_us, r.finish_us, r.forced) for r in L.raw_log_spans(spark.createDataFrame(log, EVENTS), starts).collect())
    assert got == sorted((h, a, last if z is None else z, z is None) for h, a, z in tasks)


def test_wrapped_lines_and_forced_close(spark):
    text = """[log][2026-01-01 00:00:00,000] STDERR: [--:--:--][        ][    main:core activity ] START Build
[log][2026-01-01 00:00:01,000] STDERR: [00:00:00][aa][build:x.bst] START x.log
[log][2026-01-01 00:00:01,500] STDERR: [00:00:00][aa][build:x.bst] START Staging dependencies
[log][2026-01-01 00:00:02,000] STDERR: [00:00:01][aa][build:x.bst] SUCCESS Staging dependencies
[log][2026-01-01 00:00:02,250] STDERR: [00:00:00][bb][build:y.bst] START y.log
[log][2026-01-01 00:00:03,000] STDERR: [00:00:02][aa][build:x.bst] FAILURE x.log
[log][2026-01-01 00:00:04,000] STDERR: [00:00:02][cc][build:z.bst] SUCCESS stray"""
    lines = spark.createDataFrame([("p", n, v) for n, v in enumerate(text.split("\n"))], "path string, line_no long, value string")
    events = L.build_log_events(lines)
    spans = {r.element: r for r in L.wrapped_log_spans(events).collect()}
    assert set(spans) == {"x.bst", "y.bst"} and not spans["x.bst"].forced and spans["y.bst"].forced
    assert spans["x.bst"].finish_us - spans["x.bst"].ts_us == 2_000_000 and spans["x.bst"].status == "FAILURE" and spans["x.bst"].phase == "x.log"
    assert spans["y.bst"].finish_us - spans["y.bst"].ts_us == 1_750_000 and spans["y.bst"].status is None
    raw = {r.element: r for r in L.raw_log_spans(events, spark.createDataFrame([("p", 0)], "path string, raw_start_us long")).collect()}
    assert (raw["x.bst"].ts_us, raw["x.bst"].finish_us, raw["y.bst"].finish_us) == (0, 2_000_000, 4_000_000)
    assert [(r.start_us, r.end_us) for r in L.element_build_spans(L.wrapped_log_spans(events)).orderBy("element").collect()] == [(spans[e].ts_us, spans[e].finish_us) for e in ("x.bst", "y.bst")]
    assert L.wrapped_log_spans(events.limit(0)).count() == 0 and L.raw_log_spans(events.limit(0), spark.createDataFrame([("p", 0)], "path string, raw_start_us long")).count() == 0
