"""Streaming forms: processes paired as their records arrive, and sandbox sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "scope string, pid long, src string, start_us long, end_us long, cmd string, exec_chain long, state string"
STATE = "start_us long, ppid long, cmd string, chain long"


def _pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows, scope, pid, src = [], *key
    if state.hasTimedOut:
        start, _, cmd, chain = state.get
        state.remove()
        yield pd.DataFrame([(scope, pid, src, start, None, cmd, chain, "open")], columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"end_us": "Int64"})
        return
    held = state.get if state.exists else None
    for r in pd.concat(list(batches)).sort_values(["ts_us", "line_no"]).itertuples():
        if r.event == "START":
            if held and held[1] != r.ppid:  # the pid is used again
                rows.append((scope, pid, src, held[0], None, held[2], held[3], "end-lost"))
                held = None
            held = (held[0], r.ppid, r.cmd, held[3] + 1) if held else (r.ts_us, r.ppid, r.cmd, 1)
        elif held:
            rows.append((scope, pid, src, held[0], r.ts_us, held[2], held[3], "closed"))
            held = None
    if held:
        state.update(held)
        # not before the watermark: its group waits from the newest time that is known
        state.setTimeoutTimestamp(max(held[0] // 1000, state.getCurrentWatermarkMs()) + 3_600_000)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"end_us": "Int64"})


def paired_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Process records of a stream of log events (columns of ``process_events``).

    State is one open process per scope, pid and stream; one that does not end within an
    hour of event time is emitted as open.
    """
    keyed = events.withColumn("scope", F.coalesce("invocation", "element")).withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)
    return keyed.groupBy("scope", "pid", "src").applyInPandasWithState(_pair, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def sandbox_sessions(events: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(scope, session, n): stretches of activity of each sandbox, closed by a quiet ``gap``."""
    timed = events.withColumn("scope", F.coalesce("invocation", "element")).withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)
    return timed.groupBy("scope", F.session_window("event_time", gap)).agg(F.count("*").alias("n"))
