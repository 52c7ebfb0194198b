"""Sinks: reports as JSON documents, attribution as CSV, Chrome traces, run directories, store listings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Published document kinds and their schema stamps.
SCHEMAS = {"analyze": "analyze/v1", "compare": "compare/v1", "blast": "blast/v1", "store": "store/v1"}


def run_documents(blocks: dict[str, DataFrame], kind: str = "analyze", sections: list[str] | None = None) -> DataFrame:
    """(run_id, document): one JSON document per run, each block a list of rows ordered by their JSON text.

    ``sections`` names the blocks that are wanted; others are not computed.
    """
    out = None
    for name, df in blocks.items():
        if sections is not None and name not in sections:
            continue
        rows = df.select("run_id", F.to_json(F.struct(*[c for c in df.columns if c != "run_id"])).alias("j"))
        one = rows.groupBy("run_id").agg(F.concat(F.lit(f'"{name}":['), F.concat_ws(",", F.array_sort(F.collect_list("j"))), F.lit("]")).alias("part"))
        out = one if out is None else out.unionByName(one)
    body = F.concat_ws(",", F.array_sort(F.collect_list("part")))
    return out.groupBy("run_id").agg(F.concat(F.lit(f'{{"schema":"{SCHEMAS[kind]}",'), body, F.lit("}")).alias("document"))


def published_schema(blocks: dict[str, DataFrame], kind: str = "analyze") -> str:
    """JSON text with the stamp of a document kind and the schema of each of its blocks."""
    return json.dumps({"schema": SCHEMAS[kind], "blocks": {name: blocks[name].schema.jsonValue() for name in sorted(blocks)}})


def attribution_csv(attribution: DataFrame) -> DataFrame:
    """(run_id, category, duration_us, duration_s, percent), ready for ``write.csv(header=True)``."""
    total = F.sum("dur_us").over(Window.partitionBy("run_id"))
    return attribution.select("run_id", "category", F.col("dur_us").alias("duration_us"), F.round(F.col("dur_us") / 1e6, 6).alias("duration_s"), F.when(total > 0, F.round(100 * F.col("dur_us") / total, 3)).alias("percent"))


def chrome_trace(spans: DataFrame, offset_us: int = 0) -> DataFrame:
    """(run_id, event): one complete trace event per span as JSON; spans without an end become instants."""
    lane = F.dense_rank().over(Window.partitionBy("run_id").orderBy("element_uid")) + 1
    ended = F.col("dur_us").isNotNull()
    event = F.struct(F.when(ended, "X").otherwise("i").alias("ph"), F.col("task_key").alias("name"), (F.col("ts_us") + offset_us).alias("ts"), F.col("dur_us").alias("dur"), F.lit(1).alias("pid"), lane.alias("tid"))
    return spans.select("run_id", F.to_json(event).alias("event"))


def clock_offset_us(plane1: DataFrame, plane2: DataFrame) -> int:
    """What to add to the second clock: the anchor's first start here less its earliest start there.

    The anchor is the element with the longest span that both sides know; both frames have (element, start_us), the first also dur_us.
    """
    both = plane1.groupBy("element").agg(F.min("start_us").alias("a"), F.max("dur_us").alias("d")).join(plane2.groupBy("element").agg(F.min("start_us").alias("b")), "element")
    row = both.orderBy(F.desc("d"), "element").select((F.col("a") - F.col("b")).alias("offset")).limit(1).collect()
    return row[0]["offset"] if row else 0


def write_run_parts(frames: dict[str, DataFrame], path: str) -> None:
    """Canonical frames as Parquet, partitioned by run."""
    for name, df in frames.items():
        df.write.mode("overwrite").partitionBy("run_id").parquet(f"{path.rstrip('/')}/{name}")


def prune(store: DataFrame, keep: int, oldest_stamp: str | None = None) -> DataFrame:
    """Snapshots to delete from (stamp, complete): beyond ``keep`` or too old, but never the last two nor the last complete one."""
    nth = F.row_number().over(Window.orderBy(F.desc("stamp")))
    good = F.row_number().over(Window.partitionBy("complete").orderBy(F.desc("stamp")))
    ranked = store.withColumns({"nth": nth, "good": F.when(F.col("complete"), good)})
    surplus = (F.col("nth") > keep) | (F.col("stamp") < oldest_stamp if oldest_stamp else F.lit(False))
    return ranked.filter(surplus & (F.col("nth") > 2) & (F.coalesce("good", F.lit(0)) != 1)).select("stamp")
