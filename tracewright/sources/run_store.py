"""Run directories as a Spark data source: read and written by run, with traces of both clocks merged.

A directory per run holds JSON files. The source carries them as rows (run_id, file, section, nth,
row): ``row`` is the JSON text of the nth entry of the list ``section`` of a file, or, with an
empty section, a whole file of one object. Python only moves lines of text; the JSON is made and
parsed by Spark. A file is written and read line by line, so a run of any size holds one row in
memory; files of another layout are read whole. Each file is written under a name of its task and
moved into place at the end, the run context last: a run without it is not complete.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "run_id string, file string, section string, nth long, row string"
CONTEXT, GRAPH, TRACE, MERGED = "run-context.json", "graph.json", "trace.json", "merged-trace.json"
_HEAD = re.compile(r'^"([^"]+)": \[$')


def _storage(path: str):
    """The file system and the folder that a path or an address names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class RunFile(InputPartition):
    run_id: str
    file: str
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, str]]  # run, file, where it is now


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.file = options["path"], options.get("file")

    def partitions(self) -> list[RunFile]:
        from pyarrow.fs import FileSelector, FileType

        storage, root = _storage(self.root)
        found = []
        for info in storage.get_file_info(FileSelector(root, recursive=True)):
            parts = info.path.removeprefix(root).strip("/").split("/")
            if info.type == FileType.File and len(parts) == 2 and not parts[0].startswith(".") and parts[1].endswith(".json") and self.file in (None, parts[1]):
                found.append(RunFile(*parts, info.path))
        return found or [RunFile("", "", "")]

    def read(self, partition: RunFile) -> Iterator[tuple]:
        if not partition.path:
            return
        storage, _ = _storage(self.root)
        with storage.open_input_stream(partition.path) as raw:
            lines = io.TextIOWrapper(raw, encoding="utf-8", newline="\n")
            first, second = lines.readline(), lines.readline()
            head = _HEAD.match(second.rstrip("\n"))
            if first == "{\n" and head:
                section, nth = head[1], 0
                for line in map(str.strip, lines):
                    head = _HEAD.match(line)
                    if head:
                        section, nth = head[1], 0
                    elif line.startswith("{"):
                        yield partition.run_id, partition.file, section, nth, line.rstrip(",")
                        nth += 1
                return
            whole = json.loads(first + second + lines.read())
        lists = {k: v for k, v in whole.items() if isinstance(v, list) and partition.file != CONTEXT}
        for section, rows in lists.items():
            yield from ((partition.run_id, partition.file, section, i, json.dumps(r)) for i, r in enumerate(rows))
        rest = {k: v for k, v in whole.items() if k not in lists}
        if rest:
            yield partition.run_id, partition.file, "", 0, json.dumps(rest)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.root, self.overwrite, self.job = options["path"], overwrite, f".parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        storage, root = _storage(self.root)
        folder, done, at, out, section = f"{root}/{self.job}/{uuid.uuid4().hex}", [], None, None, None

        def close() -> None:
            if out is not None:
                out.write(b"\n]\n}\n" if section else b"\n")
                out.close()

        for run, file, name, _, row in iterator:
            if (run, file) != at:
                close()
                if not run or "/" in run or run.startswith("."):
                    raise ValueError(f"no name for a run directory: {run!r}")
                place = f"{folder}/{len(done)}"
                storage.create_dir(folder, recursive=True)
                out, at, section = storage.open_output_stream(place), (run, file), None
                done.append((run, file, place))
            elif not name:
                raise ValueError(f"{run}/{file} has more than one object")
            if name and name != section:
                before = "{" if section is None else "\n],"
                out.write(f'{before}\n"{name}": [\n{row}'.encode())
            else:
                out.write((f",\n{row}" if name else row).encode())
            section = name
        close()
        return Written(done)

    def commit(self, messages: list) -> None:
        storage, root = _storage(self.root)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f[1] == CONTEXT, f))
        if len({f[:2] for f in files}) < len(files):
            self.abort(messages)
            raise ValueError("rows of one file came in several tasks: write through write_rows")
        for run, file, place in files:
            target = f"{root}/{run}/{file}"
            if not self.overwrite and storage.get_file_info(target).is_file:
                self.abort(messages)
                raise FileExistsError(target)
        for run, file, place in files:
            storage.create_dir(f"{root}/{run}", recursive=True)
            storage.move(place, f"{root}/{run}/{file}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        storage, root = _storage(self.root)
        if storage.get_file_info(f"{root}/{self.job}").type == FileType.Directory:
            storage.delete_dir(f"{root}/{self.job}")


class RunDirectories(DataSource):
    """``spark.read.format("run_directories").load(root)``; option ``file`` reads the files of one name only."""

    @classmethod
    def name(cls) -> str:
        return "run_directories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def rows(df: DataFrame, file: str, section: str, order: list[str]) -> DataFrame:
    """The rows of a frame with run_id as entries of a list in a file of each run, in the order of up to ten columns, text or whole numbers."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != "run_id"]))
    text = dict(df.dtypes)
    keys = [F.col(c).alias(f"k{i}s") if text[c] == "string" else F.col(c).cast("long").alias(f"k{i}n") for i, c in enumerate(order)]
    return df.select(F.col("run_id").cast("string").alias("run_id"), F.lit(file).alias("file"), F.lit(section).alias("section"), *keys, body.alias("row"))


def write_rows(parts: list[DataFrame], path: str, overwrite: bool = True) -> None:
    """Write ``rows`` of several frames; a file of a run is one task, which gets its rows sorted and keeps none."""
    parts[0].sparkSession.dataSource.register(RunDirectories)
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = sorted(c for c in every.columns if re.fullmatch(r"k\d[ns]", c))
    laid = every.repartition("run_id", "file").sortWithinPartitions("run_id", "file", "section", *order, "row")
    laid.select("run_id", "file", "section", F.lit(0).cast("long").alias("nth"), "row").write.format("run_directories").mode("overwrite" if overwrite else "append").save(path)


def write_runs(path: str, contexts: DataFrame, elements: DataFrame, edges: DataFrame, spans: DataFrame, phases: DataFrame, overwrite: bool = True) -> None:
    """Frames of the readers in ``run_dirs`` as run directories, which those readers read back."""
    wall = F.struct(F.col("wall_start_us").alias("start_us"), F.col("wall_end_us").alias("end_us")).alias("wall_clock")
    span = spans.select("run_id", "span_seq", "task_key", "ts_us", "dur_us", "resources", "primary_resource", "status")
    write_rows(
        [
            rows(contexts.select("*", wall).drop("wall_start_us", "wall_end_us"), CONTEXT, "", []),
            rows(elements.drop("run_identity_hash"), GRAPH, "elements", ["uid"]),
            rows(edges, GRAPH, "dependencies", ["predecessor", "successor"]),
            rows(span, TRACE, "spans", ["span_seq"]),
            rows(phases, TRACE, "phases", ["ts_us", "name"]),
        ],
        path,
        overwrite,
    )


def read_rows(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """(run_id, file, section, nth, row) of the run directories below ``path``, a task per file."""
    spark.dataSource.register(RunDirectories)
    reader = spark.read.format("run_directories")
    return (reader.option("file", file) if file else reader).load(path)


def read_section(spark: SparkSession, path: str, file: str, section: str, schema: str) -> DataFrame:
    """(run_id, nth, columns of ``schema``) of one list in the files of one name."""
    picked = read_rows(spark, path, file).filter(F.col("section") == section)
    return picked.select("run_id", "nth", F.from_json("row", schema).alias("x")).select("run_id", "nth", "x.*")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(stamp, n_files, bytes, complete) of the run directories below ``path``; complete with context, graph and trace."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path", "length")
    at = F.split("path", "/")
    named = files.select(F.element_at(at, -2).alias("stamp"), F.element_at(at, -1).alias("file"), "length")
    needed = F.count_distinct(F.when(F.col("file").isin(CONTEXT, GRAPH, TRACE), F.col("file")))
    return named.groupBy("stamp").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), (needed == 3).alias("complete"))


def clock_offsets(spans: DataFrame, procs: DataFrame) -> DataFrame:
    """(run_id, anchor, offset_us): what to add to the second clock of each run.

    spans: (run_id, element, start_us, dur_us), procs: (run_id, element, start_us). The anchor is
    the element with the longest span that both know, ties to the smaller name; its first starts meet.
    """
    own = spans.groupBy("run_id", "element").agg(F.min("start_us").alias("a"), F.max("dur_us").alias("d"))
    both = own.join(procs.groupBy("run_id", "element").agg(F.min("start_us").alias("b")), ["run_id", "element"])
    best = F.min_by(F.struct("element", "a", "b"), F.struct(-F.col("d"), F.col("element"))).alias("x")
    return both.groupBy("run_id").agg(best).select("run_id", F.col("x.element").alias("anchor"), (F.col("x.a") - F.col("x.b")).alias("offset_us"))


def merged_trace(spans: DataFrame, procs: DataFrame) -> DataFrame:
    """(run_id, ts, ph, name, dur, pid, element): both planes on one clock, for section traceEvents of a merged trace.

    spans: (run_id, element, name, start_us, dur_us), all of pid 1; procs: (run_id, element, name,
    start_us, end_us), their elements numbered from 2 by name. A process that never ended is an
    instant; a run without an anchor has no merged second plane.
    """
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("element")) + 1
    lanes = procs.select("run_id", "element").distinct().withColumn("pid", nth.cast("long"))
    first = spans.select("run_id", F.col("start_us").alias("ts"), F.lit("X").alias("ph"), "name", F.col("dur_us").alias("dur"), F.lit(1).cast("long").alias("pid"), "element")
    moved = procs.join(clock_offsets(spans, procs).select("run_id", "offset_us"), "run_id").join(lanes, ["run_id", "element"])
    second = moved.select("run_id", (F.col("start_us") + F.col("offset_us")).alias("ts"), F.when(F.col("end_us").isNull(), "i").otherwise("X").alias("ph"), "name", (F.col("end_us") - F.col("start_us")).alias("dur"), "pid", "element")
    return first.unionByName(second)
