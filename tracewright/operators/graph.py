"""Graph analytics over dependency edges.

Two forms. *Frontier loops* run one small job per level over the whole edge table and
suit wide graphs of few levels, whatever their size. *Per-run graphs* of one run fit one
task (10^2 to 10^4 elements) and are handled in a grouped map, in parallel over runs.

Ties between equally long paths go to the smaller uid.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class CycleError(ValueError):
    """The edges of some run hold a cycle."""


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of this machine only where the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        if spark not in _LOCAL:
            _LOCAL[spark] = tempfile.mkdtemp(prefix="tracewright-")
        folder = _LOCAL[spark]
    return folder.rstrip("/")


_LOCAL: dict[SparkSession, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_cut(df: DataFrame) -> DataFrame:
    """``df`` written in the checkpoint folder that all executors share, and read from there.

    Unlike a checkpoint, a table that is read has its own size, so that the plans of a loop
    neither carry nor multiply the estimates of the rounds before. The shuffles that made it are
    over with it: Spark drops their files when the table is written, not when the driver collects garbage.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


# --- set-based operators -------------------------------------------------------------


def degrees(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """In- and out-degree of every node, zero where it has no edge."""
    ins = edges.groupBy(*by, F.col("successor").alias("uid")).agg(F.count("*").alias("in_degree"))
    outs = edges.groupBy(*by, F.col("predecessor").alias("uid")).agg(F.count("*").alias("out_degree"))
    keys = [*by, "uid"]
    return nodes.select(*keys).join(ins, keys, "left").join(outs, keys, "left").na.fill(0, ["in_degree", "out_degree"])


def terminals(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    return nodes.select(*by, "uid").join(edges.select(*by, F.col("predecessor").alias("uid")), [*by, "uid"], "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges that name an undeclared element."""
    known = nodes.select(*by, "uid")
    return edges.join(known.withColumnRenamed("uid", "predecessor"), [*by, "predecessor"], "left_anti").unionByName(edges.join(known.withColumnRenamed("uid", "successor"), [*by, "successor"], "left_anti")).distinct()


def consolidation_groups(edges: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """Elements with exactly the same consumers: (by…, consumers, members, n)."""
    sets = edges.groupBy(*by, "predecessor").agg(F.concat_ws(",", F.array_sort(F.collect_set("successor"))).alias("consumers"))
    return sets.groupBy(*by, "consumers").agg(F.concat_ws(",", F.array_sort(F.collect_list("predecessor"))).alias("members"), F.count("*").alias("n")).filter(F.col("n") >= least)


# --- frontier loops ------------------------------------------------------------------


def longest_paths(nodes: DataFrame, edges: DataFrame, duration: str = "dur_us") -> DataFrame:
    """(uid, level, finish_us): longest hop count and longest time to the end of each node, one job per level."""
    links = shared_cut(edges.select("predecessor", "successor").distinct())
    every = shared_cut(nodes.select("uid", F.col(duration).alias("dur")))
    waiting = shared_cut(every.join(links.groupBy(F.col("successor").alias("uid")).agg(F.count("*").alias("open")), "uid", "left").select("uid", "dur", F.coalesce("open", F.lit(0)).alias("open"), F.lit(0).cast("long").alias("best")))
    done, level = None, 0
    while True:
        peeled = shared_cut(waiting.filter("open = 0").select("uid", F.lit(level).cast("long").alias("level"), (F.col("best") + F.col("dur")).alias("finish_us")))
        if peeled.limit(1).count() == 0:
            break
        done = peeled if done is None else done.unionByName(peeled)
        news = peeled.join(links, F.col("uid") == F.col("predecessor")).groupBy("successor").agg(F.count("*").alias("n"), F.max("finish_us").alias("f"))
        waiting = shared_cut(waiting.filter("open > 0").join(news, F.col("uid") == F.col("successor"), "left").select("uid", "dur", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.greatest("best", F.coalesce("f", F.lit(0))).alias("best")))
        level += 1
    if waiting.limit(1).count():
        raise CycleError("some nodes wait for each other")
    return done if done is not None else every.select("uid", F.lit(0).cast("long").alias("level"), F.col("dur").alias("finish_us"))


def reach(starts: DataFrame, edges: DataFrame, upward: bool = False) -> DataFrame:
    """(origin, uid): all that each start reaches along the edges, itself excluded; distinct per level."""
    a, b = ("successor", "predecessor") if upward else ("predecessor", "successor")
    links = shared_cut(edges.select(F.col(a).alias("from"), F.col(b).alias("to")).distinct())
    frontier = starts.select(F.col("uid").alias("origin"), "uid").distinct()
    seen = None
    while True:
        step = frontier.join(links, F.col("uid") == F.col("from")).select("origin", F.col("to").alias("uid")).distinct()
        if seen is not None:
            step = step.join(seen, ["origin", "uid"], "left_anti")
        frontier = shared_cut(step)
        if frontier.limit(1).count() == 0:
            return seen if seen is not None else frontier
        seen = frontier if seen is None else shared_cut(seen.unionByName(frontier))


#: Starts of a slice on average, less than a short can number; slices are followed in so many passes at most.
SLICE, PASSES = 61_440, 8
#: Predecessors whose sets are united in one step; with an element that has more of them, sets are united in two.
UNITED = 4096


def reach_sizes(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, n): how many elements each start reaches along the edges, for those that reach any; as ``reach``, counted.

    Starts are numbered in slices. An element has one row a slice, of the numbers of all starts
    that reach it, so no pair has a row of its own; passes over the slices bound what is written at once.
    """
    key = ["uid", "slice"]
    links = shared_cut(edges.select(F.col("predecessor").alias("from"), F.col("successor").alias("uid")).repartition("uid").distinct())
    sources = shared_cut(links.select(F.col("from").alias("uid")).distinct())
    busiest = links.groupBy("uid").count().agg(F.max("count")).first()[0] or 0
    origins = starts.select("uid").distinct()
    n_slices = max(1, -(-origins.count() // SLICE))
    place = F.row_number().over(Window.partitionBy("slice").orderBy("uid")) - 32_769
    numbers = shared_cut(origins.withColumn("slice", F.pmod(F.xxhash64("uid"), F.lit(n_slices)).cast("int")).withColumn("no", place.cast("short")))
    passes, counts = min(n_slices, PASSES), []
    for i in range(passes):
        frontier, seen = numbers.filter(F.col("slice") % passes == i).select(F.col("uid").alias("from"), "slice", F.array("no").alias("nos")), []
        while True:
            step = frontier.join(links, "from").select(*key, "nos", F.pmod(F.xxhash64("from"), F.lit(busiest // UNITED + 1)).alias("salt"))
            for by in ([*key, "salt"], key) if busiest > UNITED else (key,):
                step = step.groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_list("nos"))).alias("nos"))
            step = shared_cut(step)
            if seen:
                before = reduce(DataFrame.unionByName, seen)
                again = shared_cut(step.select(*key).join(before.select(*key).distinct(), key))
                if not again.isEmpty():
                    held = before.join(again, key).groupBy(*key).agg(F.flatten(F.collect_list("nos")).alias("held"))
                    news = F.when(F.col("held").isNull(), F.col("nos")).otherwise(F.array_except("nos", "held"))
                    step = shared_cut(step.join(held, key, "left").withColumn("nos", news).drop("held").filter("size(nos) > 0"))
            counts.append(shared_cut(step.select("slice", F.explode("nos").alias("no")).groupBy("slice", "no").count()))
            if step.select("uid").join(sources, "uid", "left_semi").isEmpty():
                break
            seen.append(step)
            frontier = step.withColumnRenamed("uid", "from")
        counts = [shared_cut(reduce(DataFrame.unionByName, counts).groupBy("slice", "no").agg(F.sum("count").alias("count")))]
    return counts[0].join(numbers, ["slice", "no"]).select(F.col("uid").alias("origin"), F.col("count").alias("n"))


def rebuild_set(cuts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid): the cuts and all that build edges lead to from them; a cut that is no node is an error."""
    wanted = shared_cut(cuts.select("uid").distinct())
    unknown = [r["uid"] for r in wanted.join(nodes.select("uid"), "uid", "left_anti").limit(5).collect()]
    if unknown:
        raise ValueError(f"not in the graph: {', '.join(map(str, unknown))}")
    below = reach(wanted, edges.filter("dependency_type <> 'runtime'"))
    return wanted.unionByName(below.select("uid")).distinct()


def components(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by…, uid, component): smallest uid that is connected, by label propagation with pointer jumping."""
    by = by or []
    both = shared_cut(edges.select(*by, F.col("predecessor").alias("a"), F.col("successor").alias("b")).unionAll(edges.select(*by, "successor", "predecessor")).distinct())
    labels = shared_cut(both.groupBy(*by, F.col("a").alias("uid")).agg(F.min("b").alias("m")).select(*by, "uid", F.least("uid", "m").alias("component")))
    while True:
        near = both.join(labels.select(*by, F.col("uid").alias("b"), "component"), [*by, "b"]).groupBy(*by, F.col("a").alias("uid")).agg(F.min("component").alias("near"))
        lower = labels.join(near, [*by, "uid"]).select(*by, "uid", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(*by, F.col("uid").alias("component"), F.col("component").alias("next"))
        after = shared_cut(lower.join(jump, [*by, "component"], "left").select(*by, "uid", "old", F.least("component", F.coalesce("next", "component")).alias("component")))
        labels = after.select(*by, "uid", "component")
        if after.filter("old <> component").limit(1).count() == 0:
            return labels


def tree_depths(spark: SparkSession, parents: DataFrame) -> DataFrame:
    """(uid, depth) in a forest given by (uid, parent), roots without a parent; a recursive query."""
    return spark.sql("""WITH RECURSIVE t(uid, depth) AS (
        SELECT uid, 0 FROM {parents} WHERE parent IS NULL
        UNION ALL SELECT p.uid, t.depth + 1 FROM {parents} p JOIN t ON p.parent = t.uid) SELECT * FROM t LIMIT ALL""", parents=parents)


# --- per-run graphs ------------------------------------------------------------------


class Dag:
    """One run's graph with its topological order; edges to undeclared nodes are ignored."""

    def __init__(self, uids: list[str], edges: list[tuple[str, str]]) -> None:
        self.uids, known = sorted(set(uids)), set(uids)
        self.before: dict[str, list[str]] = defaultdict(list)
        self.after: dict[str, list[str]] = defaultdict(list)
        for p, s in sorted(set(edges)):
            if p in known and s in known:
                self.before[s].append(p)
                self.after[p].append(s)
        open_, self.order = {u: len(self.before[u]) for u in self.uids}, []
        ready = [u for u in self.uids if not open_[u]]
        for u in ready:
            self.order.append(u)
            for s in self.after[u]:
                open_[s] -= 1
                if not open_[s]:
                    ready.append(s)
        if len(self.order) != len(self.uids):
            raise CycleError("some elements wait for each other")

    def levels(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for u in self.order:
            out[u] = max((out[p] + 1 for p in self.before[u]), default=0)
        return out

    def finishes(self, work: dict[str, int], head: dict[str, int] | None = None) -> dict[str, int]:
        """Earliest finish of each node; its head may overlap with its predecessors."""
        out: dict[str, int] = {}
        for u in self.order:
            start = (head or {}).get(u, 0)
            out[u] = max([start, *(out[p] for p in self.before[u])]) + work.get(u, 0)
        return out

    def length(self, work: dict[str, int], head: dict[str, int] | None = None) -> int:
        ends = self.finishes(work, head)
        return max((ends[u] for u in self.uids if not self.after[u]), default=0)

    def path(self, work: dict[str, int], head: dict[str, int] | None = None) -> list[str]:
        ends = self.finishes(work, head)
        sinks = [u for u in self.uids if not self.after[u]]
        if not sinks:
            return []
        at, out = min(sinks, key=lambda u: (-ends[u], u)), []
        while True:
            out.append(at)
            if not self.before[at]:
                return out[::-1]
            at = min(self.before[at], key=lambda u: (-ends[u], u))

    def slack(self, work: dict[str, int], total: int) -> dict[str, int]:
        """Latest less earliest start against ``total``."""
        ends, latest = self.finishes(work), {}
        for u in reversed(self.order):
            latest[u] = min((latest[s] - work.get(s, 0) for s in self.after[u]), default=total)
        return {u: latest[u] - ends[u] for u in self.uids}

    def masks(self, up: bool = False) -> dict[str, int]:
        """All ancestors (or descendants) of each node as a bit set over ``uids``."""
        bit, out = {u: 1 << i for i, u in enumerate(self.uids)}, {}
        for u in self.order if up else reversed(self.order):
            out[u] = 0
            for x in self.before[u] if up else self.after[u]:
                out[u] |= out[x] | bit[x]
        return out

    def dominators(self) -> dict[str, int]:
        """Nodes on every path from a root to each node, itself included, as bit sets."""
        bit, out = {u: 1 << i for i, u in enumerate(self.uids)}, {}
        for u in self.order:
            held = -1
            for p in self.before[u]:
                held &= out[p]
            out[u] = (held if self.before[u] else 0) | bit[u]
        return out

    def named(self, mask: int) -> list[str]:
        return [u for i, u in enumerate(self.uids) if mask >> i & 1]


def over_runs(nodes: DataFrame, edges: DataFrame, func, schema: str, durations: tuple[str, ...] = ("dur_us",)) -> DataFrame:
    """``func(Dag, {duration name: {uid: value}})`` of each run; it returns rows without the run id."""
    cols = [c.split()[0] for c in schema.split(",")]

    def one(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        dag = Dag(n["uid"].tolist(), list(zip(e["predecessor"], e["successor"], strict=True)))
        given = {d: dict(zip(n["uid"], n[d].tolist(), strict=True)) for d in durations}
        return pd.DataFrame([(key[0], *row) for row in func(dag, given)], columns=["run_id", *cols])

    return nodes.select("run_id", "uid", *durations).groupBy("run_id").cogroup(edges.select("run_id", "predecessor", "successor").groupBy("run_id")).applyInPandas(one, f"run_id long, {schema}")


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, uid, level, finish_us, slack_us, n_up, n_down, down_us, on_path) of every element."""

    def rows(dag: Dag, given: dict) -> list[tuple]:
        dur = given["dur_us"]
        total, level, ends = dag.length(dur), dag.levels(), dag.finishes(dur)
        slack, up, down, path = dag.slack(dur, total), dag.masks(True), dag.masks(), set(dag.path(dur))
        return [(u, level[u], ends[u], slack[u], up[u].bit_count(), down[u].bit_count(), sum(dur[x] for x in dag.named(down[u])), u in path) for u in dag.uids]

    return over_runs(nodes, edges, rows, "uid string, level long, finish_us long, slack_us long, n_up long, n_down long, down_us long, on_path boolean")


def critical_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, at, uid, length_us): the longest path of each run in order."""

    def rows(dag: Dag, given: dict) -> list[tuple]:
        total = dag.length(given["dur_us"])
        return [(i, u, total) for i, u in enumerate(dag.path(given["dur_us"]))]

    return over_runs(nodes, edges, rows, "at long, uid string, length_us long")


def closure_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return over_runs(nodes, edges, lambda dag, _: [(u, x) for u, m in dag.masks().items() for x in dag.named(m)], "ancestor string, uid string")


def dominator_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return over_runs(nodes, edges, lambda dag, _: [(u, x) for u, m in dag.dominators().items() for x in dag.named(m)], "uid string, dominator string")


def realizable_savings(nodes: DataFrame, edges: DataFrame, top: int = 8) -> DataFrame:
    """How much shorter the longest path gets without each of the ``top`` longest elements on it."""

    def rows(dag: Dag, given: dict) -> list[tuple]:
        dur = given["dur_us"]
        total = dag.length(dur)
        heavy = sorted(dag.path(dur), key=lambda u: (-dur[u], u))[:top]
        return [(u, dur[u], total - dag.length({**dur, u: 0})) for u in heavy]

    return over_runs(nodes, edges, rows, "uid string, dur_us long, saving_us long")


def optimization_horizon(nodes: DataFrame, edges: DataFrame, steps: int = 5) -> DataFrame:
    """Greedy: remove the element of the path that saves most, again and again."""

    def rows(dag: Dag, given: dict) -> list[tuple]:
        dur, out = dict(given["dur_us"]), []
        for step in range(steps):
            total = dag.length(dur)
            saved = [(total - dag.length({**dur, u: 0}), u) for u in dag.path(dur) if dur[u]]
            if not saved:
                break
            best, uid = min(saved, key=lambda x: (-x[0], x[1]))
            dur[uid] = 0
            out.append((step, uid, best, total - best))
        return out

    return over_runs(nodes, edges, rows, "step long, uid string, saving_us long, left_us long")


def joint_saving(nodes: DataFrame, edges: DataFrame, members: int = 3) -> DataFrame:
    """Saving when the longest ``members`` elements of the path all go, beside the sum of their single savings."""

    def rows(dag: Dag, given: dict) -> list[tuple]:
        dur = given["dur_us"]
        total, heavy = dag.length(dur), sorted(dag.path(dur), key=lambda u: (-dur[u], u))[:members]
        single = sum(total - dag.length({**dur, u: 0}) for u in heavy)
        return [(",".join(heavy), total - dag.length({**dur, **dict.fromkeys(heavy, 0)}), single)]

    return over_runs(nodes, edges, rows, "members string, saving_us long, single_us long")


def latent_heavies(nodes: DataFrame, edges: DataFrame, share: float = 0.01, top: int = 5) -> DataFrame:
    """Long elements that are not on the path: at least ``share`` of all time, the ``top`` longest of a run."""

    def rows(dag: Dag, given: dict) -> list[tuple]:
        dur = given["dur_us"]
        off, total = set(dag.uids) - set(dag.path(dur)), sum(dur.values())
        return [(u, dur[u]) for u in sorted(off, key=lambda u: (-dur[u], u)) if dur[u] >= share * total][:top]

    return over_runs(nodes, edges, rows, "uid string, dur_us long")


def sensitivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, uid, slack_us, saving_us, score): what shortening each element can save before another path rules."""

    def rows(dag: Dag, given: dict) -> list[tuple]:
        dur = given["dur_us"]
        total = dag.length(dur)
        slack = dag.slack(dur, total)
        gap = min((s for s in slack.values() if s > 0), default=None)
        save = {u: 0 if slack[u] > 0 else dur[u] if gap is None else min(dur[u], gap) for u in dag.uids}
        return [(u, slack[u], save[u], save[u] / total if total else 0.0) for u in dag.uids]

    return over_runs(nodes, edges, rows, "uid string, slack_us long, saving_us long, score double")


def serial_chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, start, n): from each root, how far a node has only one successor; the longest of each run."""

    def rows(dag: Dag, _: dict) -> list[tuple]:
        best = ("", 0)
        for u in dag.uids:
            if not dag.before[u]:
                n, at = 1, u
                while len(dag.after[at]) == 1:
                    at, n = dag.after[at][0], n + 1
                best = (u, n) if n > best[1] else best
        return [best] if best[1] else []

    return over_runs(nodes, edges, rows, "start string, n long")


def invalidation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, root, n_flooded, flooded_us): changed elements without a changed predecessor, and what they flood.

    ``nodes`` has ``changed`` (0/1) beside its duration; the flood passes changed elements only.
    """

    def rows(dag: Dag, given: dict) -> list[tuple]:
        changed, dur = given["changed"], given["dur_us"]
        out = []
        for u in dag.uids:
            if changed[u] and not any(changed[p] for p in dag.before[u]):
                seen, work = set(), [u]
                while work:
                    for s in dag.after[work.pop()]:
                        if changed[s] and s not in seen:
                            seen.add(s)
                            work.append(s)
                out.append((u, len(seen), dur[u] + sum(dur[s] for s in seen)))
        return out

    return over_runs(nodes, edges, rows, "root string, n_flooded long, flooded_us long", ("dur_us", "changed"))


def independent_batches(nodes: DataFrame, edges: DataFrame, candidates: int = 5) -> DataFrame:
    """The longest elements split first-fit into groups without any path between their members."""

    def rows(dag: Dag, given: dict) -> list[tuple]:
        dur, down, bit = given["dur_us"], dag.masks(), {u: 1 << i for i, u in enumerate(dag.uids)}
        groups: list[list[str]] = []
        for u in sorted(dag.uids, key=lambda u: (-dur[u], u))[:candidates]:
            free = lambda g: all(not (down[u] & bit[x] or down[x] & bit[u]) for x in g)  # noqa: B023, E731
            home = next((g for g in groups if free(g)), None)
            groups.append([u]) if home is None else home.append(u)
        return [(i, ",".join(g)) for i, g in enumerate(groups)]

    return over_runs(nodes, edges, rows, "batch long, members string")
