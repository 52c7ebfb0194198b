"""Registered queries over dependency graphs and scheduling kernels, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import blame as B
from tracewright.operators import graph as G
from tracewright.operators import kernels as K
from tracewright.operators import prep as P
from tracewright.plans.tasks import _TASKS
from tracewright.sources import tables as T
from tracewright.sources.tables import with_frames as frames

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(func):
        QUERIES[func.__name__] = func
        if sql:
            ORACLES[func.__name__] = sql
        return func

    return add


RUN = frames("spans", "run_elements", "run_edges")
TASKS = frames("spans", "run_edges") + _TASKS
SUPPLY = frames("supply_nodes", "supply_edges")
_CLOSURE = """, reach AS (SELECT run_id, predecessor AS ancestor, successor AS uid FROM run_edges
    UNION SELECT r.run_id, r.ancestor, e.successor FROM reach r JOIN run_edges e ON e.run_id = r.run_id AND e.predecessor = r.uid)"""
_FINISH = """, walk AS (SELECT run_id, uid, 0 AS hops, dur_us AS f FROM run_elements
    UNION SELECT w.run_id, e.successor, w.hops + 1, w.f + n.dur_us FROM walk w JOIN run_edges e ON e.run_id = w.run_id AND e.predecessor = w.uid
    JOIN run_elements n ON n.run_id = e.run_id AND n.uid = e.successor)"""
# longest finish by level, where every node sits on its longest hop count
_LEVELS = """, lv(run_id, uid, level) AS (SELECT run_id, uid, 0 FROM run_elements
    UNION SELECT l.run_id, e.successor, l.level + 1 FROM lv l JOIN run_edges e ON e.run_id = l.run_id AND e.predecessor = l.uid),
    level AS (SELECT run_id, uid, max(level) AS level FROM lv GROUP BY 1, 2)"""


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return T.run_elements(spark, d), T.run_edges(spark, d)


@query(SUPPLY + """ SELECT uid, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM supply_nodes
    LEFT JOIN (SELECT successor AS uid, count(*) AS n FROM supply_edges GROUP BY 1) i USING (uid)
    LEFT JOIN (SELECT predecessor AS uid, count(*) AS n FROM supply_edges GROUP BY 1) o USING (uid)""")
def g_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(T.supply_nodes(spark, d), T.supply_edges(spark, d), [])


@query(SUPPLY + " SELECT uid FROM supply_nodes WHERE uid NOT IN (SELECT predecessor FROM supply_edges)")
def g_terminals(spark: SparkSession, d: str) -> DataFrame:
    return G.terminals(T.supply_nodes(spark, d), T.supply_edges(spark, d), [])


@query(SUPPLY + """, b AS (SELECT * FROM supply_edges WHERE dependency_type = 'build'),
    fp AS (SELECT n.uid, n.dur_us + coalesce(max(s.dur_us), 0) AS f, count(s.uid) > 0 AS has FROM supply_nodes n LEFT JOIN b ON b.successor = n.uid AND n.uid LIKE 'p%'
           LEFT JOIN supply_nodes s ON s.uid = b.predecessor WHERE n.uid LIKE 'p%' OR n.uid LIKE 's%' GROUP BY n.uid, n.dur_us),
    fo AS (SELECT n.uid, n.dur_us + coalesce(max(p.f), 0) AS f, count(p.uid) > 0 AS has, max(CASE WHEN p.has THEN 2 WHEN p.uid IS NOT NULL THEN 1 ELSE 0 END) AS lv
           FROM supply_nodes n LEFT JOIN b ON b.successor = n.uid LEFT JOIN fp p ON p.uid = b.predecessor WHERE n.uid LIKE 'o%' GROUP BY n.uid, n.dur_us),
    fc AS (SELECT n.uid, n.dur_us + coalesce(max(o.f), 0) AS f, max(CASE WHEN o.uid IS NULL THEN 0 ELSE o.lv + 1 END) AS lv
           FROM supply_nodes n LEFT JOIN b ON b.successor = n.uid LEFT JOIN fo o ON o.uid = b.predecessor WHERE n.uid LIKE 'c%' GROUP BY n.uid, n.dur_us)
    SELECT uid, CASE WHEN has THEN 1 ELSE 0 END::BIGINT AS level, f AS finish_us FROM fp UNION ALL SELECT uid, lv::BIGINT, f FROM fo UNION ALL SELECT uid, lv::BIGINT, f FROM fc""")
def g_supply_longest_path(spark: SparkSession, d: str) -> DataFrame:
    return G.longest_paths(T.supply_nodes(spark, d), T.supply_edges(spark, d).filter("dependency_type = 'build'"))


@query(SUPPLY + """, sp AS (SELECT predecessor AS s, successor AS p FROM supply_edges WHERE predecessor LIKE 's%'),
    po AS (SELECT DISTINCT s, successor AS o FROM sp JOIN supply_edges ON predecessor = p), oc AS (SELECT DISTINCT s, successor AS c FROM po JOIN supply_edges ON predecessor = o)
    SELECT s AS origin, count(*) AS n FROM (SELECT s, p AS x FROM sp UNION ALL SELECT * FROM po UNION ALL SELECT * FROM oc) GROUP BY 1""")
def g_supply_blast(spark: SparkSession, d: str) -> DataFrame:
    """How much of the wide graph each supplier reaches."""
    starts = T.supply_nodes(spark, d).filter(F.col("uid").startswith("s"))
    return G.reach_sizes(starts, T.supply_edges(spark, d))


@query(SUPPLY + """, b AS (SELECT * FROM supply_edges WHERE dependency_type = 'build'), po AS (SELECT DISTINCT successor AS o FROM b WHERE predecessor = 'p1'), oc AS (SELECT DISTINCT successor AS c FROM po JOIN b ON predecessor = o)
    SELECT 'p1' AS uid UNION ALL SELECT o FROM po UNION ALL SELECT c FROM oc""")
def g_rebuild_set(spark: SparkSession, d: str) -> DataFrame:
    """What a change of one part rebuilds."""
    return G.rebuild_set(spark.range(1).select(F.lit("p1").alias("uid")), T.supply_nodes(spark, d), T.supply_edges(spark, d))


@query(SUPPLY + """, po AS (SELECT DISTINCT predecessor AS p FROM supply_edges WHERE predecessor LIKE 'p%'), sp AS (SELECT DISTINCT predecessor AS s FROM supply_edges WHERE predecessor LIKE 's%'),
    o1 AS (SELECT DISTINCT predecessor AS o FROM supply_edges WHERE successor = 'c1' OR successor = 'c2'),
    x AS (SELECT e.successor AS origin, e.predecessor AS uid FROM supply_edges e WHERE e.successor IN ('c1', 'c2')),
    y AS (SELECT DISTINCT x.origin, e.predecessor AS uid FROM x JOIN supply_edges e ON e.successor = x.uid),
    z AS (SELECT DISTINCT y.origin, e.predecessor AS uid FROM y JOIN supply_edges e ON e.successor = y.uid)
    SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z""")
def g_upstream_targets(spark: SparkSession, d: str) -> DataFrame:
    """All that two targets need."""
    targets = spark.range(1, 3).select(F.concat(F.lit("c"), "id").alias("uid"))
    return G.reach(targets, T.supply_edges(spark, d), upward=True)


@query(frames("supply_edges") + """, g AS (SELECT predecessor, string_agg(DISTINCT successor, ',' ORDER BY successor) AS consumers FROM supply_edges GROUP BY 1)
    SELECT consumers, string_agg(predecessor, ',' ORDER BY predecessor) AS members, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 2""")
def g_consolidation(spark: SparkSession, d: str) -> DataFrame:
    return G.consolidation_groups(T.supply_edges(spark, d), [])


@query("""WITH RECURSIVE e AS (SELECT 'v' || conv_id || '-' || turn AS a, 'v' || conv_id || '-' || (turn + 1) AS b FROM conversations),
    k AS (SELECT e.a, e.b FROM e JOIN (SELECT DISTINCT 'v' || conv_id || '-' || turn AS u FROM conversations) n ON n.u = e.b),
    s AS (SELECT a AS x, b AS y FROM k UNION SELECT b, a FROM k), r AS (SELECT x, x AS y FROM s UNION SELECT r.x, s.y FROM r JOIN s ON r.y = s.x)
    SELECT x AS uid, min(y) AS component FROM r GROUP BY 1""")
def g_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of the turns of conversations, each linked to the next."""
    c = T.read(spark, d, "conversations").select("conv_id", "turn").distinct()
    name = lambda t: F.concat(F.lit("v"), "conv_id", F.lit("-"), t)
    known = c.select(name(F.col("turn")).alias("successor"))
    edges = c.select(name(F.col("turn")).alias("predecessor"), name(F.col("turn") + 1).alias("successor")).join(known, "successor", "left_semi")
    return G.components(edges)


@query("""WITH RECURSIVE t AS (SELECT doc_id, 0 AS depth FROM documents WHERE doc_id = 0 UNION ALL SELECT x.doc_id, t.depth + 1 FROM documents x JOIN t ON x.doc_id // 2 = t.doc_id AND x.doc_id > 0)
    SELECT doc_id AS uid, depth FROM t""")
def g_tree_depth(spark: SparkSession, d: str) -> DataFrame:
    """Depth of every document in the tree of halved ids, by a recursive query."""
    p = T.read(spark, d, "documents").select(F.col("doc_id").alias("uid"), F.when(F.col("doc_id") > 0, F.expr("doc_id div 2")).alias("parent"))
    return G.tree_depths(spark, p)


@query(RUN + _LEVELS + " SELECT run_id, uid, level::BIGINT AS level FROM level")
def g_levels(spark: SparkSession, d: str) -> DataFrame:
    return G.node_metrics(*_run(spark, d)).select("run_id", "uid", "level")


@query(RUN + _LEVELS + " SELECT run_id, level::BIGINT AS level, count(*) AS width, CAST(sum(count(*)) OVER (PARTITION BY run_id ORDER BY level) AS BIGINT) AS so_far FROM level GROUP BY run_id, level")
def g_parallelism_profile(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy("level")
    widths = G.node_metrics(*_run(spark, d)).groupBy("run_id", "level").agg(F.count("*").alias("width"))
    return widths.withColumn("so_far", F.sum("width").over(w))


@query(RUN + _CLOSURE + " SELECT run_id, ancestor, uid FROM reach")
def g_closure(spark: SparkSession, d: str) -> DataFrame:
    return G.closure_pairs(*_run(spark, d))


@query(RUN + _CLOSURE + """ SELECT n.run_id, n.uid, count(r.uid) AS n_down, coalesce(CAST(sum(m.dur_us) AS BIGINT), 0) AS down_us FROM run_elements n
    LEFT JOIN reach r ON r.run_id = n.run_id AND r.ancestor = n.uid LEFT JOIN run_elements m ON m.run_id = r.run_id AND m.uid = r.uid GROUP BY 1, 2""")
def g_blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return G.node_metrics(*_run(spark, d)).select("run_id", "uid", "n_down", "down_us")


@query(RUN + _CLOSURE + """, u AS (SELECT run_id, uid, count(*) AS n FROM reach GROUP BY 1, 2), w AS (SELECT run_id, ancestor AS uid, count(*) AS n FROM reach GROUP BY 1, 2),
    t AS (SELECT run_id, count(*) AS n FROM run_elements GROUP BY 1)
    SELECT e.run_id, e.uid FROM run_elements e LEFT JOIN u USING (run_id, uid) LEFT JOIN w USING (run_id, uid) JOIN t ON t.run_id = e.run_id
    WHERE coalesce(u.n, 0) + coalesce(w.n, 0) = t.n - 1""")
def g_choke_points(spark: SparkSession, d: str) -> DataFrame:
    """Elements that are before or after every other element of their run."""
    from pyspark.sql import Window

    m = G.node_metrics(*_run(spark, d)).withColumn("n", F.count("*").over(Window.partitionBy("run_id")))
    return m.filter("n_up + n_down = n - 1").select("run_id", "uid")


@query(RUN + _CLOSURE + """, roots AS (SELECT run_id, uid FROM run_elements e WHERE NOT EXISTS (SELECT 1 FROM run_edges x WHERE x.run_id = e.run_id AND x.successor = e.uid)),
    -- x dominates u if u cannot be reached from a root once x is gone
    av AS (SELECT x.run_id, x.uid AS gone, r.uid FROM run_elements x JOIN roots r ON r.run_id = x.run_id AND r.uid <> x.uid
           UNION SELECT a.run_id, a.gone, e.successor FROM av a JOIN run_edges e ON e.run_id = a.run_id AND e.predecessor = a.uid AND e.successor <> a.gone)
    SELECT u.run_id, u.uid, x.uid AS dominator FROM run_elements u JOIN run_elements x ON x.run_id = u.run_id
    WHERE x.uid = u.uid OR NOT EXISTS (SELECT 1 FROM av a WHERE a.run_id = u.run_id AND a.gone = x.uid AND a.uid = u.uid)""")
def g_dominators(spark: SparkSession, d: str) -> DataFrame:
    return G.dominator_pairs(*_run(spark, d))


_LONGEST = RUN + _FINISH + """, fin AS (SELECT run_id, uid, max(f) AS finish_us FROM walk GROUP BY 1, 2),
    back AS (SELECT run_id, uid, 0 AS hops, 0::BIGINT AS f FROM run_elements
        UNION SELECT b.run_id, e.predecessor, b.hops + 1, b.f + n.dur_us FROM back b JOIN run_edges e ON e.run_id = b.run_id AND e.successor = b.uid
        JOIN run_elements n ON n.run_id = b.run_id AND n.uid = b.uid),
    tail AS (SELECT run_id, uid, max(f) AS tail_us FROM back GROUP BY 1, 2),
    tot AS (SELECT run_id, max(finish_us) AS total FROM fin GROUP BY 1),
    cpm AS (SELECT fin.run_id, fin.uid, n.dur_us, finish_us, total, total - finish_us - tail_us AS slack_us FROM fin JOIN tail USING (run_id, uid) JOIN tot ON tot.run_id = fin.run_id
        JOIN run_elements n ON n.run_id = fin.run_id AND n.uid = fin.uid)"""


@query(_LONGEST + " SELECT run_id, uid, finish_us, slack_us, slack_us = 0 AS on_path FROM cpm")
def g_weighted_depth(spark: SparkSession, d: str) -> DataFrame:
    """Longest finish time and slack of every element."""
    return G.node_metrics(*_run(spark, d)).select("run_id", "uid", "finish_us", "slack_us", "on_path")


@query(_LONGEST + " SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY finish_us) - 1 AS place, uid, total AS length_us FROM cpm WHERE slack_us = 0")
def g_critical_path(spark: SparkSession, d: str) -> DataFrame:
    return G.critical_paths(*_run(spark, d)).withColumnRenamed("at", "place")


_WITHOUT = _LONGEST + """, tp AS (SELECT run_id, uid, dur_us, total, row_number() OVER (PARTITION BY run_id ORDER BY dur_us DESC, uid) AS nth FROM cpm WHERE slack_us = 0),
    zs(run_id, scenario, uid) AS ({0}), wz AS (SELECT s.run_id, s.scenario, n.uid, 0 AS hops, CASE WHEN z.uid IS NULL THEN n.dur_us ELSE 0 END AS f FROM (SELECT DISTINCT run_id, scenario FROM zs) s JOIN run_elements n ON n.run_id = s.run_id
        LEFT JOIN zs z ON z.run_id = s.run_id AND z.scenario = s.scenario AND z.uid = n.uid
      UNION SELECT w.run_id, w.scenario, e.successor, w.hops + 1, w.f + CASE WHEN z.uid IS NULL THEN n.dur_us ELSE 0 END FROM wz w JOIN run_edges e ON e.run_id = w.run_id AND e.predecessor = w.uid
        JOIN run_elements n ON n.run_id = e.run_id AND n.uid = e.successor LEFT JOIN zs z ON z.run_id = w.run_id AND z.scenario = w.scenario AND z.uid = e.successor),
    lz AS (SELECT run_id, scenario, max(f) AS length FROM wz GROUP BY 1, 2)"""


@query(_WITHOUT.format("SELECT run_id, uid, uid FROM tp WHERE nth <= 8") + " SELECT tp.run_id, uid, dur_us, total - length AS saving_us FROM tp JOIN lz ON lz.run_id = tp.run_id AND scenario = uid WHERE nth <= 8")
def g_realizable(spark: SparkSession, d: str) -> DataFrame:
    return G.realizable_savings(*_run(spark, d))


@query()
def g_horizon_steps(spark: SparkSession, d: str) -> DataFrame:
    return G.optimization_horizon(*_run(spark, d))


@query(_WITHOUT.format("SELECT run_id, uid, uid FROM tp WHERE nth <= 3 UNION ALL SELECT run_id, 'all', uid FROM tp WHERE nth <= 3") + """, mb AS (SELECT run_id, any_value(total) AS total, string_agg(uid, ',' ORDER BY nth) AS members FROM tp WHERE nth <= 3 GROUP BY 1)
    SELECT mb.run_id, members, CAST(max(total - length) FILTER (scenario = 'all') AS BIGINT) AS saving_us, CAST(sum(total - length) FILTER (scenario <> 'all') AS BIGINT) AS single_us FROM mb JOIN lz USING (run_id) GROUP BY 1, 2""")
def g_joint_saving(spark: SparkSession, d: str) -> DataFrame:
    return G.joint_saving(*_run(spark, d))


@query(_LONGEST + """, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY dur_us DESC, uid) AS n FROM cpm WHERE slack_us > 0)
    SELECT o.run_id, o.uid, o.dur_us FROM o JOIN (SELECT run_id, sum(dur_us) AS s FROM run_elements GROUP BY 1) t ON t.run_id = o.run_id WHERE n <= 5 AND dur_us >= 0.01 * s""")
def g_latent_heavies(spark: SparkSession, d: str) -> DataFrame:
    return G.latent_heavies(*_run(spark, d))


@query(_LONGEST + """, m AS (SELECT run_id, min(slack_us) FILTER (slack_us > 0) AS gap FROM cpm GROUP BY 1)
    SELECT c.run_id, uid, slack_us, CASE WHEN slack_us > 0 THEN 0 ELSE least(dur_us, coalesce(gap, dur_us)) END AS saving_us,
    round(CASE WHEN slack_us > 0 THEN 0 ELSE least(dur_us, coalesce(gap, dur_us)) END / total, 9) AS score FROM cpm c JOIN m ON m.run_id = c.run_id""")
def g_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return G.sensitivity(*_run(spark, d)).withColumn("score", F.round("score", 9))


@query()
def g_serial_chain(spark: SparkSession, d: str) -> DataFrame:
    return G.serial_chains(*_run(spark, d))


@query()
def g_batches(spark: SparkSession, d: str) -> DataFrame:
    return G.independent_batches(*_run(spark, d))


_CHANGED = "SELECT *, CASE WHEN CAST(substr(uid, 2) AS BIGINT) % 3 <> 0 THEN 1 ELSE 0 END AS changed FROM run_elements"


@query(RUN + f""", c AS ({_CHANGED}), ce AS (SELECT e.* FROM run_edges e JOIN c p ON p.run_id = e.run_id AND p.uid = e.predecessor AND p.changed = 1
        JOIN c s ON s.run_id = e.run_id AND s.uid = e.successor AND s.changed = 1),
    roots AS (SELECT run_id, uid FROM c WHERE changed = 1 AND NOT EXISTS (SELECT 1 FROM ce WHERE ce.run_id = c.run_id AND ce.successor = c.uid)),
    fl AS (SELECT run_id, uid AS root, uid FROM roots UNION SELECT f.run_id, f.root, ce.successor FROM fl f JOIN ce ON ce.run_id = f.run_id AND ce.predecessor = f.uid)
    SELECT f.run_id, root, count(*) - 1 AS n_flooded, CAST(sum(c.dur_us) AS BIGINT) AS flooded_us FROM fl f JOIN c ON c.run_id = f.run_id AND c.uid = f.uid GROUP BY 1, 2""")
def g_invalidation_roots(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _run(spark, d)
    changed = F.when(F.substring("uid", 2, 20).cast("long") % 3 != 0, 1).otherwise(0)
    return G.invalidation(nodes.withColumn("changed", changed), edges)


@query(RUN + _CLOSURE + """, sinks AS (SELECT run_id, uid, dur_us FROM run_elements e WHERE NOT requested_target AND NOT EXISTS (SELECT 1 FROM run_edges x WHERE x.run_id = e.run_id AND x.predecessor = e.uid))
    SELECT run_id, uid, CASE WHEN dur_us < 1000000 THEN 'medium' ELSE 'high' END AS risk FROM sinks""")
def g_deferrable_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Elements that nothing needs and nobody asked for."""
    nodes, edges = _run(spark, d)
    leaves = G.terminals(nodes, edges, ["run_id"]).join(nodes, ["run_id", "uid"]).filter("NOT requested_target")
    return leaves.select("run_id", "uid", F.when(F.col("dur_us") < 1_000_000, "medium").otherwise("high").alias("risk"))


_CAPACITY = {"PROCESS": 4, "DOWNLOAD": 2, "OTHER": 2}
_BOUNDS = _LONGEST + """, wk AS (SELECT run_id, resource, sum({0}) AS work FROM spans GROUP BY 1, 2), nd AS (SELECT run_id, resource, ceil(work / CASE resource WHEN 'PROCESS' THEN 4 ELSE 2 END) AS need FROM wk),
    pr AS (SELECT run_id, max(need) AS need, arg_min(resource, (-need, resource)) AS tightest, sum(need) AS every FROM nd GROUP BY 1)"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return K.path_lengths(*_run(spark, d))


@query(_BOUNDS.format("dur_us") + """ SELECT run_id, CAST(greatest(total, need) AS BIGINT) AS lower_us, CAST(total + every AS BIGINT) AS upper_us, CASE WHEN need > total THEN tightest END AS bound_by FROM tot JOIN pr USING (run_id)""")
def k_makespan_bounds(spark: SparkSession, d: str) -> DataFrame:
    return K.makespan_bounds(_paths(spark, d), K.resource_work(T.spans(spark, d)), _CAPACITY)


@query(_BOUNDS.format("dur_us") + """, s AS (SELECT run_id, c AS capacity, CAST(greatest(total, ceil(work / c)) AS BIGINT) AS lower_us FROM tot JOIN wk USING (run_id), range(1, 9) r(c) WHERE resource = 'PROCESS'),
    g AS (SELECT *, lag(lower_us) OVER w AS b FROM s WINDOW w AS (PARTITION BY run_id ORDER BY capacity)), i AS (SELECT *, (b - lower_us) / b AS improvement FROM g)
    SELECT run_id, capacity, lower_us, round(improvement, 9) AS improvement, capacity = coalesce(max(capacity) FILTER (improvement >= 0.05) OVER (PARTITION BY run_id), 1) AS is_knee FROM i""")
def k_sweep(spark: SparkSession, d: str) -> DataFrame:
    return K.capacity_sweep(_paths(spark, d), K.resource_work(T.spans(spark, d)), "PROCESS", 1, 8).withColumn("improvement", F.round("improvement", 9))


@query(_LONGEST + " SELECT tot.run_id, total AS as_is_us, x.longest AS without_us FROM tot JOIN (SELECT run_id, max(dur_us) AS longest FROM run_elements GROUP BY 1) x ON x.run_id = tot.run_id")
def k_without_edges(spark: SparkSession, d: str) -> DataFrame:
    """Longest path of each run as it is, and when no element waits for another one."""
    nodes, edges = _run(spark, d)
    without = K.path_lengths(nodes, edges.filter(F.lit(False)))
    return K.path_lengths(nodes, edges).withColumnRenamed("path_us", "as_is_us").join(without.withColumnRenamed("path_us", "without_us"), "run_id")


@query(RUN + """, hf AS (SELECT run_id, uid, dur_us // 2 AS d FROM run_elements), wh AS (SELECT run_id, uid, 0 AS hops, d AS f FROM hf
        UNION SELECT w.run_id, e.successor, w.hops + 1, w.f + n.d FROM wh w JOIN run_edges e ON e.run_id = w.run_id AND e.predecessor = w.uid JOIN hf n ON n.run_id = e.run_id AND n.uid = e.successor)
    SELECT run_id, max(f) AS path_us FROM wh GROUP BY 1""")
def k_reduced_durations(spark: SparkSession, d: str) -> DataFrame:
    """Longest path of each run with all elements at half their time."""
    nodes, edges = _run(spark, d)
    return K.path_lengths(nodes.withColumn("dur_us", F.expr("dur_us div 2")), edges)


_CHAIN = TASKS + """, ex AS (SELECT run_id, task_key, pred_key, 'dep' AS bywhat FROM (SELECT b.run_id, b.task_key, f.task_key AS pred_key FROM tasks b JOIN tasks f USING (run_id, element_uid) WHERE b.task_kind = 'BUILD' AND f.task_kind = 'FETCH'
        UNION ALL SELECT b.run_id, b.task_key, d.build_key FROM tasks b JOIN run_edges e ON e.run_id = b.run_id AND e.successor = b.element_uid JOIN done d ON d.run_id = e.run_id AND d.uid = e.predecessor WHERE b.task_kind = 'BUILD' AND e.dependency_type <> 'runtime')
    UNION ALL SELECT a.run_id, a.task_key, arg_max(b.task_key, (CASE b.task_kind WHEN 'TRACK' THEN 0 WHEN 'BUILD' THEN 2 ELSE 1 END, b.finish_us, b.task_key)), 'intra' FROM tasks a JOIN tasks b ON a.run_id = b.run_id AND a.element_uid = b.element_uid AND a.attempt = b.attempt
        AND CASE b.task_kind WHEN 'TRACK' THEN 0 WHEN 'PULL' THEN 1 WHEN 'FETCH' THEN 1 WHEN 'BUILD' THEN 2 END < CASE a.task_kind WHEN 'TRACK' THEN 0 WHEN 'PULL' THEN 1 WHEN 'FETCH' THEN 1 WHEN 'BUILD' THEN 2 END GROUP BY 1, 2
    UNION ALL SELECT run_id, task_key, p, 'retry' FROM (SELECT run_id, task_key, lag(task_key) OVER (PARTITION BY run_id, element_uid, task_kind ORDER BY attempt) AS p FROM tasks) WHERE p IS NOT NULL),
    mt AS (SELECT x.run_id, x.task_key, x.pred_key, x.bywhat, p.finish_us AS pf, t.start_us FROM ex x JOIN tasks p ON p.run_id = x.run_id AND p.task_key = x.pred_key JOIN tasks t ON t.run_id = x.run_id AND t.task_key = x.task_key),
    pe AS (SELECT run_id, task_key, arg_min(pred_key, (-pf, pred_key)) FILTER (pf <= start_us) AS pred_key, max(pf) FILTER (pf <= start_us) AS last_us, max(pf) FILTER (bywhat = 'intra') AS intra_us, max(pf) FILTER (bywhat = 'retry') AS retry_us FROM mt GROUP BY 1, 2),
    pt AS (SELECT t.run_id, t.task_key, t.start_us, t.finish_us, t.resource, pe.pred_key, retry_us IS NOT NULL AS is_retry, last_us, retry_us, greatest(ready_us, coalesce(intra_us, ready_us)) AS ready FROM ready_tasks t LEFT JOIN pe USING (run_id, task_key)),
    bl AS (SELECT *, greatest(CASE WHEN retry_us IS NULL THEN ready WHEN ready < start_us THEN greatest(ready, retry_us) ELSE retry_us END, coalesce(last_us, -9e18::BIGINT)) AS gap_us FROM pt),
    ch AS (SELECT run_id, arg_min(task_key, (-finish_us, task_key)) AS task_key FROM tasks GROUP BY 1 UNION SELECT c.run_id, b.pred_key FROM ch c JOIN bl b ON b.run_id = c.run_id AND b.task_key = c.task_key WHERE b.pred_key IS NOT NULL),
    oc AS (SELECT b.* FROM ch JOIN bl b ON b.run_id = ch.run_id AND b.task_key = ch.task_key),
    gp AS (SELECT run_id, task_key, gap_us AS g0, start_us AS g1, resource, is_retry, CASE resource WHEN 'PROCESS' THEN {0} WHEN 'DOWNLOAD' THEN {1} END AS cap FROM oc WHERE gap_us < start_us),
    -- every stretch between two changes of anything in a wait, with its holders and all that runs
    pn AS (SELECT run_id, task_key, g0 AS t FROM gp UNION SELECT run_id, task_key, g1 FROM gp UNION SELECT g.run_id, g.task_key, u.t FROM gp g JOIN (SELECT run_id, start_us AS t FROM tasks UNION SELECT run_id, finish_us FROM tasks) u ON u.run_id = g.run_id AND u.t > g.g0 AND u.t < g.g1),
    sg AS (SELECT run_id, task_key, t AS a, lead(t) OVER (PARTITION BY run_id, task_key ORDER BY t) AS z FROM pn),
    ct AS (SELECT s.run_id, s.task_key, s.a, s.z, g.is_retry, count(o.task_key) AS running, coalesce(count(o.task_key) FILTER (o.resource = g.resource) >= g.cap, false) AS fullup
           FROM sg s JOIN gp g ON g.run_id = s.run_id AND g.task_key = s.task_key LEFT JOIN tasks o ON o.run_id = s.run_id AND o.task_key <> s.task_key AND o.start_us <= s.a AND o.finish_us >= s.z AND o.finish_us > o.start_us WHERE s.z IS NOT NULL GROUP BY s.run_id, s.task_key, s.a, s.z, g.is_retry, g.cap),
    sr AS (SELECT *, CASE WHEN fullup = lag(fullup) OVER w THEN 0 ELSE 1 END AS turn FROM ct WINDOW w AS (PARTITION BY run_id, task_key ORDER BY a)),
    st AS (SELECT *, sum(turn) OVER (PARTITION BY run_id, task_key ORDER BY a) AS nth FROM sr),
    ag AS (SELECT run_id, task_key, nth, any_value(is_retry) AS is_retry, any_value(fullup) AS fullup, sum(z - a) AS us, min(running) < {2} AS room FROM st GROUP BY 1, 2, 3),
    nm AS (SELECT *, bool_or(NOT fullup AND NOT room) OVER (PARTITION BY run_id, task_key ORDER BY nth) AS lost FROM ag),
    wt AS (SELECT run_id, task_key, CASE WHEN lost THEN CASE WHEN is_retry THEN 'RETRY_WAIT' ELSE 'DEPENDENCY_WAIT' END WHEN fullup THEN 'RESOURCE_WAIT' ELSE 'SCHEDULER_WAIT' END AS category, us FROM nm
           UNION ALL SELECT run_id, task_key, 'EXECUTION_ON_CHAIN', finish_us - start_us FROM oc WHERE finish_us > start_us)"""


def _blame(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tasks, edges = G.shared_cut(P.quantised(T.spans(spark, d))), G.shared_cut(T.run_edges(spark, d))  # each is read several times
    return P.ready_times(tasks, edges), P.task_dependencies(tasks, edges)


@query(_CHAIN.format(2, 1, 3) + """, su AS (SELECT run_id, category, CAST(sum(us) AS BIGINT) AS dur_us FROM wt GROUP BY 1, 2), hz AS (SELECT run_id, max(finish_us) - min(start_us) AS h FROM tasks GROUP BY 1)
    SELECT * FROM su UNION ALL SELECT hz.run_id, 'IDLE', CAST(h - s AS BIGINT) FROM hz JOIN (SELECT run_id, sum(dur_us) AS s FROM su GROUP BY 1) x ON x.run_id = hz.run_id WHERE h > s""")
def k_blame(spark: SparkSession, d: str) -> DataFrame:
    """Where the time of each run went."""
    return B.attribution(*_blame(spark, d), {"PROCESS": 2, "DOWNLOAD": 1}, 3)


@query(_CHAIN.format(1, 1, 2) + " SELECT run_id, task_key, category, CAST(sum(us) AS BIGINT) AS dur_us FROM wt GROUP BY 1, 2, 3")
def k_chain_waits(spark: SparkSession, d: str) -> DataFrame:
    """Execution and waits of each task on the chain of its run, with scarcer slots."""
    return B.chain_waits(*_blame(spark, d), {"PROCESS": 1, "DOWNLOAD": 1}, 2)


@query(TASKS + " SELECT run_id, max(finish_us) - min(start_us) AS horizon_us, max(finish_us) - min(start_us) AS attributed_us, 0::BIGINT AS gap_us FROM tasks GROUP BY 1")
def k_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Categories of each run add up to its horizon."""
    tasks, deps = _blame(spark, d)
    return B.reconciliation(B.attribution(tasks, deps, {"PROCESS": 2, "DOWNLOAD": 1}, 3), tasks)


@query()
def k_montecarlo(spark: SparkSession, d: str) -> DataFrame:
    return K.criticality(*_run(spark, d))
